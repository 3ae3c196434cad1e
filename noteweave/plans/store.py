"""The objects that queries run over, and queries compiled to plans over them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.common import shelve
from noteweave.functions.interpreter import OWN, Evaluator, add_own
from noteweave.functions.literals import Link, loads, normal_header, truthy
from noteweave.plans import ast as A
from noteweave.plans import variants
from noteweave.plans.expressions import VARIANT, Compiler, NotStatic, Val, compared, constant, of_type, sortable
from noteweave.plans.parser import parse_query

_LINKS = "array<struct<path:string,type:string,subpath:string>>"


@dataclass(frozen=True)
class Field:
    """A field of objects: its column and the types that have it; None: the objects where it isn't null."""

    column: str
    types: frozenset[str] | None = None


@dataclass
class ObjectStore:
    """Objects as one DataFrame, with the relations between them.

    ``objects`` has id, typename, types array<string>, and where there are any: parent_id, file, folder,
    tags array<string>, link_key (the text by which links name the object), title, block_id, revision, and
    a column per field of ``fields`` (by name; names with ``$`` are case-sensitive, others are kept in lower
    case). ``json_fields`` may name a map<string,string> column with fields as JSON by lower-case key.
    ``closure()`` gives (id, ancestor) pairs, ``links`` (src_id, dst_key): an object and the text of a link it
    holds, and ``resolved()`` (src_id, dst_id): the objects that its links lead to. ``resolve`` adds dst_id to rows
    of path, type, subpath and, where links may be relative, the folder they are read from; rows that lead nowhere
    fall away. Without it a link's path is the ``link_key``.

    Faster ways, where a store has them: ``ancestors`` and ``descendants`` give the objects above and below those of
    a source (id, typename), with them if ``inclusive``, instead of ``closure()``; ``by_id`` is the filter of one id;
    ``link_keys`` gives the dst_key of ids; ``linked_types`` are all types that have links or are their targets.
    """

    objects: DataFrame
    fields: dict[str, Field] = field(default_factory=dict)
    closure: Callable[[], DataFrame] | None = None
    links: DataFrame | None = None
    resolved: Callable[[], DataFrame] | None = None
    json_fields: str | None = None
    resolve: Callable[[DataFrame], DataFrame] | None = None
    ancestors: Callable[[DataFrame, bool], DataFrame] | None = None
    descendants: Callable[[DataFrame, bool], DataFrame] | None = None
    by_id: Callable[[str], Column] | None = None
    link_keys: Callable[[DataFrame], DataFrame] | None = None
    linked_types: frozenset[str] | None = None

    def field(self, name: str) -> Field | None:
        return self.fields.get(name) or self.fields.get(name.lower() if not name.startswith("$") else name)

    def value(self, name: str) -> Val | None:
        if name == "$row":
            raise NotStatic("the whole row")
        f = self.field(name)
        if f:
            return of_type(F.col(f.column), self.objects.schema[f.column].dataType)
        if self.json_fields and not name.startswith("$"):
            return Val(F.try_element_at(self.json_fields, F.lit(name.lower())), VARIANT)
        return None

    def present(self, name: str) -> Column:
        """Whether an object has the field, be it null."""
        if name == "$parent":
            return F.col("parent_id").isNotNull()
        f = self.field(name)
        here = F.lit(False)
        if f and f.types is not None:
            here = F.col("typename").isin(*sorted(f.types))
        elif f:
            here = F.col(f.column).isNotNull()
        if self.json_fields and not name.startswith("$"):
            here = here | F.coalesce(F.map_contains_key(self.json_fields, F.lit(name.lower())), F.lit(False))
        return here

    def as_json(self, names: set[str] | None) -> Column:
        """map<string,string>: the fields of an object as JSON by name; ``names`` None: all of them. Fields that are null
        fall away; own fields go before those of columns, as they do in ``value``."""
        fixed = {}
        for n in sorted(self.fields if names is None else names):
            if self.field(n):
                try:
                    fixed[n] = self.value(n)
                except NotStatic:  # of a type that the language doesn't have
                    continue
        pairs = [F.struct(F.lit(n).alias("key"), variants.to_json(v).alias("value")) for n, v in fixed.items()]
        columns = F.filter(F.array(*pairs), lambda e: e["value"].isNotNull()) if pairs else F.lit(None)
        parts = [columns] if pairs else []
        if self.json_fields:
            lower = None if names is None else sorted({n.lower() for n in names} - set(fixed))
            if lower is None or lower:
                parts.append(F.filter(F.map_entries(self.json_fields), lambda e: ~e["key"].isin(*fixed) if lower is None else e["key"].isin(*lower)))
        if not parts:
            return F.create_map().cast("map<string,string>")
        entries = F.array_compact(F.flatten(F.array(*(F.coalesce(p, F.array().cast("array<struct<key:string,value:string>>")) for p in parts))))
        return F.map_from_entries(entries)

    def find(self, link: Link, folder: str | None = None) -> str | None:
        """The id of the object that a link leads to, read from a file in ``folder``: by path from there, by path, by
        either and ``.md``, or by a file name that only one file has. None if there is none."""
        o = self.objects
        if "file" not in o.columns or self.resolve is None:
            hit = o.where(self.by_id(link.path) if self.by_id else F.col("link_key") == link.path).select("id").take(1)
        else:
            spark = o.sparkSession
            one = spark.createDataFrame([(link.path, link.type, link.subpath, folder)], "path string, type string, subpath string, folder string")
            hit = self.resolve(one).select("dst_id").take(1)
        return hit[0][0] if hit else None

    def load(self, object_id: str, names: set[str] | None = None) -> dict[str, Any] | None:
        """The fields of one object as Python values."""
        rows = self.objects.where(self.by_id(object_id) if self.by_id else F.col("id") == object_id).select(self.as_json(names).alias("m")).take(1)
        return {k: loads(v) for k, v in rows[0]["m"].items()} if rows else None


def _chains(n: A.Node) -> int:
    """The most indices that follow one another in an expression: no more links are followed in a row."""
    return max(map(_chains, A.children(n)), default=0) + int(isinstance(n, A.Index))


def _followed(link: Val, name: str) -> Val:
    raise NotStatic("a field of what a link leads to")


def _asked(n: A.Node) -> set[str] | None:
    """The names that an expression may ask of what links and parents lead to; None: any."""
    if isinstance(n, A.Var):
        return None if n.name == "$row" else {n.name}
    out: set[str] = set()
    if isinstance(n, A.Index):
        if not isinstance(n.key, A.Lit):
            return None
        out.add(str(n.key.value))
    for c in A.children(n):
        below = _asked(c)
        if below is None:
            return None
        out |= below
    return out


class Planner:
    """Compiles queries over a store. ``this``: fields of the object that asks, as Python values; ``folder``: where its
    file is, which links written in the query are read from. An expression that has no value for an object, such as a sum
    of a text list and a date, doesn't match it; with ``strict`` it fails the query."""

    def __init__(self, store: ObjectStore, this: dict[str, Any] | None = None, *, folder: str | None = None, strict: bool = False):
        self.store, self.this, self.folder, self.strict = store, this, folder, strict
        self._parent: dict[str, str] = {}  # fields of the parent and their columns
        self._rows: list[tuple[str, A.Node, set[str]]] = []  # columns with what interpreted expressions need
        self._targets: dict[Link, str | None] = {}

    # entry points

    def run(self, query: A.Query | str) -> DataFrame:
        """The objects that match, with all columns of the store."""
        q = A.simplify(parse_query(query) if isinstance(query, str) else query)
        return self._select(self.store.objects, q)

    def _walk(self, q: A.Tree) -> Callable[[DataFrame, bool], DataFrame] | None:
        return self.store.descendants if q.down else self.store.ancestors

    def _source(self, q: A.Query) -> DataFrame:
        """id and typename of what ``q`` finds."""
        inner = Planner(self.store, self.this, folder=self.folder, strict=self.strict)
        inner._targets = self._targets
        return inner._select(self.store.objects, q).select("id", "typename")

    def ids(self, q: A.Query) -> DataFrame:
        return self._source(q).select("id")

    # queries

    def _select(self, df: DataFrame, q: A.Query) -> DataFrame:
        columns = df.columns
        parts = list(q.items) if isinstance(q, A.And) else [q]
        walked = next((p for p in parts if isinstance(p, A.Tree) and self._walk(p)), None)
        if walked is not None:  # the tree step gives the objects themselves
            df, parts = self._walk(walked)(self._source(walked.source), walked.inclusive), [p for p in parts if p is not walked]
        local = [p for p in parts if self._is_local(p)]
        joined = []
        for p in local:
            predicate = self._predicate(p)
            if self._parent or self._rows:  # after all that need no join
                joined.append((predicate, self._parent, self._rows))
                self._parent, self._rows = {}, []
            else:
                df = self._where(df, predicate)
        for predicate, self._parent, self._rows in joined:
            df = self._where(df, predicate).select(*columns)
        return self._sets(df, [p for p in parts if p not in local])

    def _sets(self, df: DataFrame, parts: list[A.Query]) -> DataFrame:
        """The rows of ``df`` that are in all sets that tree and link steps find."""
        columns = df.columns
        for i, p in enumerate(parts):
            # a whole conjunct needs no flag: a semi or anti join takes the rows or leaves them
            if isinstance(p, (A.Tree, A.Linked, A.ByLink)):
                if isinstance(p, A.Linked) and self.store.linked_types and not p.inclusive:
                    df = df.where(F.col("typename").isin(*sorted(self.store.linked_types)))
                df = df.join(self._found(p), "id", "left_semi")
            elif isinstance(p, A.NotQ) and isinstance(p.item, (A.Tree, A.Linked, A.ByLink)):
                df = df.join(self._found(p.item), "id", "left_anti")
            else:
                df, predicate = self._flagged(df, p, f"_f{i}")
                df = self._where(df, predicate)
        return df.select(*columns)

    def _where(self, df: DataFrame, predicate: Column) -> DataFrame:
        """The rows that pass, once what the predicate needs of parents and link targets is joined."""
        s = self.store
        if self._parent:
            wanted = [variants.to_json(v).alias(c) if v.kind == VARIANT else v.col.alias(c) for n, c in self._parent.items() for v in [s.value(n)]]
            df = df.join(s.objects.where("id is not null").select(F.col("id").alias("_parent"), *wanted), F.col("parent_id") == F.col("_parent"), "left")
        for name, n, free in self._rows:
            df = self._with_loads(df, name, n, free)
        self._parent, self._rows = {}, []
        return df.where(predicate)

    def _with_loads(self, df: DataFrame, name: str, n: A.Node, free: set[str]) -> DataFrame:
        """``df`` with what the interpreter needs as ``name``: struct<own,up,links>, the fields of the object and of its
        parent as JSON, and the link targets in reach with theirs. Every link is followed by a join of the different
        targets, and once more for each index in a row; objects without links take no part."""
        s = self.store
        asked = _asked(n)
        own = s.as_json(None if "$row" in free else {x for x in free if x not in ("$parent", "this")})
        up = F.lit(None).cast("map<string,string>")
        if "$parent" in free and "parent_id" in df.columns:
            df = df.join(s.objects.where("id is not null").select(F.col("id").alias(f"{name}k"), s.as_json(asked).alias(f"{name}p")), F.col("parent_id") == F.col(f"{name}k"), "left").drop(f"{name}k")
            up = F.col(f"{name}p")
        hops = _chains(n)
        texts = F.concat(F.map_values(own), F.coalesce(F.map_values(up), F.array().cast("array<string>")))
        found = F.array_distinct(F.flatten(F.transform(texts, variants.written_links)))
        df = df.withColumns({f"{name}o": own, f"{name}u": up, f"{name}l": found if hops else F.lit(None).cast(_LINKS)})
        links = F.lit(None).cast("array<struct<link:struct<path:string,type:string,subpath:string>,m:map<string,string>>>")
        if hops:
            folder = F.col("folder") if "folder" in df.columns else F.lit(None).cast("string")
            reach = df.where(F.size(f"{name}l") > 0).select("id", folder.alias("folder"), F.explode(f"{name}l").alias("link"))
            parts = None
            for hop in range(hops):
                reach = shelve(reach.distinct(), "links") if hops > 1 else reach.distinct()
                led = self._led_to(reach.select("folder", "link").distinct(), asked)
                at = reach.alias("r").join(led.alias("l"), (F.col("r.link") == F.col("l.link")) & F.col("r.folder").eqNullSafe(F.col("l.folder"))).select("r.id", "r.link", "l.m", "l.below")
                parts = at.select("id", "link", "m") if parts is None else parts.unionByName(at.select("id", "link", "m"))
                if hop + 1 < hops:
                    reach = at.select("id", F.col("below").alias("folder"), F.explode(F.array_distinct(F.flatten(F.transform(F.map_values("m"), variants.written_links)))).alias("link"))
            gathered = parts.groupBy(F.col("id").alias(f"{name}i")).agg(F.collect_list(F.struct("link", "m")).alias(f"{name}g"))
            df = df.join(gathered, F.col("id") == F.col(f"{name}i"), "left")
            links = F.col(f"{name}g")
        return df.withColumn(name, F.struct(F.col(f"{name}o").alias("own"), F.col(f"{name}u").alias("up"), links.alias("links")))

    def _led_to(self, wanted: DataFrame, asked: set[str] | None) -> DataFrame:
        """folder, link, m, below of links (folder, link): the fields of the target as JSON and the target's own folder."""
        s = self.store
        flat = wanted.select("folder", "link", "link.path", "link.type", "link.subpath")
        keyed = s.resolve(flat) if s.resolve else flat.join(s.objects.where("link_key is not null").select(F.col("link_key").alias("path"), F.col("id").alias("dst_id")), "path")
        below = F.col("folder") if "folder" in s.objects.columns else F.lit(None).cast("string")
        targets = s.objects.select(F.col("id").alias("dst_id"), s.as_json(asked).alias("m"), below.alias("below"))
        return keyed.select("folder", "link", "dst_id").join(targets, "dst_id").select("folder", "link", "m", "below")

    def _is_local(self, q: A.Query) -> bool:
        if isinstance(q, (A.And, A.Or)):
            return all(map(self._is_local, q.items))
        if isinstance(q, A.NotQ):
            return self._is_local(q.item)
        return not isinstance(q, (A.Tree, A.Linked, A.ByLink))

    def _flagged(self, df: DataFrame, q: A.Query, name: str) -> tuple[DataFrame, Column]:
        """``df`` with a flag per set of ids in ``q``, and the predicate over the flags."""
        if self._is_local(q):
            return df, self._predicate(q)
        if isinstance(q, (A.And, A.Or)):
            out = None
            for i, x in enumerate(q.items):
                df, p = self._flagged(df, x, f"{name}_{i}")
                out = p if out is None else out & p if isinstance(q, A.And) else out | p
            return df, out
        if isinstance(q, A.NotQ):
            df, p = self._flagged(df, q.item, name)
            return df, ~p
        flags = self._found(q).distinct().withColumn(name, F.lit(True))
        return df.join(flags, "id", "left"), F.coalesce(name, F.lit(False))

    def _predicate(self, q: A.Query) -> Column:
        """A local query as a filter that is never null."""
        s = self.store
        if isinstance(q, A.Const):
            return F.lit(q.value)
        if isinstance(q, A.ById):
            return s.by_id(q.id) if s.by_id else F.col("id") == q.id
        if isinstance(q, A.ByType):
            return F.array_contains("types", q.name)
        if isinstance(q, A.ByTag):
            tag = q.tag if q.tag.startswith("#") else f"#{q.tag}"
            if q.exact:
                return F.coalesce(F.array_contains("tags", tag), F.lit(False))
            return F.coalesce(F.exists("tags", lambda t: (t == tag) | t.startswith(tag + "/")), F.lit(False))
        if isinstance(q, A.ByPath):
            path = q.path.strip("/")
            if q.exact:
                return F.coalesce((F.col("folder") == path) | (F.col("file") == path), F.lit(False))
            if not path:
                return F.lit(True)
            return F.coalesce((F.col("file") == path) | F.col("file").startswith(path + "/"), F.lit(False))
        if isinstance(q, A.HasField):
            return s.present(q.key)
        if isinstance(q, A.FieldEquals):
            return self._equals(q)
        if isinstance(q, A.Where):
            return self._expression(q.expression)
        if isinstance(q, (A.And, A.Or)):
            out = self._predicate(q.items[0])
            for x in q.items[1:]:
                out = out & self._predicate(x) if isinstance(q, A.And) else out | self._predicate(x)
            return out
        if isinstance(q, A.NotQ):
            return ~self._predicate(q.item)
        raise TypeError(q)

    def _equals(self, q: A.FieldEquals) -> Column:
        v = self.store.value(q.key)
        if v is None:
            return F.lit(False)
        if v.kind == VARIANT:
            try:
                one = F.lit(False)
                for x in q.values:
                    same = variants.is_null(v) if x is None else F.coalesce(compared("=", v, constant(x)), F.lit(False))
                    one = one | same
                return self.store.present(q.key) & one
            except NotStatic:
                return self._expression(A.Call(A.Var("econtains"), (A.Lit(list(q.values)), A.Var(q.key))))
        same = [constant(x) for x in q.values if x is not None and constant(x).kind == v.kind]
        one = F.lit(False)
        if same:
            one = F.coalesce(v.col.isin(*(x.const for x in same)) if v.name in ("string", "boolean", "number") else sortable(v).isin(*(sortable(x) for x in same)), F.lit(False))
        if None in q.values:
            one = one | v.col.isNull()
        return self.store.present(q.key) & one

    def _expression(self, n: A.Node) -> Column:
        free = A.free_variables(n)
        n = self._bound(n)
        held = dict(self._parent)
        try:
            found = Compiler(self._variable, _followed).filter(n)
        except NotStatic:
            self._parent = held
            found = self._dynamic(n)
        names = sorted(free - {"$row", "this"})
        if not names:
            return found
        here = self.store.present(names[0])
        for name in names[1:]:
            here = here | self.store.present(name)
        return here & found

    def _variable(self, name: str) -> Val | None:
        if name == "this":
            return constant(self.this) if self.this else None
        if name == "$parent":
            raise NotStatic("the whole parent")
        if name.startswith("$parent."):
            name = name.split(".", 1)[1]
            v = self.store.value(name)
            if v is None or "parent_id" not in self.store.objects.columns:
                return None
            column = self._parent.setdefault(name, f"_p{len(self._parent)}")
            return Val(F.col(column), v.kind)
        return self.store.value(name)

    def _bound(self, n: A.Node) -> A.Node:
        """``n`` with the fields of links that are written out looked up: one object each, read while planning."""
        if isinstance(n, A.Index):
            value, key = self._bound(n.value), self._bound(n.key)
            if isinstance(value, A.Lit) and isinstance(value.value, Link) and isinstance(key, A.Lit):
                return A.Lit(self._field_of(value.value, str(key.value)))
            if isinstance(value, A.Var) and value.name == "this" and isinstance(key, A.Lit) and isinstance((self.this or {}).get(key.value), Link):
                return A.Lit(self.this[key.value])
            return A.Index(value, key)
        return A.rebuilt(n, self._bound)

    def _field_of(self, link: Link, name: str) -> Any:
        if link not in self._targets:
            self._targets[link] = self.store.find(link, self.folder)
        target = self._targets[link]
        loaded = self.store.load(target, {name}) if target is not None else None
        return next((v for k, v in (loaded or {}).items() if k.lower() == name.lower()), None)

    def _dynamic(self, n: A.Node) -> Column:
        """The truth of an expression whose kinds differ by row, by the interpreter in Arrow batches. The fields of its
        parent and of the objects that its links lead to come with each row."""
        this, own_functions, strict = self.this or {}, dict(OWN), self.strict

        def holds(row):
            add_own(own_functions)
            env = {k: loads(v) for k, v in (row["own"] or {}).items()} | {"this": this}
            if row["up"] is not None:
                env["$parent"] = {k: loads(v) for k, v in row["up"].items()}
            targets = {(x["link"]["path"], x["link"]["type"], x["link"]["subpath"]): x["m"] for x in row["links"] or ()}

            def load(link):
                m = targets.get((link.path, link.type, link.subpath))
                return None if m is None else {k: loads(v) for k, v in m.items()}

            try:
                return truthy(Evaluator(load).evaluate(n, env))
            except Exception:  # noqa: BLE001 - whatever fails has no value
                if strict:
                    raise
                return False

        name = f"_x{len(self._rows)}"
        self._rows.append((name, n, A.free_variables(n)))
        return F.coalesce(F.udf(holds, "boolean", useArrow=True)(F.col(name)), F.lit(False))

    # sets of ids

    def _found(self, q: A.Query) -> DataFrame:
        s = self.store
        if isinstance(q, A.ByLink):
            return self._link_target(q.link)
        if isinstance(q, A.Tree) and self._walk(q):
            return self._walk(q)(self._source(q.source), q.inclusive).select("id")
        source = self.ids(q.source)
        if isinstance(q, A.Tree):
            pairs = s.closure() if s.closure else s.objects.where("false").select("id", F.col("id").alias("ancestor"))
            if q.down:
                found = pairs.join(source.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id")
            else:
                found = pairs.join(source, "id", "left_semi").select(F.col("ancestor").alias("id"))
            return (found.unionByName(source) if q.inclusive else found).distinct()
        return self._linked(source, q)

    def _linked(self, source: DataFrame, q: A.Linked) -> DataFrame:
        """Breadth-first search over at most ``distance`` links, a join and an anti join per hop."""
        if self.store.links is None:
            return source if q.inclusive else source.where("false")
        if q.distance == 1:
            # the sources themselves are left out unless they are asked for
            near = self._step(source, q.direction)
            return near.unionByName(source).distinct() if q.inclusive else near.join(source, "id", "left_anti").distinct()
        source = shelve(source.distinct(), "hop")
        seen, frontier = source, source
        for _ in range(q.distance):
            frontier = shelve(self._step(frontier, q.direction).join(seen, "id", "left_anti").distinct(), "hop")
            if frontier.isEmpty():
                break
            seen = seen.unionByName(frontier)
        return seen if q.inclusive else seen.join(source, "id", "left_anti")

    def _step(self, ids: DataFrame, direction: str) -> DataFrame:
        s, found = self.store, []
        if direction in ("incoming", "both"):
            keys = s.link_keys(ids) if s.link_keys else s.objects.join(ids, "id", "left_semi").where(F.col("link_key").isNotNull()).select(F.col("link_key").alias("dst_key"))
            found.append(s.links.join(keys, "dst_key", "left_semi").select(F.col("src_id").alias("id")))
        if direction in ("outgoing", "both"):
            pairs = s.resolved() if s.resolved else s.links.join(s.objects.select(F.col("id").alias("dst_id"), F.col("link_key").alias("dst_key")), "dst_key").select("src_id", "dst_id")
            found.append(pairs.join(ids.select(F.col("id").alias("src_id")), "src_id", "left_semi").select(F.col("dst_id").alias("id")))
        return found[0] if len(found) == 1 else found[0].unionByName(found[1])

    def _link_target(self, link: Link) -> DataFrame:
        """The object that a link written in a query names; it is looked up while planning."""
        if link not in self._targets:
            self._targets[link] = self.store.find(link, self.folder)
        return self.store.objects.where(F.col("id") == F.lit(self._targets[link])).select("id")
