"""Expressions compiled to Spark columns.

Every value has a static kind, taken from the schema, so that expressions stay inside Catalyst. Lambdas
become higher-order functions. What has no static kind (a list of texts and numbers, say) raises
``NotStatic``; callers then fall back on the interpreter (see ``dynamic``).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from noteweave.common import let
from noteweave.functions.literals import UNIT_MS, UNITS, Duration, Link, type_of
from noteweave.plans import ast as A


class NotStatic(Exception):
    """The expression has no static kind, or uses something only the interpreter has."""


@dataclass(frozen=True)
class Kind:
    name: str
    item: Kind | None = None  # of arrays and maps
    fields: tuple[tuple[str, Kind], ...] | None = None  # of structs

    def __str__(self) -> str:
        return self.name


NULL, BOOLEAN, NUMBER, STRING, DATE, DURATION, LINK = map(Kind, ("null", "boolean", "number", "string", "date", "duration", "link"))
#: Of no fixed kind: a JSON text, see ``variants``.
VARIANT = Kind("variant")
LINK_FIELDS = ["path", "type", "subpath", "display", "embed"]


def array_of(item: Kind) -> Kind:
    return Kind("array", item)


def kind_of_type(t: T.DataType) -> Kind:
    """The kind of values that a column of type ``t`` holds."""
    if isinstance(t, T.NullType):
        return NULL
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, T.NumericType):
        return NUMBER
    if isinstance(t, T.StringType):
        return STRING
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DATE
    if isinstance(t, T.ArrayType):
        return array_of(kind_of_type(t.elementType))
    if isinstance(t, T.MapType):
        return Kind("object", kind_of_type(t.valueType))
    if isinstance(t, T.StructType):
        if t.names == LINK_FIELDS:
            return LINK
        if t.names == UNITS:
            return DURATION
        return Kind("object", None, tuple((f.name, kind_of_type(f.dataType)) for f in t.fields))
    raise NotStatic(f"no values of {t.simpleString()}")


@dataclass(frozen=True)
class Val:
    """A column, or a row-independent one, and its kind."""

    col: Column
    kind: Kind
    const: Any = None  # the value of a literal

    @property
    def name(self) -> str:
        return self.kind.name


@dataclass(frozen=True)
class Fn:
    """A lambda with the names it was made among."""

    params: tuple[str, ...]
    body: A.Node
    env: dict[str, Any]
    compiler: Compiler

    def __call__(self, *args: Val) -> Val:
        return self.compiler.value(self.body, {**self.env, **dict(zip(self.params, args))})


def of_type(c: Column, t: T.DataType) -> Val:
    kind = kind_of_type(t)
    if kind == NUMBER and not isinstance(t, T.DoubleType):
        c = c.cast("double")
    if isinstance(t, (T.DateType, T.TimestampNTZType)):
        c = c.cast("timestamp")
    if isinstance(t, T.ArrayType) and kind.item == NUMBER and not isinstance(t.elementType, T.DoubleType):
        c = c.cast("array<double>")
    return Val(c, kind)


def number(c: Column) -> Val:
    return Val(c.cast("double"), NUMBER)


def string(c: Column) -> Val:
    return Val(c, STRING)


def boolean(c: Column) -> Val:
    return Val(c, BOOLEAN)


def null() -> Val:
    return Val(F.lit(None), NULL)


def constant(v: Any) -> Val:
    kind = type_of(v)
    if kind == "null":
        return null()
    if kind == "boolean":
        return Val(F.lit(v), BOOLEAN, v)
    if kind == "number":
        return Val(F.lit(float(v)), NUMBER, float(v))
    if kind == "string":
        return Val(F.lit(v), STRING, v)
    if kind == "date":
        at = v if v.tzinfo else v.replace(tzinfo=dt.timezone.utc)
        return Val(F.timestamp_micros(F.lit(round(at.timestamp() * 1_000_000))), DATE, v)
    if kind == "duration":
        return Val(F.struct(*(F.lit(float(getattr(v, u))).alias(u) for u in UNITS)), DURATION, v)
    if kind == "link":
        return Val(F.struct(*(F.lit(getattr(v, f)).cast("boolean" if f == "embed" else "string").alias(f) for f in LINK_FIELDS)), LINK, v)
    if kind == "array":
        return list_of([constant(x) for x in v])
    return object_of([(k, constant(x)) for k, x in v.items()])


def list_of(items: list[Val]) -> Val:
    if any(v.kind == VARIANT for v in items):
        raise NotStatic("a list of no fixed kind")
    kinds = {v.kind for v in items if v.kind != NULL}
    if len(kinds) > 1:
        raise NotStatic("a list of several kinds")
    if not kinds:
        return Val(F.array(*(v.col.cast("string") for v in items)).cast("array<string>"), array_of(NULL if not items else STRING))
    return Val(F.array(*(v.col for v in items)), array_of(kinds.pop()))


def object_of(items: list[tuple[str, Val]]) -> Val:
    last = dict(items)
    if not last or any(v.kind == VARIANT for v in last.values()):
        raise NotStatic("an object that is empty or of no fixed kind")
    return Val(F.struct(*((v.col if v.kind != NULL else v.col.cast("string")).alias(k) for k, v in last.items())), Kind("object", None, tuple((k, v.kind if v.kind != NULL else STRING) for k, v in last.items())))


# truth, order and text


def truth(v: Val) -> Column:
    """Whether the value counts as true; never null."""
    c = v.col
    if v.kind == VARIANT:
        from noteweave.plans import variants

        return variants.truth(c)
    by = {
        "null": lambda: F.lit(False), "boolean": lambda: c, "number": lambda: (c != 0) | F.isnan(c), "string": lambda: c != "", "date": lambda: F.unix_millis(c) != 0,
        "duration": lambda: duration_ms(c) != 0, "link": lambda: c["path"] != "", "array": lambda: F.size(c) > 0, "object": lambda: c.isNotNull() if v.kind.fields else F.size(c) > 0,
    }[v.name]()
    return F.coalesce(by, F.lit(False))


def duration_ms(c: Column) -> Column:
    return sum((c[u] * float(UNIT_MS[u]) for u in UNITS[1:]), c[UNITS[0]] * float(UNIT_MS[UNITS[0]]))


def sortable(v: Val) -> Column:
    """What Spark orders and groups as the language orders the values of one kind."""
    c = v.col
    if v.name == "duration":
        return duration_ms(c)
    if v.name == "link":
        return F.when(c.isNotNull(), F.struct(c["path"], c["type"], c["subpath"].isNotNull(), F.coalesce(c["subpath"], F.lit(""))))
    if v.name == "array" and v.kind.item and v.kind.item.name in ("duration", "link"):
        return F.transform(c, lambda x: sortable(Val(x, v.kind.item)))
    if v.name == "object" and v.kind.fields:
        return F.when(c.isNotNull(), F.struct(*(sortable(Val(c[k], kind)).alias(k) for k, kind in sorted(v.kind.fields))))
    if v.name == "object":
        return F.array_sort(F.map_entries(c))
    return c


def _ordered(v: Val) -> Column:
    return F.collate(v.col, "UNICODE") if v.name == "string" else sortable(v)


def compared(op: str, a: Val, b: Val) -> Column:
    """``a op b`` in the total order, null only where both are null."""
    if VARIANT in (a.kind, b.kind):
        from noteweave.plans import variants

        return variants.compared(op, a, b)
    if a.kind == NULL and b.kind == NULL:
        return F.lit(None).cast("boolean")
    if a.name != b.name and NULL not in (a.kind, b.kind):
        c = (a.name > b.name) - (a.name < b.name)
        plain = F.lit({"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0, "=": c == 0, "!=": c != 0}[op])
    elif NULL in (a.kind, b.kind):
        plain = F.lit(None).cast("boolean")
    else:
        x, y = (sortable(a), sortable(b)) if op in ("=", "!=") else (_ordered(a), _ordered(b))
        plain = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y, "=": x == y, "!=": x != y}[op]
    left, right = a.col.isNull(), b.col.isNull()
    if a.const is not None:
        left = F.lit(False)
    if b.const is not None:
        right = F.lit(False)
    return F.when(left & right, F.lit(None).cast("boolean")).when(left, F.lit(op in ("<", "<=", "!="))).when(right, F.lit(op in (">", ">=", "!="))).otherwise(plain)


def pushable(op: str, a: Val, b: Val) -> Column | None:
    """A filter equal to the truth of ``a op b`` that a scan can take, where one side is a constant."""
    if a.const is not None and b.const is None:
        return pushable({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
    if b.const is None or a.name != b.name or a.name not in ("number", "string", "date", "boolean"):
        return None
    if a.name == "string" and op not in ("=", "!="):
        return None
    c, k = a.col, b.col
    if op == "=":
        return F.coalesce(c == k, F.lit(False)) if a.name == "boolean" else c.isNotNull() & (c == k)
    plain = {"<": c < k, "<=": c <= k, ">": c > k, ">=": c >= k, "!=": c != k}[op]
    return plain | c.isNull() if op in ("<", "<=", "!=") else c.isNotNull() & plain


def text(v: Val, inner: bool = False) -> Column:
    """The text of a value as it is joined to other text; never null."""
    c = v.col
    if v.name == "null":
        return F.lit("-")
    if v.name == "number":
        whole = (c == F.floor(c)) & (F.abs(c) < 1e18)
        shown = F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))
    elif v.name == "date":
        midnight = (F.hour(c) == 0) & (F.minute(c) == 0) & (F.second(c) == 0)
        shown = F.when(midnight, F.date_format(c, "MMMM dd, yyyy")).otherwise(F.date_format(c, "h:mm a - MMMM dd, yyyy"))
    elif v.name == "duration":
        parts = [F.when(c[u] != 0, F.concat(text(Val(c[u], NUMBER)), F.lit(" "), F.when(c[u] == 1, u[:-1]).otherwise(u))) for u in UNITS]
        shown = F.coalesce(F.nullif(F.concat_ws(", ", *parts), F.lit("")), F.when(c.isNotNull(), "0 seconds"))
    elif v.name == "link":
        shown = link_markdown(c)
    elif v.name == "array":
        joined = F.array_join(F.transform(c, lambda x: text(Val(x, v.kind.item), True)), ", ")
        shown = F.concat(F.lit("["), joined, F.lit("]")) if inner else joined
    elif v.name == "object" and v.kind.fields:
        shown = F.when(c.isNotNull(), F.concat(F.lit("{ "), F.concat_ws(", ", *(F.concat(F.lit(f"{k}: "), text(Val(c[k], kind), True)) for k, kind in v.kind.fields)), F.lit(" }")))
    elif v.name == "object":
        shown = F.concat(F.lit("{ "), F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit(": "), text(Val(e["value"], v.kind.item), True))), ", "), F.lit(" }"))
    else:
        shown = c.cast("string")
    return F.coalesce(shown, F.lit("-"))


def link_markdown(c: Column) -> Column:
    target = F.concat(c["path"], F.when(c["type"] == "block", F.concat(F.lit("#^"), c["subpath"])).when(c["type"] == "header", F.concat(F.lit("#"), c["subpath"])).otherwise(""))
    title = F.regexp_replace(F.substring_index(c["path"], "/", -1), r"\.md$", "")
    shown = F.coalesce(c["display"], F.concat(title, F.coalesce(F.concat(F.lit(" > "), c["subpath"]), F.lit(""))))
    return F.concat(F.when(c["embed"], "!").otherwise(""), F.lit("[["), target, F.lit("|"), shown, F.lit("]]"))


# operators


def divided(a: Column, b: Column) -> Column:
    nan, inf = F.lit(float("nan")), F.lit(float("inf"))
    return F.when(b != 0, a / b).when(b.isNull() | a.isNull(), F.lit(None)).when((a == 0) | F.isnan(a), nan).when(a > 0, inf).otherwise(-inf)


def normal_duration(parts: dict[str, Column]) -> Column:
    """A duration with months below 12 and every unit from days on below the next larger one."""
    months = parts["years"] * 12 + parts["months"]
    sub = sum((parts[u] * float(UNIT_MS[u]) for u in UNITS[3:]), parts["weeks"] * float(UNIT_MS["weeks"]))

    def split(s: Column) -> Column:
        cut = lambda x: x.cast("long").cast("double")
        years = cut(months / 12)
        out, above = [years.alias("years"), (months % 12).alias("months"), F.lit(0.0).alias("weeks")], None
        for u in UNITS[3:]:
            rest = s if above is None else s % float(UNIT_MS[above])
            out.append((cut(rest / float(UNIT_MS[u])) if u != UNITS[-1] else rest).alias(u))
            above = u
        return F.struct(*out)

    return let(sub, split)


def moved(d: Column, by: Column, sign: int) -> Column:
    """A date moved by whole calendar months, then by the exact rest."""
    months = ((by["years"] * 12 + by["months"]) * sign).cast("int")
    rest = sum((by[u] * float(UNIT_MS[u]) for u in UNITS[3:]), by["weeks"] * float(UNIT_MS["weeks"])) * sign
    shifted = d + F.make_interval(F.lit(0), months)
    return F.timestamp_micros((F.unix_micros(shifted) + (rest * 1000).cast("long")))


def date_difference(a: Column, b: Column) -> Column:
    """The duration from ``b`` to ``a``: whole years and months, then days and smaller."""

    def of(p: Column) -> Column:
        lo, hi, sign = p["lo"], p["hi"], p["sign"]
        # months_between counts two month ends as whole months; step back where that goes too far
        after = lambda n: lo + F.make_interval(F.lit(0), n)
        whole = let(F.floor(F.months_between(hi, lo, False)).cast("int"), lambda n: F.when(after(n) > hi, n - 1).when(after(n + 1) <= hi, n + 1).otherwise(n))

        def rest(m: Column) -> Column:
            ms = (F.unix_micros(hi) - F.unix_micros(lo + F.make_interval(F.lit(0), m))).cast("double") / 1000
            zero = F.lit(0.0)
            return normal_duration({u: zero for u in UNITS} | {"months": m.cast("double") * sign, "milliseconds": ms * sign})

        return let(whole, rest)

    return F.when(a.isNotNull() & b.isNotNull(), let(F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.when(a < b, -1.0).otherwise(1.0).alias("sign")), of))


def binary(op: str, a: Val, b: Val) -> Val:
    if op in ("<", "<=", ">", ">=", "=", "!="):
        return boolean(compared(op, a, b))
    if op in ("&", "|"):
        from noteweave.plans.variants import is_null

        x, y = truth(a), truth(b)
        both = is_null(a) & is_null(b)
        return boolean(F.when(both, F.lit(None).cast("boolean")).otherwise(x & y if op == "&" else x | y))
    ka, kb = a.name, b.name
    if VARIANT in (a.kind, b.kind):
        raise NotStatic(f"{op} of no fixed kind")
    if NULL in (a.kind, b.kind):
        if a.kind == b.kind:
            return null()
        if op == "+" and "string" in (ka, kb):
            return string(F.concat(text(a), text(b)))
        return null()
    if ka == kb == "number":
        x, y = a.col, b.col
        if op == "/":
            return number(x / y if b.const else divided(x, y))
        if op == "%":
            return number(x % y if b.const else F.when(y != 0, x % y).when(x.isNotNull() & y.isNotNull(), F.lit(float("nan"))))
        return number({"+": x + y, "-": x - y, "*": x * y}[op])
    if op == "+":
        if "string" in (ka, kb):
            both = a.col.isNull() & b.col.isNull()
            joined = F.concat(a.col if a.const is not None and ka == "string" else text(a), b.col if b.const is not None and kb == "string" else text(b))
            return string(joined if a.const is not None or b.const is not None else F.when(~both, joined))
        if {ka, kb} == {"date", "duration"}:
            d, by = (a, b) if ka == "date" else (b, a)
            return Val(moved(d.col, by.col, 1), DATE)
        if ka == kb == "duration":
            return Val(normal_duration({u: a.col[u] + b.col[u] for u in UNITS}), DURATION)
        if ka == kb == "array":
            if a.kind != b.kind:
                raise NotStatic("arrays of several kinds")
            return Val(F.concat(a.col, b.col), a.kind)
        if ka == kb == "object":
            return _merged(a, b)
    if op == "-":
        if ka == kb == "date":
            return Val(date_difference(a.col, b.col), DURATION)
        if (ka, kb) == ("date", "duration"):
            return Val(moved(a.col, b.col, -1), DATE)
        if ka == kb == "duration":
            return Val(normal_duration({u: a.col[u] - b.col[u] for u in UNITS}), DURATION)
    if op == "*":
        if {ka, kb} == {"string", "number"}:
            s, n = (a, b) if ka == "string" else (b, a)
            return string(F.repeat(s.col, F.greatest(n.col, F.lit(0.0)).cast("int")))
        if {ka, kb} == {"duration", "number"}:
            d, n = (a, b) if ka == "duration" else (b, a)
            return Val(F.struct(*((d.col[u] * n.col).alias(u) for u in UNITS)), DURATION)
    if op == "/" and (ka, kb) == ("duration", "number"):
        return Val(F.struct(*((a.col[u] / F.nullif(b.col, F.lit(0.0))).alias(u) for u in UNITS)), DURATION)
    raise TypeError(f"no {op} of {ka} and {kb}")


def _merged(a: Val, b: Val) -> Val:
    if a.kind.fields and b.kind.fields:
        return object_of([(k, Val(a.col[k], kind)) for k, kind in a.kind.fields] + [(k, Val(b.col[k], kind)) for k, kind in b.kind.fields])
    if a.kind.fields or b.kind.fields or a.kind != b.kind:
        raise NotStatic("objects of several kinds")
    kept = F.map_filter(a.col, lambda k, _: ~F.map_contains_key(b.col, k))
    return Val(F.map_from_entries(F.concat(F.map_entries(kept), F.map_entries(b.col))), a.kind)


_DATE_PARTS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second, "week": F.weekofyear,
    "millisecond": lambda c: F.pmod(F.unix_millis(c), F.lit(1000)),
}


class Compiler:
    """Compiles trees; ``variable`` gives the value of a name, ``follow`` the field of what a link leads to."""

    def __init__(self, variable: Callable[[str], Val | None], follow: Callable[[Val, str], Val] | None = None):
        self.variable, self.follow = variable, follow

    def value(self, n: A.Node, env: dict[str, Any] | None = None) -> Val:
        out = self.any(n, env or {})
        if isinstance(out, Fn):
            raise NotStatic("a function as a value")
        return out

    def any(self, n: A.Node, env: dict[str, Any]) -> Val | Fn:
        if isinstance(n, A.Lit):
            return constant(n.value)
        if isinstance(n, A.Var):
            if n.name in env:
                return env[n.name]
            return self.variable(n.name) or null()
        if isinstance(n, A.ListOf):
            return list_of([self.value(x, env) for x in n.items])
        if isinstance(n, A.ObjectOf):
            return object_of([(k, self.value(x, env)) for k, x in n.items])
        if isinstance(n, A.Bin):
            return binary(n.op, self.value(n.left, env), self.value(n.right, env))
        if isinstance(n, A.Not):
            return boolean(~truth(self.value(n.value, env)))
        if isinstance(n, A.Lambda):
            return Fn(n.params, n.body, env, self)
        if isinstance(n, A.Index):
            if isinstance(n.value, A.Var) and n.value.name == "$parent" and "$parent" not in env and isinstance(n.key, A.Lit):
                return self.variable(f"$parent.{n.key.value}") or null()
            return self.index(self.value(n.value, env), self.value(n.key, env))
        if isinstance(n, A.Method):
            return self.call(n.name, [self.any(x, env) for x in (n.target, *n.args)])
        if isinstance(n.func, A.Var) and n.func.name not in env:
            return self.call(n.func.name, [self.any(x, env) for x in n.args])
        f = self.any(n.func, env)
        if not isinstance(f, Fn):
            raise TypeError(f"{A.text_of(n.func)} is no function")
        args = [self.any(x, env) for x in n.args]
        return f.compiler.any(f.body, {**f.env, **dict(zip(f.params, args))})

    def call(self, name: str, args: list[Val | Fn]) -> Val:
        from noteweave.functions.columns import call_column

        if any(isinstance(x, Val) and x.kind == VARIANT for x in args):
            raise NotStatic(f"{name} of no fixed kind")
        return call_column(name, args)

    def index(self, v: Val, key: Val) -> Val:
        if VARIANT in (v.kind, key.kind):
            raise NotStatic("an index of no fixed kind")
        if NULL in (v.kind, key.kind):
            return null()
        c = v.col
        if v.name == "array" and key.name == "number":
            at = key.col.cast("int")
            return Val(F.when((at >= 0) & (key.col == at), F.get(c, at)), v.kind.item)
        if v.name == "array":
            inner = self.index(Val(F.lit(None), v.kind.item), key).kind
            return Val(F.transform(c, lambda x: self.index(Val(x, v.kind.item), key).col), array_of(inner))
        if v.name == "object" and v.kind.fields:
            if key.const is None:
                raise NotStatic("a computed key of an object")
            fields = dict(v.kind.fields)
            found = key.const if key.const in fields else next((k for k in fields if k.lower() == str(key.const).lower()), None)
            return null() if found is None else Val(c[found], fields[found])
        if v.name == "object":
            return Val(F.try_element_at(c, text(key) if key.name != "string" else key.col), v.kind.item)
        if v.name == "string" and key.name == "number":
            at = key.col.cast("int")
            return string(F.when((at >= 0) & (at < F.length(c)), F.substring(c, at + 1, F.lit(1))))
        if key.const is None:
            raise NotStatic(f"a computed key of {v.name}")
        if v.name == "date":
            return number(_DATE_PARTS[key.const](c)) if key.const in _DATE_PARTS else null()
        if v.name == "duration":
            return number(c[key.const]) if key.const in UNITS and key.const != "weeks" else null()
        if v.name == "link":
            if not self.follow:
                return null()
            return self.follow(v, key.const)
        raise TypeError(f"no index of {v.name}")

    def filter(self, n: A.Node, env: dict[str, Any] | None = None) -> Column:
        """The truth of an expression as a filter, never null, in a form that scans can take where there is one."""
        env = env or {}
        if isinstance(n, A.Bin) and n.op in ("&", "|"):
            x, y = self.filter(n.left, env), self.filter(n.right, env)
            return x & y if n.op == "&" else x | y
        if isinstance(n, A.Not):
            return ~self.filter(n.value, env)
        if isinstance(n, A.Bin) and n.op in ("<", "<=", ">", ">=", "=", "!="):
            a, b = self.value(n.left, env), self.value(n.right, env)
            if (c := pushable(n.op, a, b)) is not None:
                return c
            return F.coalesce(compared(n.op, a, b), F.lit(False))
        return truth(self.value(n, env))
