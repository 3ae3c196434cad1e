"""Values of no fixed kind, as JSON texts: their kind, order and truth as columns, and typed values as JSON.

A column of such texts (what ``functions.literals.dumps`` writes) is a ``Val`` of kind ``variant``. Comparing it with a
value of one kind, and its truth, stay inside Catalyst; all else raises ``NotStatic``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from noteweave.common import let
from noteweave.functions.columns import call_column
from noteweave.functions.literals import UNITS
from noteweave.plans import expressions as E
from noteweave.plans.expressions import Kind, NotStatic, Val

_LINK = "struct<path:string,type:string,subpath:string,display:string,embed:boolean>"
_SPAN = "struct<" + ",".join(f"{u}:double" for u in UNITS) + ">"
#: A link as ``dumps`` writes it, wherever it stands in a JSON text; the group is what it holds.
_WRITTEN_LINK = r'\{\s*"\$_type"\s*:\s*"link"\s*,\s*"value"\s*:\s*(\{(?:[^{}"]|"(?:[^"\\]|\\.)*+")*+\})\s*\}'


def kind_name(c: Column) -> Column:
    """The name of the kind of a JSON text; a null column is of kind null."""
    first = F.substring(c, 1, 1)
    tag = F.get_json_object(c, "$['$_type']")
    return (
        F.when(c.isNull() | (c == "null"), "null").when(first == '"', "string").when(first == "[", "array")
        .when(first == "{", F.when(tag.isin("date", "duration", "link"), tag).otherwise("object")).when(c.isin("true", "false"), "boolean").otherwise("number")
    )


def as_kind(c: Column, kind: Kind) -> Val:
    """The values of one scalar kind; null where a JSON text is of another."""
    inner = F.get_json_object(c, "$.value")
    if kind.name == "string":
        out = F.when(F.substring(c, 1, 1) == '"', F.get_json_object(c, "$"))
    elif kind.name == "number":
        out = F.when(kind_name(c) == "number", c.try_cast("double"))
    elif kind.name == "boolean":
        out = F.when(c == "true", True).when(c == "false", False)
    elif kind.name == "date":
        full = inner
        for pattern, by in ((r"^(\d{4}-\d{2})$", "$1-01"), (r"^(\d{4}-\d{2}-\d{2})$", "$1T00:00:00"), (r"^(.{10}T\d{2}:\d{2})(?!:)", "$1:00"), (r"\[([^\[\]]+)\]$", " $1"), (r"(:\d{2}(?:\.\d+)?)$", "$1Z")):
            full = F.regexp_replace(full, pattern, by)  # a month, a day, no seconds, a region in brackets, no zone
        zoned = F.when(full.rlike(r"[+-]\d{2}:\d{2}Z$"), F.regexp_replace(full, "Z$", "")).otherwise(full)
        out = F.when(kind_name(c) == "date", zoned.try_cast("timestamp"))
    elif kind.name == "duration":
        units = F.from_json(inner, _SPAN)
        held = F.struct(*(F.coalesce(units[u], F.lit(0.0)).alias(u) for u in UNITS))
        iso = F.struct(*(F.coalesce(F.regexp_extract(inner, p + r"([\d.]+)" + u[0].upper(), 1).try_cast("double"), F.lit(0.0)).alias(u) for u, p in zip(UNITS, [*["^P[^T]*?"] * 4, *["T.*?"] * 3, "^$"])))
        out = F.when(kind_name(c) == "duration", F.when(inner.startswith("{"), held).when(inner.startswith("P"), iso).otherwise(call_column("dur", [Val(inner, E.STRING)]).col))
    elif kind.name == "link":
        out = F.when(kind_name(c) == "link", F.from_json(inner, _LINK))
    else:
        raise NotStatic(f"a {kind} of no fixed kind")
    return Val(out, kind)


def is_null(v: Val) -> Column:
    return v.col.isNull() | (v.col == "null") if v.kind == E.VARIANT else v.col.isNull()


def compared(op: str, a: Val, b: Val) -> Column:
    """``a op b`` in the total order of all kinds, null only where both are null."""
    if a.kind == b.kind:
        raise NotStatic("two values of no fixed kind")
    if a.kind != E.VARIANT:
        return compared({"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op), b, a)
    if b.kind == E.NULL:
        return F.when(~is_null(a), F.lit(op in (">", ">=", "!=")))

    def of(c: Column) -> Column:
        kind = kind_name(c)
        by_name = {"<": kind < b.name, "<=": kind < b.name, ">": kind > b.name, ">=": kind > b.name, "=": F.lit(False), "!=": F.lit(True)}[op]
        other = ~kind.isin("null", b.name) if b.const is not None else ~kind.isin("null", b.name) & b.col.isNotNull()
        return F.when(other, by_name).otherwise(E.compared(op, as_kind(c, b.kind), b))

    return let(a.col, of)


def truth(c: Column) -> Column:
    """Whether a JSON text counts as true; never null."""
    return let(c, _truth)


def _truth(c: Column) -> Column:
    scalar = {k.name: E.truth(as_kind(c, k)) for k in (E.NUMBER, E.DATE, E.DURATION, E.LINK)}
    kind = kind_name(c)
    out = F.when(kind == "boolean", c == "true").when(kind == "string", c != '""').when(kind == "array", ~c.rlike(r"^\[\s*\]$")).when(kind == "object", ~c.rlike(r"^\{\s*\}$"))
    for name, column in scalar.items():
        out = out.when(kind == name, column)
    return F.coalesce(out.otherwise(F.lit(False)), F.lit(False))


def written_links(c: Column) -> Column:
    """All links in a JSON text, at any depth: array<struct<path,type,subpath>>; none in null."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(_WRITTEN_LINK), F.lit(1))
    return F.transform(found, lambda x: F.from_json(x, "struct<path:string,type:string,subpath:string>"))


def to_json(v: Val) -> Column:
    """A typed value as the JSON text that ``literals.loads`` reads; null stays null."""
    c, quote = v.col, lambda x: F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]$", "")
    tagged = lambda kind, inner: F.concat(F.lit(f'{{"$_type": "{kind}", "value": '), inner, F.lit("}"))
    whole = lambda parts, a, b: F.concat(F.lit(a), parts, F.lit(b))
    if v.kind == E.VARIANT:
        return c
    if v.name in ("number", "boolean"):
        return c.cast("string")
    if v.name == "string":
        return F.when(c.isNotNull(), quote(c))
    if v.name == "date":
        return tagged("date", F.concat(F.lit('"'), F.date_format(F.to_utc_timestamp(c, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit('"')))
    if v.name in ("duration", "link"):
        return F.when(c.isNotNull(), tagged(v.name, F.to_json(c)))
    if v.name == "array":
        return whole(F.array_join(F.transform(c, lambda x: to_json(Val(x, v.kind.item))), ", ", "null"), "[", "]")
    if v.name == "object" and v.kind.fields:
        pairs = [F.concat(F.lit(f'"{k}": '), F.coalesce(to_json(Val(c[k], kind)), F.lit("null"))) for k, kind in v.kind.fields]
        return F.when(c.isNotNull(), whole(F.concat_ws(", ", *pairs), "{", "}"))
    if v.name == "object":
        return whole(F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(quote(e["key"]), F.lit(": "), F.coalesce(to_json(Val(e["value"], v.kind.item)), F.lit("null")))), ", "), "{", "}")
    return F.lit(None).cast("string")
