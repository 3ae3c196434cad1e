"""Attribute-value rows into one wide, typed row per entity."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noteweave.common import let, shelve, strip
from noteweave.operators.instants import readings, region_map, settle

#: So many attributes become columns at most; a wider list is an error, never cut.
MAX_COLUMNS = 2_000

_NUMBER = r"^[+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
_ISO_DURATION = r"^P(?=[\dT])(?:\d+(?:[.,]\d+)?Y)?(?:\d+(?:[.,]\d+)?M)?(?:\d+(?:[.,]\d+)?W)?(?:\d+(?:[.,]\d+)?D)?(?:T(?=\d)(?:\d+(?:[.,]\d+)?H)?(?:\d+(?:[.,]\d+)?M)?(?:\d+(?:[.,]\d+)?S)?)?$"
_AMOUNT = r"(\d+(?:\.\d+)?)\s*(weeks?|wks?|w|days?|d|hours?|hrs?|hr|h|minutes?|mins?|min|m)(?![a-z])"
_AMOUNTS = rf"^{_AMOUNT}(?:(?:\s*,\s*|\s+and\s+|\s*){_AMOUNT})*$"
_TRUE, _FALSE = ["true", "yes", "on", "1"], ["false", "no", "off", "0"]

SQL_TYPES = {"text": "string", "list": "array<string>", "number": "double", "boolean": "boolean", "date": "timestamp", "duration": "double", "link": "string"}


def parsed(cells: DataFrame, value: str) -> DataFrame:
    """``cells`` with p: struct<what,text,literal> of the JSON literal ``value``; null if it is SQL null, JSON null or a
    blank text.

    ``what`` is object, list, text, number or boolean; what isn't JSON is a text. ``text`` is the content
    of a text, any other literal as it is written, without outer blanks. Each step is a projection of its own, which
    Spark compiles and evaluates once.
    """
    v, first = F.col("_literal"), F.col("_first")
    what = (
        F.when(first == "{", "object").when(first == "[", "list").when(first == '"', "text").when(v.isin("true", "false"), "boolean")
        .when(v.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "number").otherwise("text")
    )
    text = F.when(first == '"', strip(F.coalesce(F.get_json_object(v, "$"), v))).otherwise(v)
    steps = cells.withColumn("_literal", strip(F.col(value))).withColumn("_first", F.substring("_literal", 1, 1)).withColumns({"_what": what, "_text": text})
    filled = (v != "null") & (F.col("_text") != "")
    return steps.withColumn("p", F.when(filled, F.struct(F.col("_what").alias("what"), F.col("_text").alias("text"), v.alias("literal")))).drop("_literal", "_first", "_what", "_text")


def typed(p: Column, kind: str, zone: Column, regions: Column) -> Column:
    """struct<v,fits>: what ``parsed`` gave in the declared type ``kind``, and whether it is of that type.

    number: double; boolean; date: all its readings as moments, see ``instants``; duration: seconds as double, null with years or
    months, which have no fixed length; link: its path; list: its elements as text; text: its content.
    """
    what, text = p["what"], p["text"]
    scalar = what.isin("number", "text")
    pair = lambda v, fits: F.struct(v.alias("v"), fits.alias("fits"))
    if kind == "number":
        fits = scalar & text.rlike(_NUMBER)
        return pair(F.when(fits, F.regexp_replace(text, ",", "").try_cast("double")), fits)
    if kind == "boolean":
        fits = (what == "boolean") | scalar & F.lower(text).isin(*_TRUE, *_FALSE)
        return pair(F.when(fits, F.lower(text).isin(*_TRUE)), fits)
    if kind not in ("date", "duration", "link"):
        whole = F.array(text) if kind == "list" else text
        return pair(F.when(what == "list", F.from_json(p["literal"], "array<string>")).otherwise(whole) if kind == "list" else whole, F.lit(True))
    tag = F.when(what == "object", F.from_json(p["literal"], "`$_type` string, value string"))

    def of(t: Column) -> Column:
        tagged = F.coalesce(t["$_type"] == kind, F.lit(False))
        if kind == "date":
            moments = readings(F.when(scalar, text).when(tagged, t["value"]), zone, regions)
            return let(moments, lambda m: pair(m, tagged | scalar & (F.size(m) > 0)))
        if kind == "link":
            path = F.when(tagged, F.get_json_object(t["value"], "$.path")).when(what == "text", F.regexp_extract(text, r"^\[\[([^\[\]|#]*)", 1))
            fits = tagged | (what == "text") & text.rlike(r"^\[\[[^\[\]]+\]\]$")
            return pair(F.when(fits, path), fits)

        def span(x: Column) -> Column:
            amounts, iso = F.lower(x).rlike(_AMOUNTS), x.rlike(_ISO_DURATION)
            return pair(F.when(amounts, _amount_seconds(F.lower(x))).when(iso, _iso_seconds(x)), tagged | F.coalesce(amounts | iso, F.lit(False)))

        return let(F.when(what == "text", text).when(tagged, t["value"]), span)

    return let(tag, of)


def _amount_seconds(span: Column) -> Column:
    each = F.arrays_zip(F.regexp_extract_all(span, F.lit(_AMOUNT), F.lit(1)).alias("n"), F.regexp_extract_all(span, F.lit(_AMOUNT), F.lit(2)).alias("u"))
    unit = lambda u: F.when(u.startswith("w"), 604_800).when(u.startswith("d"), 86_400).when(u.startswith("h"), 3_600).otherwise(60)
    return F.aggregate(each, F.lit(0.0), lambda s, x: s + x["n"].cast("double") * unit(F.substring(x["u"], 1, 1)))


def _iso_seconds(span: Column) -> Column:
    part = lambda p: F.coalesce(F.regexp_replace(F.regexp_extract(span, p, 1), ",", ".").try_cast("double"), F.lit(0.0))
    n = r"(\d+(?:[.,]\d+)?)"
    fixed = part(f"{n}W") * 604_800 + part(f"{n}D") * 86_400 + part(f"T.*?{n}H") * 3_600 + part(f"T(?:.*?[^\\d.,])??{n}M") * 60 + part(f"T.*?{n}S")
    return F.when(~span.rlike(r"^P[^T]*[YM]"), fixed)


def winners(rows: DataFrame, *, entity: str, attribute: str, order: list[Column], value: Column, carry: list[str]) -> DataFrame:
    """Of the rows of one entity and attribute, the one that comes first in ``order``."""
    first = F.min(F.struct(*(c.alias(f"_o{i}") for i, c in enumerate(order)), value.alias("value"), *carry)).alias("w")
    return rows.groupBy(entity, attribute).agg(first).select(entity, attribute, F.col("w.value").alias("value"), *(F.col(f"w.{c}").alias(c) for c in carry))


def wide_table(cells: DataFrame, columns: dict[str, str], *, entity: str, attribute: str = "attribute", zone: str = "zone", source: str | None = None) -> DataFrame:
    """One row per entity: ``entity``, a typed column per attribute of ``columns`` and ``misfits``.

    ``cells`` has at most one row per entity and attribute, with the JSON literal ``value`` and the
    ``zone`` of local times; ``columns`` gives the type of each attribute (see ``typed``). ``misfits``
    lists the attributes that have a value, but none of the declared type: their column is null. Null,
    JSON null and blank values are empty cells. Rows whose attribute isn't in ``columns`` only add their
    entity; rows without an entity are left out; an empty table gives no rows. Column names are the
    attributes as given, so they may clash with nothing but ``entity`` and ``misfits``, which is an error.

    A date that can be read in several ways is read as its ``source`` (a column; without it all cells are of one) mostly
    writes dates, as ``normalise_instants`` does; where no reading is likely the column is null, but no misfit.

    The cells are typed and stored partitioned by attribute. Each attribute then is a narrow table that reads its
    own partition and is shuffled once by entity. All outer joins work on that partitioning: every group
    starts from the list of entities, and groups are joined pairwise in a balanced tree.
    """
    if len(columns) > MAX_COLUMNS or {entity, "misfits"} & set(columns):
        raise ValueError(f"at most {MAX_COLUMNS} attributes, none of them named {entity} or misfits")
    spark = cells.sparkSession
    regions, kinds = region_map(spark), sorted(set(columns.values()))
    by_kind = {k: [a for a, b in columns.items() if b == k] for k in kinds}
    home = F.lit("") if source is None else F.coalesce(F.col(source).cast("string"), F.lit(""))
    own = F.when(F.col(attribute).isin(*columns), F.col("value")) if columns else F.lit(None).cast("string")
    cell = cells.where(F.col(entity).isNotNull()).select(F.col(entity).alias("_e"), F.col(attribute).alias("_a"), own.alias("_value"), F.col(zone).alias("zone"), home.alias("source"))
    cell = parsed(cell, "_value").drop("_value")
    kept = cell.withColumn("_a", F.when(F.col("_a").isin(*columns) & F.col("p").isNotNull(), F.col("_a")))
    each = [F.when(F.col("_a").isin(*by_kind[k]), typed(F.col("p"), k, F.col("zone"), regions)).alias(f"_t{at}") for at, k in enumerate(kinds)]
    stored = shelve(kept.select("_e", "_a", "source", *each), "cells", partition_by="_a")
    spine = stored.select("_e").distinct()
    held = lambda kind: F.col(f"_t{kinds.index(kind)}")
    dates = settle(stored.where(F.col("_a").isin(*by_kind["date"])).select("_e", "_a", "source", held("date")["v"].alias("readings"), held("date")["fits"].alias("fits"))) if "date" in kinds else None

    def narrow(i: int, name: str, kind: str) -> DataFrame:
        if kind == "date":
            own = dates.where(F.col("_a") == name).select("_e", F.timestamp_millis("epoch_ms").alias("v"), "fits")
        else:
            own = stored.where(F.col("_a") == name).select("_e", held(kind)["v"].alias("v"), held(kind)["fits"].alias("fits"))
        return own.select("_e", F.col("v").alias(f"_v{i}"), F.when(~F.coalesce("fits", F.lit(False)), F.lit(name)).alias(f"_m{i}"))

    tree = []
    names = list(columns.items())
    size = max(2, isqrt(len(names)))
    for at in range(0, len(names), size):
        group = spine
        for i, (name, kind) in list(enumerate(names))[at : at + size]:
            group = group.join(narrow(i, name, kind), "_e", "left")
        tree.append(group)
    while len(tree) > 1:
        tree = [tree[i].join(tree[i + 1], "_e", "left") if i + 1 < len(tree) else tree[i] for i in range(0, len(tree), 2)]
    table = tree[0] if tree else spine
    misfits = F.array_compact(F.array(*(F.col(f"_m{i}") for i in range(len(names))))) if names else F.array().cast("array<string>")
    return table.select(F.col("_e").alias(entity), *(F.col(f"_v{i}").alias(name) for i, (name, _) in enumerate(names)), misfits.alias("misfits"))
