"""Plain relational tables as objects: regions, nations, customers, orders and line items are a tree."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import file_system, table
from noteweave.plans.store import Field, ObjectStore

#: Each table with the columns of its key and its parent's table and key.
TABLES = {
    "region": (["r_regionkey"], None, None),
    "nation": (["n_nationkey"], "region", "n_regionkey"),
    "customer": (["c_custkey"], "nation", "c_nationkey"),
    "supplier": (["s_suppkey"], "nation", "s_nationkey"),
    "part": (["p_partkey"], None, None),
    "orders": (["o_orderkey"], "customer", "o_custkey"),
    "lineitem": (["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "orders", "l_orderkey"),
    "events": (["event_id"], None, None),
}


def object_id(name: str, *keys: str) -> Column:
    return F.expr(_id(name, *keys))


def _id(name: str, *keys: str) -> str:
    return f"concat_ws('/', '{name}', {', '.join(f'CAST(CAST({k} AS BIGINT) AS STRING)' for k in keys)})"


def _tags(name: str) -> str:
    if name == "part":
        brand, kind = (f"regexp_replace({c}, '[^A-Za-z0-9]+', '-')" for c in ("p_brand", "p_type"))
        return f"array(concat_ws('/', '#part', {brand}, {kind}))"
    return "array(concat_ws('/', '#event', event_type))" if name == "events" else "CAST(array() AS ARRAY<STRING>)"


def _as_objects(df: DataFrame, name: str, columns: dict[str, str]) -> DataFrame:
    """A table's rows as objects, with all ``columns`` (name to type) of all tables."""
    keys, parent, foreign = TABLES[name]
    own = _id(name, *keys)
    return df.selectExpr(
        f"{own} AS id", f"'{name}' AS typename", f"array('{name}', 'row') AS types", f"{_id(parent, foreign) if parent else 'CAST(NULL AS STRING)'} AS parent_id",
        f"concat('tables/', {own}) AS file", f"'tables/{name}' AS folder", f"{own} AS link_key", f"{_tags(name)} AS tags", *(f"`{c}`" if c in df.columns else f"CAST(NULL AS {t}) AS `{c}`" for c, t in columns.items()),
    )


def relational_store(spark: SparkSession, sf_dir: str) -> ObjectStore:
    """All tables as one store. A query that names a type reads that table only: the other branches of the
    union have another constant there, which Catalyst folds away. A session plans the store of unchanged files once."""
    stamps = []
    for name in TABLES:
        fs, at = file_system(spark, f"{sf_dir}/{name}.parquet")
        status = fs.getFileStatus(at)
        stamps.append((status.getModificationTime(), status.getLen()))
    held = spark.__dict__.setdefault("_noteweave_tables", {})
    if sf_dir not in held or held[sf_dir][0] != stamps:
        held[sf_dir] = (stamps, _store(spark, sf_dir))
    return held[sf_dir][1]


def _store(spark: SparkSession, sf_dir: str) -> ObjectStore:
    frames = {name: table(spark, sf_dir, name) for name in TABLES}
    columns = {f.name: f.dataType.simpleString() for df in frames.values() for f in df.schema}
    parts = {name: _as_objects(df, name, columns) for name, df in frames.items()}
    objects, fields = _together(parts.values()), {}
    for name, df in frames.items():
        fields |= {c: Field(c, frozenset([name])) for c in df.columns}
    fields |= {"$id": Field("id", frozenset(TABLES)), "$typename": Field("typename", frozenset(TABLES)), "$tags": Field("tags", frozenset(TABLES)), "$path": Field("file", frozenset(TABLES))}
    item = frames["lineitem"]
    own = object_id("lineitem", *TABLES["lineitem"][0]).alias("src_id")
    links = item.select(own, F.explode(F.array(object_id("part", "l_partkey"), object_id("supplier", "l_suppkey"))).alias("dst_key"))
    return ObjectStore(
        objects, fields, links=links, resolved=lambda: links.withColumnRenamed("dst_key", "dst_id"), by_id=_by_id, link_keys=lambda ids: ids.select(F.col("id").alias("dst_key")),
        linked_types=frozenset(["lineitem", "part", "supplier"]),
        descendants=lambda source, inclusive: _descendants(parts, source, inclusive), ancestors=lambda source, inclusive: _ancestors(parts, source, inclusive),
    )


def _together(parts: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _by_id(object_id: str) -> Column:
    """The object of an id, as a filter that leaves only its table to be read."""
    name, _, key = object_id.partition("/")
    here = (F.col("typename") == name) & (F.col("id") == object_id)
    if name in TABLES and len(TABLES[name][0]) == 1 and key.isdigit():
        here = here & (F.col(TABLES[name][0][0]) == int(key))
    return here


def _keys(source: DataFrame, name: str) -> DataFrame:
    """The keys (k) of the objects of one table among ``source``: all of a text id's parts."""
    return source.where(F.col("typename") == name).select(F.split("id", "/").alias("k"))


def _first(source: DataFrame, name: str) -> DataFrame:
    return _keys(source, name).select(F.get("k", F.lit(1)).cast("bigint").alias("k"))


def _within(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    return rows.join(keys, F.col(column) == F.col("k"), "left_semi")


def _descendants(parts: dict[str, DataFrame], source: DataFrame, inclusive: bool) -> DataFrame:
    """The rows below those of ``source`` (id, typename): one foreign key per level, from the top down."""
    out, below = {}, {}
    for name, (keys, parent, foreign) in TABLES.items():  # parents stand before their children
        here = _first(source, name) if len(keys) == 1 else None
        rows = _within(parts[name], foreign, below[parent]) if parent else None
        if inclusive:
            mine = here.distinct() if here is not None else source.where(F.col("typename") == name).select(F.col("id").alias("k")).distinct()
            column = keys[0] if here is not None else "id"
            if rows is None:
                rows = _within(parts[name], column, mine)
            else:
                up = below[parent].select(F.col("k").alias("_up")).distinct()
                flagged = parts[name].join(mine, F.col(column) == F.col("k"), "left").join(up, F.col(foreign) == F.col("_up"), "left")
                rows = flagged.where("k is not null or _up is not null").drop("k", "_up")
        if rows is not None:
            out[name] = rows
        if here is not None:
            found = rows.select(F.col(keys[0]).cast("bigint").alias("k")) if rows is not None else None
            below[name] = here if found is None else found if inclusive else found.unionByName(here)
    return _together(out.values())


def _ancestors(parts: dict[str, DataFrame], source: DataFrame, inclusive: bool) -> DataFrame:
    """The rows above those of ``source`` (id, typename): one foreign key per level, from the bottom up."""
    up: dict[str, DataFrame] = {}
    out: dict[str, DataFrame] = {}
    for name in reversed(TABLES):
        keys, parent, foreign = TABLES[name]
        if name in up:
            above = up[name].distinct()
            wanted = above.unionByName(_first(source, name)).distinct() if inclusive else above
            out[name] = _within(parts[name], keys[0], wanted)
        elif inclusive:
            out[name] = parts[name].join(source.where(F.col("typename") == name).select("id"), "id", "left_semi")
        if parent is None:
            continue
        if foreign in keys:  # the id tells it
            more = _keys(source, name).select(F.get("k", F.lit(keys.index(foreign) + 1)).cast("bigint").alias("k"))
        else:
            starts = _first(source, name)
            found = _within(parts[name], keys[0], starts.unionByName(up[name]) if name in up else starts)
            more = found.select(F.col(foreign).cast("bigint").alias("k"))
        up[parent] = up[parent].unionByName(more.distinct()) if parent in up else more.distinct()
    return _together(out.values())
