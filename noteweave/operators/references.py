"""References to records that do not exist (at the time they were made).

Parents and children come into one long table of tagged keys. One ordered pass over each key then
tells for every child whether a parent was alive at its time, so that only orphan rows leave it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.common import let, strip

#: A key with more child rows than this is spread over several sort groups.
HOT_ROWS = 100_000
#: So many hot keys are looked up from the driver at most; beyond it they are joined.
MAX_HOT_KEYS = 10_000

_FAR = "timestamp'9999-12-31 00:00:00'"


def canonical_path(c: Column) -> Column:
    """One spelling per path: no outer blanks, percent signs decoded, no leading ``/`` or ``./``, lower case.

    A name without an ending gets ``.md``. Null and blank paths give null. ``%`` without two hex digits
    and ``+`` stand for themselves.
    """

    def decoded(outer: Column) -> Column:
        escaped = F.regexp_replace(F.replace(outer, F.lit("+"), F.lit("%2B")), r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.when(outer.contains("%"), strip(F.coalesce(F.try_url_decode(escaped), outer))).otherwise(outer)

    def named(bare: Column) -> Column:
        ending = F.regexp_extract(bare, r"\.([^./\s]+)$", 1)
        return F.when(bare != "", F.when(ending != "", bare).otherwise(F.concat(bare, F.lit(".md"))))

    return let(strip(c), lambda outer: let(decoded(outer), lambda plain: let(F.lower(F.regexp_replace(plain, r"^(?:\./|/)+", "")), named)))


def _salted(children: DataFrame, parents: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_salt``: children of a hot key are spread, its parents repeated for each part."""
    hot = children.groupBy("key").count().where(F.col("count") > hot_rows).select("key", F.ceil(F.col("count") / hot_rows).cast("int").alias("_parts"))
    rows = hot.limit(MAX_HOT_KEYS + 1).collect()
    if not rows:
        return children.withColumn("_salt", F.lit(0)), parents.withColumn("_salt", F.lit(0))
    if len(rows) <= MAX_HOT_KEYS:
        hot = F.broadcast(children.sparkSession.createDataFrame(rows, hot.schema))
    spread = F.pmod(F.xxhash64("ref_file", "ref_key"), F.coalesce("_parts", F.lit(1))).cast("int")
    children = children.join(hot, "key", "left").withColumn("_salt", spread).drop("_parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
    return children, parents.join(hot, "key", "left").withColumn("_salt", every).drop("_parts")


def orphan_references(children: DataFrame, parents: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Children whose parent isn't there at the child's time.

    ``children``: key, at, ref_table, ref_file, ref_key. ``parents``: key, since, until (null: still
    there), a row per life of a parent. Result: ref_table, ref_file, ref_key, at, orphan_kind, with
    orphan_kind

    - ``missing``: no parent ever has the key,
    - ``late``: the first parent comes after ``at``,
    - ``deleted``: any other time without a parent.

    A null key is no reference. A child without a time is only reported as ``missing``. A parent
    without ``since`` was there from the beginning. Rows exactly alike count once; further columns are
    ignored. An empty parent table makes every child ``missing``.
    """
    kids = children.where(F.col("key").isNotNull()).select("key", "at", "ref_table", "ref_file", "ref_key")
    born = F.coalesce("since", F.expr("timestamp'0001-01-01 00:00:00'"))
    kin = parents.where(F.col("key").isNotNull()).select("key", born.alias("since"), F.coalesce("until", F.expr(_FAR)).alias("until"))
    kids, kin = _salted(kids, kin, hot_rows)
    long = kids.select("key", "_salt", F.lit(1).alias("child"), "at", F.lit(None).cast("timestamp").alias("until"), "ref_table", "ref_file", "ref_key").unionByName(
        kin.select("key", "_salt", F.lit(0).alias("child"), F.col("since").alias("at"), "until"), allowMissingColumns=True
    )
    group = Window.partitionBy("key", "_salt")
    so_far = group.orderBy("at", "child").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = long.withColumns({
        "_alive_until": F.max("until").over(so_far),
        "_first": F.min(F.when(F.col("child") == 0, F.col("at"))).over(group.orderBy("at", "child").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
    })
    kind = F.when(F.col("_first").isNull(), "missing").when(F.col("_first") > F.col("at"), "late").when(F.col("_alive_until") <= F.col("at"), "deleted")
    found = seen.where("child = 1").withColumn("orphan_kind", kind).where("orphan_kind is not null")
    return found.select("ref_table", "ref_file", "ref_key", "at", "orphan_kind").distinct()


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, calendar month of the reference and kind. A reference without a time has a null month."""
    month = F.date_format("at", "yyyy-MM").alias("month")
    return orphans.groupBy("ref_table", month, "orphan_kind").agg(F.count("*").alias("n"))
