"""False-discovery control over tables of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.common import shelve


def with_q_values(tested: DataFrame, hypotheses: int | Column, *, log10_p: str = "log10_p") -> DataFrame:
    """``tested`` with the Benjamini-Hochberg ``q_value`` of each row.

    Rows are sorted range by range, equal p-values by the hash of their row, so that ties fill many ranges and
    no task sorts more than one; ranks are the place within the range and the number of rows in those before.
    The least of p·m/rank from a row on is taken likewise, which gives tied rows one value by itself.
    Hypotheses without a row count as tests of p = 1. A null p counts as 1; repeated rows stay.
    """
    key = [F.col("_p").asc(), F.xxhash64(*tested.columns).asc()]
    ranges = tested.withColumn("_p", F.coalesce(F.col(log10_p), F.lit(0.0))).repartitionByRange(*key).sortWithinPartitions(*key)
    held = shelve(ranges.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranked")
    before, after = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    counts = held.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_ahead", F.coalesce(F.sum("_n").over(before), F.lit(0)))  # a row per range
    raw = held.join(F.broadcast(counts.drop("_n")), "_part").withColumn("_raw", F.least(F.lit(1.0), F.pow(F.lit(10.0), "_p") * hypotheses / (F.col("_ahead") + F.col("_at") + 1)))
    later = raw.groupBy("_part").agg(F.min("_raw").alias("_m")).select("_part", F.coalesce(F.min("_m").over(after), F.lit(1.0)).alias("_later"))
    down = Window.partitionBy("_part").orderBy(F.desc("_at")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return raw.join(F.broadcast(later), "_part").select(*tested.columns, F.least(F.min("_raw").over(down), "_later").alias("q_value"))
