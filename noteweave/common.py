"""Session helpers that every operator shares."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as blank at the edges of keys, values and paths.
BLANKS = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def ship(spark: SparkSession) -> None:
    """Send this package to all workers of a session, once; it need not be installed there."""
    if spark.__dict__.setdefault("_noteweave_shipped", False):
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="noteweave-package-")
    atexit.register(_remove_local, folder)
    with zipfile.ZipFile(f"{folder}/noteweave.zip", "w") as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    spark.sparkContext.addPyFile(f"{folder}/noteweave.zip")
    spark._noteweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strip(c: Column) -> Column:
    """``c`` without outer blanks of any kind."""
    return F.btrim(c, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is evaluated once, however often ``body`` uses it.

    Catalyst inlines projections into filters, where shared subexpressions are computed anew at every use.
    """
    return F.get(F.transform(F.array(value), body), 0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, a private local one on a
    local master; on a cluster every executor would write to its own disk, so there it is an error."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given:
        given = getattr(spark, "_noteweave_shared", None)
        if not given:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError(f"spark.checkpoint.dir must name a folder that all executors share on {master}")
            given = "file://" + tempfile.mkdtemp(prefix="noteweave-")
            spark._noteweave_shared = given
            atexit.register(_remove_local, given[len("file://"):])
    return given


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder. What is written there goes when the application ends, or by ``release``."""
    path = f"{shared_dir(spark)}/noteweave/{label}-{uuid.uuid4().hex}"
    fs, at = file_system(spark, path)
    fs.mkdirs(at)  # only what is there can be marked
    fs.deleteOnExit(at)
    spark.__dict__.setdefault("_noteweave_paths", []).append(path)
    return path


def release(spark: SparkSession) -> int:
    """Delete all that operators stored in the shared folder so far; results must have been written by then. Returns
    how many paths there were."""
    paths = spark.__dict__.pop("_noteweave_paths", [])
    for path in paths:
        remove(spark, path)
    return len(paths)


def shelve(df: DataFrame, label: str, *, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    This cuts the lineage like a reliable checkpoint, but later reads keep column pruning and filter
    pushdown. The data survive the loss of any executor.
    """
    spark = df.sparkSession
    path = shared_path(spark, label)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# small files on any file system that Spark reads


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as it knows it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_system(spark, path)
    fs.delete(at, True)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none where there is no folder."""
    fs, at = file_system(spark, folder)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = file_system(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file at once: it is there in whole or not at all."""
    fs, at = file_system(spark, path + ".tmp")
    stream = fs.create(at, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    _, final = file_system(spark, path)
    fs.delete(final, False)
    fs.rename(at, final)


def latest(df: DataFrame, key: str, payload: list[str], order: list[str]) -> DataFrame:
    """One row per ``key``: ``payload`` of the row that is greatest by ``order``.

    It is an aggregation, so repeated revisions fold together before the shuffle. Rows with a null key
    are dropped, and rows that tie on ``order`` give the greatest payload, so the result is one and the
    same in every run.
    """
    best = F.max(F.struct(*order, *payload)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *(F.col(f"_best.{c}").alias(c) for c in payload))
