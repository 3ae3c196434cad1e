"""A vault index that takes in changed files, and live queries on it.

The objects are kept in buckets of files. A batch of changed files rewrites the buckets that hold them, beside the
old ones; then a manifest names the buckets of the new revision, which makes it valid at once. An index that is
opened again goes on from its last manifest. There may be one writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from noteweave.common import listing, read_text, remove, shared_path, write_text
from noteweave.plans.ast import Query
from noteweave.plans.parser import parse_query
from noteweave.plans.store import ObjectStore, Planner
from noteweave.sources.markdown import OBJECTS, parse_files, vault_store

FILES = "path string, content string, ctime timestamp, mtime timestamp, size bigint"
#: Of what is stored. Objects of another version are not read: their files must be read again.
VERSION = 2
#: Files are spread over so many buckets by the hash of their path.
BUCKETS = 64


@dataclass
class Watch:
    """A live query: ``callback`` gets the result whenever it has changed."""

    query: Query
    callback: Callable[[DataFrame], None]
    seen: Any = None


@dataclass
class LiveIndex:
    """The objects of a vault at the latest revision, in ``folder``; without a folder it lasts as long as the application.

    ``outdated`` tells that the folder holds objects of another version, which are not there for queries:
    ``reindex`` replaces them.
    """

    spark: SparkSession
    folder: str = ""
    buckets: int = BUCKETS
    listeners: list[Callable[[str, Any], None]] = field(default_factory=list)
    watches: list[Watch] = field(default_factory=list)
    revision: int = 0
    outdated: bool = False
    _places: dict[str, str] = field(default_factory=dict)
    _batches: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.folder = self.folder or shared_path(self.spark, "index")
        names = [n for n in listing(self.spark, f"{self.folder}/manifests") if n.endswith(".json")]
        if names:
            held = json.loads(read_text(self.spark, f"{self.folder}/manifests/{names[-1]}"))
            self.revision, self.outdated = held["revision"], held["version"] != VERSION
            if not self.outdated:
                self.buckets, self._places, self._batches = held["buckets"], held["places"], held["batches"]

    # reading

    def objects(self) -> DataFrame:
        if not self._places:
            return self.spark.createDataFrame([], OBJECTS)
        return self._read(self._places.values())

    def _read(self, places) -> DataFrame:
        return self.spark.read.schema(OBJECTS).parquet(*(f"{self.folder}/{p}" for p in sorted(places)))

    def _bucket(self, path: Column) -> Column:
        return F.pmod(F.xxhash64(path), F.lit(self.buckets)).cast("int")

    def store(self) -> ObjectStore:
        return vault_store(self.objects())

    def query(self, q: str | Query, this: dict[str, Any] | None = None) -> DataFrame:
        return Planner(self.store(), this).run(q)

    # changing

    def apply(self, changed: DataFrame | None = None, deleted: DataFrame | None = None, *, batch: tuple[str, int] | None = None) -> int:
        """Take in ``changed`` files (FILES; of several rows of a path the last changed counts) and drop the files of
        ``deleted`` (path), with all objects in them. Returns the new revision. A ``batch`` (name of its stream,
        number) that was taken in before changes nothing. Only the buckets of these files are read and written."""
        if batch and self._batches.get(batch[0], -1) >= batch[1]:
            return self.revision
        paths = [df.select("path") for df in (changed, deleted) if df is not None]
        revision, places = self.revision + 1, dict(self._places)
        if paths:
            gone = (paths[0] if len(paths) == 1 else paths[0].unionByName(paths[1])).where("path is not null").distinct()
            touched = [str(r[0]) for r in gone.select(self._bucket(F.col("path"))).distinct().collect()]  # so many at most as there are buckets
            held = [places[b] for b in touched if b in places]
            old = self._read(held) if held else self.spark.createDataFrame([], OBJECTS)
            rows = old.join(gone.select(F.col("path").alias("file")), "file", "left_anti").select(*old.columns)
            if changed is not None:
                last = changed.where("path is not null").groupBy("path").agg(F.max(F.struct("mtime", "size", "ctime", "content")).alias("f"))
                rows = rows.unionByName(parse_files(last.select("path", "f.content", "f.ctime", "f.mtime", "f.size"), revision))
            data = f"data/{revision}"
            rows.withColumn("bucket", self._bucket(F.col("file"))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/{data}")
            written = set(listing(self.spark, f"{self.folder}/{data}"))
            for b in touched:
                if f"bucket={b}" in written:
                    places[b] = f"{data}/bucket={b}"
                else:
                    places.pop(b, None)
        return self._commit(revision, places, batch)

    def _commit(self, revision: int, places: dict[str, str], batch: tuple[str, int] | None = None) -> int:
        """Make a revision valid. What neither it nor the one before needs is deleted."""
        before = set(self._places.values())
        self.revision, self._places, self.outdated = revision, places, False
        if batch:
            self._batches[batch[0]] = batch[1]
        held = {"version": VERSION, "revision": revision, "buckets": self.buckets, "places": places, "batches": self._batches}
        write_text(self.spark, f"{self.folder}/manifests/{revision:012d}.json", json.dumps(held))
        for name in listing(self.spark, f"{self.folder}/manifests")[:-2]:
            remove(self.spark, f"{self.folder}/manifests/{name}")
        needed = {*places.values(), *before}
        for r in listing(self.spark, f"{self.folder}/data"):
            buckets = [b for b in listing(self.spark, f"{self.folder}/data/{r}") if b.startswith("bucket=")]
            dropped = [b for b in buckets if f"data/{r}/{b}" not in needed]
            if len(dropped) == len(buckets) and int(r) < revision:
                remove(self.spark, f"{self.folder}/data/{r}")
            elif int(r) < revision:
                for b in dropped:
                    remove(self.spark, f"{self.folder}/data/{r}/{b}")
        self._notify()
        return revision

    def rename(self, old: str, new: str, file: DataFrame) -> int:
        """A file under another path: ``file`` has it there."""
        revision = self.apply(file, self.spark.createDataFrame([(old,)], "path string"))
        for f in self.listeners:
            f("rename", (old, new))
        return revision

    def clear(self) -> int:
        return self._commit(self.revision + 1, {})

    def reindex(self, files: DataFrame) -> int:
        """Nothing but ``files``, whatever was there before."""
        self._places = {}
        return self.apply(files)

    def touch(self) -> int:
        return self._commit(self.revision + 1, dict(self._places))

    def sync(self, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Against a full ``listing`` (path, mtime): the paths that are new or changed, and those that are gone."""
        known = self.objects().where(F.col("id") == F.col("file")).select(F.col("file").alias("path"), F.col("mtime").alias("known"))
        changed = listing.join(known, "path", "left").where(F.col("known").isNull() | (F.col("mtime") > F.col("known"))).select("path")
        return changed, known.join(listing, "path", "left_anti").select("path")

    # following

    def watch(self, q: str | Query, callback: Callable[[DataFrame], None]) -> Watch:
        w = Watch(parse_query(q) if isinstance(q, str) else q, callback)
        self.watches.append(w)
        self._check(w)
        return w

    def watch_file(self, path: str, callback: Callable[[DataFrame], None]) -> Watch:
        from noteweave.plans.ast import ById

        return self.watch(ById(path), callback)

    def unwatch(self, w: Watch) -> None:
        self.watches.remove(w)

    def _check(self, w: Watch) -> None:
        """Call back if another set of objects, or another revision of one, matches."""
        found = self.query(w.query)
        digest = tuple(found.agg(F.count("*"), F.max("revision"), F.sum(F.xxhash64("id", "revision").cast("decimal(38,0)"))).collect()[0])
        if digest != w.seen:
            w.seen = digest
            w.callback(found)

    def _notify(self) -> None:
        for f in self.listeners:
            f("update", self.revision)
        for w in self.watches:
            self._check(w)

    def follow(self, source: str, checkpoint: str, *, every: str = "500 milliseconds", max_files: int = 1000, once: bool = False) -> StreamingQuery:
        """Take in files below ``source`` as they come, in batches of ``max_files``; what is new within ``every`` comes
        in one batch. A batch that Spark hands over again after a crash is not taken in twice. Files that were deleted
        don't come by themselves: see ``sync``."""
        root = source.rstrip("/").removeprefix("file:").lstrip("/") + "/"
        raw = self.spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", max_files).load(source)
        text = F.when(F.lower("path").rlike(r"\.(md|markdown|canvas)$"), F.decode("content", "UTF-8"))
        files = raw.select(F.regexp_replace("path", r"^(?:\w+:)?/*\Q" + root + r"\E", "").alias("path"), text.alias("content"), F.col("modificationTime").alias("ctime"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        writer = files.writeStream.foreachBatch(lambda batch, number: self.apply(batch, batch=(checkpoint, number)) and None).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
