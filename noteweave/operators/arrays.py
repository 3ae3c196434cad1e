"""An ordered array of rows as a lazy DataFrame.

The order is carried as sort columns whose last one is unique, so that no step numbers all rows. Steps
that need positions count the rows ahead, or number rows range by range.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cmp_to_key
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noteweave.common import shared_path, shelve

Row2Col = Callable[[Column], Column]
Comparator = Callable[[Any, Any], int]

#: The first so many rows are taken by a top-k of every task; others by their position.
TOP = 10_000
#: A comparator of one's own is asked about so many different keys at most; more are an error.
MAX_COMPARED = 100_000


def _sorts(order: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in order]


@dataclass(frozen=True)
class DataArray:
    """Rows ``df`` in ``order``: pairs of column and whether it ascends; the last column is unique."""

    df: DataFrame
    order: tuple[tuple[str, bool], ...]

    @staticmethod
    def of(df: DataFrame, *order: str) -> DataArray:
        """``df`` ordered by ``order``; a leading ``-`` descends."""
        return DataArray(df, tuple((c.lstrip("-"), not c.startswith("-")) for c in order))

    # one row to one or more

    def where(self, test: Column) -> DataArray:
        return replace(self, df=self.df.where(F.coalesce(test, F.lit(False))))

    filter = where

    def map(self, **columns: Column) -> DataArray:
        """Rows of the named values, and the sort columns that aren't among them."""
        kept = [c for c, _ in self.order if c not in columns]
        return replace(self, df=self.df.select(*kept, *(v.alias(k) for k, v in columns.items())))

    def mutate(self, **columns: Column) -> DataArray:
        return replace(self, df=self.df.withColumns(columns))

    def flat_map(self, values: Column, name: str = "value") -> DataArray:
        """A row per element of the array ``values``; null and empty arrays give none."""
        sorts = [c for c, _ in self.order]
        out = self.df.select(*sorts, F.posexplode(values).alias("_at", name))
        return DataArray(out, (*self.order, ("_at", True)))

    def to(self, column: str) -> DataArray:
        """The column's values without nulls; arrays are opened one level."""
        if self.df.schema[column].dataType.simpleString().startswith("array"):
            out = self.flat_map(F.col(column), "value")
            return out.where(F.col("value").isNotNull())
        return self.into(column)

    def into(self, column: str) -> DataArray:
        """The column's values without nulls, arrays as they are."""
        return self.where(F.col(column).isNotNull()).map(value=F.col(column))

    def expand(self, children: DataFrame, *, key: str, child: str) -> DataArray:
        """These rows and everything below them. ``children``: (key, child) pairs of ``key`` values and the rows
        of their children, with this array's columns. Rows whose ``child`` column is null are dropped, but not
        those of an empty list. A level is a join; each level is written, so that depth doesn't add up.

        There is no limit of depth; a row below itself raises a ValueError. To see it, rows hand down the key
        that their ancestor at the last depth that is a power of two had: every cycle meets its own in time."""
        spark, columns = self.df.sparkSession, self.df.columns
        kinds = self.df.unionByName(children.select(*columns)).schema
        path, depth = shared_path(spark, "levels"), 0
        id_type = children.schema[key].dataType
        level = self.df.withColumns({"_mark": F.lit(None).cast(id_type), "_again": F.lit(None).cast(id_type)})
        while True:
            level = level.where(F.col(child).isNotNull()).select(*(F.col(f.name).cast(f.dataType) for f in kinds), F.lit(depth).alias("_depth"), "_mark", "_again")
            level.write.parquet(f"{path}/{depth}")
            level = spark.read.schema(level.schema).parquet(f"{path}/{depth}")
            rows, again = level.agg(F.count("*"), F.max("_again")).first()
            if again is not None:
                raise ValueError(f"{again!r} is below itself")
            if not rows:
                break
            depth += 1
            below = level.select(F.explode(child).alias("_below"), F.col("_mark").alias("_above")).join(children, F.col("_below") == F.col(key))
            mark = F.col(key) if depth & (depth - 1) == 0 else F.col("_above")
            level = below.withColumns({"_mark": mark, "_again": F.when(F.col(key) == F.col("_above"), F.col(key))})
        out = spark.read.schema(level.schema).option("recursiveFileLookup", True).parquet(path)
        return DataArray(out.drop("_mark", "_again"), (("_depth", True), *self.order))

    # order and position

    def sort(self, key: Column | None = None, direction: str = "asc", comparator: Comparator | None = None) -> DataArray:
        """A stable sort: equal keys stay in their order, nulls are least. A ``comparator`` (negative, zero or positive for
        two keys) orders the different keys on the driver, MAX_COMPARED of them at most; a key column that
        Spark can order needs none and has no bound."""
        if key is None:
            return self
        name = f"_key{len(self.order)}"
        df = self.df.withColumn(name, key)
        if comparator:
            df = _placed(df, name, comparator)
        return DataArray(df, ((name, direction == "asc"), *self.order))

    sort_in_place = sort

    def ordered(self) -> DataFrame:
        return self.df.orderBy(*_sorts(self.order))

    def limit(self, n: int) -> DataArray:
        """The first ``n`` rows; a negative ``n`` leaves out the last ones."""
        return self.slice(0, n)

    def slice(self, start: int = 0, end: int | None = None) -> DataArray:
        """Rows from ``start`` up to ``end``; negative numbers count from the end. Up to TOP rows from the start are a
        top-k; all else goes by positions, so that no task gets all rows."""
        if start >= 0 and end is not None and 0 <= end <= TOP:
            out = self.ordered().limit(end)
            return replace(self, df=out.offset(start) if start else out)
        if start == 0 and end is None:
            return self
        rows = self.indexed("_index")
        size = rows.count() if start < 0 or end is not None and end < 0 else 0
        lo = max(size + start, 0) if start < 0 else start
        hi = None if end is None else max(size + end, 0) if end < 0 else end
        kept = F.col("_index") >= lo if hi is None else (F.col("_index") >= lo) & (F.col("_index") < hi)
        return replace(self, df=rows.where(kept).drop("_index"))

    def at(self, n: int) -> DataFrame:
        return self.slice(n, n + 1 if n != -1 else None).df

    def first(self) -> DataFrame:
        return self.ordered().limit(1)

    def last(self) -> DataFrame:
        return self.df.orderBy(*_sorts(tuple((c, not up) for c, up in self.order))).limit(1)

    def page(self, number: int, size: int = 50) -> DataFrame:
        return self.slice(number * size, (number + 1) * size).df

    def paged(self, number: int, size: int = 50) -> Page:
        """A page with its number, brought into those there are, and how many rows and pages there are."""
        total = self.length()
        pages = -(-total // size)
        number = min(max(number, 0), max(pages - 1, 0))
        return Page(self.page(number, size), number, pages, total)

    def find(self, test: Column) -> DataFrame:
        return self.where(test).first()

    def find_index(self, test: Column, start: int = 0) -> int:
        """Position of the first row from ``start`` on that passes, or -1."""
        rows = self.slice(start) if start else self
        hit = rows.where(test).ordered().select(*(c for c, _ in self.order)).take(1)
        if not hit:
            return -1
        return self.df.where(self._before(hit[0])).count()

    def index_of(self, column: str, value: object, start: int = 0) -> int:
        return self.find_index(F.col(column).eqNullSafe(F.lit(value)), start)

    def includes(self, column: str, value: object) -> bool:
        return not self.df.where(F.col(column).eqNullSafe(F.lit(value))).isEmpty()

    def _before(self, row) -> Column:
        out, same = F.lit(False), F.lit(True)
        for c, up in self.order:
            col, v = F.col(c), row[c]
            least_null = (col.isNull() & F.lit(v is not None)) if up else (col.isNotNull() & F.lit(v is None))
            ahead = least_null | F.coalesce(col < F.lit(v) if up else col > F.lit(v), F.lit(False)) if v is not None else least_null
            out, same = out | same & ahead, same & col.eqNullSafe(F.lit(v))
        return out

    def indexed(self, name: str = "index") -> DataFrame:
        """All rows with their position. Rows are sorted range by range and numbered within each; only the
        number of rows per range goes to the driver."""
        parts = self.df.repartitionByRange(*_sorts(self.order)).sortWithinPartitions(*_sorts(self.order))
        held = shelve(parts.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "ranges")
        counts = held.groupBy("_part").agg(F.count("*").alias("_n"))
        ahead = counts.withColumn("_ahead", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
        return held.join(F.broadcast(ahead), "_part").withColumn(name, F.col("_at") + F.col("_ahead")).drop("_part", "_at", "_ahead")

    # groups and sets

    def group_by(self, comparator: Comparator | None = None, **keys: Column) -> Groups:
        """Groups by keys; by a ``comparator`` those keys are one group that it calls equal, under the first of them."""
        rows = self.mutate(**keys)
        if comparator:
            for k in keys:
                rows = replace(rows, df=_placed(rows.df, k, comparator, name_of=True))
        return Groups(rows, tuple(keys))

    def distinct(self, *keys: str, comparator: Comparator | None = None) -> DataArray:
        """The first row of each key, in the order of the keys. Every task keeps one row of a key before rows move, so a hot
        key is no load. A ``comparator`` tells which keys are equal, as in ``group_by``."""
        if comparator:
            names = {k: f"_same_{k}" for k in keys}
            df = self.df.withColumns({n: F.col(k) for k, n in names.items()})
            for n in names.values():
                df = _placed(df, n, comparator)
            out = replace(self, df=df).distinct(*names.values())
            return out
        first = Window.partitionBy(*keys).orderBy(*_sorts(self.order))
        kept = self.df.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")
        return DataArray(kept, (*((k, True) for k in keys), *self.order))

    def concat(self, other: DataArray | DataFrame) -> DataArray:
        """These rows, then those of ``other``, which has the same columns."""
        rest = other.df if isinstance(other, DataArray) else other
        out = self.df.withColumn("_side", F.lit(0)).unionByName(rest.withColumn("_side", F.lit(1)), allowMissingColumns=True)
        return DataArray(out, (("_side", True), *self.order))

    # whole array

    def every(self, test: Column) -> Column:
        return F.coalesce(F.every(F.coalesce(test, F.lit(False))), F.lit(True))

    def some(self, test: Column) -> Column:
        return F.coalesce(F.some(F.coalesce(test, F.lit(False))), F.lit(False))

    def none(self, test: Column) -> Column:
        return ~self.some(test)

    def length(self) -> int:
        return self.df.count()

    def chain(self, f: Callable[[DataArray], DataArray]) -> DataArray:
        return f(self)

    def for_each(self, f: Callable) -> None:
        self.df.foreach(f)

    def array(self) -> list:
        """The rows on the driver."""
        return self.ordered().collect()

    def __iter__(self):
        return iter(self.ordered().toLocalIterator())

    def join_text(self, text: Column, separator: str = ", ") -> Column:
        """An aggregate that joins texts in order; the result is one value, so it is for bounded arrays."""
        rows = F.array_sort(F.collect_list(F.struct(*(F.col(c) for c, _ in self.order), text.alias("_t"))))
        return F.array_join(F.transform(rows, lambda r: F.coalesce(r["_t"], F.lit("-"))), separator)


def _placed(df: DataFrame, column: str, comparator: Comparator, *, name_of: bool = False) -> DataFrame:
    """``df`` with the place of each key of ``column`` in the order of a comparator, equal keys on one place; or with
    the first key of that place (``name_of``)."""
    rows = df.select(column).distinct().limit(MAX_COMPARED + 1).collect()
    if len(rows) > MAX_COMPARED:
        raise ValueError(f"a comparator orders {MAX_COMPARED} different keys at most")
    keys = sorted((r[0] for r in rows), key=cmp_to_key(comparator))
    places, first = [], 0
    for i, k in enumerate(keys):
        first = first if i and comparator(keys[first], k) == 0 else i
        places.append((k, first, keys[first]))
    kind = df.schema[column].dataType.simpleString()
    table = df.sparkSession.createDataFrame(places, f"_held {kind}, _place int, _first {kind}")
    out = df.join(F.broadcast(table), F.col(column).eqNullSafe(F.col("_held")))
    return out.withColumn(column, F.col("_first" if name_of else "_place")).drop("_held", "_place", "_first")


@dataclass(frozen=True)
class Page:
    """One page of rows."""

    rows: DataFrame
    number: int
    pages: int
    total: int


@dataclass(frozen=True)
class Groups:
    """Rows in groups, outer keys first. Groups stay rows of one DataFrame: no task holds a whole group."""

    rows: DataArray
    keys: tuple[str, ...]

    def group_in(self, **keys: Column) -> Groups:
        """Groups within the groups."""
        return Groups(self.rows.mutate(**keys), (*self.keys, *keys))

    def aggregate(self, **values: Column) -> DataFrame:
        return self.rows.df.groupBy(*self.keys).agg(*(v.alias(k) for k, v in values.items())).orderBy(*(F.col(k).asc_nulls_first() for k in self.keys))

    def count(self) -> int:
        """The number of leaves."""
        return self.rows.df.count()

    def sorted_rows(self) -> DataArray:
        return DataArray(self.rows.df, (*((k, True) for k in self.keys), *self.rows.order))

    def slice(self, start: int, end: int) -> Groups:
        """The leaves from ``start`` up to ``end`` across all groups; groups without any fall away."""
        kept = self.sorted_rows().slice(start, end)
        return Groups(DataArray(kept.df, self.rows.order), self.keys)

    def nested(self, *columns: str) -> DataFrame:
        """A row per innermost group with its ``rows`` as an array in order: for groups of bounded size."""
        held = F.collect_list(F.struct(*(F.col(c) for c, _ in self.rows.order), *(F.col(c).alias(f"v_{c}") for c in columns)))
        shown = F.transform(F.array_sort(held), lambda r: F.struct(*(r[f"v_{c}"].alias(c) for c in columns)))
        return self.rows.df.groupBy(*self.keys).agg(shown.alias("rows")).orderBy(*(F.col(k).asc_nulls_first() for k in self.keys))
