"""The programming interface: queries, expressions and arrays over an object store."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Generic, TypeVar

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from noteweave.functions.interpreter import Evaluator, call
from noteweave.functions.literals import Link, to_text, truthy, type_of
from noteweave.operators.arrays import DataArray
from noteweave.plans import ast as A
from noteweave.plans.parser import parse_date, parse_duration, parse_expression, parse_link, parse_query
from noteweave.plans.store import ObjectStore, Planner
from noteweave.sources.inline_fields import line_span

T = TypeVar("T")


@dataclass(frozen=True)
class Result(Generic[T]):
    """A value or an error."""

    value: T | None = None
    error: Exception | None = None

    @property
    def successful(self) -> bool:
        return self.error is None

    def map(self, f: Callable[[T], Any]) -> Result:
        return Result.trying(lambda: f(self.value)) if self.successful else self

    def flat_map(self, f: Callable[[T], Result]) -> Result:
        return f(self.value) if self.successful else self

    def or_else(self, other: T) -> T:
        return self.value if self.successful else other

    def or_raise(self) -> T:
        if self.error:
            raise self.error
        return self.value

    @staticmethod
    def trying(f: Callable[[], T]) -> Result[T]:
        try:
            return Result(f())
        except Exception as e:  # noqa: BLE001 - any failure is the result
            return Result(error=e)

    @staticmethod
    def all(results: list[Result]) -> Result:
        """The values of all results, or the first error."""
        bad = next((r for r in results if not r.successful), None)
        return bad or Result([r.value for r in results])


@dataclass(frozen=True)
class SearchResult:
    """A query with its lazy result, the seconds that planning took, and the highest revision in the result."""

    query: A.Query
    results: DataFrame
    duration: float

    @property
    def revision(self) -> int:
        if "revision" not in self.results.columns:
            return 0
        return self.results.agg(F.max("revision")).collect()[0][0] or 0


class coerce:  # noqa: N801 - a namespace
    """Conversions that give None where a value has no such form."""

    string = staticmethod(lambda v: None if v is None else to_text(v))
    boolean = staticmethod(lambda v: {"true": True, "false": False}.get(v.lower()) if isinstance(v, str) else truthy(v) if v is not None else None)
    number = staticmethod(lambda v: float(v) if isinstance(v, (bool, int, float)) else call("number", [v]) if isinstance(v, str) else None)
    date = staticmethod(lambda v: v if isinstance(v, dt.datetime) else parse_date(v) if isinstance(v, str) else call("date", [v]) if isinstance(v, Link) else None)
    duration = staticmethod(lambda v: v if type_of(v) == "duration" else parse_duration(v) if isinstance(v, str) else None)
    link = staticmethod(lambda v: v if isinstance(v, Link) else Link.parse(v.strip().removeprefix("!").removeprefix("[[").removesuffix("]]")) if isinstance(v, str) else None)
    array = staticmethod(lambda v: v if isinstance(v, list) else None if v is None else [v])


class Engine:
    """Everything that can be asked of an object store. ``source``: the file that asks, for relative links and ``this``;
    ``strict``: a row for which an expression has no value fails the query instead of not matching."""

    coerce = coerce

    def __init__(self, store: ObjectStore, source: str | None = None, *, strict: bool = False):
        self.store, self.source, self.strict = store, source, strict
        self._planned: dict[A.Query, DataFrame] = {}

    # queries

    def query(self, q: str | A.Query) -> DataFrame:
        return self.full_query(q).results

    def try_query(self, q: str | A.Query) -> Result[DataFrame]:
        return Result.trying(lambda: self.query(q))

    def full_query(self, q: str | A.Query) -> SearchResult:
        start = time.perf_counter()
        tree = A.simplify(parse_query(q) if isinstance(q, str) else q)
        if tree not in self._planned:  # equal queries share one plan
            self._planned[tree] = Planner(self.store, self._this(), folder=self._folder(), strict=self.strict).run(tree)
        return SearchResult(tree, self._planned[tree], time.perf_counter() - start)

    def try_full_query(self, q: str | A.Query) -> Result[SearchResult]:
        return Result.trying(lambda: self.full_query(q))

    def _this(self) -> dict[str, Any] | None:
        return self.store.load(self.source) if self.source else None

    def page(self, path: str | Link) -> Row | None:
        """The object of a file by its full path."""
        full = path.path if isinstance(path, Link) else path
        return next(iter(self.store.objects.where(F.col("id") == full).take(1)), None)

    def expand(self, q: str | A.Query, max_depth: int | None = None) -> DataFrame:
        """What ``q`` finds with everything below it, down to ``max_depth`` levels if one is given: root, level and the
        object's columns. An object below two of the found ones comes once for each. Needs a store with ``ancestors``."""
        found = self.query(q)
        paths = F.col("ancestors") if max_depth is None else F.slice("ancestors", 1, max_depth)
        below = self.store.objects.select("*", F.posexplode(paths).alias("_at", "root"))
        roots = found.select(F.col("id").alias("root"))
        down = below.withColumn("level", F.col("_at") + 1).drop("_at").join(roots, "root", "left_semi")
        return found.withColumns({"root": F.col("id"), "level": F.lit(0)}).unionByName(down)

    def array(self, data: DataFrame | list[Row], *order: str) -> DataArray:
        df = data if isinstance(data, DataFrame) else self.store.objects.sparkSession.createDataFrame(data)
        return DataArray.of(df, *(order or ("id",)))

    def local(self, path: str) -> Engine:
        """This interface as the file ``path`` sees it."""
        return Engine(self.store, path, strict=self.strict)

    def current_path(self) -> str | None:
        return self.source

    def current_file(self) -> Row | None:
        return self.page(self.source) if self.source else None

    def resolve_path(self, path: str | Link) -> str | None:
        """The full path of the file that a link's path names from here; None if there is none."""
        return self.store.find(Link(path.path if isinstance(path, Link) else path), self._folder())

    def _folder(self) -> str | None:
        return self.source.rpartition("/")[0] if self.source else None

    def element_text(self, element_id: str, content: DataFrame) -> str | None:
        """The lines of an object. ``content``: path, content of the files."""
        row = self.page(element_id)
        if row is None or row["position"] is None:
            return None
        text = content.where(F.col("path") == row["file"]).select("content").take(1)
        return line_span(text[0][0], row["position"]["start"], row["position"]["end"]) if text else None

    # parsing

    parse_query = staticmethod(parse_query)
    parse_link = staticmethod(parse_link)
    parse_expression = staticmethod(parse_expression)

    @staticmethod
    def try_parse_query(text: str) -> Result[A.Query]:
        return Result.trying(lambda: parse_query(text))

    @staticmethod
    def try_parse_link(text: str) -> Result[Link]:
        return Result.trying(lambda: parse_link(text))

    @staticmethod
    def file_link(path: str) -> Link:
        return Link(path)

    @staticmethod
    def header_link(path: str, header: str) -> Link:
        return Link(path, "header", header)

    @staticmethod
    def block_link(path: str, block: str) -> Link:
        return Link(path, "block", block)

    # expressions

    def evaluate(self, expression: str | A.Node, variables: dict[str, Any] | None = None) -> Any:
        """The value of an expression with the given variables; links lead to the objects of the store."""
        tree = parse_expression(expression) if isinstance(expression, str) else expression
        env = {**(variables or {})}
        if self.source and "this" not in env:
            env["this"] = self._this()
        return Evaluator(self._load).evaluate(tree, env)

    def try_evaluate(self, expression: str | A.Node, variables: dict[str, Any] | None = None) -> Result:
        return Result.trying(lambda: self.evaluate(expression, variables))

    def _load(self, link: Link) -> dict | None:
        target = self.store.find(link, self._folder())
        return self.store.load(target) if target else None
