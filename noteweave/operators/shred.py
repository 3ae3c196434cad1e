"""Deeply nested JSON as an adjacency table, and flat entity tables made from it.

Shredding stores every object as a node with its parent, label and ordinal, and every scalar as a child
of its object. Object nodes then meet their scalar children in one grouping, which pivots the scalars
into typed columns; a join of the nodes with themselves adds what is asked of the parent.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADJACENCY = "doc string, root string, node int, parent int, label string, ordinal int, scalar string, above string"
_SCHEMA = pa.schema([("doc", pa.string()), ("root", pa.string()), ("node", pa.int32()), ("parent", pa.int32()), ("label", pa.string()), ("ordinal", pa.int32()), ("scalar", pa.string()), ("above", pa.string())])
#: Rows of the adjacency table that are handed over at once.
_CHUNK = 100_000


def members(value: Any) -> list[dict]:
    """The objects of a list, however it was stored: as a list, as an object keyed by position, as one
    bare object, or as any of these inside a JSON text. Anything else, unreadable text included, has none."""
    while isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return []
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if isinstance(value, dict):
        if all(k.isdigit() for k in value):
            return [value[k] for k in sorted(value, key=int) if isinstance(value[k], dict)]
        return [value]
    return []


def scalar_text(value: Any) -> str | None:
    """A scalar as text, as JSON writes it but for the quotes of a text; null for null, lists and objects."""
    if isinstance(value, str):
        return value
    return None if value is None or isinstance(value, (list, dict)) else json.dumps(value)


def adjacency_rows(doc: str, text: str | None, label: str, lists: tuple[str, ...], scalars: tuple[tuple[str, ...], ...], root_key: str | None, scalars_of: str | None = None) -> Iterator[tuple]:
    """Rows of ADJACENCY for one JSON list of objects."""
    count, leaves = 0, -2
    named = [(path, ".".join(path)) for path in scalars]
    stack: list[tuple[Any, str, int, str | None, str | None]] = [(text, label, -1, None, None)]
    while stack:
        value, name, parent, root, above = stack.pop()
        for ordinal, item in enumerate(members(value)):
            node, top = count, root
            count += 1
            if parent < 0:
                top = scalar_text(item.get(root_key)) if root_key else ""
            yield doc, top, node, parent, name, ordinal, None, above
            for path, full in named if scalars_of in (None, name) else ():
                inner: Any = item
                for step in path:
                    inner = inner.get(step) if isinstance(inner, dict) else None
                if (leaf := scalar_text(inner)) is not None:
                    yield doc, top, leaves, node, full, 0, leaf, name
                    leaves -= 1
            for child in lists:
                if item.get(child) is not None:
                    stack.append((item[child], child, node, top, name))


def adjacency(docs: DataFrame, *, key: str, text: str, label: str, lists: Iterable[str], scalars: Iterable[str], root_key: str | None = None, scalars_of: str | None = None) -> DataFrame:
    """The adjacency table of the JSON lists in column ``text``: doc, root, node, parent, label, ordinal, scalar, above.

    ``label`` names the outermost list, ``lists`` the keys that hold lists of objects at any depth,
    ``scalars`` the dotted paths to keep, of the objects in lists ``scalars_of`` only where it is given:
    what no later step needs isn't stored. An object row has no scalar; a scalar row has its object as
    parent. Objects are numbered from 0 up, the same whatever scalars are kept, and scalars from -2 down.
    The parent of an outermost object is -1. ``above`` is the parent's label. ``root`` is
    the scalar ``root_key`` of the outermost object ('' without it). Null, blank and unreadable texts
    give no rows. Repeated documents give repeated rows.
    """
    args = (label, tuple(lists), tuple(tuple(s.split(".")) for s in scalars), root_key, scalars_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, body in zip(batch.column(0), batch.column(1)):
                rows.extend(adjacency_rows(doc.as_py(), body.as_py(), *args))
                if len(rows) >= _CHUNK:
                    yield _pack(rows)
                    rows = []
            if rows:
                yield _pack(rows)

    return docs.select(F.col(key).cast("string"), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(run, ADJACENCY)


def _pack(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SCHEMA.types)], schema=_SCHEMA)


def entities(adj: DataFrame, *, labels: Iterable[str], columns: dict[str, tuple[str, str]]) -> DataFrame:
    """One row per object node: doc, root, node, parent, kind, ordinal, above and the ``columns``.

    ``kind`` is the position of the node's label in ``labels``, ``above`` that of its parent's label. ``columns`` maps a name to the scalar path
    and SQL type that fill it; a scalar of another type gives null. Exact repeats of a document fold
    together here; a document without a key has no nodes.
    """
    is_node = F.col("scalar").isNull()
    own = adj.withColumn("owner", F.when(is_node, F.col("node")).otherwise(F.col("parent")))
    code, above = (F.coalesce(*(F.when(F.col(c) == name, i) for i, name in enumerate(names))) for names in [list(labels)] for c in ("label", "above"))
    pivot = [F.max(F.when(~is_node & (F.col("label") == path), F.col("scalar").try_cast(kind))).alias(name) for name, (path, kind) in columns.items()]
    own = own.where(F.col("doc").isNotNull() & F.col("owner").isNotNull())
    return own.groupBy("doc", "root", F.col("owner").alias("node")).agg(
        F.max(F.when(is_node, F.col("parent"))).alias("parent"), F.max(F.when(is_node, code)).alias("kind"), F.max(F.when(is_node, F.col("ordinal"))).alias("ordinal"), F.max(F.when(is_node, above)).alias("above"), *pivot
    )


def with_parents(nodes: DataFrame, *columns: str) -> DataFrame:
    """``nodes`` with ``parent_<column>`` of the parent node; null for outermost nodes."""
    up = nodes.select(F.col("doc").alias("_doc"), F.col("root").alias("_root"), F.col("node").alias("_node"), F.col("parent").alias("_grand"), *(F.col(c).alias(f"parent_{c}") for c in columns))
    same = (F.col("doc") == F.col("_doc")) & F.col("root").eqNullSafe(F.col("_root")) & (F.col("parent") == F.col("_node"))
    # a parent is always numbered before its children; asking for it keeps both sides' columns alike, so
    # that the shuffle of the nodes is made once and read twice
    return nodes.join(up, same & (F.col("_grand") < F.col("node")), "left").drop("_doc", "_root", "_node", "_grand")


def kind_name(c: Column, names: list[str]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), c + 1)
