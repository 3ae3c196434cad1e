"""Queries of the general data problems: wide tables, orphan references, instants."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.operators.instants import normalise_instants
from noteweave.operators.references import orphan_references, orphan_report
from noteweave.operators.shred import entities, kind_name, with_parents
from noteweave.operators.wide import wide_table
from noteweave.sources import vault_tables as V


def p1_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page with a typed column per declared field."""
    return wide_table(V.field_cells(spark, sf_dir), V.declared_types(spark, sf_dir), entity="page_path", source="vault")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the wide table that have a value, but not one of the declared type."""
    return p1_wide(spark, sf_dir).select("page_path", F.explode("misfits").alias("field_key"))


def p1_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the fields of text, list, number and boolean: the pages that have a value, of the declared type or not."""
    types = V.declared_types(spark, sf_dir)
    names = [c for c, t in types.items() if t in ("text", "list", "number", "boolean")]
    filled = [F.when(F.col(f"`{c}`").isNotNull() | F.array_contains("misfits", c), F.lit(c)) for c in names]
    return p1_wide(spark, sf_dir).select(F.explode(F.array_compact(F.array(*filled))).alias("field_key")).groupBy("field_key").agg(F.count("*").alias("pages"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose file isn't there at the time of the reference."""
    return orphan_references(V.all_references(spark, sf_dir), V.file_lives(spark, sf_dir)).drop("at")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, month and kind."""
    return orphan_report(orphan_references(V.all_references(spark, sf_dir), V.file_lives(spark, sf_dir)))


def _nodes(adj: DataFrame, top: str) -> DataFrame:
    """The p4_found rows of one adjacency table, whose outermost nodes lie in a ``top``."""
    flat = entities(adj, labels=V.NODE_LABELS, columns={"line": ("$position.start", "bigint")})
    flat = flat.withColumn("line", F.when(F.col("kind") == 0, F.lit(-1).cast("bigint")).otherwise(F.col("line")))
    linked = with_parents(flat, "kind", "line")
    outer = F.col("parent") < 0
    return linked.select(
        F.col("doc").alias("file_path"),
        F.col("root").alias("card_id"),
        kind_name(F.col("kind"), V.NODE_KINDS).alias("node_kind"),
        F.col("line").alias("node_line"),
        F.when(outer, F.lit(top)).otherwise(kind_name(F.col("parent_kind"), V.NODE_KINDS)).alias("parent_kind"),
        F.when(outer, F.lit(-1).cast("bigint")).otherwise(F.col("parent_line")).alias("parent_line"),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every card, section, block and item of all pages and canvases, with its parent."""
    pages = _nodes(V.page_adjacency(spark, sf_dir, ["$position.start"]), "page")
    return pages.unionByName(_nodes(V.canvas_adjacency(spark, sf_dir, ["$position.start"]), "canvas"))


_LINES = {"line_from": ("$position.start", "bigint"), "line_to": ("$position.end", "bigint")}
#: The columns of the entity tables: the scalars of each kind of node. A card's ``$id`` is its card_id.
SCALARS: dict[str, dict[str, tuple[str, str]]] = {
    "card": {
        "type": ("$type", "string"), "file": ("$file", "string"), "x": ("$position.x", "double"), "y": ("$position.y", "double"), "width": ("$dimensions.width", "double"), "height": ("$dimensions.height", "double"),
        "color": ("$color", "string"), "linked_file": ("$linkedFile", "string"), "url": ("$url", "string"),
        "link_path": ("$link.path", "string"), "link_type": ("$link.type", "string"), "link_subpath": ("$link.subpath", "string"), "link_display": ("$link.display", "string"), "link_embed": ("$link.embed", "boolean"),
    },
    "section": {"number": ("$ordinal", "int"), "title": ("$title", "string"), "level": ("$level", "int"), **_LINES},
    "block": {"number": ("$ordinal", "int"), "type": ("$type", "string"), "block_id": ("$blockId", "string"), "style": ("$style", "string"), "content_from": ("$contentPosition.start", "bigint"), "content_to": ("$contentPosition.end", "bigint"), **_LINES},
    "item": {"type": ("$type", "string"), "status": ("$status", "string"), "symbol": ("$symbol", "string"), "text": ("$text", "string"), "block_id": ("$blockId", "string"), "parent_line": ("$parentLine", "bigint"), **_LINES},
}


def _entity_table(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """The nodes of one kind of all pages and canvases: file_path, card_id, node, parent, parent_kind, ordinal and
    their scalars. ``parent`` is the parent's ``node`` in the table of its kind, -1 for a page or canvas."""
    at, columns = V.NODE_KINDS.index(kind), SCALARS[kind]

    def nodes(read: Callable[..., DataFrame], top: str) -> DataFrame:
        label = V.NODE_LABELS[at]
        adj = read(spark, sf_dir, [path for path, _ in columns.values()], label)
        flat = entities(adj.where((F.col("label") == label) | F.col("scalar").isNotNull()), labels=V.NODE_LABELS, columns=columns)
        above = F.when(F.col("parent") < 0, F.lit(top)).otherwise(kind_name(F.col("above"), V.NODE_KINDS)).alias("parent_kind")
        return flat.select(F.col("doc").alias("file_path"), F.col("root").alias("card_id"), "node", "parent", above, "ordinal", *columns)

    canvases = nodes(V.canvas_adjacency, "canvas")
    return canvases if kind == "card" else nodes(V.page_adjacency, "page").unionByName(canvases)


def p4_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of the cards of canvases."""
    return _entity_table(spark, sf_dir, "card")


def p4_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of the sections of pages and cards."""
    return _entity_table(spark, sf_dir, "section")


def p4_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of the blocks of all sections."""
    return _entity_table(spark, sf_dir, "block")


def p4_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entity table of the list items and tasks of all blocks, at any depth."""
    return _entity_table(spark, sf_dir, "item")


def p5_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date field with its instant, or why it has none."""
    rows = V.zoned_fields(spark, sf_dir).where("field_type = 'date'")
    return normalise_instants(rows, key="field_id", source="vault", raw="entry_raw", zone="zone").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date fields that name one valid moment, and that moment."""
    return p5_instants(spark, sf_dir).where("epoch_ms is not null").select("field_id", "epoch_ms").distinct()


QUERIES = {f.__name__: f for f in (p1_wide, p1_filled, p1_found, p2_found, p2_report, p4_found, p4_cards, p4_sections, p4_blocks, p4_items, p5_instants, p5_found)}
_ORPHANS = r"""WITH c0 AS (SELECT DISTINCT canvas_path, mtime, CASE WHEN json_valid(cards) THEN (CASE json_type(cards) WHEN 'VARCHAR' THEN cards::JSON->>'$' ELSE cards END) END AS cards
  FROM (SELECT * FROM canvases QUALIFY rank() OVER (PARTITION BY canvas_path ORDER BY revision DESC, loaded_at DESC) = 1)),
c1 AS (SELECT canvas_path, mtime, unnest(CASE WHEN json_type(cards) = 'ARRAY' THEN json_extract(cards, '$[*]') ELSE json_extract(cards, '$.*') END) AS card FROM c0 WHERE cards IS NOT NULL),
refs AS (SELECT 'page_links' AS ref_table, page_path AS ref_file, link_id::VARCHAR AS ref_key, link_path AS p, seen_at AS t0 FROM page_links UNION SELECT 'canvases', canvas_path, card->>'$."$id"', card->>'$."$linkedFile"', mtime FROM c1),
n AS (SELECT *, lower(regexp_replace(trim(url_decode(trim(p))), '^(\./|/)+', '')) AS b FROM refs WHERE p IS NOT NULL),
k AS (SELECT *, CASE WHEN regexp_matches(b, '\.[^./\s]+$') THEN b ELSE concat(b, '.md') END AS key FROM n WHERE b <> ''),
f AS (SELECT lower(file_path) AS key, ctime, deleted_at FROM vault_files QUALIFY row_number() OVER (PARTITION BY file_path, ctime ORDER BY loaded_at DESC) = 1),
o AS (SELECT ref_table, ref_file, ref_key, t0, count(f.key) AS c, min(f.ctime) AS m, bool_or(f.ctime <= t0 AND (f.deleted_at IS NULL OR f.deleted_at > t0)) AS alive FROM k LEFT JOIN f USING (key) GROUP BY ALL),
r AS (SELECT *, CASE WHEN c = 0 THEN 'missing' WHEN m > t0 THEN 'late' ELSE 'deleted' END AS orphan_kind FROM o WHERE NOT coalesce(alive, false))
"""
_TEXT = "(CASE WHEN json_type(x) = 'VARCHAR' THEN CASE WHEN json_valid(x->>'$') THEN (x->>'$')::JSON END ELSE x END)"
_LIST = rf"""CASE json_type({_TEXT}) WHEN 'ARRAY' THEN json_extract({_TEXT}, '$[*]') WHEN 'OBJECT' THEN
    CASE WHEN list_bool_and(list_transform(json_keys({_TEXT}), lambda k: regexp_matches(k, '^\d+$'))) IS NOT FALSE THEN json_extract({_TEXT}, '$.*') ELSE [{_TEXT}] END END"""
_NODES = rf"""WITH RECURSIVE last_pages AS (SELECT DISTINCT page_path AS file, sections AS t FROM vault_pages WHERE page_path IS NOT NULL QUALIFY rank() OVER (PARTITION BY page_path ORDER BY revision DESC, loaded_at DESC) = 1),
last_boards AS (SELECT DISTINCT canvas_path AS file, cards AS t FROM canvases WHERE canvas_path IS NOT NULL QUALIFY rank() OVER (PARTITION BY canvas_path ORDER BY revision DESC, loaded_at DESC) = 1),
tops AS (SELECT file, 'page' AS top, 'section' AS kind, t::JSON AS x FROM last_pages WHERE json_valid(t) UNION ALL SELECT file, 'canvas', 'card', t::JSON FROM last_boards WHERE json_valid(t)),
nodes AS (
  SELECT file, kind, top AS parent_kind, -1::BIGINT AS parent_line, NULL::VARCHAR AS card, unnest({_LIST}) AS s FROM tops
  UNION ALL
  SELECT file, label, kind, CASE WHEN kind = 'card' THEN -1 ELSE (s->>'$."$position".start')::BIGINT END, CASE WHEN kind = 'card' THEN s->>'$."$id"' ELSE card END, unnest({_LIST})
  FROM (SELECT n.*, l.label, json_extract(n.s, l.path) AS x FROM nodes n, (VALUES ('section', '$."$sections"'), ('block', '$."$blocks"'), ('item', '$."$elements"')) AS l(label, path) WHERE json_type(n.s) = 'OBJECT') WHERE x IS NOT NULL
)
SELECT file AS file_path, coalesce(CASE WHEN kind = 'card' THEN s->>'$."$id"' ELSE card END, '') AS card_id, kind AS node_kind, CASE WHEN kind = 'card' THEN -1 ELSE (s->>'$."$position".start')::BIGINT END AS node_line, parent_kind, parent_line FROM nodes WHERE json_type(s) = 'OBJECT'
"""
_FILLED = r"""WITH pages AS (SELECT page_path AS page, lower(trim(entry_key)) AS k, entry_value AS v FROM page_fields WHERE page_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY page_path, lower(trim(entry_key)) ORDER BY coalesce(revision, -4611686018427387904) DESC, origin = 'frontmatter' DESC, coalesce(line_no, 2147483647), field_id) = 1)
SELECT k AS field_key, count(*) AS pages FROM pages WHERE k IN (SELECT lower(trim(field_key)) FROM field_types WHERE field_type IN ('text', 'list', 'number', 'boolean'))
AND v IS NOT NULL AND json_type(v) <> 'NULL' AND NOT (json_type(v) = 'VARCHAR' AND regexp_matches(v->>'$', '^[\s\x{A0}\x{2000}-\x{200B}\x{3000}\x{FEFF}]*$')) GROUP BY 1"""
SQL: dict[str, str] = {
    "p1_filled": _FILLED,
    "p4_found": _NODES,
    "p2_found": _ORPHANS + "SELECT ref_table, ref_file, ref_key, orphan_kind FROM r",
    "p2_report": _ORPHANS + "SELECT ref_table, strftime(t0, '%Y-%m') AS month, orphan_kind, count(*) AS n FROM r GROUP BY ALL",
}
