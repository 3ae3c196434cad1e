"""Queries over the stored vault as objects: fields of no fixed kind, links and parents; and the live index."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import table
from noteweave.plans import ast as A
from noteweave.plans.store import Planner
from noteweave.sources.stored import stored_vault
from noteweave.streaming.live import LiveIndex

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_PATH = r"lower(regexp_replace(trim(url_decode(trim({0}))), '^(\./|/)+', ''))"
_KEY = rf"CASE WHEN regexp_matches({_PATH}, '\.[^./\s]+$') THEN {_PATH} ELSE concat({_PATH}, '.md') END"
_BASE = rf"""WITH last AS (SELECT DISTINCT page_path AS page, tags, sections FROM vault_pages WHERE page_path IS NOT NULL QUALIFY rank() OVER (PARTITION BY page_path ORDER BY revision DESC, loaded_at DESC) = 1),
pages AS (SELECT DISTINCT page, tags FROM last),
w AS (SELECT page_path AS page, lower(trim(entry_key)) AS k, trim(entry_value) AS v FROM page_fields WHERE page_path IS NOT NULL AND trim(entry_key) <> ''
  QUALIFY row_number() OVER (PARTITION BY page_path, lower(trim(entry_key)) ORDER BY coalesce(revision, -4611686018427387904) DESC, origin = 'frontmatter' DESC, coalesce(line_no, 2147483647), field_id) = 1),
f AS (SELECT page, k, v, try_cast(v AS DOUBLE) AS num, try_cast(concat(regexp_replace(CASE length(v->>'$.value') WHEN 7 THEN concat(v->>'$.value', '-01T00:00') WHEN 10 THEN concat(v->>'$.value', 'T00:00') ELSE v->>'$.value' END, '\[(.*)\]', ' \1'), CASE WHEN regexp_matches(v->>'$.value', '(Z|\]|T.*[+-]\d\d:?\d\d)$') THEN '' ELSE '+00' END) AS TIMESTAMPTZ) AS moment, CASE coalesce(json_type(v), 'NULL') WHEN 'NULL' THEN 'null' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' WHEN 'BOOLEAN' THEN 'boolean'
    WHEN 'OBJECT' THEN CASE WHEN v->>'$."$_type"' IN ('date', 'duration', 'link') THEN v->>'$."$_type"' ELSE 'object' END ELSE 'number' END AS kind
  FROM w SEMI JOIN pages USING (page)),
files AS (SELECT {_KEY.format('page')} AS key, min(page) AS dst FROM pages GROUP BY 1),
up AS (SELECT f.page, f.k, files.dst FROM f JOIN files ON files.key = {_KEY.format('''(f.v->>'$.value.path')''')} WHERE kind = 'link'),
s0 AS (SELECT DISTINCT page, CASE WHEN json_valid(sections) THEN CASE json_type(sections) WHEN 'VARCHAR' THEN sections::JSON->>'$' ELSE sections END END AS t FROM last),
s1 AS (SELECT page, unnest(CASE json_type(t) WHEN 'ARRAY' THEN json_extract(t, '$[*]') ELSE CASE WHEN list_bool_and(list_transform(json_keys(t), lambda x: regexp_matches(x, '^\d+$'))) IS NOT FALSE THEN json_extract(t, '$.*') ELSE [t::JSON] END END) AS s FROM s0 WHERE t IS NOT NULL),
sections AS (SELECT page, s->>'$."$title"' AS title, (s->>'$."$level"')::INT AS level, (s->>'$."$position".start')::BIGINT AS line FROM s1),
links AS (SELECT DISTINCT page_path AS page, dst FROM page_links JOIN files ON files.key = {_KEY.format('link_path')} WHERE page_path IS NOT NULL AND trim(link_path) <> '')
"""


def _query(name: str, query: str | A.Query, sql: str, *columns: str) -> None:
    """Register what ``query`` finds, by id or by ``columns``; ``sql`` goes on _BASE."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return Planner(stored_vault(spark, sf_dir)).run(query).select(*(columns or ("id",)))

    run.__doc__ = query if isinstance(query, str) else repr(query)
    QUERIES[name], SQL[name] = run, _BASE + sql


_HIGH = "kind = 'number' AND num > 500 OR kind > 'number'"
_query("v_sections", "@section", "SELECT page AS file, title, level, line FROM sections", "file", "title", "level", "line")
_query("v_tag_sub", "#bucket and @page", "SELECT DISTINCT page AS id FROM pages, unnest(tags) AS x(t) WHERE regexp_matches(lower(trim(regexp_replace(trim(t), '^#+', ''))), '^bucket(/|$)')")
_query("v_exists", "@page and exists(summary)", "SELECT page AS id FROM f WHERE k = 'summary'")
_query("v_number", "@page and rating > 500", f"SELECT page AS id FROM f WHERE k = 'rating' AND kind <> 'null' AND ({_HIGH})")
_query("v_number_least", "@page and budget <= 500", "SELECT page AS id FROM f WHERE k = 'budget' AND (kind = 'null' OR kind = 'number' AND num <= 500 OR kind < 'number')")
_query("v_text", '@page and status = "active"', "SELECT page AS id FROM f WHERE k = 'status' AND v = '\"active\"'")
_TRUE = "kind = 'boolean' AND v = 'true' OR kind = 'number' AND num <> 0 OR kind = 'string' AND v <> '\"\"' OR kind = 'array' AND json_array_length(v) > 0 OR kind = 'object' AND len(json_keys(v)) > 0 OR kind IN ('date', 'link', 'duration')"
_query("v_truth", "@page and done", f"SELECT page AS id FROM f WHERE k = 'done' AND ({_TRUE})")
_query("v_not", "@page and !done", f"SELECT DISTINCT page AS id FROM pages WHERE page NOT IN (SELECT page FROM f WHERE k = 'done' AND ({_TRUE}))")
_query("v_not_in_expression", "@page and expr(!done)", f"SELECT page AS id FROM f WHERE k = 'done' AND NOT ({_TRUE})")
_query("v_date", "@page and due >= date(2023-01-01)", "SELECT page AS id FROM f WHERE k = 'due' AND kind <> 'null' AND (kind = 'date' AND moment >= TIMESTAMPTZ '2023-01-01 00:00:00+00' OR kind > 'date')")
_query("v_date_part", "@page and due.year = 2023", "SELECT page AS id FROM f WHERE k = 'due' AND kind = 'date' AND (v->>'$.value')[:4] = '2023'")
_query("v_duration", "@page and effort > dur(5 hours) and typeof(effort) = \"duration\"", "SELECT page AS id FROM f WHERE k = 'effort' AND kind = 'duration' AND 10080 * coalesce(try_cast(regexp_extract(v->>'$.value', '(\\d+) ?w', 1) AS INT), 0) + 60 * coalesce(try_cast(regexp_extract(v->>'$.value', '(\\d+) ?(h|H)', 1) AS INT), 0) + 1440 * coalesce(try_cast(regexp_extract(v->>'$.value', '(\\d+) ?(d|D)', 1) AS INT), 0) + coalesce(try_cast(regexp_extract(v->>'$.value', '(\\d+) ?(m|M)', 1) AS INT), 0) > 300")
_query("v_equal_values", A.FieldEquals("archived", (True, "no", None)), "SELECT page AS id FROM f WHERE k = 'archived' AND (v IS NULL OR v IN ('true', '\"no\"', 'null'))")
_query("v_deref", "@page and rating > [[Atlas/Start Here]].rating", "SELECT f.page AS id FROM f LEFT JOIN (SELECT v, num, kind FROM f WHERE page = 'Atlas/Start Here.md' AND k = 'rating') t ON true WHERE k = 'rating' AND f.kind <> 'null' AND (t.kind IS NULL OR f.kind > t.kind OR f.kind = t.kind AND (f.kind = 'number' AND f.num > t.num OR f.kind = 'string' AND f.v > t.v))")
_query("v_link_field", "@page and up.rating > 500", f"SELECT DISTINCT up.page AS id FROM up JOIN f ON f.page = up.dst WHERE up.k = 'up' AND f.k = 'rating' AND kind <> 'null' AND ({_HIGH})")
_query("v_link_hops", "@page and project.up.rating > 500", f"SELECT DISTINCT a.page AS id FROM up a JOIN up b ON b.page = a.dst JOIN f ON f.page = b.dst WHERE a.k = 'project' AND b.k = 'up' AND f.k = 'rating' AND kind <> 'null' AND ({_HIGH})")
_query("v_parent", "@section and $parent.rating > 500", f"SELECT page AS file, title, line FROM sections SEMI JOIN (SELECT page FROM f WHERE k = 'rating' AND kind <> 'null' AND ({_HIGH})) USING (page)", "file", "title", "line")
_query("v_childof", "@section and $level > 1 and childof(@page and archived = true)", "SELECT page AS file, title, line FROM sections SEMI JOIN (SELECT page FROM f WHERE k = 'archived' AND v = 'true') USING (page) WHERE level > 1", "file", "title", "line")
_query("v_parentof", '@page and parentof(@section and $level > 3)', "SELECT DISTINCT page AS id FROM sections WHERE level > 3")
_query("v_linksto", "linksto(@page and archived = true)", "SELECT DISTINCT page AS id FROM links WHERE dst IN (SELECT page FROM f WHERE k = 'archived' AND v = 'true') AND page IN (SELECT page FROM pages) AND page NOT IN (SELECT page FROM f WHERE k = 'archived' AND v = 'true')")
_query("v_linkedfrom", "linkedfrom([[Atlas/Start Here]])", "SELECT DISTINCT dst AS id FROM links WHERE page = 'Atlas/Start Here.md' AND dst <> page")
_query("v_function", '@page and contains(status, "o") and length(string(status)) > 4', "SELECT page AS id FROM f WHERE k = 'status' AND kind = 'string' AND contains(v->>'$', 'o') AND length(v->>'$') > 4")


def _files(rows: DataFrame, content: str) -> DataFrame:
    return rows.selectExpr("concat('customers/', c_custkey, '.md') AS path", f"{content} AS content", "timestamp'2024-01-01' AS ctime", "timestamp'2024-01-01' AS mtime", "1L AS size")


def _customers(spark: SparkSession, sf_dir: str) -> tuple[LiveIndex, DataFrame]:
    """An index of a file per customer."""
    rows = table(spark, sf_dir, "customer")
    index = LiveIndex(spark)
    index.apply(_files(rows, "concat('balance:: ', c_acctbal, '\\n\\n# Orders\\nsegment:: ', c_mktsegment, '\\n')"))
    return index, rows


def live_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The revision of each page once those of one segment have changed."""
    index, rows = _customers(spark, sf_dir)
    index.apply(_files(rows.where("c_mktsegment = 'BUILDING'"), "'balance:: 0\\n'"))
    return index.query("@page").select("id", "revision")


def live_upsert_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an index holds once some files have changed and others have gone, with all that was in them."""
    index, rows = _customers(spark, sf_dir)
    index.apply(_files(rows.where("c_acctbal < 0"), "'state:: debt\\n'"))
    index.apply(None, _files(rows.where("c_nationkey = 3"), "''").select("path"))
    return index.query("@page or @section and segment != \"BUILDING\" or state = \"debt\"").select("id", "revision")


QUERIES |= {f.__name__: f for f in (live_revision, live_upsert_delete)}
_PAGE_ID = "concat('customers/', c_custkey, '.md')"
SQL["live_revision"] = f"SELECT {_PAGE_ID} AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 2 ELSE 1 END::BIGINT AS revision FROM customer"
SQL["live_upsert_delete"] = f"""WITH c AS (SELECT {_PAGE_ID} AS id, c_acctbal < 0 AS debt, c_mktsegment AS s, c_custkey AS k FROM customer WHERE c_nationkey <> 3)
SELECT id, CASE WHEN debt THEN 2 ELSE 1 END::BIGINT AS revision FROM c UNION ALL SELECT concat(id, '/section1/Orders'), 1::BIGINT FROM c WHERE NOT debt AND s <> 'BUILDING' UNION ALL SELECT concat(id, '/section0/', k), 2::BIGINT FROM c WHERE debt UNION ALL SELECT concat(id, '/block1'), 2::BIGINT FROM c WHERE debt"""
