"""The stored vault tables as an object store: pages and their sections, with fields, tags and links."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import strip, table
from noteweave.functions.columns import header_name
from noteweave.operators.references import canonical_path
from noteweave.operators.shred import entities
from noteweave.operators.wide import winners
from noteweave.plans.store import Field, ObjectStore
from noteweave.sources import vault_tables as V

_COLUMNS = ["id", "typename", "types", "parent_id", "ancestors", "file", "folder", "tags", "link_key", "title", "level", "line", "fields"]
_BOTH, _PAGE, _SECTION = frozenset(["Page", "Section"]), frozenset(["Page"]), frozenset(["Section"])
FIELDS = {
    "$id": Field("id", _BOTH), "$typename": Field("typename", _BOTH), "$types": Field("types", _BOTH), "$file": Field("file", _BOTH), "$path": Field("file", _PAGE), "$tags": Field("tags", _PAGE),
    "$title": Field("title", _SECTION), "$level": Field("level", _SECTION), "$line": Field("line", _SECTION),
}


def page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_path, fields: the winning values of all keys of each page as JSON, by key in lower case without outer blanks.
    Null and blank keys are none; of repeated keys the same row wins as in the wide table."""
    rows = table(spark, sf_dir, "page_fields").withColumn("attribute", V.field_key(F.col("entry_key"))).where("page_path is not null and attribute <> ''")
    won = winners(rows, entity="page_path", attribute="attribute", order=V.field_order(), value=strip(F.col("entry_value")), carry=[])
    entry = F.struct(F.col("attribute").alias("key"), F.coalesce("value", F.lit("null")).alias("value"))
    return won.groupBy("page_path").agg(F.map_from_entries(F.collect_list(entry)).alias("fields"))


def stored_vault(spark: SparkSession, sf_dir: str) -> ObjectStore:
    """Pages and the sections of their latest state. Links compare by canonical path and lead to pages, or to the first
    section of a title; tags are in lower case with ``#``. Pages that only the fields name are no objects."""
    path = F.col("page_path")
    latest = V.latest_rows(table(spark, sf_dir, "vault_pages"), "page_path", ["tags"]).distinct()
    bare = F.transform("tags", lambda t: F.concat(F.lit("#"), F.lower(strip(F.regexp_replace(strip(t), "^#+", "")))))
    no_text = F.lit(None).cast("string")
    pages = latest.join(page_fields(spark, sf_dir), "page_path", "left").select(
        path.alias("id"), F.lit("Page").alias("typename"), F.array(F.lit("file"), F.lit("page")).alias("types"), no_text.alias("parent_id"), F.array().cast("array<string>").alias("ancestors"), path.alias("file"),
        F.regexp_extract(path, "^(.*)/[^/]*$", 1).alias("folder"), F.coalesce(F.filter(bare, lambda t: t != "#"), F.array()).alias("tags"), path.alias("link_key"), no_text.alias("title"), F.lit(None).cast("int").alias("level"),
        F.lit(None).cast("bigint").alias("line"), F.coalesce("fields", F.create_map().cast("map<string,string>")).alias("fields"),
    )
    columns = {"title": ("$title", "string"), "level": ("$level", "int"), "line": ("$position.start", "bigint")}
    adjacent = V.page_adjacency(spark, sf_dir, [p for p, _ in columns.values()], "$sections")
    flat = entities(adjacent.where((F.col("label") == "$sections") | F.col("scalar").isNotNull()), labels=V.NODE_LABELS, columns=columns)
    header = header_name(F.col("title"))
    sections = flat.select(
        F.concat("doc", F.lit("#"), "node").alias("id"), F.lit("Section").alias("typename"), F.array(F.lit("section")).alias("types"), F.col("doc").alias("parent_id"), F.array("doc").alias("ancestors"), F.col("doc").alias("file"),
        F.regexp_extract("doc", "^(.*)/[^/]*$", 1).alias("folder"), F.array().cast("array<string>").alias("tags"), F.concat("doc", F.lit("#"), header).alias("link_key"), "title", "level", "line", F.create_map().cast("map<string,string>").alias("fields"),
    )
    objects = pages.unionByName(sections).select(*_COLUMNS)

    def resolve(wanted: DataFrame) -> DataFrame:
        files = pages.select(canonical_path(F.col("id")).alias("_key"), F.col("id").alias("_file")).groupBy("_key").agg(F.min("_file").alias("_file"))
        hit = wanted.withColumn("_key", canonical_path(F.col("path"))).join(files, "_key")
        whole = hit.where("type = 'file'").withColumn("dst_id", F.col("_file"))
        titled = sections.groupBy("link_key").agg(F.min_by("id", F.struct("line", "id")).alias("dst_id"))
        within = hit.where("type = 'header'").withColumn("link_key", F.concat("_file", F.lit("#"), "subpath")).join(titled, "link_key")
        return whole.select(*wanted.columns, "dst_id").unionByName(within.select(*wanted.columns, "dst_id"))

    links = table(spark, sf_dir, "page_links").where("page_path is not null").select("page_path", canonical_path(F.col("link_path")).alias("_key")).where("_key is not null").distinct()
    files = pages.select(canonical_path(F.col("id")).alias("_key"), F.col("id").alias("dst_id"))
    resolved = links.join(files, "_key").select(F.col("page_path").alias("src_id"), "dst_id").distinct()
    below = lambda source, inclusive: _below(pages, sections, source, inclusive).select(*_COLUMNS)
    above = lambda source, inclusive: _above(pages, sections, source, inclusive).select(*_COLUMNS)
    return ObjectStore(
        objects, dict(FIELDS), links=resolved.withColumnRenamed("dst_id", "dst_key"), resolved=lambda: resolved, json_fields="fields", resolve=resolve, descendants=below, ancestors=above,
        link_keys=lambda ids: ids.select(F.col("id").alias("dst_key")), linked_types=_PAGE,
    )


def _below(pages: DataFrame, sections: DataFrame, source: DataFrame, inclusive: bool) -> DataFrame:
    found = sections.join(source.where("typename = 'Page'").select(F.col("id").alias("file")), "file", "left_semi").select(*_COLUMNS)
    if not inclusive:
        return found
    own = sections.join(source.where("typename = 'Section'").select("id"), "id", "left_semi").select(*_COLUMNS)
    return pages.join(source.where("typename = 'Page'").select("id"), "id", "left_semi").select(*_COLUMNS).unionByName(found.unionByName(own).dropDuplicates(["id"]))


def _above(pages: DataFrame, sections: DataFrame, source: DataFrame, inclusive: bool) -> DataFrame:
    up = source.where("typename = 'Section'").select(F.regexp_extract("id", r"^(.*)#\d+$", 1).alias("id"))
    if not inclusive:
        return pages.join(up, "id", "left_semi").select(*_COLUMNS)
    own = sections.join(source.where("typename = 'Section'").select("id"), "id", "left_semi").select(*_COLUMNS)
    return pages.join(up.unionByName(source.where("typename = 'Page'").select("id")), "id", "left_semi").select(*_COLUMNS).unionByName(own)
