"""The stored vault tables, with late, repeated and re-sent rows resolved."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import latest, strip, table
from noteweave.operators.references import canonical_path
from noteweave.operators.shred import adjacency
from noteweave.operators.wide import MAX_COLUMNS, winners


def json_list(c: Column, element: str) -> Column:
    """The JSON list ``c`` as an array of ``element``, however it was stored: as a list, as an object
    keyed by position, as one bare object, or as any of these inside a JSON text. Unreadable: null."""
    text = F.when(F.substring(F.ltrim(c), 1, 1) == '"', F.get_json_object(c, "$")).otherwise(c)
    first = F.substring(F.ltrim(text), 1, 1)
    keyed = F.from_json(text, f"map<string,{element}>")
    by_position = text.rlike(r'^\s*\{\s*("\d+"|\})')
    return (
        F.when(first == "[", F.from_json(text, f"array<{element}>"))
        .when(by_position, F.map_values(keyed))
        .when(first == "{", F.array(F.from_json(text, element)))
    )


def file_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, since, until: each time a file was there. Of rows with one path and ctime the last loaded counts."""
    files = table(spark, sf_dir, "vault_files").select(canonical_path(F.col("file_path")).alias("key"), F.col("ctime").alias("since"), "loaded_at", "deleted_at")
    last = F.max(F.struct("loaded_at", "deleted_at")).alias("last")
    return files.groupBy("key", "since").agg(last).select("key", "since", F.col("last.deleted_at").alias("until"))


def page_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, at, ref_table, ref_file, ref_key of the links of pages."""
    return table(spark, sf_dir, "page_links").select(
        canonical_path(F.col("link_path")).alias("key"), F.col("seen_at").alias("at"), F.lit("page_links").alias("ref_table"), F.col("page_path").alias("ref_file"), F.col("link_id").cast("string").alias("ref_key")
    )


def canvas_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, at, ref_table, ref_file, ref_key of the files that cards of the latest canvases name."""
    cards = table(spark, sf_dir, "canvases").select(
        "canvas_path", "revision", "loaded_at", "mtime", F.transform(json_list(F.col("cards"), "struct<`$id`:string,`$linkedFile`:string>"), lambda x: F.struct(x["$id"].alias("id"), x["$linkedFile"].alias("file"))).alias("cards")
    )
    one = latest(cards, "canvas_path", ["mtime", "cards"], ["revision", "loaded_at"])
    return one.select("canvas_path", "mtime", F.explode("cards").alias("card")).select(
        canonical_path(F.col("card.file")).alias("key"), F.col("mtime").alias("at"), F.lit("canvases").alias("ref_table"), F.col("canvas_path").alias("ref_file"), F.col("card.id").alias("ref_key")
    )


def all_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_references(spark, sf_dir).unionByName(canvas_references(spark, sf_dir))


def field_key(c: Column) -> Column:
    """A field's key as it compares: without outer blanks, in lower case."""
    return F.lower(strip(c))


def declared_types(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    """The declared fields and their types: a table of fixed size, read by the driver. Repeated keys count once, by the
    type that is least by name; more than MAX_COLUMNS keys are an error of ``wide_table``."""
    keys = table(spark, sf_dir, "field_types").where("field_key is not null").groupBy(field_key(F.col("field_key")).alias("k")).agg(F.coalesce(F.min("field_type"), F.lit("text")).alias("t"))
    return {r["k"]: r["t"] for r in sorted(keys.limit(MAX_COLUMNS + 1).collect())}


def zoned_fields(spark: SparkSession, sf_dir: str, *, undeclared: bool = False) -> DataFrame:
    """page_fields with the declared ``field_key`` and ``field_type`` and the home ``zone`` of the vault; fields
    of ``undeclared`` keys have no type."""
    types = table(spark, sf_dir, "field_types").select(field_key(F.col("field_key")).alias("field_key"), "field_type")
    zones = table(spark, sf_dir, "vaults").select("vault", F.col("zone_name").alias("zone"))
    rows = table(spark, sf_dir, "page_fields").withColumn("field_key", field_key(F.col("entry_key")))
    return rows.join(types, "field_key", "left" if undeclared else "inner").join(zones, "vault", "left")


def field_order() -> list[Column]:
    """What of several fields of one page and key comes first: the highest revision, then frontmatter, then the smallest
    line, then the smallest field_id."""
    return [-F.coalesce("revision", F.lit(-(2**62))), F.when(F.col("origin") == "frontmatter", 0).otherwise(1), F.coalesce("line_no", F.lit(2**31 - 1)), F.col("field_id")]


def field_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_path, attribute, value, zone, vault: the row that wins each cell of the wide table, see ``field_order``.

    All fields of undeclared keys of a page are one cell without attribute and value, which keeps the page.
    """
    declared = F.col("field_type").isNotNull()
    rows = zoned_fields(spark, sf_dir, undeclared=True).withColumns({"attribute": F.when(declared, F.col("field_key")), "entry_value": F.when(declared, F.col("entry_value"))})
    return winners(rows, entity="page_path", attribute="attribute", order=field_order(), value=F.col("entry_value"), carry=["zone", "vault"])


def latest_rows(df: DataFrame, key: str, keep: list[str]) -> DataFrame:
    """The rows of the highest revision of each ``key``, the last loaded among them, without moving the wide
    columns through an aggregation. Exact repeats of such a row stay."""
    newest = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct("revision", "loaded_at")).alias("_n"))
    newest = newest.select(F.col(key).alias("_k"), F.col("_n.revision").alias("_r"), F.col("_n.loaded_at").alias("_l"))
    same = (F.col(key) == F.col("_k")) & F.col("revision").eqNullSafe(F.col("_r")) & F.col("loaded_at").eqNullSafe(F.col("_l"))
    return df.select(key, "revision", "loaded_at", *keep).join(newest, same, "left_semi").select(key, *keep)


NODE_LABELS = ["$cards", "$sections", "$blocks", "$elements"]
NODE_KINDS = ["card", "section", "block", "item"]


def page_adjacency(spark: SparkSession, sf_dir: str, scalars: list[str], scalars_of: str | None = None) -> DataFrame:
    pages = latest_rows(table(spark, sf_dir, "vault_pages"), "page_path", ["sections"])
    return adjacency(pages, key="page_path", text="sections", label="$sections", lists=["$blocks", "$elements"], scalars=scalars, scalars_of=scalars_of)


def canvas_adjacency(spark: SparkSession, sf_dir: str, scalars: list[str], scalars_of: str | None = None) -> DataFrame:
    boards = latest_rows(table(spark, sf_dir, "canvases"), "canvas_path", ["cards"])
    return adjacency(boards, key="canvas_path", text="cards", label="$cards", lists=["$sections", "$blocks", "$elements"], scalars=scalars, root_key="$id", scalars_of=scalars_of)
