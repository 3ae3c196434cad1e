"""Queries of the text-corpus problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noteweave.common import strip, table
from noteweave.llm.cooccurrence import surprising_pairs
from noteweave.llm.encoding import encode_corpus
from noteweave.llm.leakage import find_leaks
from noteweave.llm.truncation import find_truncated
from noteweave.sources.vault_tables import latest_rows


def tag_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """basket, items: the tags of the latest state of each page, in lower case without outer blanks and leading ``#``."""
    pages = latest_rows(table(spark, sf_dir, "vault_pages"), "page_path", ["tags"]).distinct()
    bare = F.transform("tags", lambda t: F.lower(strip(F.regexp_replace(strip(t), "^#+", ""))))
    return pages.select(F.col("page_path").alias("basket"), F.filter(bare, lambda t: t != "").alias("items"))


def p3_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags on at least three pages, with counts, lift and surprise."""
    return surprising_pairs(tag_baskets(spark, sf_dir), min_count=3)


def p3_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counts and the lift of p3_surprise."""
    return p3_surprise(spark, sf_dir).select("a", "b", "n", "n_a", "n_b", "baskets", F.round("lift", 6).alias("lift"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of tags that are together more often than 3.1 times what independence gives."""
    pairs = surprising_pairs(tag_baskets(spark, sf_dir), min_count=3, min_share=1 / 400, min_lift=3.09)
    return pairs.where("n * 400 >= baskets and 10 * n * baskets > 31 * n_a * n_b").select(F.col("a").alias("tag_a"), F.col("b").alias("tag_b"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return encode_corpus(table(spark, sf_dir, "documents"))


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the test items that they leak, exactly or with replaced words."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold twenty consecutive words of a test item."""
    return p7_leaks(spark, sf_dir).where("exact_words >= 20").select("doc_id", "item_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text was cut."""
    return find_truncated(table(spark, sf_dir, "documents")).where("probability > 0.5").select("doc_id").distinct()


def p8_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, cut texts and their share by source."""
    judged = find_truncated(table(spark, sf_dir, "documents"))
    return judged.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("probability") > 0.5).alias("cut")).withColumn("share", F.col("cut") / F.col("n"))


QUERIES = {f.__name__: f for f in (p3_surprise, p3_counts, p3_found, p6_ids, p7_leaks, p7_found, p8_found, p8_report)}
_TAGS = """WITH latest AS (SELECT DISTINCT page_path, tags FROM vault_pages QUALIFY rank() OVER (PARTITION BY page_path ORDER BY revision DESC, loaded_at DESC) = 1),
t AS (SELECT DISTINCT page_path, lower(trim(regexp_replace(trim(u), '^#+', ''))) AS tag FROM latest, unnest(tags) AS x(u)),
s AS (SELECT page_path, tag FROM t WHERE tag <> ''),
c AS (SELECT tag, count(*) AS k FROM s GROUP BY tag),
n AS (SELECT count(DISTINCT page_path) AS pages FROM s),
p AS (SELECT x.tag AS tag_a, y.tag AS tag_b, count(*) AS n FROM s x JOIN s y ON x.page_path = y.page_path AND x.tag < y.tag GROUP BY ALL HAVING count(*) >= 3)
"""
_WORDS = """WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS w FROM documents WHERE text <> ''), t AS (SELECT item_id, regexp_extract_all(lower(item_text), '[\\p{L}\\p{N}]+') AS w FROM eval_items WHERE item_text <> ''),
tg AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 18)) AS i FROM t)),
dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 19], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d))
"""
SQL = {
    "p7_found": _WORDS + "SELECT DISTINCT doc_id, item_id FROM dg JOIN tg USING (g)",
    "p3_counts": _TAGS + "SELECT tag_a AS a, tag_b AS b, p.n, a.k AS n_a, b.k AS n_b, pages AS baskets, round(p.n::DOUBLE * pages / (a.k::DOUBLE * b.k), 6) AS lift FROM p JOIN c a ON a.tag = tag_a JOIN c b ON b.tag = tag_b, n",
    "p3_found": _TAGS + "SELECT tag_a, tag_b FROM p JOIN c a ON a.tag = tag_a JOIN c b ON b.tag = tag_b, n WHERE p.n * 400 >= pages AND p.n::DOUBLE * pages / (a.k::DOUBLE * b.k) > 3.1",
}
