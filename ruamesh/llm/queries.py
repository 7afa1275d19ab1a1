"""Queries of the problems on texts and typed names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruamesh.common import table
from ruamesh.llm.language import languages
from ruamesh.llm.leakage import leaks
from ruamesh.llm.names import street_ids, variant_pairs
from ruamesh.llm.tokens import encode


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(table(spark, sf, "gdf_edges").select("name"))


def p5_streets(spark: SparkSession, sf: str) -> DataFrame:
    """Each street by its id with the number of its spellings and the greatest of them."""
    ids = street_ids(table(spark, sf, "gdf_edges").select("name"))
    return ids.groupBy("sid").agg(F.count(F.lit(1)).alias("spellings"), F.max("name").alias("name"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return encode(table(spark, sf, "documents"))  # doc_id is unique


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    found = leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))
    return found.select("doc_id", "item_id").distinct()


def p8_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Items of which at least half stands in a document in runs of six words or more, in any order."""
    found = leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"), seed=6, least=6)
    return found.filter("covered >= 0.5 * n_words").select("doc_id", "item_id", "n_words", "longest", "covered").distinct()


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    found = languages(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))
    wrong = (F.col("seg") == 0) & F.col("lang").isNotNull() & ~F.coalesce(F.col("named") == F.col("lang"), F.lit(False))
    return found.filter(wrong | (F.col("seg") > 0) & (F.col("n_runs") > 1)).select("doc_id", "seg", "lang").distinct()


def p9_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Every document and segment with its language and confidence."""
    found = languages(table(spark, sf, "documents"), table(spark, sf, "lang_samples"))
    return found.select("doc_id", "seg", "lang", F.round("confidence", 3).alias("confidence"), "chars", "named").distinct()


QUERIES = {"p5_found": p5_found, "p5_streets": p5_streets, "p7_ids": p7_ids, "p8_found": p8_found, "p8_coverage": p8_coverage, "p9_found": p9_found, "p9_segments": p9_segments}
ORACLES = {
    "p8_found": r"""
WITH both_ AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM eval_items),
plain AS (SELECT DISTINCT kind, id, lower(strip_accents(replace(replace(replace(replace(replace(regexp_replace(text, '</?[A-Za-z][^<>]*>|<\|\w+\|>', ' ', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&nbsp;', ' '))) AS t FROM both_ WHERE text IS NOT NULL),
w AS (SELECT kind, id, regexp_extract_all(t, '[\p{L}\p{N}]+') AS w FROM plain),
g AS (SELECT kind, id, unnest(list_transform(range(1, len(w) - 10), lambda k: array_to_string(w[k:k + 11], ' '))) AS g FROM w WHERE len(w) >= 12)
SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON i.kind = 'i' AND i.g = d.g WHERE d.kind = 'd'
"""
}
