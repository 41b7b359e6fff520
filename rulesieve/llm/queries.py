"""Queries of the training-data problems, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.llm import cofiring, components, contamination, pii, secrets, sharedspans, survivor, tokenizer
from rulesieve.session import table, trimmed

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(table(spark, d, "entries"), "entry_id").drop("end_at").distinct()


def p1_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(table(spark, d, "entries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = cofiring.pair_counts(table(spark, d, "rule_hits"), "entry_id", "rule_id", min_pair=4, min_share_inv=2000)
    return cofiring.over_chance(pairs, 4).select(F.col("item_a").alias("rule_id_a"), F.col("item_b").alias("rule_id_b"))


def _pairs_with_chance(spark: SparkSession, d: str, min_pair: int) -> DataFrame:
    pairs = cofiring.with_chance(cofiring.pair_counts(table(spark, d, "rule_hits"), "entry_id", "rule_id", min_pair=min_pair))
    return pairs.select(F.col("item_a").alias("rule_id_a"), F.col("item_b").alias("rule_id_b"), "n_ab", "n_a", "n_b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that fires together at least four times, with counts, lift and pmi."""
    return _pairs_with_chance(spark, d, 4)


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every pair that fires together at all, with counts, lift and pmi."""
    return _pairs_with_chance(spark, d, 1)


def _survivors(spark: SparkSession, d: str, precedence: bool) -> DataFrame:
    rules = table(spark, d, "rules")
    fields = {"keep": F.col("name"), "severity": survivor.present(F.lower(trimmed(F.col("severity")))), "source": survivor.present(F.col("source"))}
    return survivor.survivors(
        table(spark, d, "rule_clusters"), rules, "id", "rules", "name", fields,
        survivor.newest_first(rules) if precedence else [], survivor.present(F.col("source")), "keep",
    )


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d, True)


def p4_fused(spark: SparkSession, d: str) -> DataFrame:
    """The same groups fused by source reliability alone."""
    return _survivors(spark, d, False)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.find(table(spark, d, "entries"), "entry_id").distinct()


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact(table(spark, d, "entries"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "overlap_pairs").where("jaccard >= 0.6")
    name = lambda c: trimmed(F.col(c))
    linked = pairs.select(name("rule_a").alias("u"), name("rule_b").alias("v")).where("u <> '' AND v <> ''")
    links = linked.union(components.star_links(table(spark, d, "rule_clusters"), "rules"))
    return components.components(links).withColumnRenamed("name", "rule_name")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_corpus(table(spark, d, "documents"), "doc_id", "text")


def p8_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose decoded ids differ from their text (none), counted by language."""
    docs = table(spark, d, "documents")
    back = tokenizer.decode_corpus(tokenizer.encode_corpus(docs, "doc_id", "text"), "doc_id", "ids").withColumnRenamed("text", "decoded")
    same = docs.join(back, "doc_id").withColumn("same", F.coalesce("text", F.lit("")) == F.col("decoded"))
    return same.groupBy("lang").agg(F.count("*").alias("documents"), F.count_if(~F.col("same")).alias("changed"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "test_items"), "doc_id", "item_id", "text")


def p9_edited(spark: SparkSession, d: str) -> DataFrame:
    """Leaks of 13 words of which one may be changed, dropped or added."""
    return contamination.leaks(table(spark, d, "documents"), table(spark, d, "test_items"), "doc_id", "item_id", "text", edits=1, coordinates=6, recall=0.95)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return sharedspans.shared_chars(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p3_counts": p3_counts,
    "p4_found": p4_found,
    "p4_fused": p4_fused,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_found": p9_found,
    "p9_edited": p9_edited,
    "p10_found": p10_found,
}
