"""Match matrix and what is read off it, in sparse long form keyed by rule_id.

``hits`` are (entry_id, rule_id). On generated strings an entry belongs to the one rule it was made
for; on real entries a rule's corpus is the set of entries it fires on, so the matrix counts common
entries. Zero cells are absent.

Defined results: null rules and entries are ignored, repeated hits count once, empty hits give
empty frames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_hits(hits: DataFrame, entry: str = "entry_id", rule: str = "rule_id") -> DataFrame:
    return hits.select(F.col(entry).alias("entry_id"), F.col(rule).alias("rule_id")).where("entry_id IS NOT NULL AND rule_id IS NOT NULL").distinct()


def matrix_of_corpus(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """(rule_id, source_rule_id, cnt) over the positive strings of a generated corpus."""
    positive = corpus.where("NOT is_negative").select("entry_id", "source_rule_id")
    return hits.join(positive, "entry_id").groupBy("rule_id", "source_rule_id").agg(F.count("*").alias("cnt"))


def matrix_of_entries(hits: DataFrame) -> DataFrame:
    """(rule_id, source_rule_id, cnt) of common entries, the diagonal included.

    Equal sets of firing rules are folded first, so the pairs of a set are formed once however many
    entries show it. A set holds at most as many rules as there are.
    """
    h = distinct_hits(hits)
    sets = h.groupBy("entry_id").agg(F.sort_array(F.collect_set("rule_id")).alias("rules")).groupBy("rules").agg(F.count("*").alias("n"))
    left = sets.select("rules", "n", F.explode("rules").alias("rule_id"))
    cells = left.select("rule_id", "n", F.explode("rules").alias("source_rule_id"))
    return cells.groupBy("rule_id", "source_rule_id").agg(F.sum("n").alias("cnt"))


def corpus_sizes(corpus: DataFrame) -> DataFrame:
    """(rule_id, n) of positive strings."""
    return corpus.where("NOT is_negative").groupBy(F.col("source_rule_id").alias("rule_id")).agg(F.count("*").alias("n"))


def entry_sizes(hits: DataFrame) -> DataFrame:
    """(rule_id, n) of entries the rule fires on."""
    return distinct_hits(hits).groupBy("rule_id").agg(F.count("*").alias("n"))


def overlap_counts(matrix: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, overlap_count): other known rules whose strings the rule matches; zero-filled."""
    known = rules.select("rule_id").distinct()
    others = matrix.where("rule_id <> source_rule_id AND cnt > 0").join(known.select(F.col("rule_id").alias("source_rule_id")), "source_rule_id", "left_semi")
    counts = others.groupBy("rule_id").agg(F.count("*").alias("overlap_count"))
    return known.join(counts, "rule_id", "left").na.fill(0, ["overlap_count"])


def fp_potential(matrix: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, fp_potential): matches on strings of other rules; zero-filled."""
    sums = matrix.where("rule_id <> source_rule_id").groupBy("rule_id").agg(F.sum("cnt").alias("fp_potential"))
    return rules.select("rule_id").distinct().join(sums, "rule_id", "left").na.fill(0, ["fp_potential"])


def unique_coverage(matrix: DataFrame, sizes: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, n, unique_coverage): own strings less the largest share any single other rule matches, at least 0."""
    most = matrix.where("rule_id <> source_rule_id").groupBy(F.col("source_rule_id").alias("rule_id")).agg(F.max("cnt").alias("most"))
    all_ = rules.select("rule_id").distinct().join(sizes, "rule_id", "left").join(most, "rule_id", "left").na.fill(0, ["n", "most"])
    return all_.select("rule_id", "n", F.greatest(F.lit(0).cast("bigint"), F.col("n") - F.col("most")).alias("unique_coverage"))


def exact_unique(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, only_here): entries on which no other rule fires."""
    alone = distinct_hits(hits).groupBy("entry_id").agg(F.count("*").alias("k"), F.first("rule_id").alias("rule_id")).where("k = 1")
    counts = alone.groupBy("rule_id").agg(F.count("*").alias("only_here"))
    return rules.select("rule_id").distinct().join(counts, "rule_id", "left").na.fill(0, ["only_here"])
