"""Pairs of rules: overlap ratios, relationship, recommendation, intervals.

Both directions of a pair are brought together by one aggregation on the ordered pair instead of a
self join; sizes and rule attributes come in by joins on rule_id, whose sides are as many as there
are rules. Comparisons use unrounded ratios; the output is rounded to 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesieve import schemas as S
from rulesieve.functions.stats import wilson


def pair_ratios(matrix: DataFrame, sizes: DataFrame) -> DataFrame:
    """(rule_a, rule_b, ab, ba, size_a, size_b, a2b, b2a, jaccard), rule_a < rule_b, unrounded.

    ab: strings of b that a matches. Pairs with no common match or an empty corpus are left out.
    """
    a, b = F.col("rule_id"), F.col("source_rule_id")
    pairs = (
        matrix.where(a != b)
        .groupBy(F.least(a, b).alias("rule_a"), F.greatest(a, b).alias("rule_b"))
        .agg(F.sum(F.when(a < b, F.col("cnt")).otherwise(0)).alias("ab"), F.sum(F.when(a > b, F.col("cnt")).otherwise(0)).alias("ba"))
        .where("ab > 0 OR ba > 0")
    )
    full = sizes.where("n > 0")
    of = lambda side: full.select(F.col("rule_id").alias(f"rule_{side}"), F.col("n").alias(f"size_{side}"))
    sized = pairs.join(of("a"), "rule_a").join(of("b"), "rule_b")
    common = F.least("ab", "ba")
    union = F.col("size_a") + F.col("size_b") - common
    return sized.select(
        "rule_a", "rule_b", "ab", "ba", "size_a", "size_b",
        (F.col("ab") / F.col("size_b")).alias("a2b"), (F.col("ba") / F.col("size_a")).alias("b2a"),
        F.when(union > 0, common / union).otherwise(0.0).alias("jaccard"),
    )


def _named(text: str, *columns: str) -> Column:
    return F.format_string(text, *[F.col(c) for c in columns])


def classify(ratios: DataFrame, rules: DataFrame, overlap_counts: DataFrame, threshold: float = 0.8, overlap_min: float = 0.2, catch_all_over: int = 5) -> DataFrame:
    """One row per pair that isn't disjoint. ``rules``: rule_id, name, source, priority, catch_all."""
    known = rules.select("rule_id", "name", "source", F.coalesce("priority", F.lit(0)).alias("priority"), "catch_all").join(overlap_counts, "rule_id", "left")
    wide = F.coalesce(F.col("catch_all"), F.coalesce(F.col("overlap_count"), F.lit(0)) > catch_all_over)
    known = known.select("rule_id", "name", "source", "priority", wide.alias("wide"))
    side = lambda s: known.select(*[F.col(c).alias({"rule_id": f"rule_{s}"}.get(c, f"{c}_{s}")) for c in known.columns])
    p = ratios.join(side("a"), "rule_a", "left").join(side("b"), "rule_b", "left")

    up, down = F.col("a2b") >= threshold, F.col("b2a") >= threshold
    some = (F.col("a2b") >= overlap_min) | (F.col("b2a") >= overlap_min)
    a_first, b_first = F.col("priority_a") > F.col("priority_b"), F.col("priority_b") > F.col("priority_a")
    relation = F.when(up & down, S.DUPLICATE).when(up, S.SUBSET).when(down, S.SUPERSET).when(some, S.OVERLAP).otherwise(S.DISJOINT)
    advice = (
        F.when(up & down, F.when(a_first, S.KEEP_A).when(b_first, S.KEEP_B).otherwise(S.REVIEW))
        .when(up, F.when(b_first | F.col("wide_a"), S.KEEP_BOTH).otherwise(S.KEEP_A))
        .when(down, F.when(a_first | F.col("wide_b"), S.KEEP_BOTH).otherwise(S.KEEP_B))
        .when(some, S.REVIEW)
        .otherwise(S.KEEP_BOTH)
    )
    # The texts of the reasons.
    from_source = lambda c: F.concat(F.lit("Higher priority source"), F.when(F.length(c) > 0, F.concat(F.lit(" ("), F.col(c), F.lit(")"))).otherwise(""))
    higher, umbrella, broader = "'%s' has higher priority but is a subset", "'%s' is a catch-all — dropping '%s' would lose its label", "'%s' is more comprehensive (superset)"
    reason = (
        F.when(up & down, F.when(a_first, from_source("source_a")).when(b_first, from_source("source_b")).otherwise("Equal priority — review manually"))
        .when(up, F.when(b_first, _named(higher, "name_b")).when(F.col("wide_a"), _named(umbrella, "name_a", "name_b")).otherwise(_named(broader, "name_a")))
        .when(down, F.when(a_first, _named(higher, "name_a")).when(F.col("wide_b"), _named(umbrella, "name_b", "name_a")).otherwise(_named(broader, "name_b")))
        .when(some, "Partial overlap — review manually")
        .otherwise("")
    )
    told = p.select(
        F.col("rule_a").alias("rule_id_a"), F.col("rule_b").alias("rule_id_b"),
        F.col("name_a").alias("rule_a"), F.col("name_b").alias("rule_b"), "source_a", "source_b", "priority_a", "priority_b",
        F.col("ab").alias("a_matches_b_corpus"), F.col("ba").alias("b_matches_a_corpus"), F.col("size_a").alias("a_corpus_size"), F.col("size_b").alias("b_corpus_size"),
        F.round("a2b", 4).alias("overlap_a_to_b"), F.round("b2a", 4).alias("overlap_b_to_a"), F.round("jaccard", 4).alias("jaccard"),
        relation.alias("relationship"), advice.alias("recommendation"), reason.alias("reason"),
        wilson(F.col("ab"), F.col("size_b")).alias("ci_a_to_b"), wilson(F.col("ba"), F.col("size_a")).alias("ci_b_to_a"),
    )
    lost = ((F.col("relationship") == S.SUBSET) & (F.col("recommendation") == S.KEEP_A)) | ((F.col("relationship") == S.SUPERSET) & (F.col("recommendation") == S.KEEP_B))
    return told.where(F.col("relationship") != S.DISJOINT).withColumn("downstream_label_loss", lost)


def totals(pairs: DataFrame) -> DataFrame:
    """One row of counts over pairs: duplicates, subsets, overlaps, drops and reviews."""
    n = lambda test, name: F.count_if(test).alias(name)
    r, a = F.col("relationship"), F.col("recommendation")
    return pairs.agg(
        n(r == S.DUPLICATE, "duplicate_pairs"), n(r.isin(S.SUBSET, S.SUPERSET), "subset_pairs"), n(r == S.OVERLAP, "overlap_pairs"),
        n(a.isin(S.KEEP_A, S.KEEP_B), "rules_recommended_drop"), n(a == S.REVIEW, "rules_recommended_review"),
    )
