"""Clusters of rules: connected components over similar pairs.

Smallest-label propagation with pointer jumping; every round is one aggregation and two joins, and
the lineage is cut by a checkpoint. A chain of n rules takes O(log n) rounds. Clusters are ordered
by their smallest rule_id; members by priority, then rule_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rulesieve.session import cut


def labels(edges: DataFrame, most: int = 40) -> DataFrame:
    """(rule_id, label): label is the smallest rule_id reachable over edges (rule_a, rule_b)."""
    e = edges.select(F.col("rule_a").alias("u"), F.col("rule_b").alias("v")).where("u <> v")
    e = cut(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    now = cut(e.groupBy(F.col("u").alias("rule_id")).agg(F.least(F.min("v"), F.col("u")).alias("label")))
    for _ in range(most):
        near = e.join(now.withColumnsRenamed({"rule_id": "v"}), "v").groupBy(F.col("u").alias("rule_id")).agg(F.min("label").alias("seen"))
        step = now.join(near, "rule_id").select("rule_id", "label", F.least("label", "seen").alias("best"))
        # jump: the label of the label
        far = now.select(F.col("rule_id").alias("best"), F.col("label").alias("jump"))
        after = cut(step.join(far, "best", "left").select("rule_id", F.col("label").alias("was"), F.least("best", F.coalesce("jump", "best")).alias("label")))
        moved = after.where("was <> label").isEmpty()
        now = after.select("rule_id", "label")
        if moved:
            return now
    raise RuntimeError(f"components did not settle in {most} rounds")


def clusters(pairs: DataFrame, rules: DataFrame, threshold: float = 0.6) -> DataFrame:
    """(id, rules, keep, reason) over pairs with rounded jaccard >= threshold."""
    edges = pairs.where(F.round("jaccard", 4) >= threshold).select(F.col("rule_id_a").alias("rule_a"), F.col("rule_id_b").alias("rule_b"))
    member = labels(edges).join(rules.select("rule_id", "name", "source", F.coalesce("priority", F.lit(0)).alias("priority")), "rule_id")
    grouped = member.groupBy("label").agg(F.sort_array(F.collect_list(F.struct((-F.col("priority")).alias("p"), "rule_id", "name", "source"))).alias("m"))
    ranked = grouped.withColumn("id", F.row_number().over(Window.orderBy("label")))
    source = F.col("m")[0]["source"]
    # fixed value: the text of the reason
    reason = F.concat(F.lit("Highest priority in cluster"), F.when(F.length(source) > 0, F.concat(F.lit(" (from "), source, F.lit(")"))).otherwise(""))
    return ranked.select("id", F.col("m.name").alias("rules"), F.col("m")[0]["name"].alias("keep"), reason.alias("reason"))
