"""Rules on real entries: counts, co-firing, precision and recall, drift between two corpora.

``hits`` are (entry_id, rule_id), ``entries`` (entry_id, text, label, source). Labelled means a
label that is neither null nor empty. All frames are zero-filled over the rules.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.operators.match import match
from rulesieve.operators.matrix import distinct_hits

DRIFT = 0.05


def latest(entries: DataFrame, version: str = "ingested_at") -> DataFrame:
    """One row per entry_id: the one delivered last."""
    rest = [c for c in ("text", "label", "source") if c in entries.columns]
    return entries.groupBy("entry_id").agg(F.max_by(F.struct(*rest), version).alias("e")).select("entry_id", *[F.col(f"e.{c}").alias(c) for c in rest])


def latest_hits(entries: DataFrame, rules: DataFrame, version: str = "ingested_at", **how) -> DataFrame:
    """(entry_id, rule_id) of the rules that fire on the last delivery of each entry.

    Deliveries are matched where they stand and sorted out by their keys afterwards, so ids and hits
    are shuffled and texts are not.
    """
    told = entries.withColumn("delivery", F.struct("entry_id", version))
    hits = match(told, rules, entry_key="delivery", **how).select("delivery.*", "rule_id")
    last = entries.groupBy("entry_id").agg(F.max(version).alias(version))
    return hits.join(last, (hits["entry_id"] == last["entry_id"]) & hits[version].eqNullSafe(last[version]), "left_semi").select("entry_id", "rule_id").distinct()


def match_counts(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, name, matched_count) of every rule."""
    counts = distinct_hits(hits).groupBy("rule_id").agg(F.count("*").alias("matched_count"))
    return rules.select("rule_id", "name").join(counts, "rule_id", "left").na.fill(0, ["matched_count"])


def never_firing(hits: DataFrame, rules: DataFrame) -> DataFrame:
    return rules.select("rule_id", "name").join(distinct_hits(hits).select("rule_id"), "rule_id", "left_anti")


def co_firing(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_a, rule_b, count) by name, rule_a < rule_b.

    Equal firing sets are folded before pairs are formed; a set holds at most the number of rules.
    """
    named = distinct_hits(hits).join(rules.select("rule_id", "name"), "rule_id")
    sets = named.groupBy("entry_id").agg(F.sort_array(F.collect_set("name")).alias("names")).where(F.size("names") > 1).groupBy("names").agg(F.count("*").alias("n"))
    left = sets.select("names", "n", F.posexplode("names").alias("at", "rule_a"))
    pairs = left.select("rule_a", "n", F.explode(F.slice("names", F.col("at") + 2, F.size("names"))).alias("rule_b"))
    return pairs.groupBy("rule_a", "rule_b").agg(F.sum("n").alias("count"))


def co_firing_top(pairs: DataFrame, n: int = 100) -> DataFrame:
    return pairs.orderBy(F.desc("count"), "rule_a", "rule_b").limit(n)


def labels_of(rules: DataFrame) -> DataFrame:
    """(rule_id, label): a rule's name and its tags; ``name = label or label in tags`` as an equi join."""
    return rules.select("rule_id", F.explode(F.array_union(F.array("name"), F.coalesce("tags", F.array().cast("array<string>")))).alias("label")).distinct()


def _share(part, whole):
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def labelled_metrics(hits: DataFrame, entries: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, name, matched_count, tp, fp, fn, precision, recall, f1); entry_id is unique in entries."""
    # no pair of an entry and a rule relevant to it is formed: what is missed is the rule's relevant total less what it found
    labelled, told = entries.where("label <> ''").select("entry_id", "label"), labels_of(rules)
    total = labelled.groupBy("label").agg(F.count("*").alias("n")).join(told, "label").groupBy("rule_id").agg(F.sum("n").alias("wanted"))
    fired = distinct_hits(hits).join(labelled, "entry_id").groupBy("rule_id", "label").agg(F.count("*").alias("n"))
    right = fired.join(told.withColumn("right", F.lit(True)), ["rule_id", "label"], "left")
    found = right.groupBy("rule_id").agg(F.sum(F.when(F.col("right"), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("right"), 0).otherwise(F.col("n"))).alias("fp"))
    counts = total.join(found, "rule_id", "full").na.fill(0, ["wanted", "tp", "fp"]).select("rule_id", "tp", "fp", (F.col("wanted") - F.col("tp")).alias("fn"))
    m = match_counts(hits, rules).join(counts, "rule_id", "left").na.fill(0, ["tp", "fp", "fn"])
    p, r = _share(F.col("tp"), F.col("tp") + F.col("fp")), _share(F.col("tp"), F.col("tp") + F.col("fn"))
    return m.select("rule_id", "name", "matched_count", "tp", "fp", "fn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(_share(2 * p * r, p + r), 4).alias("f1"))


def labelled_summary(metrics: DataFrame) -> DataFrame:
    """Averages of the rounded values over rules with relevant entries."""
    judged = F.col("tp") + F.col("fn") > 0
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(judged, F.col(c))), F.lit(0.0)), 4).alias(f"avg_{c}")
    return metrics.agg(F.count_if(F.col("matched_count") > 0).alias("rules_firing"), F.count_if(F.col("matched_count") == 0).alias("rules_never_firing"), F.count_if(judged).alias("rules_judged"), mean("precision"), mean("recall"))


def drift(hits: DataFrame, sides: DataFrame, rules: DataFrame, threshold: float = DRIFT) -> DataFrame:
    """Match rates in two corpora. ``sides``: (entry_id, side) with side 'a' or 'b'; one pass over the hits."""
    n = {r["side"]: r["count"] for r in sides.groupBy("side").count().collect()}
    h = distinct_hits(hits).join(sides, "entry_id").groupBy("rule_id").agg(F.count_if(F.expr("side = 'a'")).alias("matches_a"), F.count_if(F.expr("side = 'b'")).alias("matches_b"))
    m = rules.select("rule_id", "name").join(h, "rule_id")
    rate = lambda s: F.col(f"matches_{s}") / F.lit(float(n[s])) if n.get(s) else F.lit(0.0)
    gap = F.abs(rate("a") - rate("b"))
    return m.where("matches_a > 0 OR matches_b > 0").select(
        "rule_id", F.col("name").alias("rule"), "matches_a", "matches_b", F.round(rate("a"), 4).alias("rate_a"), F.round(rate("b"), 4).alias("rate_b"),
        F.round(gap, 4).alias("drift"), (gap > threshold).alias("significant"),
    )
