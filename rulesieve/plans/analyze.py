"""The whole analysis: load, generate, match, classify, assess; evaluation and drift on real entries.

Frames stay distributed until the end; what is collected is bounded by the number of rules and of
related pairs, which is what a report lists.
"""

from __future__ import annotations

import logging
import time
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import rulesieve
from rulesieve import schemas as S
from rulesieve.operators import classify, cluster, evaluate, matrix, quality
from rulesieve.operators.generate import Settings, diversity, generate
from rulesieve.operators.match import match
from rulesieve.session import cut
from rulesieve.sources.rules import load_files, rules_frame

log = logging.getLogger("rulesieve.plans")
WIDE_INTERVAL, LARGE_CLUSTER = 0.3, 5
PARTITION_FIELDS = ("name", "source", "detector", "severity", "priority")


@dataclass
class Report:
    """Everything a renderer shows; lists of plain dicts."""

    version: str
    timestamp: str
    config: dict
    input: dict
    corpus: dict
    evaluation: dict
    duplicates: list[dict]
    subsets: list[dict]
    overlaps: list[dict]
    clusters: list[dict]
    quality: dict
    summary: dict = field(default_factory=dict)


def dicts(df: DataFrame) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.collect()]


def hits_of_corpus(corpus: DataFrame, rules: DataFrame, partition_by: str | None = None, engine: str = "python") -> DataFrame:
    """Hits of the positive strings, within equal values of a rule field where one is named."""
    strings = corpus.where("NOT is_negative").select("entry_id", "text", "source_rule_id")
    if not partition_by:
        return match(strings, rules, engine=engine)
    if partition_by not in PARTITION_FIELDS:
        raise ValueError(f"rules can be partitioned by {', '.join(PARTITION_FIELDS)}, not by {partition_by!r}")
    keyed = rules.select(F.col("rule_id").alias("source_rule_id"), F.col(partition_by).cast("string").alias("own_key"))
    told = rules.withColumn("rule_key", F.col(partition_by).cast("string"))
    return match(strings.join(keyed, "source_rule_id"), told, engine=engine, partition=("own_key", "rule_key"))


def warn_low_diversity(corpus: DataFrame, rules: DataFrame) -> None:
    low = diversity(corpus.where("NOT is_negative"), "source_rule_id").where("is_low").join(rules.select(F.col("rule_id").alias("source_rule_id"), "name"), "source_rule_id")
    for r in low.orderBy("source_rule_id").toLocalIterator():
        log.warning("'%s': its strings are much alike (%.2f of them differ in their middle)", r["name"], r["ratio"])


def analyze(
    spark: SparkSession, paths: Sequence[str], threshold: float = 0.8, cluster_threshold: float = 0.6, samples: int = 50, negative_samples: int = 10, seed: int | None = None,
    workers: int = 0, partition_by: str | None = None, skip_invalid: bool = False, priorities: dict[str, int] | None = None, field_mapping: dict[str, str] | None = None, engine: str = "python",
) -> Report:
    """Overlap of the rules of one or more files, estimated on strings made from them."""
    begun = time.monotonic()
    loaded = load_files(paths, skip_invalid, priorities, field_mapping)
    rules = rules_frame(spark, loaded)
    corpus = generate(rules, Settings(samples=samples, negatives=negative_samples, seed=42 if seed is None else seed), skip_invalid)
    made = corpus.agg(F.count("*").alias("n"), F.count_if("is_negative").alias("bad")).first()
    generated = time.monotonic()
    if made["n"] == made["bad"]:
        log.warning("no strings to match the rules against")
    else:
        warn_low_diversity(corpus, rules)

    cells = cut(matrix.matrix_of_corpus(hits_of_corpus(corpus, rules, partition_by, engine), corpus))
    sizes = cut(matrix.corpus_sizes(corpus))
    matched = cells.agg(F.sum("cnt")).first()[0] or 0
    evaluated = time.monotonic()

    pairs = cut(classify.classify(classify.pair_ratios(cells, sizes), rules, matrix.overlap_counts(cells, rules), threshold))
    groups = cluster.clusters(pairs, rules, cluster_threshold)
    rated = cut(quality.quality(rules, cells, sizes, quality.random_strings(spark)))
    found = dicts(pairs.orderBy("rule_id_a", "rule_id_b"))
    counted = classify.totals(pairs).first().asDict()
    grouped = dicts(groups.orderBy("id"))
    for p in found:
        width = max(p[c]["hi"] - p[c]["lo"] for c in ("ci_a_to_b", "ci_b_to_a"))
        if width > WIDE_INTERVAL:
            log.warning("'%s' and '%s': interval %.2f wide; more samples would narrow it", p["rule_a"], p["rule_b"], width)
    for c in grouped:
        if len(c["rules"]) > LARGE_CLUSTER:
            log.warning("cluster %d has %d rules; its members may be linked through others only", c["id"], len(c["rules"]))
    rates = dicts(rated.orderBy("rule_id"))
    said = quality.summary(rated).first().asDict()
    show = lambda test, *keys: [{k: r[k] for k in keys} for r in rates if r[test]]
    broad, low, redundant = show("is_broad", "name", "source", "overlap_count"), show("is_low_specificity", "name", "source", "specificity"), show("is_redundant", "name", "source")
    return Report(
        rulesieve.__version__, datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"),
        {"threshold": threshold, "cluster_threshold": cluster_threshold, "samples_per_rule": samples, "negative_samples": negative_samples, "seed": seed, "workers": workers, "partition_by": partition_by},
        {"files": list(map(str, paths)), "total_rules": len(loaded), "rules_by_source": dict(Counter(r.source for r in loaded)), "rules_skipped": 0, "skip_reasons": {}},
        {"total_strings": made["n"], "positive_strings": made["n"] - made["bad"], "negative_strings": made["bad"], "generation_duration_s": round(generated - begun, 1)},
        {"total_comparisons": len(loaded) * (made["n"] - made["bad"]), "positive_matches": matched, "duration_s": round(evaluated - generated, 1), "workers": workers or "auto"},
        [p for p in found if p["relationship"] == S.DUPLICATE], [p for p in found if p["relationship"] in (S.SUBSET, S.SUPERSET)], [p for p in found if p["relationship"] == S.OVERLAP], grouped,
        {"broad_patterns": broad, "low_specificity": low, "fully_redundant": redundant, "summary": said},
        counted | {"clusters": len(grouped), "broad_patterns": len(broad), "low_specificity_rules": len(low), "fully_redundant_rules": len(redundant), "analysis_duration_s": round(time.monotonic() - begun, 1)},
    )


#: Hits that the debug log names.
LOGGED_HITS = 1000


def evaluate_entries(rules: DataFrame, entries: DataFrame, engine: str = "python", redact_samples: bool = False) -> dict:
    """Counts, metrics and the 100 most frequent co-firing pairs of rules on real entries; ``redact_samples`` keeps hits out of the debug log."""
    begun = time.monotonic()
    hits = cut(match(entries, rules, engine=engine))
    if log.isEnabledFor(logging.DEBUG) and not redact_samples:
        named = hits.join(rules.select("rule_id", "name"), "rule_id").join(entries.select("entry_id", "source"), "entry_id")
        for r in named.orderBy("entry_id", "rule_id").take(LOGGED_HITS):
            log.debug("'%s' matches entry %s (source %s)", r["name"], r["entry_id"], r["source"])
    sizes = entries.agg(F.count("*").alias("n"), F.count_if(F.expr("label <> ''")).alias("labelled")).first()
    metrics = cut(evaluate.labelled_metrics(hits, entries, rules))
    pairs = cut(evaluate.co_firing(hits, rules))
    means = evaluate.labelled_summary(metrics).first()
    return {
        "total_entries": sizes["n"], "labeled_entries": sizes["labelled"], "unlabeled_entries": sizes["n"] - sizes["labelled"], "rules_evaluated": metrics.count(),
        "rule_metrics": dicts(metrics.orderBy("rule_id")), "co_firing": dicts(evaluate.co_firing_top(pairs)), "duration_s": round(time.monotonic() - begun, 1),
        "summary": {"rules_firing": means["rules_firing"], "co_firing_pairs": pairs.count(), "avg_precision": means["avg_precision"], "avg_recall": means["avg_recall"]},
    }


def diff_entries(rules: DataFrame, a: DataFrame, b: DataFrame, name_a: str = "a", name_b: str = "b", threshold: float = evaluate.DRIFT, engine: str = "python") -> dict:
    """Drift of the rules' match rates between two corpora, found in one match pass over both."""
    # an entry's own id and its side make one id for both, so no text is written again
    of = lambda e, side, low: e.select("text", F.lit(side).alias("side"), (F.col("entry_id") * 2 + low).alias("entry_id"))
    both = of(a, "a", 0).union(of(b, "b", 1))
    rows = evaluate.drift(match(both, rules, engine=engine), both.select("entry_id", "side"), rules, threshold)
    results = dicts(rows.orderBy(F.desc("drift"), "rule_id"))
    n = {r["side"]: r["count"] for r in both.groupBy("side").count().collect()}
    return {"name_a": name_a, "name_b": name_b, "entries_a": n.get("a", 0), "entries_b": n.get("b", 0), "results": results, "summary": {"rules_compared": len(results), "significant_drifts": sum(r["significant"] for r in results)}}
