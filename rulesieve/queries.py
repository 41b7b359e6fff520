"""Queries of the core operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.functions.stats import interval_width, is_confident, samples_needed, wilson
from rulesieve.operators import badrows, classify, cluster, drift, evaluate, generate, matrix, quality
from rulesieve.operators.match import match
from rulesieve.oracles import ORACLES, SCAN_RULES, SCAN_SAMPLES  # noqa: F401
from rulesieve.plans.analyze import hits_of_corpus
from rulesieve.session import cut, table
from rulesieve.sources.corpus import first_seen
from rulesieve.sources.rules import rules_of_table
from rulesieve.streaming.matching import stream_hits, windowed_counts

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return badrows.rejects(badrows.load_rows(table(spark, d, "raw_rows"))).select("row_id", "reason").distinct()


def p2_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The valid rows; typed values that may be null are written out, so that any reader compares them alike."""
    loaded = badrows.valid(badrows.load_rows(table(spark, d, "raw_rows"))).distinct()
    return loaded.withColumns({c: F.col(c).cast("string") for c in ("priority", "seen_on")})


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "rule_file_records")).drop("detail").distinct()


def p6_table(spark: SparkSession, d: str) -> DataFrame:
    """One table of all files under the canonical fields, keys that replaced one another read as one field."""
    records = table(spark, d, "rule_file_records")
    return drift.consistent(records, drift.learned_aliases(drift.changes(records)))


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return rules_of_table(table(spark, d, "base_rules"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """(entry_id, label, source) of the last delivery; the texts stay where they are."""
    return evaluate.latest(table(spark, d, "entries").drop("text"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "rule_hits")


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return matrix.matrix_of_entries(_hits(spark, d))


def rule_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every base rule against every entry, Python's regular expressions."""
    rules = _rules(spark, d)
    return evaluate.match_counts(evaluate.latest_hits(table(spark, d, "entries"), rules), rules)


def rule_match_counts_native(spark: SparkSession, d: str) -> DataFrame:
    """The same on the JVM's engine with rewritten patterns."""
    rules = _rules(spark, d)
    return evaluate.match_counts(evaluate.latest_hits(table(spark, d, "entries"), rules, engine="auto"), rules)


def partitioned_match_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rules only meet entries whose label equals the rule's detector."""
    rules = _rules(spark, d)
    return evaluate.match_counts(evaluate.latest_hits(table(spark, d, "entries"), rules, partition=("label", "detector")), rules)


def never_firing_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules without an entry on which they match more than once."""
    return evaluate.never_firing(_hits(spark, d).where("n_matches > 1"), _rules(spark, d))


def match_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


def corpus_sizes(spark: SparkSession, d: str) -> DataFrame:
    return matrix.entry_sizes(_hits(spark, d))


def overlap_counts(spark: SparkSession, d: str) -> DataFrame:
    return matrix.overlap_counts(_cells(spark, d), _rules(spark, d))


def fp_potential(spark: SparkSession, d: str) -> DataFrame:
    return matrix.fp_potential(_cells(spark, d), _rules(spark, d))


def unique_coverage(spark: SparkSession, d: str) -> DataFrame:
    return matrix.unique_coverage(_cells(spark, d), matrix.entry_sizes(_hits(spark, d)), _rules(spark, d))


def exact_unique(spark: SparkSession, d: str) -> DataFrame:
    return matrix.exact_unique(_hits(spark, d), _rules(spark, d))


def _ratios(spark: SparkSession, d: str) -> DataFrame:
    return classify.pair_ratios(cut(_cells(spark, d)), matrix.entry_sizes(_hits(spark, d)))


def pair_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _ratios(spark, d).select("rule_a", "rule_b", "ab", "ba", *[F.round(c, 4).alias(c) for c in ("a2b", "b2a", "jaccard")])


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    # real entries share far fewer hits than strings made for a rule, hence the lower thresholds
    rules, cells = _rules(spark, d), cut(_cells(spark, d))
    ratios = classify.pair_ratios(cells, matrix.entry_sizes(_hits(spark, d)))
    return classify.classify(ratios, rules, matrix.overlap_counts(cells, rules), threshold=0.4, overlap_min=0.1, catch_all_over=30)


def pair_classification(spark: SparkSession, d: str) -> DataFrame:
    return _pairs(spark, d).select("rule_id_a", "rule_id_b", "rule_a", "rule_b", "overlap_a_to_b", "overlap_b_to_a", "jaccard", "relationship", "recommendation", "reason", "downstream_label_loss")


def pair_totals(spark: SparkSession, d: str) -> DataFrame:
    return classify.totals(_pairs(spark, d))


def wilson_ci(spark: SparkSession, d: str) -> DataFrame:
    p = _ratios(spark, d)
    ci = wilson(F.col("ab"), F.col("size_b"))
    return p.select(
        "rule_a", "rule_b", ci["lo"].alias("lo"), ci["hi"].alias("hi"), interval_width(ci).alias("width"),
        is_confident(F.col("ab"), F.col("size_b"), 0.1).alias("confident"), samples_needed(F.col("ab"), F.col("size_b")).alias("samples"),
    )


def clusters(spark: SparkSession, d: str) -> DataFrame:
    """Members of clusters over pairs with jaccard >= 0.25, with the rule to keep."""
    found = cluster.clusters(_pairs(spark, d), _rules(spark, d), threshold=0.25)
    return found.select(F.col("id").cast("bigint").alias("id"), F.explode("rules").alias("rule"), "keep", "reason")


def co_firing(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.co_firing(_hits(spark, d), _rules(spark, d))


def co_firing_top(spark: SparkSession, d: str) -> DataFrame:
    """The 100 pairs that fire together most often."""
    return evaluate.co_firing_top(co_firing(spark, d))


def labeled_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.labelled_metrics(_hits(spark, d), _labels(spark, d), _rules(spark, d))


def labeled_summary(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.labelled_summary(labeled_metrics(spark, d))


def coverage_drift(spark: SparkSession, d: str) -> DataFrame:
    """Entries of the busiest source against all others."""
    sides = _labels(spark, d).select("entry_id", F.when(F.col("source") == "monolith-audit", "a").otherwise("b").alias("side"))
    return evaluate.drift(_hits(spark, d), sides, _rules(spark, d), threshold=0.005)


def report_totals(spark: SparkSession, d: str) -> DataFrame:
    """Rules by source with the sum of their matches."""
    cells = _cells(spark, d).groupBy("rule_id").agg(F.sum("cnt").alias("cnt"))
    return _rules(spark, d).join(cells, "rule_id", "left").groupBy("source").agg(F.count("*").alias("rules"), F.coalesce(F.sum("cnt"), F.lit(0)).alias("positive_matches"))


def matrix_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Matches by detector and rule with subtotals."""
    hits = matrix.distinct_hits(_hits(spark, d)).join(_rules(spark, d).select("rule_id", "detector", "name"), "rule_id")
    return hits.rollup("detector", "name").agg(F.count("*").alias("matches"))


def diversity_ratio(spark: SparkSession, d: str) -> DataFrame:
    return generate.diversity(table(spark, d, "documents"), "source")


def first_seen_lines(spark: SparkSession, d: str) -> DataFrame:
    """First document and line of every distinct line of the documents."""
    docs = table(spark, d, "documents").where("text IS NOT NULL")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return first_seen(lines.where("line <> ''"), "line", ["doc_id", "line_no"]).select(F.md5("line").alias("line_md5"), "doc_id", F.col("line_no").cast("bigint").alias("line_no"))


def event_rules(spark: SparkSession, d: str) -> DataFrame:
    """Four rules on the property text of events."""
    rules = spark.createDataFrame([(1, "even", r"[02468]\}"), (2, "small", r": \d\}"), (3, "key", r'^\{"k"'), (4, "never", "absent")], "rule_id int, name string, pattern string")
    hits = match(table(spark, d, "events"), rules, entry_key="event_id", text="props")
    return hits.groupBy("rule_id").agg(F.count("*").alias("matched")).join(rules, "rule_id", "right").select("name", F.coalesce("matched", F.lit(0)).alias("matched"))


def hits_by_window(spark: SparkSession, d: str) -> DataFrame:
    """Hits per rule and day, by the operator that also runs on streams."""
    entries = table(spark, d, "entries").where("seen_at IS NOT NULL").withColumn("at", F.struct("entry_id", "seen_at"))
    hits = stream_hits(entries, _rules(spark, d), time="at").distinct().select("at.seen_at", "rule_id")
    return windowed_counts(hits, window="1 day")


def complexity(spark: SparkSession, d: str) -> DataFrame:
    return quality.complexities(_rules(spark, d))


def _quality(spark: SparkSession, d: str) -> DataFrame:
    return quality.quality(_rules(spark, d), cut(_cells(spark, d)), matrix.entry_sizes(_hits(spark, d)), quality.random_strings(spark))


def rule_quality(spark: SparkSession, d: str) -> DataFrame:
    """Quality of the base rules; complexity, which SQL cannot count, is a query of its own."""
    return _quality(spark, d).select("rule_id", "name", "source", "specificity", "fp_potential", "unique_coverage", "overlap_count", "is_broad", "is_low_specificity", "is_redundant")


def quality_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.summary(_quality(spark, d)).drop("avg_complexity")


def literal_scan(spark: SparkSession, d: str) -> DataFrame:
    """Scan from end to end, strings made from eight fixed rules: match, matrix, pairs, classes. The SQL holds the strings as literals."""
    rules = spark.createDataFrame([(i, n, p, "fixed", priority, None) for i, (n, p, priority) in enumerate(SCAN_RULES)], "rule_id int, name string, pattern string, source string, priority int, catch_all boolean")
    corpus = generate.generate(rules, generate.Settings(samples=SCAN_SAMPLES))
    cells = cut(matrix.matrix_of_corpus(hits_of_corpus(corpus, rules), corpus))
    pairs = classify.classify(classify.pair_ratios(cells, matrix.corpus_sizes(corpus)), rules, matrix.overlap_counts(cells, rules))
    return pairs.select("rule_a", "rule_b", "a_matches_b_corpus", "b_matches_a_corpus", "a_corpus_size", "b_corpus_size", "overlap_a_to_b", "overlap_b_to_a", "jaccard", "relationship", "recommendation", "downstream_label_loss")


def synthetic_scan(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of the base rules on strings made from them: rule, strings, related rules."""
    rules = _rules(spark, d).withColumn("rule_id", F.col("rule_id").cast("int"))
    corpus = generate.generate(rules, skip_invalid=True)
    cells = cut(matrix.matrix_of_corpus(hits_of_corpus(corpus, rules), corpus))
    sizes = matrix.corpus_sizes(corpus)
    pairs = classify.classify(classify.pair_ratios(cells, sizes), rules, matrix.overlap_counts(cells, rules))
    related = pairs.groupBy(F.col("rule_a").alias("name")).agg(F.count("*").alias("related"))
    return sizes.join(rules.select("rule_id", "name"), "rule_id").select("name", "n").join(related, "name", "left").na.fill(0, ["related"])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        rule_match_counts, rule_match_counts_native, partitioned_match_counts, never_firing_rules, match_matrix, corpus_sizes, overlap_counts, fp_potential,
        unique_coverage, exact_unique, pair_overlap, pair_classification, pair_totals, wilson_ci, clusters, co_firing, co_firing_top, labeled_metrics, labeled_summary,
        coverage_drift, report_totals, matrix_rollup, diversity_ratio, first_seen_lines, event_rules, hits_by_window, complexity, rule_quality, quality_summary,
        synthetic_scan, literal_scan, p2_found, p2_loaded, p6_found, p6_table,
    )
}
