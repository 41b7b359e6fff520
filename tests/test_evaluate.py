"""Evaluation, drift, quality and generation."""

import pytest
from pyspark.sql import functions as F

from rulesieve.errors import SampleError
from rulesieve.functions.patterns import compiled
from rulesieve.operators import evaluate, generate, quality
from rulesieve.operators.match import match
from rulesieve.plans.analyze import diff_entries, evaluate_entries
from rulesieve.queries import QUERIES
from rulesieve.streaming.matching import stream_hits, windowed_counts

RULES = [(0, "aws", r"AKIA[A-Z0-9]{4}", "s", ["cloud"], 1), (1, "any", r"[A-Z]{4}", "s", [], 1), (2, "never", "zzz", "s", ["cloud"], 1)]


@pytest.fixture(scope="module")
def rules(spark):
    return spark.createDataFrame(RULES, "rule_id int, name string, pattern string, source string, tags array<string>, priority int")


@pytest.fixture(scope="module")
def entries(spark):
    rows = [(1, "AKIA1234", "aws", ""), (2, "nothing", "aws", ""), (3, "ABCD", "", ""), (4, "AKIAZZZZ", None, ""), (5, "AKIAQQQQ", "cloud", ""), (6, None, "aws", "")]
    return spark.createDataFrame(rows, "entry_id bigint, text string, label string, source string")


def test_metrics(rules, entries):
    report = evaluate_entries(rules, entries)
    m = {r["name"]: r for r in report["rule_metrics"]}
    assert (m["aws"]["tp"], m["aws"]["fp"], m["aws"]["fn"], m["aws"]["matched_count"]) == (2, 0, 2, 3)
    assert (m["aws"]["precision"], m["aws"]["recall"], m["aws"]["f1"]) == (1.0, 0.5, 0.6667)
    assert (m["any"]["tp"], m["any"]["fp"], m["never"]["fn"], m["never"]["precision"]) == (0, 2, 1, 0.0)
    assert report["co_firing"] == [{"rule_a": "any", "rule_b": "aws", "count": 3}]
    assert report["summary"] == {"rules_firing": 2, "co_firing_pairs": 1, "avg_precision": 0.5, "avg_recall": 0.25}
    assert report["labeled_entries"] == 4


def test_drift(rules, entries, spark):
    other = spark.createDataFrame([(1, "no"), (2, "no"), (3, "no")], "entry_id bigint, text string")
    d = diff_entries(rules, entries, other, "x", "y")
    assert {r["rule"]: (r["rate_a"], r["rate_b"], r["significant"]) for r in d["results"]} == {"aws": (0.5, 0.0, True), "any": (0.6667, 0.0, True)}
    assert diff_entries(rules, entries, entries)["summary"]["significant_drifts"] == 0
    assert diff_entries(rules, entries.limit(0), other)["results"] == []


def test_latest_delivery(spark):
    e = spark.createDataFrame([(1, "old", 1), (1, "new", 2)], "entry_id int, text string, ingested_at int")
    assert [r["text"] for r in evaluate.latest(e).collect()] == ["new"]


def test_quality_flags(spark):
    rules = spark.createDataFrame([(0, "broad", ".*", "s"), (1, "specific", "abc[0-9]{5}", "s")], "rule_id int, name string, pattern string, source string")
    cells = spark.createDataFrame([(0, 0, 5), (0, 1, 2), (1, 1, 2)], "rule_id int, source_rule_id int, cnt bigint")
    sizes = spark.createDataFrame([(0, 5), (1, 2)], "rule_id int, n bigint")
    strings = quality.random_strings(spark)
    assert strings.count() == 200 and strings.collect() == quality.random_strings(spark).collect()
    q = {r["name"]: r for r in quality.quality(rules, cells, sizes, strings).collect()}
    assert q["broad"]["specificity"] == 0.0 and q["broad"]["is_low_specificity"] and q["broad"]["flags"][0] == "Low specificity (0.00) — matches 100% of random strings"
    assert q["specific"]["is_redundant"] and q["specific"]["flags"] == ["Zero unique coverage — fully redundant"]
    s = quality.summary(quality.quality(rules, cells, sizes, strings)).first()
    assert (s["rules"], s["fully_redundant"], s["low_specificity"], s["avg_specificity"]) == (2, 1, 1, 0.5)


PATTERNS = [(0, "digits", r"\d{8}"), (1, "hex", r"[0-9a-f]{16}"), (2, "wide", r"[a-zA-Z0-9]{10,100}"), (3, "anchored", r"^\d{8}$"), (4, "pem", r"-----BEGIN (?:RSA |EC )?PRIVATE KEY-----")]


def test_generated_strings(spark):
    rules = spark.createDataFrame(PATTERNS, "rule_id int, name string, pattern string")
    settings = generate.Settings(samples=20, longest=120)
    a = generate.generate(rules.repartition(1), settings).collect()
    b = generate.generate(rules.repartition(5), settings).collect()
    assert sorted(a) == sorted(b)
    for i, _, p in PATTERNS:
        good = [r["text"] for r in a if r["source_rule_id"] == i and not r["is_negative"]]
        bad = [r["text"] for r in a if r["source_rule_id"] == i and r["is_negative"]]
        assert 10 <= len(good) == len(set(good)) and all(compiled(p).search(t) and len(t) <= 120 for t in good)
        assert not any(compiled(p).search(t) for t in bad)


def test_generation_failures(spark):
    rules = spark.createDataFrame([(0, "one", "^exact$"), (1, "ok", r"\d{9}")], "rule_id int, name string, pattern string")
    with pytest.raises(SampleError):
        generate.generate(rules)
    assert {r[0] for r in generate.generate(rules, skip_invalid=True).select("source_rule_id").collect()} == {1}


def test_diversity(spark):
    t = spark.createDataFrame([("same", "x" * 60)] * 12 + [("varied", f"{i:030d}" * 2) for i in range(12)] + [("none", None)], "k string, text string")
    rows = {r["k"]: r for r in generate.diversity(t, "k").collect()}
    assert rows["same"]["is_low"] and not rows["varied"]["is_low"] and "none" not in rows


def test_stream_equals_batch(spark, rules, tmp_path):
    rows = [("2024-01-01 10:00:00", "AKIA1234"), ("2024-01-01 10:30:00", "ABCD"), ("2024-01-01 12:00:00", "AKIAZZZZ")]
    told = spark.createDataFrame(rows, "s string, text string").select(F.col("s").cast("timestamp").alias("seen_at"), "text")
    told.write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(told.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream_hits(live, rules)).writeStream.format("memory").queryName("hits").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    want = sorted(windowed_counts(stream_hits(told, rules)).collect())
    assert sorted(spark.table("hits").collect()) == want and len(want) == 4


def test_match_counts_are_zero_filled(rules, entries):
    hits = match(entries, rules)
    assert {r["name"]: r["matched_count"] for r in evaluate.match_counts(hits, rules).collect()} == {"aws": 3, "any": 4, "never": 0}
    assert [r["name"] for r in evaluate.never_firing(hits, rules).collect()] == ["never"]


def test_scan_takes_the_default_settings(spark, monkeypatch):
    told = []

    def noted(rules, settings=generate.Settings(), skip_invalid=False):
        told.append(settings)
        raise SampleError("noted")

    monkeypatch.setattr(generate, "generate", noted)
    with pytest.raises(SampleError):
        QUERIES["synthetic_scan"](spark, "/root/testdata/sf0.001")
    assert told == [generate.Settings()]
