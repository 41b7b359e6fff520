"""Distributed sinks: what is written can be read again."""

import pytest

from rulesieve.plans import sinks


def test_pairs_in_folders(spark, tmp_path):
    pairs = spark.createDataFrame([("a", "b", 0.5, "overlap", (0.1, 0.9)), ("a", 'c "x"', 1.0, "duplicate", (0.8, 1.0))], "rule_a string, rule_b string, jaccard double, relationship string, ci struct<lo: double, hi: double>")
    for form in ("parquet", "json"):
        sinks.write_pairs(pairs, str(tmp_path / form), form)
        assert {(r["rule_b"], r["ci"]["lo"]) for r in spark.read.format(form).load(str(tmp_path / form)).collect()} == {("b", 0.1), ('c "x"', 0.8)}
    sinks.write_pairs(pairs, str(tmp_path / "csv"), "csv")
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"')
    assert {(r["rule_b"], r["ci_hi"], r["relationship"]) for r in back.collect()} == {("b", "0.9", "overlap"), ('c "x"', "1.0", "duplicate")}
    with pytest.raises(ValueError):
        sinks.write_pairs(pairs, str(tmp_path / "x"), "xlsx")


def test_corpus(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "t", 0, False), (2, None, 0, True)], "entry_id bigint, text string, source_rule_id int, is_negative boolean")
    rules = spark.createDataFrame([(0, "r")], "rule_id int, name string")
    sinks.write_corpus(corpus, rules, str(tmp_path / "c"))
    assert {(r["text"], r["source_rule"], r["is_negative"]) for r in spark.read.json(str(tmp_path / "c")).collect()} == {("t", "r", False), (None, "r", True)}
    sinks.write_corpus(corpus.limit(0), rules, str(tmp_path / "e"), "parquet")
    assert spark.read.parquet(str(tmp_path / "e")).isEmpty()
