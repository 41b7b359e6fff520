"""Survivors field by field."""

import random
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rulesieve.llm import survivor
from rulesieve.session import trimmed

RULES = "rule_id bigint, name string, severity string, source string, priority int, updated_at timestamp, id string"


def t(day):
    return datetime(2024, 1, day)


ROWS = [
    (1, "a", "None", "s1", 10, t(1), "x"), (1, "a", " HIGH\t", None, 10, t(2), "x"), (2, "b", "low", "n/a", None, t(9), "x"), (3, "c", "critical", "s3", 50, t(1), "x"),
    (3, "c", "critical", "s3", 50, t(1), "x"), (4, "d", "unknown", "", 10, t(2), "x"), (5, "e", "low", "s5", 10, t(2), "x"), (6, "f", None, None, None, None, "x"),
]
GROUPS = [(1, ["a", "b", None]), (2, ["b", "c"]), (3, ["d", "e", "d"]), (4, ["retired"]), (5, []), (6, None), (7, ["f"]), (7, ["f"]), (8, ["a", "d", "e"])]


def run(spark, rows=ROWS, groups=GROUPS, precedence=True):
    r = spark.createDataFrame(rows, RULES)
    g = spark.createDataFrame(groups, "id int, rules array<string>").withColumn("keep", F.lit("stale"))
    fields = {"keep": F.col("name"), "severity": survivor.present(F.lower(trimmed(F.col("severity")))), "source": survivor.present(F.col("source"))}
    out = survivor.survivors(g, r, "id", "rules", "name", fields, survivor.newest_first(r) if precedence else [], survivor.present(F.col("source")), "keep")
    return {tuple(x) for x in out.collect()}


def test_precedence(spark):
    assert run(spark) == {
        (1, "a", "high", "s1"), (2, "c", "critical", "s3"), (3, "d", "low", "s5"), (4, None, "", ""), (5, None, "", ""), (6, None, "", ""), (7, "f", "", ""), (8, "a", "high", "s5"),
    }


def test_empty_tables(spark):
    assert run(spark, rows=[ROWS[0]], groups=[(1, ["zz"])]) == {(1, None, "", "")}
    r = spark.createDataFrame(ROWS, RULES)
    g = spark.createDataFrame(GROUPS, "id int, rules array<string>").limit(0)
    assert survivor.survivors(g, r, "id", "rules", "name", {"keep": F.col("name")}, [], F.col("source"), "keep").isEmpty()


def test_sources_earn_their_weight(spark):
    # 'liar' stands alone against two that agree in most groups; where one honest source meets it, honesty wins
    rows = [(i, f"g{i}", v, s, 1, t(1), "x") for i in range(8) for s, v in (("one", "true"), ("two", "true"), ("liar", "false"))]
    rows += [(9, "g9", "false", "liar", 1, t(1), "x"), (9, "g9", "true", "one", 1, t(1), "x")]
    r = spark.createDataFrame(rows, RULES)
    g = spark.createDataFrame([(i, [f"g{i}"]) for i in [*range(8), 9]], "id int, rules array<string>")
    told = survivor.claims(g, r, "id", "rules", "name", {"v": F.col("severity")}, [], F.col("source"))
    winners, weights = survivor.discover(told)
    assert {x["value"] for x in winners.collect()} == {"true"}
    w = {x["source"]: x["weight"] for x in weights.collect()}
    assert w["one"] > 0.8 > 0.2 > w["liar"]


def scattered():
    """(grp, value, source): many sources of unlike honesty, whose reliabilities take more than six rounds to settle."""
    rng = random.Random(381)
    return sorted({(g, rng.choice("abc"), f"s{min(rng.randrange(40), rng.randrange(40))}") for g in range(120) for _ in range(4)})


def one_round(told, weights):
    support = Counter()
    for g, v, s in told:
        support[g, v] += weights[s]
    best = {}
    for (g, v), x in support.items():
        best[g] = min(best.get(g, (0, "")), (-round(x, 9), v))
    hits, all_of = Counter(s for g, v, s in told if best[g][1] == v), Counter(s for _, _, s in told)
    return {g: v for g, (_, v) in best.items()}, {s: (hits[s] + 1) / (n + 2) for s, n in all_of.items()}


def test_winners_are_settled(spark):
    rows = scattered()
    told = spark.createDataFrame([(g, "f", v, s, 0) for g, v, s in rows], "grp int, field string, value string, source string, rank int")
    winners, weights = survivor.discover(told)
    got, w = {r["grp"]: r["value"] for r in winners.collect()}, {r["source"]: r["weight"] for r in weights.collect()}
    again, moved = one_round(rows, w)
    assert again == got and max(abs(moved[s] - w[s]) for s in w) < 1e-3
    early = dict.fromkeys(w, 0.5)
    for _ in range(6):
        sixth, early = one_round(rows, early)
    assert sixth != got
    with pytest.raises(RuntimeError):
        survivor.discover(told, most=6)
