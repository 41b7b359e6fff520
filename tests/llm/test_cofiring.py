"""Co-firing pairs against a dictionary count."""

import random
from collections import Counter
from itertools import combinations
from math import log2

from rulesieve.llm import cofiring
from rulesieve.llm.queries import QUERIES


def brute(rows, min_pair, inv):
    baskets = {}
    for b, i in rows:
        if b is not None and i is not None:
            baskets.setdefault(b, set()).add(i)
    ones, twos = Counter(), Counter()
    for s in baskets.values():
        ones.update(s)
        twos.update(combinations(sorted(s), 2))
    n = len(baskets)
    return {p: (c, ones[p[0]], ones[p[1]], n) for p, c in twos.items() if c >= min_pair and c * inv >= n}


def frame(spark, rows):
    return spark.createDataFrame([(b, i, "x", 0) for b, i in rows], "entry_id bigint, rule_id bigint, item string, n int")


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(150), min(rng.randrange(12), rng.randrange(12))) for _ in range(900)]
    rows += rows[:50] + [(None, 1), (3, None), (None, None)] + [(999, i) for i in range(12)]
    for least, inv, held in ((1, 10**9, 2000), (1, 10**9, 3), (4, 20, 2000)):
        got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in cofiring.pair_counts(frame(spark, rows), "entry_id", "rule_id", least, inv, basket_items=held).collect()}
        assert got == brute(rows, least, inv)


def test_chance(spark):
    rows = [(e, i) for e in range(10) for i in ((1, 2) if e < 4 else (3,))]
    r = cofiring.with_chance(cofiring.pair_counts(frame(spark, rows), "entry_id", "rule_id")).first()
    assert (r["lift"], r["pmi"]) == (2.5, log2(2.5))
    pairs = cofiring.pair_counts(frame(spark, rows), "entry_id", "rule_id")
    assert cofiring.over_chance(pairs, 2).count() == 1 and cofiring.over_chance(pairs, 3).count() == 0


def test_empty(spark):
    assert cofiring.pair_counts(frame(spark, [(1, 1)]).limit(0), "entry_id", "rule_id").isEmpty()
    assert cofiring.pair_counts(frame(spark, [(None, None)]), "entry_id", "rule_id", 4, 2000).isEmpty()


def test_counts_hold_rare_pairs(spark, tmp_path):
    rows = [(e, i) for e in range(9) for i in ((1, 2) if e < 5 else (3, 4) if e < 6 else (1, 3))]
    frame(spark, rows).write.parquet(str(tmp_path / "rule_hits.parquet"))
    got = {(r["rule_id_a"], r["rule_id_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in QUERIES["p3_counts"](spark, str(tmp_path)).collect()}
    assert got == brute(rows, 1, 10**9) and got[3, 4] == (1, 4, 1, 9)
