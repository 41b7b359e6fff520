"""Hand-made matrices with exact expectations."""

import pytest
from pyspark.sql import functions as F

from rulesieve.operators import classify, cluster, matrix

RULES = "rule_id int, name string, source string, priority int, catch_all boolean"


def pairs(spark, cells, sizes=None, rules=None, threshold=0.8, **kw):
    ids = sorted({i for a, b, _ in cells for i in (a, b)})
    m = spark.createDataFrame(cells, "rule_id int, source_rule_id int, cnt bigint")
    s = spark.createDataFrame([(i, (sizes or {}).get(i, 50)) for i in ids], "rule_id int, n bigint")
    told = {i: (i, f"r{i}", "src", 0, None) for i in ids} | {r[0]: r for r in rules or []}
    r = spark.createDataFrame(list(told.values()), RULES)
    return classify.classify(classify.pair_ratios(m, s), r, matrix.overlap_counts(m, r), threshold, **kw)


@pytest.mark.parametrize(
    ("ab", "ba", "pri", "want"),
    [
        (45, 42, (10, 5), ("duplicate", "keep_a", False)),
        (45, 42, (5, 10), ("duplicate", "keep_b", False)),
        (45, 42, (5, 5), ("duplicate", "review", False)),
        (48, 10, (5, 5), ("subset", "keep_a", True)),
        (48, 10, (1, 10), ("subset", "keep_both", False)),
        (10, 48, (5, 5), ("superset", "keep_b", True)),
        (10, 48, (10, 1), ("superset", "keep_both", False)),
        (20, 15, (0, 0), ("overlap", "review", False)),
        (40, 40, (0, 0), ("duplicate", "review", False)),
        (39, 39, (0, 0), ("overlap", "review", False)),
    ],
)
def test_relationships(spark, ab, ba, pri, want):
    rules = [(1, "a", "x", pri[0], None), (2, "b", "y", pri[1], None)]
    row = pairs(spark, [(1, 2, ab), (2, 1, ba)], rules=rules).first()
    assert (row["relationship"], row["recommendation"], row["downstream_label_loss"]) == want


def test_disjoint_pairs_are_left_out_and_thresholds_move(spark):
    assert pairs(spark, [(1, 2, 2), (2, 1, 1)]).isEmpty()
    assert pairs(spark, [(1, 2, 30), (2, 1, 30)], threshold=0.5).first()["relationship"] == "duplicate"
    row = pairs(spark, [(1, 2, 50), (2, 1, 50)]).first()
    assert row["jaccard"] == 1.0 and row["ci_a_to_b"]["hi"] == 1.0 and row["ci_a_to_b"]["lo"] < 1


def test_catch_all_by_flag_and_by_breadth(spark):
    broad = [(1, i, 48) for i in range(2, 8)] + [(i, 1, 5) for i in range(2, 8)]
    rows = pairs(spark, broad).collect()
    assert {r["recommendation"] for r in rows} == {"keep_both"} and not any(r["downstream_label_loss"] for r in rows)
    assert {r["recommendation"] for r in pairs(spark, broad, rules=[(1, "a", "", 0, False)]).collect()} == {"keep_a"}
    assert pairs(spark, [(1, 2, 48), (2, 1, 10)], rules=[(1, "a", "", 0, True)]).first()["recommendation"] == "keep_both"


def test_missing_corpus_drops_the_pair(spark):
    assert pairs(spark, [(1, 2, 45), (2, 1, 45)], sizes={2: 0}).isEmpty()


def test_clusters_keep_the_highest_priority(spark):
    cells = [(a, b, 45) for g in ((1, 2, 3), (7, 8)) for a in g for b in g if a != b]
    rules = [(i, f"r{i}", "s", 10 if i == 3 else 1, None) for i in (1, 2, 3, 7, 8)]
    found = pairs(spark, cells, rules=rules)
    rows = cluster.clusters(found, spark.createDataFrame(rules, RULES), 0.5).orderBy("id").collect()
    assert [(r["id"], r["rules"], r["keep"]) for r in rows] == [(1, ["r3", "r1", "r2"], "r3"), (2, ["r7", "r8"], "r7")]
    assert rows[0]["reason"] == "Highest priority in cluster (from s)"


def test_labels_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)], "rule_a int, rule_b int")
    assert cluster.labels(edges).select("label").distinct().collect() == [(0,)]


def test_matrix_readings(spark):
    hits = spark.createDataFrame([(1, 1), (1, 2), (1, 1), (2, 1), (3, 3), (None, 1), (4, None)], "entry_id int, rule_id int")
    rules = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "rule_id int, name string")
    m = matrix.matrix_of_entries(hits)
    assert {tuple(r) for r in m.collect()} == {(1, 1, 2), (1, 2, 1), (2, 1, 1), (2, 2, 1), (3, 3, 1)}
    as_map = lambda df, c: {r["rule_id"]: r[c] for r in df.collect()}
    sizes = matrix.entry_sizes(hits)
    assert as_map(matrix.overlap_counts(m, rules), "overlap_count") == {1: 1, 2: 1, 3: 0, 4: 0}
    assert as_map(matrix.fp_potential(m, rules), "fp_potential") == {1: 1, 2: 1, 3: 0, 4: 0}
    assert as_map(matrix.unique_coverage(m, sizes, rules), "unique_coverage") == {1: 1, 2: 0, 3: 1, 4: 0}
    assert as_map(matrix.exact_unique(hits, rules), "only_here") == {1: 1, 2: 0, 3: 1, 4: 0}
    assert matrix.matrix_of_entries(hits.where(F.lit(False))).isEmpty()
