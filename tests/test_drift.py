"""Drift between files of a feed."""

import json

from rulesieve.operators.drift import changes, consistent, learned_aliases


def frame(spark, rows):
    told = [(f, n, f"{f}/{n}", 1, i, b if isinstance(b, str) or b is None else json.dumps(b), "x") for i, (f, n, b) in enumerate(rows)]
    return spark.createDataFrame(told, "feed string, file_no int, file_name string, loaded_at int, record_no int, body string, field string")


def log(df):
    return sorted(tuple(r) for r in changes(df).select("feed", "file_no", "field_name", "drift_kind").collect())


def test_each_kind(spark):
    rules = [(f"r{i}", f"p{i}", i) for i in range(6)]
    rows = [("f", 1, {"name": n, "pattern": p, "n": k, "gone": "x"}) for n, p, k in rules]
    rows += [("f", 4, {"id": n, "regex": p, "n": str(k), "fresh": [k]}) for n, p, k in rules]
    rows += [("f", 9, {"id": n, "regex": p, "n": str(k), "fresh": [k], "N": None}) for n, p, k in rules[:5]] + [("f", 9, {"id": "r5", "regex": 7, "n": "5"})]
    rows += [("g", 1, {"name": "a"})]
    assert log(frame(spark, rows)) == [("f", 4, "fresh", "added"), ("f", 4, "gone", "removed"), ("f", 4, "id", "renamed"), ("f", 4, "n", "type_changed"), ("f", 4, "regex", "renamed")]


def test_a_field_that_comes_back(spark):
    rows = [("f", 1, {"name": "a", "x": 1}), ("f", 2, {"name": "a"}), ("f", 3, {"name": "a", "x": 1})]
    assert log(frame(spark, rows)) == [("f", 2, "x", "removed"), ("f", 3, "x", "added")]


def test_odd_bodies(spark):
    rows = [("f", 1, {"name": "a", "é'\"$.k": True}), ("f", 2, None), ("f", 2, "not json"), ("f", 2, "[1]"), ("f", 2, {"name": "a"}), (None, 1, {"name": "a"}), ("f", None, {"q": 1})]
    assert log(frame(spark, rows)) == [("f", 2, "é'\"$.k", "removed")]
    assert log(frame(spark, rows).limit(0)) == []


def test_redelivery_counts_once(spark):
    a = frame(spark, [("f", 1, {"name": "a", "x": 1}), ("f", 1, {"name": "b", "x": "s"}), ("f", 1, {"name": "c", "x": "s"}), ("f", 2, {"name": "a", "x": "s"})])
    many = a.unionAll(a.where("record_no = 0")).unionAll(a.where("record_no = 0"))
    assert log(many) == []


def test_renamings_need_no_known_names(spark):
    """Identity comes from the values: neither the key of the rule's name nor the fields are in any list, and an id field arrives."""
    rules = [(f"r{i}", f"p{i}x", ["high", "low"][i % 2]) for i in range(8)]
    rows = [("f", 1, {"zorp": n, "blat": p, "grade": g}) for n, p, g in rules]
    rows += [("f", 2, {"zarp": n, "blat": p, "stufe": g, "uid": f"u{n}"}) for n, p, g in reversed(rules)]
    assert log(frame(spark, rows)) == [("f", 2, "stufe", "renamed"), ("f", 2, "uid", "added"), ("f", 2, "zarp", "renamed")]


def test_consistent_table(spark):
    rows = [("f", 1, {"name": f"a{i}", "severity": ["high", "low"][i % 2], "entropy": str(i + 0.5), "tags": ["t"], "enabled": "true", "expr": "q"}) for i in range(4)]
    rows += [("f", 2, {"rName": f"a{i}", "grade": ["high", "low"][i % 2], "min_ent": str(i + 0.5), "tags": "t", "enabled": True, "pattern": [f"p{i}"], "description": {"en": "m"}, "priority": "no"}) for i in range(4)]
    df = frame(spark, rows)
    learned = learned_aliases(changes(df))
    assert "rName" in learned["name"][1] and "grade" in learned["severity"][1] and "min_ent" in learned["entropy"][1]
    got = consistent(df, learned).orderBy("file_no", "record").collect()
    for k, r in enumerate(got):
        assert (r["name"], r["severity"], r["entropy"], r["tags"], r["enabled"]) == (f"a{k % 4}", ["high", "low"][k % 2], k % 4 + 0.5, ["t"], True)
    assert (got[4]["pattern"], got[4]["description"], got[4]["priority"], got[0]["pattern"]) == ("p0", "m", None, None)
