"""The match operator: engines agree, partitioning doesn't matter, odd input is defined."""

import pytest

from rulesieve.operators.match import match

RULES = [(1, r"\bfoo\d+\b", "x"), (2, r"(?i)ſtraße|KEY", "y"), (3, r"[A-Z]{3}$", "x"), (4, r"(", "x"), (5, None, "x"), (6, r"(a)?(?(1)b|c)", ""), (7, r"(?i)kelvin", "y")]
TEXTS = [(1, "foo12 bar", "x"), (2, "my key", "y"), (3, "ends ABC", "x"), (4, None, "x"), (5, "", "x"), (6, "ab", None), (7, "Kelvin", "y"), (8, "foo9 KEY", "y")]
WANT = {(1, 1), (2, 2), (3, 3), (6, 6), (7, 7), (8, 1), (8, 2), (8, 3)}


@pytest.fixture(scope="module")
def frames(spark):
    r = spark.createDataFrame(RULES, "rule_id int, pattern string, detector string")
    e = spark.createDataFrame(TEXTS, "entry_id bigint, text string, own string")
    return e, r


@pytest.mark.parametrize("engine", ["python", "auto"])
@pytest.mark.parametrize("parts", [1, 8])
def test_engines_and_partitions_agree(frames, engine, parts):
    e, r = frames
    assert {tuple(x) for x in match(e.repartition(parts), r, engine=engine).collect()} == WANT


def test_native_literals_are_quoted(spark):
    texts = ["${env:HOME} it's", "a\\\\b's", "tab\tx", 'say "hi"', "\u212aelvin's", "none"]
    rules = [(1, r"\$\{env:HOME\} it's"), (2, r"a\\\\b's"), (3, r"tab\tx"), (4, 'say "hi"'), (5, "(?i)kelvin's")]
    e, r = spark.createDataFrame(list(enumerate(texts)), "entry_id bigint, text string"), spark.createDataFrame(rules, "rule_id int, pattern string")
    got = {tuple(x) for x in match(e, r, engine="native").collect()}
    assert got == {tuple(x) for x in match(e, r).collect()} == {(i, i + 1) for i in range(5)}


def test_native_refuses_what_it_cannot(frames):
    e, r = frames
    with pytest.raises(ValueError):
        match(e, r, engine="native")
    assert {tuple(x) for x in match(e, r.where("rule_id IN (1, 3)"), engine="native").collect()} == {(1, 1), (3, 3), (8, 1), (8, 3)}
    with pytest.raises(ValueError):
        match(e, r, engine="quantum")


@pytest.mark.parametrize("engine", ["python", "auto"])
def test_partition_keys(frames, engine):
    e, r = frames
    assert {tuple(x) for x in match(e, r, engine=engine, partition=("own", "detector")).collect()} == {(1, 1), (2, 2), (3, 3), (6, 6), (7, 7), (8, 2)}


def test_empty_sides(frames):
    e, r = frames
    assert match(e.limit(0), r).isEmpty() and match(e, r.limit(0)).isEmpty()


def test_a_string_is_never_held_against_rules_of_other_keys(monkeypatch):
    from rulesieve.operators import match as M

    sent = ("name", {"x": [(1, "foo")], "y": [(2, "fo")]})
    assert M.matcher_of(sent, "x").hits("foo") == [1] and M.matcher_of(sent, "y").hits("foo") == [2] and M.matcher_of(sent, "z") is None
    assert M.matcher_of(sent, "x") is M.matcher_of(sent, "x")
    assert M.matcher_of(("other", {"x": [(7, "foo")]}), "x").hits("foo") == [7] and len(M._MATCHERS) == 1


def test_branches_lead_the_search():
    from rulesieve.operators.match import Matcher

    m = Matcher([(1, r"(?:secret|token)=\w+"), (2, r"\d"), (3, r"(?i)kelvin"), (4, "("), (5, r"alpha|beta\d")])
    assert len(m.always) == 1
    assert sorted(m.hits("TOKEN=a token=b")) == [1] and sorted(m.hits("beta7 alph")) == [2, 5] and m.hits("\u212aelvin") == [3]


def test_spread_follows_the_session_parameter(spark):
    from rulesieve import session

    df = spark.range(100).coalesce(1)
    kept = spark.conf.get(session.MAP_PARTITIONS)
    try:
        spark.conf.set(session.MAP_PARTITIONS, "3")
        assert session.spread(df).rdd.getNumPartitions() == 3
        spark.conf.unset(session.MAP_PARTITIONS)
        assert session.spread(df) is df
    finally:
        spark.conf.set(session.MAP_PARTITIONS, kept)


def test_hash_sample_is_bounded_and_stable(spark):
    from rulesieve.session import hash_sample

    df = spark.range(5000).selectExpr("id", "cast(id AS string) AS t", "'x' AS other")
    a = hash_sample(df.repartition(3), "id", ["id", "t"], 200)
    assert 100 <= len(a) <= 200 and a == hash_sample(df.repartition(7), "id", ["id", "t"], 200)
    assert len(hash_sample(df.limit(50), "id", ["id"], 200)) == 50 and hash_sample(df.limit(0), "id", ["id"], 200) == []
    same = spark.range(30_000).selectExpr("7 AS id", "'equal' AS t")
    assert len(hash_sample(same, "id", ["t"], 12)) == 12


def test_checkpoints_need_a_named_folder_on_a_cluster(spark, monkeypatch):
    from rulesieve import session

    assert session.checkpoint_folder(spark).startswith("file:")
    assert "mkdtemp" not in open(session.__file__).read()


def test_latest_delivery_decides(spark):
    from rulesieve.operators.evaluate import latest_hits

    e = spark.createDataFrame([(1, "foo1", 1), (1, "no", 2), (2, "foo2", 5), (2, "foo2", 5), (3, "foo3", None)], "entry_id bigint, text string, ingested_at int")
    r = spark.createDataFrame([(1, r"foo\d")], "rule_id int, pattern string")
    assert sorted(tuple(x) for x in latest_hits(e, r).collect()) == [(2, 1), (3, 1)]
