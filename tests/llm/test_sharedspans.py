"""Shared characters against a dictionary of all spans."""

import random
from collections import defaultdict

import pytest

from rulesieve.llm.sharedspans import _common, _tree, shared_chars


def brute(docs, n):
    where = defaultdict(set)
    for d, t in docs:
        for i in range(len(t or "") - n + 1):
            where[t[i : i + n]].add(d)
    out = {}
    for d, t in docs:
        end = total = 0
        for i in range(len(t or "") - n + 1):
            if len(where[t[i : i + n]]) > 1:
                total += i + n - max(i, end)
                end = i + n
        if total:
            out[d] = total
    return out


def corpus(kind):
    rng = random.Random(kind)
    noise = lambda k: "".join(rng.choices("abcdefghij é漢😀\r\n", k=k))
    docs = [(i, noise(rng.randrange(0, 500))) for i in range(20)]
    if kind == "passages":
        parts = [noise(rng.randrange(30, 120)) for _ in range(6)]
        docs += [(100 + i, noise(rng.randrange(90)) + rng.choice(parts) + noise(5) + rng.choice(parts) + noise(rng.randrange(60))) for i in range(30)]
    if kind == "periodic":
        docs += [(200, "ab" * 150), (201, "x" + "ab" * 100 + "y"), (202, " " * 300), (203, "q" + " " * 90 + "r"), (204, "abc" * 80)]
    if kind == "boilerplate":
        head = noise(80)
        docs += [(300 + i, noise(rng.randrange(40)) + head + noise(40)) for i in range(60)]
    if kind == "copies":
        t = noise(200)
        docs += [(400, t), (401, t), (402, t), (403, t[:-1] + "!"), (404, t[:59]), (405, t[:60])]
    return docs + [(900, None), (901, ""), (902, "short")]


@pytest.mark.parametrize("kind", ["passages", "periodic", "boilerplate", "copies"])
@pytest.mark.parametrize("group_rows", [4000, 3])
def test_against_brute_force(spark, kind, group_rows):
    docs = corpus(kind)
    df = spark.createDataFrame([(*r, 1, "k") for r in docs + docs[:3]], "doc_id bigint, text string, d int, key string")
    got = [tuple(r) for r in shared_chars(df, "doc_id", "text", span=60, prefix=24, group_rows=group_rows).collect()]
    assert len(got) == len(dict(got)) and dict(got) == brute(docs, 60)


def test_empty_and_long(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert shared_chars(df, "doc_id", "text").isEmpty()
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefgh ", k=1_500_000))
    df = spark.createDataFrame([(1, long), (2, "zz" + long[700_000:701_000] + "zz"), (3, "solo" * 200)], "doc_id bigint, text string")
    assert {tuple(r) for r in shared_chars(df, "doc_id", "text").collect()} == {(1, 1000), (2, 1000)}


def test_trees():
    texts = ["abcd", "abce", "b", "abc", "b", ""]
    order, common = _tree([0, 0, 0, 0, 1, 0], texts)
    assert [texts[i] for i in order] == ["", "abc", "abcd", "abce", "b", "b"] and common.tolist() == [-1, 0, 3, 3, 0, -1]
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choices("ab", k=rng.randrange(12))) for _ in range(2))
        n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert _common(a, b) == n
