"""Groups of links against union-find."""

import random

import pytest

from rulesieve.llm import components


def brute(edges):
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            up[max(root(a), root(b))] = min(root(a), root(b))
    groups = {}
    for x in up:
        groups.setdefault(root(x), []).append(x)
    return {(x, min(g)) for g in groups.values() for x in g}


def links(kind):
    rng = random.Random(5)
    name = lambda i: f"n{i:04d}"
    if kind == "chain":
        order = list(range(60))
        rng.shuffle(order)
        return [(name(a), name(b)) for a, b in zip(order, order[1:], strict=False)]
    if kind == "star":
        return [(name(7), name(i)) for i in range(40)]
    if kind == "core":
        return [(name(rng.randrange(40)), name(rng.randrange(40))) for _ in range(150)] + [(name(i), name(i + 100)) for i in range(40)]
    if kind == "forest":
        return [(name(i), name(rng.randrange(max(1, i - 20), i + 1))) for i in range(1, 120) if i % 17]
    if kind == "rings":
        return [(name(g * 10 + i), name(g * 10 + (i + 1) % 7)) for g in range(4) for i in range(7)]
    return [("é", "z"), ("z", "\U0001f600"), ("a", "a"), (None, "b"), ("b", None), ("x", "y"), ("y", "x"), ("x", "y")]


@pytest.mark.parametrize("kind", ["chain", "star", "core", "forest", "rings", "odd"])
@pytest.mark.parametrize("hot_edges", [components.HOT_EDGES, 5])
def test_against_union_find(spark, kind, hot_edges):
    edges = links(kind)
    df = spark.createDataFrame([(a, b, "c", "x") for a, b in edges], "u string, v string, label string, a string")
    got = [tuple(r) for r in components.components(df, hot_edges=hot_edges).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(edges)


def test_lists_and_empty(spark):
    lists = spark.createDataFrame([(["b ", "a", None, "b"],), (["c"],), ([None],), (None,), ([],), ([" ", "d"],)], "m array<string>")
    assert {tuple(r) for r in components.star_links(lists, "m").collect()} == {("a", "b")}
    assert components.components(components.star_links(lists.limit(0), "m")).isEmpty()
