"""Consolidating pairwise matches into groups: connected components by graph reduction.

While enough vertices of degree one or two are left, an independent set of them (local maxima of a
random priority among low-degree neighbours) is removed: a leaf hangs itself on its neighbour, a
chain vertex is spliced out and its two neighbours are joined, which is list ranking by
independent-set removal: a chain of length n is gone after O(log n) rounds. What is left, the core,
is solved by alternating large-star and small-star steps. Every removed vertex points to a neighbour
that was removed later or not at all, so pointer jumping gives all of them their labels in as many
rounds as the layers' number has binary digits.

Names are numbered by a 64-bit hash that is checked to give every name a number of its own; rounds
move numbers only. Two checkpoints a round: the vertices removed and the edges left. No list of links or
components reaches the driver: only counts do. Hot vertices, those with more than a ``1 / MOST_HOT``
share of all edges, of which there are at most ``MOST_HOT``, meet what belongs to them by a broadcast
of that bounded size; only the others are shuffled by vertex.

Defined results: null ends, blank names and self links are ignored; pairs may repeat and turn
round; names are trimmed; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.session import cut


def both_ways(edges: DataFrame) -> DataFrame:
    """Distinct directed edges (u, v) in both directions, without loops."""
    e = edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    return e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()


def star_links(lists: DataFrame, column: str) -> DataFrame:
    """Links every member of a list to its smallest member; a list of one links nothing."""
    members = F.array_distinct(F.filter(F.transform(F.col(column), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))
    m = lists.select(members.alias("m")).where(F.size("m") > 1)
    return m.select(F.array_min("m").alias("u"), F.explode("m").alias("v")).where("u <> v")


def _priority(column: str, turn: int):
    return F.struct(F.xxhash64(F.lit(turn), F.col(column)), F.col(column))


#: Vertices that may be hot at once, and the edges a vertex has at least to be one.
MOST_HOT, HOT_EDGES = 1000, 100_000
#: Rounds of peeling go on while they remove a vertex for every so many directed edges.
WORTHWHILE = 20


def _hot(degrees: DataFrame, total: int, least: int) -> DataFrame | None:
    """(u,) of the vertices with over ``total / MOST_HOT`` and at least ``least`` of the directed edges; None where there can be none."""
    return degrees.where(F.col("d") > max(least, total // MOST_HOT)).select("u") if total > least else None


def _met(left: DataFrame, right: DataFrame, key: str, how: str, hot: DataFrame | None) -> DataFrame:
    """``left.join(right, key, how)`` for a right side with at most one row a key; hot keys meet by broadcast."""
    if hot is None:
        return left.join(right, key, how)
    few = F.broadcast(hot.withColumnRenamed("u", key))
    cold = left.join(few, key, "left_anti").join(right, key, how)
    return cold.unionByName(left.join(few, key, "left_semi").join(F.broadcast(right.join(few, key, "left_semi")), key, how))


def _peeled(edges: DataFrame, total: int, turn: int, hot_edges: int) -> tuple[DataFrame, DataFrame]:
    """The edges (u, v) left, and the removed vertices (u, to) with a neighbour of theirs."""
    degrees = edges.groupBy("u").agg(F.count("*").alias("d"), F.min("v").alias("a"), F.max("v").alias("b"))
    hot = _hot(degrees, total, hot_edges)
    ends = degrees.where("d <= 2")
    near = ends.select("u", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("near"))
    # a neighbour of low degree is a rival; a hot one never is
    rival = _met(near, ends.select(F.col("u").alias("near"), F.lit(True).alias("low")), "near", "left", hot)
    gone = rival.groupBy("u", "a", "b").agg(F.max(F.when(F.col("low"), _priority("near", turn))).alias("rival")).where(F.col("rival").isNull() | (_priority("u", turn) > F.col("rival"))).select("u", "a", "b")
    gone = cut(gone)
    kept = _met(_met(edges, gone.select("u"), "u", "left_anti", hot), gone.select(F.col("u").alias("v")), "v", "left_anti", hot).select("u", "v")
    joined = gone.where("a <> b").select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select("e.u", "e.v")
    return cut(kept.union(joined).distinct()), gone.select("u", F.col("a").alias("to"))


def _core_labels(edges: DataFrame, total: int, most: int, hot_edges: int) -> DataFrame:
    """(u, label) of every vertex of the core: large-star and small-star until the edges are stars."""
    e = edges.where("v < u").select("u", "v")
    before = None
    for _ in range(most):
        two = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("d"))
        met = _met(two, low.select("u", "m"), "u", "inner", _hot(low, total, hot_edges))
        large = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("d"))
        small = _met(large, low.select("u", "m"), "u", "inner", _hot(low, total, hot_edges))
        e = cut(small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the core did not settle in {most} rounds")
    labels = e.select("u", F.col("v").alias("label"))
    return labels.union(e.select(F.col("v").alias("u"), F.col("v").alias("label"))).distinct()


def _own_seed(names: DataFrame, most: int = 8) -> int:
    """The first seed whose hash gives every name a number of its own; one does unless there are over some 10^10 names."""
    count = names.count()
    for seed in range(most):
        if names.agg(F.count_distinct(F.xxhash64(F.lit(seed), "name"))).first()[0] == count:
            return seed
    raise RuntimeError(f"no hash of {most} tells {count} names apart")


def _pointed(to: DataFrame, total: int, least: int) -> DataFrame | None:
    """The hot ones of the vertices pointed to."""
    return _hot(to.groupBy(F.col("to").alias("u")).agg(F.count("*").alias("d")), total, least)


def components(edges: DataFrame, most: int = 60, hot_edges: int = HOT_EDGES) -> DataFrame:
    """(name, group_name) of every vertex with a neighbour; group_name is the smallest member."""
    named = cut(both_ways(edges))
    names = cut(named.select(F.col("u").alias("name")).distinct())
    seed = _own_seed(names)
    number = lambda c: F.xxhash64(F.lit(seed), F.col(c))
    left = named.select(number("u").alias("u"), number("v").alias("v"))
    total = left.count()
    removed: list[DataFrame] = []
    pointers = 0
    for turn in range(most):
        if not total:
            break
        left, gone = _peeled(left, total, turn, hot_edges)
        removed.append(gone)
        went = gone.count()
        pointers += went
        if went * WORTHWHILE < total:
            total = left.count()
            break
        total = left.count()
    else:
        raise RuntimeError(f"vertices of low degree were left after {most} rounds")
    labels = _core_labels(left, total, most, hot_edges) if not left.isEmpty() else left.select("u", F.col("v").alias("label"))
    if removed:
        # who is pointed to and points nowhere is of the core, or the last of its group
        to = cut(reduce(DataFrame.union, removed))
        for _ in range(len(removed).bit_length()):
            there = to.select(F.col("u").alias("to"), F.col("to").alias("next"))
            to = cut(_met(to, there, "to", "left", _pointed(to, pointers, hot_edges)).select("u", F.coalesce("next", "to").alias("to")))
        known = labels.select(F.col("u").alias("to"), "label")
        ends = to.select("to").distinct().join(known, "to", "left").select("to", F.coalesce("label", "to").alias("label"))
        hung = _met(to, ends, "to", "inner", _pointed(to, pointers, hot_edges)).select("u", "label")
        labels = labels.union(ends.select(F.col("to").alias("u"), "label")).union(hung).distinct()
    told = cut(names.withColumn("u", number("name")).join(labels, "u").select("name", "label"))
    small = told.groupBy("label").agg(F.min("name").alias("group_name"), F.count("*").alias("d"))
    # a label that a large share of all names has is met by broadcast
    hot = _hot(small.select(F.col("label").alias("u"), "d"), pointers + total, hot_edges)
    return _met(told, small.select("label", "group_name"), "label", "inner", hot).select("name", "group_name").distinct()
