"""Intervals, patterns, the JVM dialect and the sampler."""

import random
import re

import pytest
from pyspark.sql import functions as F

from rulesieve.functions import patterns, stats
from rulesieve.functions.sampler import NearMiss, Sampler


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_wilson_bounds(spark):
    w = lambda m, n, c=0.95: one(spark, stats.wilson(F.lit(m), F.lit(n), c))
    assert tuple(w(0, 0)) == (0, 0)
    lo, hi = w(45, 50)
    assert 0.78 < lo < 0.9 < hi < 0.96
    assert w(0, 50)["lo"] == 0 and w(50, 50)["hi"] == 1
    assert w(45, 50, 0.99)["lo"] < lo
    assert one(spark, stats.interval_width(stats.wilson(F.lit(450), F.lit(500)))) < hi - lo
    assert one(spark, stats.is_confident(F.lit(50), F.lit(50), 0.8)) and not one(spark, stats.is_confident(F.lit(40), F.lit(50), 0.8))


def test_samples_needed(spark):
    n = lambda m, k, w=0.1: one(spark, stats.samples_needed(F.lit(m), F.lit(k), w))
    assert (n(0, 0), n(0, 30), n(5, 5)) == (1000, 30, 10)
    assert n(25, 50) == 385 and n(25, 50, 0.05) > n(25, 50)


def test_z_values():
    assert stats.z_value(0.95) == 1.96 and stats.z_value(0.9) == 1.6449 and stats.z_value(0.99) == 2.5758
    assert abs(stats.z_value(0.98) - 2.3263) < 0.001 and stats.z_value(1.0) == 1.96


def test_complexity():
    assert patterns.complexity("abc") == 3
    assert patterns.complexity("[a-z0-9_]") == 1
    assert patterns.complexity("(a|b)+") > patterns.complexity("a+")
    assert patterns.complexity("(") == 0


@pytest.mark.parametrize(("pattern", "literals"), [
    (r"foo\d+barbaz", {"barbaz"}), (r"(?i)AbCd", {"abcd"}), (r"a|bcd", {"a", "bcd"}), (r"(?:token)+x", {"token"}), (r"(abc)?de", {"de"}), (r"x{0,3}yz", {"yz"}),
    (r"(?:secret|token)\s*=", {"secret", "token"}), (r"(?:a|\d)x", {"x"}), (r"(foo|bar)?", set()), (r"ab(?:cdef|ghij)", {"cdef", "ghij"}), (r"(?i:abc)", set()),
])
def test_required_literals(pattern, literals):
    assert patterns.required_literals(pattern)[0] == literals


PROBES = [
    (r"(?P<a_b>x)(?P=a_b)", ["xx", "xy"]), (r"end\Z", ["end", "end\n"]), (r"a.b", ["a\rb", "a\nb"]), (r"\d+", ["٣", "x"]), (r"\w", ["é", "!"]),
    (r"^\s$", [" ", "\x1c"]), (r"[[]", ["[", "]"]), (r"[a&&b]", ["&", "c"]), (r"a{,2}$", ["aa", "b"]), (r"a{b", ["a{b", "ab"]), (r"(?i)straSSe", ["STRASSE", "\u017ftrasse", "e"]),
    (r"[]x]", ["]", "y"]), (r"(?<=a)b", ["ab", "b"]), (r"x{2,3}y", ["xxy", "xy"]), (r"[^\s]z", ["az", " z"]),
    (r"a\vb", ["a\nb", "a\x0bb"]), (r"(?x)[a ]z", [" z", "az", "bz"]), (r"\101", ["A", "1"]), (r"(?m)^$", ["a\n", "a", "\n"]), (r"a\0b", ["a\0b", "ab"]), (r"\U0001F600", ["\U0001F600", "x"]),
    (r"(?i)[a-z]{3}", ["\u212aEY", "12"]), (r"(?i)[^k]$", ["\u212a", "K", "x"]), (r"\bé\b", ["é", "aé"]), (r"(?s)a.b", ["a\nb"]), (r"(?a)\w\d\s", ["é٣\x1c", "a1 "]), (r"(?m)b$", ["b\nc", "bc"]), (r"b$", ["b\n", "b\nc", "b\n\n"]),
    (r"(?i:a)b", ["Ab", "AB"]), (r"[\w.-]+@x", ["é.-@x"]), (r"\Aab", ["ab", "xab"]), (r"[^\W\d_]+$", ["é", "_", "5"]), (r"(?:ab){2,3}c", ["ababc", "abc"]),
]


@pytest.mark.parametrize(("pattern", "texts"), PROBES)
def test_jvm_dialect_agrees(spark, pattern, texts):
    jvm = patterns.to_jvm(pattern)
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(F.col("t").rlike(jvm)).collect()]
    assert got == [bool(re.search(pattern, t)) for t in texts]


@pytest.mark.parametrize("pattern", [r"(a)?(?(1)b|c)", "(", r"(?i)é", r"(?:ab)*c", r"\Bx", r"(?i)(a)\1"])
def test_jvm_dialect_refuses(pattern):
    assert patterns.to_jvm(pattern) is None


@pytest.mark.parametrize("pattern", [r"\d{8}", r"^[0-9a-f]{16}$", r"key=[A-Z]{20}\b", r"(foo|bar)-\d{4}", r"a.+z"])
def test_near_misses_mostly_miss_and_keep_close(pattern):
    n, rng = NearMiss(pattern, random.Random(2)), random.Random(3)
    told = [n.one() for _ in range(200)]
    assert sum(not re.search(pattern, t) for t in told) > 40 and rng
    assert {NearMiss(pattern, random.Random(9)).one() for _ in range(2)} == {NearMiss(pattern, random.Random(9)).one()}


@pytest.mark.parametrize("pattern", [r"\d{8}", r"[0-9a-f]{16}", r"(?i)\[INST\]", r"[a-f0-9]{146}", r"a.+z", r"(foo|ba[rz]){2}\1", r"\w+@\w+\.com", r"[^a-z]{3}", r"x(?=y)y", r"(?>ab)c", r"-----BEGIN (?:RSA|EC) KEY-----"])
def test_sampler_matches(pattern):
    s = Sampler(pattern, random.Random(1))
    assert sum(bool(re.search(pattern, s.one())) for _ in range(40)) >= 20


def test_sampler_lazy_takes_the_minimum():
    assert Sampler(r"a(?s:.){0,100}?b", random.Random(1)).one() == "ab"
    assert len(Sampler(r"[a-f]{5,50}?", random.Random(1)).one()) == 5
