"""Quality of single rules: specificity, breadth, redundancy, complexity."""

from __future__ import annotations

import random
import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from rulesieve.functions.patterns import complexity
from rulesieve.operators.match import match
from rulesieve.operators.matrix import fp_potential, overlap_counts, unique_coverage

RANDOM_STRINGS = 200
LENGTHS = (8, 16, 32, 64, 128)
BROAD_OVER, LOW_SPECIFICITY, COMPLEX_OVER = 5, 0.1, 50


def random_rows(count: int = RANDOM_STRINGS, seed: int = 42) -> list[tuple[int, str]]:
    """Seeded strings of letters, digits, punctuation and blanks."""
    rng = random.Random(seed)
    alphabet = string.ascii_letters + string.digits + string.punctuation + " "
    return [(i, "".join(rng.choices(alphabet, k=rng.choice(LENGTHS)))) for i in range(count)]


def random_strings(spark: SparkSession, count: int = RANDOM_STRINGS, seed: int = 42) -> DataFrame:
    """(entry_id, text) of :func:`random_rows`."""
    return spark.createDataFrame(random_rows(count, seed), "entry_id bigint, text string")


def specificity(rules: DataFrame, strings: DataFrame) -> DataFrame:
    """(rule_id, random_hits, specificity): 1 less the share of the strings the rule matches; 1 without strings."""
    n = strings.count()
    hits = match(strings, rules).groupBy("rule_id").agg(F.count("*").alias("random_hits"))
    all_ = rules.select("rule_id").distinct().join(hits, "rule_id", "left").na.fill(0, ["random_hits"])
    return all_.withColumn("specificity", F.round(1 - F.col("random_hits") / F.lit(float(n)), 4) if n else F.lit(1.0))


def complexities(rules: DataFrame) -> DataFrame:
    """(rule_id, complexity); each distinct pattern is parsed once."""

    @F.pandas_udf(IntegerType())
    def nodes(patterns):
        return patterns.map(lambda p: complexity(p) if p is not None else 0)

    distinct = rules.select("pattern").distinct().withColumn("complexity", nodes("pattern"))
    return rules.select("rule_id", "pattern").join(distinct, "pattern", "left").select("rule_id", F.coalesce("complexity", F.lit(0)).alias("complexity"))


def quality(rules: DataFrame, matrix: DataFrame, sizes: DataFrame, strings: DataFrame) -> DataFrame:
    """One row per rule with its flags; rules: rule_id, name, source, pattern."""
    q = (
        rules.select("rule_id", "name", "source")
        .join(specificity(rules, strings), "rule_id")
        .join(fp_potential(matrix, rules), "rule_id")
        .join(overlap_counts(matrix, rules), "rule_id")
        .join(unique_coverage(matrix, sizes, rules), "rule_id")
        .join(complexities(rules), "rule_id")
    )
    broad = F.col("overlap_count") > BROAD_OVER
    low = F.col("specificity") < LOW_SPECIFICITY
    redundant = (F.col("unique_coverage") == 0) & (F.col("n") > 0)
    # fixed values: the texts of the flags
    flags = F.array_compact(
        F.array(
            F.when(low, F.format_string("Low specificity (%.2f) — matches %.0f%% of random strings", "specificity", (1 - F.col("specificity")) * 100)),
            F.when(broad, F.format_string("Broad pattern — overlaps with %d rules", "overlap_count")),
            F.when(redundant, F.lit("Zero unique coverage — fully redundant")),
            F.when(F.col("complexity") > COMPLEX_OVER, F.format_string("High complexity (%d AST nodes)", "complexity")),
        )
    )
    return q.select("rule_id", "name", "source", "specificity", "fp_potential", "complexity", "unique_coverage", "overlap_count", broad.alias("is_broad"), low.alias("is_low_specificity"), redundant.alias("is_redundant"), flags.alias("flags"))


def summary(quality_rows: DataFrame) -> DataFrame:
    return quality_rows.agg(
        F.count("*").alias("rules"), F.count_if("is_broad").alias("broad_patterns"), F.count_if("is_low_specificity").alias("low_specificity"), F.count_if("is_redundant").alias("fully_redundant"),
        F.round(F.coalesce(F.avg("specificity"), F.lit(0.0)), 3).alias("avg_specificity"), F.round(F.coalesce(F.avg("complexity"), F.lit(0.0)), 1).alias("avg_complexity"),
    )
