"""Best representative of each duplicate group, built field by field.

Iterative truth discovery: every record of a group claims a value for every field; the support of
a value is the sum of the reliabilities of the sources claiming it, and the reliability of a
source is the share of its claims that won, re-estimated until it settles.

``precedence`` lists the order in which records must be believed. Votes are compared by
precedence first and by support where precedence ties; with an empty precedence the support alone
decides. Missing values never win over present ones.

Defined results: a group without any known record gets null as representative and '' in the other
fields; null group members are ignored; repeated records count once; an empty table gives an empty
result. Only (group, field, source, value) claims are shuffled, never whole groups to one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rulesieve.session import cut, trimmed

MISSING_WORDS = ("", "none", "unknown", "n/a")


def present(value: Column) -> Column:
    """The value, or null where it is null, blank or a word for missing."""
    return F.when(~F.lower(trimmed(value)).isin(*MISSING_WORDS), value)


def claims(groups: DataFrame, records: DataFrame, group: str, members: str, key: str, fields: dict[str, Column], precedence: list[Column], source: Column) -> DataFrame:
    """(grp, field, value, source, rank, votes): one row per distinct claim; value is never null."""
    member = groups.select(F.col(group).alias("grp"), F.explode(F.array_distinct(F.col(members))).alias("member")).where("member IS NOT NULL").distinct()
    order = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(precedence or [F.lit(0)])])
    record = records.select(
        F.col(key).alias("member"),
        source.alias("source"),
        order.alias("rank"),
        F.array(*[F.struct(F.lit(n).alias("field"), c.alias("value")) for n, c in fields.items()]).alias("told"),
    ).distinct()
    told = member.join(record, "member").select("grp", "source", "rank", F.explode("told").alias("t"))
    return told.select("grp", "t.field", "t.value", "source", "rank").where("value IS NOT NULL").groupBy("grp", "field", "value", "source").agg(F.min("rank").alias("rank"), F.count("*").alias("votes"))


def discover(told: DataFrame, most: int = 100, tolerance: float = 1e-3) -> tuple[DataFrame, DataFrame]:
    """(winners, reliability) after the alternation settles; one that doesn't in ``most`` rounds is an error.

    winners: (grp, field, value, support); reliability: (source, weight).
    """
    told = cut(told)
    weights = None
    for _ in range(most):
        weighted = told.withColumn("weight", F.lit(0.5)) if weights is None else told.join(weights, F.col("source").eqNullSafe(F.col("w_source"))).drop("w_source")
        support = weighted.groupBy("grp", "field", "value").agg(F.min("rank").alias("rank"), F.sum("weight").alias("support"))
        # ties of precedence and support go to the smaller value
        best = F.min_by(F.struct("value", "support"), F.struct(F.col("rank"), -F.round("support", 9), F.col("value")))
        winners = cut(support.groupBy("grp", "field").agg(best.alias("w")).select("grp", "field", "w.value", "w.support"))
        won = winners.select("grp", "field", F.col("value").alias("winner"))
        hit = F.when(F.col("value") == F.col("winner"), 1).otherwise(0)
        fresh = cut(told.join(won, ["grp", "field"]).groupBy(F.col("source").alias("w_source")).agg(((F.sum(hit) + 1) / (F.count("*") + 2)).alias("weight")))
        if weights is not None:
            old = weights.withColumnRenamed("weight", "was").withColumnRenamed("w_source", "o_source")
            moved = fresh.join(old, F.col("w_source").eqNullSafe(F.col("o_source"))).agg(F.max(F.abs(F.col("weight") - F.col("was")))).first()[0]
            weights = fresh
            if moved is None or moved < tolerance:
                break
        weights = fresh
    else:
        raise RuntimeError(f"the reliabilities did not settle in {most} rounds")
    return winners, weights.withColumnRenamed("w_source", "source")


def survivors(groups: DataFrame, records: DataFrame, group: str, members: str, key: str, fields: dict[str, Column], precedence: list[Column], source: Column, name: str, most: int = 100) -> DataFrame:
    """One row per group: group, ``name`` (null without records) and every field ('' where missing)."""
    winners, _ = discover(claims(groups, records, group, members, key, fields, precedence, source), most)
    wide = winners.groupBy("grp").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    ids = groups.select(F.col(group).alias("grp")).distinct()
    out = ids.join(wide, "grp", "left")
    return out.select(F.col("grp").alias(group), *[F.col(f) if f == name else F.coalesce(f, F.lit("")).alias(f) for f in fields])


def newest_first(records: DataFrame) -> list[Column]:
    """priority descending with null last, updated_at descending, rule_id ascending; smaller sorts first."""
    return [
        F.col("priority").isNull(),
        F.coalesce(-F.col("priority").cast("bigint"), F.lit(0)),
        F.col("updated_at").isNull(),
        F.coalesce(-F.unix_micros(F.col("updated_at").cast("timestamp")), F.lit(0)),
        F.col("rule_id"),
    ]
