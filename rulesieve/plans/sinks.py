"""Distributed sinks: pairs, matrices and corpora written by the executors, whatever their number."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FORMATS = ("parquet", "json", "csv", "orc")


def flat(df: DataFrame) -> DataFrame:
    """Structs as columns of their own and arrays as JSON, for formats without nesting."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind == "struct":
            out += [F.col(f"`{f.name}`.`{x}`").alias(f"{f.name}_{x}") for x in f.dataType.names]
        else:
            out.append(F.to_json(f"`{f.name}`").alias(f.name) if kind in ("array", "map") else F.col(f"`{f.name}`"))
    return df.select(*out)


def write_frame(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """Writes a frame to a folder, one file a task, in folders by a column where one is named; replaces what is there."""
    if form not in FORMATS:
        raise ValueError(f"unknown format {form!r}; known: {', '.join(FORMATS)}")
    writer = (flat(df) if form == "csv" else df).write.mode("overwrite").format(form)
    if form == "csv":
        writer = writer.option("header", True).option("escape", '"')
    (writer.partitionBy(by) if by else writer).save(path)


def write_pairs(pairs: DataFrame, path: str, form: str = "parquet") -> None:
    """Classified pairs, in one folder per relationship."""
    write_frame(pairs, path, form, "relationship")


def write_corpus(corpus: DataFrame, rules: DataFrame, path: str, form: str = "json") -> None:
    """A generated corpus as (text, source_rule, is_negative)."""
    names = rules.select(F.col("rule_id").alias("source_rule_id"), F.col("name").alias("source_rule"))
    write_frame(corpus.join(names, "source_rule_id").select("text", "source_rule", "is_negative"), path, form)
