"""The match operator on a stream of entries: hits per rule and time window, late data by watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.operators.match import match
from rulesieve.sources.corpus import jsonl_lines


def stream_hits(entries: DataFrame, rules: DataFrame, time: str = "seen_at", text: str = "text", engine: str = "python") -> DataFrame:
    """(seen_at, rule_id) of every hit; works on static and streaming frames alike."""
    return match(entries, rules, entry_key=time, text=text, engine=engine)


def windowed_counts(hits: DataFrame, time: str = "seen_at", window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """(window_start, rule_id, hits): counts per tumbling or sliding window; rows later than ``late`` are left out of a stream."""
    kept = hits.withWatermark(time, late) if hits.isStreaming else hits
    at = F.window(time, window, slide) if slide else F.window(time, window)
    return kept.groupBy(at.alias("w"), "rule_id").agg(F.count("*").alias("hits")).select(F.col("w.start").alias("window_start"), "rule_id", "hits")


def jsonl_stream(spark, path: str, **fields: str) -> DataFrame:
    """(text, label, source) of JSON lines files as they arrive in a folder."""
    return jsonl_lines(spark.readStream.text(path), **fields)
