"""Rows that fail to parse: load the valid ones, set the others apart with the reason.

Records are assembled quote-aware from physical lines, parsed with Python's strict csv reader (or
the JSON parser), and only then given to the typed constructors. The first of ``syntax``,
``columns`` and ``values`` that holds is the reason.

Defined results: blank and null lines and the first line of a CSV file are neither valid nor
rejected; a layout that isn't known rejects with ``columns``; an unquoted line end inside one
record makes it two and rejects with ``columns``; repeated rows come out as often as they went in
(the query's result is distinct); extra columns are carried through untouched where asked for; a
priority beyond 64 bits rejects with ``values``.
One map over the rows, no shuffle.
"""

from __future__ import annotations

import csv
import io
import json
import re
import warnings
from collections.abc import Callable, Iterator
from datetime import date

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.session import spread

SEVERITIES = ("critical", "high", "medium", "low")
INTEGER = re.compile(r"[+-]?[0-9]+")
ISO_DATE = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")
OUT = "reason string, detail string, name string, pattern string, source string, detector string, severity string, priority bigint, text string, label string, seen_on date"
FIELDS = ("name", "pattern", "source", "detector", "severity", "priority", "text", "label", "seen_on")

csv.field_size_limit(1 << 30)


class Reject(ValueError):
    def __init__(self, reason: str, detail: str):
        super().__init__(detail)
        self.reason, self.detail = reason, detail


def assemble(lines: list[str]) -> Iterator[tuple[int, str]]:
    """(number of the first line, record) of CSV lines: lines are joined while a quoted field is open.

    A line that parses by itself is a record. One that leaves a quoted field open goes on to the line
    that closes it, if what comes together then parses as one record; else the line stands alone, is
    rejected later, and the next line begins anew. So a stray quote costs its own line only.
    """
    odd = [n for n, line in enumerate(lines) if line.count('"') % 2]
    n = k = 0
    while n < len(lines):
        end = n + 1
        if lines[n].count('"') % 2 and _parts(lines[n]) < 0:
            while k < len(odd) and odd[k] <= n:
                k += 1
            if k < len(odd) and _parts(joined := "".join(lines[n : odd[k] + 1])) == 1 and joined:
                end = odd[k] + 1
        yield n + 1, "".join(lines[n:end]).rstrip("\r\n")
        n = end


def _parts(text: str) -> int:
    """Records in a text; -1 where a quoted field stays open or closes wrongly."""
    try:
        return len(list(csv.reader(io.StringIO(text, newline=""), strict=True)))
    except csv.Error:
        return -1


def csv_fields(record: str) -> list[str]:
    try:
        rows = list(csv.reader(io.StringIO(record, newline=""), strict=True))
    except csv.Error as e:
        raise Reject("syntax", str(e)) from None
    if len(rows) != 1:
        raise Reject("columns", f"{len(rows)} records in one")
    return rows[0]


def rule_row(fields: list[str]) -> dict:
    name, pattern, source, detector, severity, priority = fields
    if not name.strip():
        raise Reject("values", "blank name")
    if not pattern.strip():
        raise Reject("values", "blank pattern")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            re.compile(pattern)
    except (re.error, OverflowError, RecursionError) as e:
        raise Reject("values", f"pattern: {e}") from None
    level = severity.strip().lower()
    if level and level not in SEVERITIES:
        raise Reject("values", f"severity {severity!r}")
    number = priority.strip()
    if number and not INTEGER.fullmatch(number):
        raise Reject("values", f"priority {priority!r}")
    if len(number.lstrip("+-0")) > 19 or (number and not -(2**63) <= int(number) < 2**63):
        raise Reject("values", "priority beyond 64 bits")
    return {"name": name, "pattern": pattern, "source": source, "detector": detector, "severity": level or None, "priority": int(number) if number else None}


def entry_row(fields: list[str]) -> dict:
    text, label, source, seen_on = fields
    if not text.strip():
        raise Reject("values", "blank text")
    day = seen_on.strip()
    try:
        if not ISO_DATE.fullmatch(day):
            raise ValueError
        seen = date.fromisoformat(day)
    except ValueError:
        raise Reject("values", f"seen_on {seen_on!r}") from None
    return {"text": text, "label": label, "source": source, "seen_on": seen}


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _long(digits: str):
    """An integer; one too long to be read as a number stays text."""
    return int(digits) if len(digits) < 4000 else digits


def json_row(record: str) -> dict:
    try:
        value = json.loads(record, parse_constant=_no_constant, parse_int=_long)
    except (ValueError, RecursionError) as e:
        raise Reject("syntax", str(e)) from None
    if not isinstance(value, dict) or "text" not in value:
        raise Reject("columns", "no object with a key text")
    if not isinstance(value["text"], str) or not value["text"].strip():
        raise Reject("values", "text blank or no string")
    said = lambda k: None if value.get(k) is None else value[k] if isinstance(value[k], str) else json.dumps(value[k])
    return {"text": value["text"], "label": said("label"), "source": said("source")}


#: layout -> (number of CSV fields or 0 for JSON, constructor)
LAYOUTS: dict[str, tuple[int, Callable]] = {"rules_csv": (6, rule_row), "entries_csv": (4, entry_row), "entries_jsonl": (0, json_row)}


def parse(layout: str | None, line_no: int | None, text: str | None) -> dict | None:
    """The typed row, the reason and detail of a reject, or None for what is neither."""
    if text is None or not text.strip():
        return None
    width, build = LAYOUTS.get(layout or "", (-1, None))
    if width > 0 and line_no == 1:
        return None
    try:
        if width < 0:
            raise Reject("columns", f"layout {layout!r}")
        if width == 0:
            return build(text)
        fields = csv_fields(text)
        if len(fields) != width:
            raise Reject("columns", f"{len(fields)} fields, not {width}")
        return build(fields)
    except Reject as e:
        return {"reason": e.reason, "detail": e.detail}


def load_rows(raw: DataFrame, key: str = "row_id", layout: str = "layout", line_no: str = "line_no", text: str = "raw_text") -> DataFrame:
    """key, reason (null for a valid row), detail and the typed fields, one row per record."""
    names = ["reason", "detail", *FIELDS]
    kinds = [pa.string()] * 7 + [pa.int64(), pa.string(), pa.string(), pa.date32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, rows = [], []
            for i, (kind, number, told) in enumerate(zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True)):
                row = parse(kind, number, told)
                if row is not None:
                    keep.append(i)
                    rows.append(row)
            columns = [pa.array([r.get(n) for r in rows], k) for n, k in zip(names, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns], ["k", *names])

    kind = raw.schema[key].dataType.simpleString()
    return spread(raw.select(key, layout, line_no, text)).mapInArrow(run, f"k {kind}, {OUT}").withColumnRenamed("k", key)


def valid(loaded: DataFrame) -> DataFrame:
    return loaded.where("reason IS NULL").drop("reason", "detail")


def rejects(loaded: DataFrame, key: str = "row_id") -> DataFrame:
    return loaded.where("reason IS NOT NULL").select(key, "reason", "detail")


def read_files(spark: SparkSession, paths: str | list[str], layout: str) -> DataFrame:
    """raw rows (file_name, line_no, layout, raw_text, row_id) of text files.

    JSON lines are records of their own and are split wherever Spark splits the file; their line_no
    orders them within it. CSV is assembled quote-aware, one file a task.
    """
    if LAYOUTS.get(layout, (1, None))[0] == 0:
        lines = spark.read.text(paths).select(F.input_file_name().alias("file_name"), F.monotonically_increasing_id().alias("row_id"), "value")
        return lines.select("file_name", F.lit(None).cast("int").alias("line_no"), F.lit(layout).alias("layout"), F.col("value").alias("raw_text"), "row_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                records = list(assemble(list(io.StringIO(text, newline=""))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(records), pa.string()), pa.array([n for n, _ in records], pa.int32()), pa.array([layout] * len(records), pa.string()), pa.array([r for _, r in records], pa.string())],
                    ["file_name", "line_no", "layout", "raw_text"],
                )

    files = spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("file_name"), "value")
    rows = files.mapInArrow(run, "file_name string, line_no int, layout string, raw_text string")
    return rows.withColumn("row_id", F.xxhash64("file_name", "line_no"))
