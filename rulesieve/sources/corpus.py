"""Real corpora: JSON lines and the added lines of a git history."""

from __future__ import annotations

import json
import logging
import subprocess
import tempfile
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.errors import InputError
from rulesieve.session import checkpoint_folder, cut

log = logging.getLogger("rulesieve.sources")
#: Stands before every commit in the log; no text of a patch holds it as a rule.
COMMIT = "\x1e\x1d\x1e"


def _said(value: object) -> str:
    return value if isinstance(value, str) else str(value)


def jsonl_lines(lines: DataFrame, text_field: str = "text", label_field: str = "label", source_field: str = "source", line: str = "value", keep_bad: bool = False) -> DataFrame:
    """(text, label, source) of lines that are JSON objects with a text; other lines are left out, or kept with a null text.

    Values that are no strings become what Python prints for them, so a null label becomes 'None'.
    Blank lines and empty texts are left out in either case: they are no faults.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for told in batch.column(0).to_pylist():
                told = (told or "").strip()
                if not told:
                    continue
                try:
                    value = json.loads(told)
                except (ValueError, RecursionError):
                    value = None
                if not isinstance(value, dict):
                    rows += [(None, None, None)] if keep_bad else []
                elif text := value.get(text_field):
                    rows.append((_said(text), _said(value.get(label_field, "")), _said(value.get(source_field, ""))))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], ["text", "label", "source"])

    return lines.select(line).mapInArrow(run, "text string, label string, source string")


def load_jsonl(spark: SparkSession, path: str, text_field: str = "text", label_field: str = "label", source_field: str = "source") -> DataFrame:
    """(entry_id, text, label, source), parsed once and cut; raises InputError where the file is missing or holds no entry."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        raise InputError(f"{path}: {e}") from e
    parsed = cut(jsonl_lines(lines, text_field, label_field, source_field, keep_bad=True).select(F.monotonically_increasing_id().alias("entry_id"), "*"))
    counts = parsed.agg(F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("bad")).first()
    if counts["bad"]:
        log.warning("%s: %d lines are no JSON objects and were left out", path, counts["bad"])
    if counts["n"] == counts["bad"]:
        raise InputError(f"{path}: no entries")
    return parsed.where("text IS NOT NULL")


def git_log(repo: str, into: Path, max_commits: int = 500, seconds: int = 120) -> None:
    """Writes the history's patches to a file, one commit after each record separator; nothing is held in memory."""
    command = ["git", "-C", repo, "log", f"--max-count={max_commits}", "--diff-filter=AM", "-p", "--no-color", "--unified=0", f"--format={COMMIT}%H"]
    try:
        with into.open("wb") as out:
            done = subprocess.run(command, stdout=out, stderr=subprocess.PIPE, timeout=seconds, check=False)
    except (OSError, subprocess.TimeoutExpired) as e:
        raise InputError(f"{repo}: {e}") from e
    if done.returncode:
        raise InputError(f"{repo}: {done.stderr.decode(errors='replace').strip()}")


def added_lines(commits: DataFrame, max_line_length: int = 500) -> DataFrame:
    """(text, label, source) of commits (commit_no, value), value a hash and its patch: first occurrence of every added line.

    A commit is one row, so the file of a line is carried forward within it and nothing is sorted in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for number, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                head, *lines = (told or "").split("\n")
                path = ""
                for n, line in enumerate(lines):
                    if line.startswith("+++"):
                        path = line[6:] if line.startswith("+++ b/") else path
                    elif line.startswith("+") and line[1:].strip() and len(line) - 1 <= max_line_length:
                        rows.append((number, n, line[1:], f"{head[:7]}:{path}"))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["commit_no", "line_no", "text", "source"])

    lines = commits.select("commit_no", "value").mapInArrow(run, "commit_no bigint, line_no bigint, text string, source string")
    first = lines.groupBy("text").agg(F.min_by("source", F.struct("commit_no", "line_no")).alias("source"))
    return first.select("text", F.lit("").alias("label"), "source")


def load_git(spark: SparkSession, repo: str, max_commits: int = 500, max_line_length: int = 500) -> DataFrame:
    """(entry_id, text, label '', source 'hash7:path') of a repository's added lines; the log goes through a file in the folder for checkpoints, which all executors share."""
    shared = urlparse(checkpoint_folder(spark))
    if shared.scheme not in ("", "file"):
        raise InputError(f"{repo}: the history is read through spark.checkpoint.dir, which must be a mounted folder, not {shared.scheme}")
    with tempfile.TemporaryDirectory(prefix="git-", dir=shared.path) as folder:
        file = Path(folder, "log")
        git_log(repo, file, max_commits)
        commits = spark.read.option("lineSep", COMMIT).text(file.as_uri()).where("value <> ''").select(F.monotonically_increasing_id().alias("commit_no"), "value")
        entries = cut(added_lines(commits, max_line_length).select(F.monotonically_increasing_id().alias("entry_id"), "*"))
    if entries.isEmpty():
        raise InputError(f"{repo}: no added lines")
    return entries


def first_seen(lines: DataFrame, text: str, order: list[str]) -> DataFrame:
    """One row per distinct text: the first in the given order (row_number = 1 without a sort of whole groups)."""
    rest = [c for c in lines.columns if c != text]
    return lines.groupBy(text).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("f")).select(text, *[F.col(f"f.{c}").alias(c) for c in rest])
