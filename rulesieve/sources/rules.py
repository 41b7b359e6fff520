"""Rule files to validated rules and to the ``rules`` DataFrame."""

from __future__ import annotations

import json
import logging
import re
from collections.abc import Iterator, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rulesieve.errors import InputError, RuleError
from rulesieve.functions.patterns import compiled
from rulesieve.schemas import RULES, Rule
from rulesieve.sources.formats import raw_entries

log = logging.getLogger("rulesieve.sources")

# The keys a field may stand under, in order of preference.
NAMES = ("name", "id", "rule_name", "rule_id")
PATTERNS = ("pattern", "regex", "regexp", "re")
DETECTORS = ("detector", "type", "category")
SEVERITIES = ("severity", "level")


def _first(entry: dict, keys: Sequence[str]) -> str | None:
    """The value under the first key present, as a string."""
    return next((str(entry[k]) for k in keys if k in entry), None)


class _Checker:
    """Validates entries of one file in order; names are reserved even by rules rejected later."""

    def __init__(self, path: str, priority: int, mapping: dict[str, str]):
        self.path, self.priority, self.taken = path, priority, set()
        self.names = (*([mapping["name"]] if "name" in mapping else []), *NAMES)
        self.patterns = (*([mapping["pattern"]] if "pattern" in mapping else []), *PATTERNS)
        self.known = {*self.names, *self.patterns, *DETECTORS, *SEVERITIES, "tags"}

    def rule(self, entry: object, number: int) -> Rule:
        at = f"entry {number} of {self.path}"
        if not isinstance(entry, dict):
            raise RuleError(f"{at} is no mapping but {type(entry).__name__}", "", self.path, number)
        name = _first(entry, self.names)
        if not name:
            raise RuleError(f"{at} has no name (looked for {', '.join(self.names)})", "", self.path, number)

        def bad(what: str) -> RuleError:
            return RuleError(f"rule '{name}', {at}, {what}", name, self.path, number)

        if name in self.taken:
            raise bad("repeats a name; names are unique within a file")
        self.taken.add(name)
        pattern = _first(entry, self.patterns)
        if pattern is None:
            raise bad(f"has no pattern (looked for {', '.join(self.patterns)})")
        if not pattern.strip():
            raise bad("has an empty pattern")
        try:
            compiled(pattern)
        except (re.error, RecursionError, OverflowError) as e:
            raise bad(f"has a pattern that doesn't compile: {e}: {pattern}") from e
        given = entry.get("metadata")
        return Rule(
            name, pattern, self.path, _first(entry, DETECTORS) or "", _first(entry, SEVERITIES) or "",
            tuple(map(str, entry["tags"])) if isinstance(entry.get("tags"), list) else (), self.priority,
            given if isinstance(given, dict) else {k: v for k, v in entry.items() if k not in self.known},
        )


def checked(path: str, priority: int = 0, field_mapping: dict[str, str] | None = None) -> Iterator[Rule | RuleError]:
    """Every entry of a file as a rule or as what is wrong with it."""
    checker = _Checker(str(path), priority, field_mapping or {})
    for number, entry in enumerate(raw_entries(str(path)), 1):
        try:
            yield checker.rule(entry, number)
        except RuleError as e:
            yield e


def load_rules(path: str | Path, skip_invalid: bool = False, priority: int = 0, field_mapping: dict[str, str] | None = None) -> list[Rule]:
    """The valid rules of a file. The first invalid entry raises, or is logged and left out with ``skip_invalid``."""
    rules: list[Rule] = []
    skipped = 0
    for r in checked(str(path), priority, field_mapping):
        if isinstance(r, Rule):
            rules.append(r)
        elif skip_invalid:
            skipped += 1
            log.warning("left out: %s", r)
        else:
            raise r
    if not rules:
        raise InputError(f"{path}: no valid rules")
    log.info("%s: %d rules loaded, %d left out", path, len(rules), skipped)
    return rules


def load_files(paths: Sequence[str | Path], skip_invalid: bool = False, priorities: dict[str, int] | None = None, field_mapping: dict[str, str] | None = None) -> list[Rule]:
    """Rules of several files in file order; priorities by base name, then path, else 10 per place from the last."""
    told = priorities or {}
    out: list[Rule] = []
    for place, path in enumerate(paths):
        priority = told.get(Path(path).name, told.get(str(path), (len(paths) - place) * 10))
        out += load_rules(path, skip_invalid, priority, field_mapping)
    return out


def rules_frame(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The ``rules`` DataFrame; rule_id is the place in the list, so names may repeat across files."""
    flag = lambda r: r.metadata.get("catch_all") if isinstance(r.metadata.get("catch_all"), bool) else None
    rows = [(i, r.name, r.pattern, r.source, r.detector, r.severity, list(r.tags), r.priority, json.dumps(r.metadata, default=str), flag(r)) for i, r in enumerate(rules)]
    return spark.createDataFrame(rows, RULES)


def rules_of_table(table: DataFrame) -> DataFrame:
    """A stored rule table (rule_id, name, …, metadata JSON) with catch_all read from its metadata, where it is a boolean."""
    told = F.try_variant_get(F.try_parse_json("metadata"), "$.catch_all", "variant")
    return table.withColumn("catch_all", F.when(F.schema_of_variant(told) == "BOOLEAN", told.cast("boolean")))
