"""Schemas of the tables the operators exchange, and the constants in them."""

from __future__ import annotations

from dataclasses import dataclass, field

RULES = "rule_id int, name string, pattern string, source string, detector string, severity string, tags array<string>, priority int, metadata string, catch_all boolean"
CORPUS = "entry_id bigint, text string, source_rule_id int, is_negative boolean"
ENTRIES = "entry_id bigint, text string, label string, source string"

# Relationships and recommendations as reports spell them.
DUPLICATE, SUBSET, SUPERSET, OVERLAP, DISJOINT = "duplicate", "subset", "superset", "overlap", "disjoint"
KEEP_A, KEEP_B, KEEP_BOTH, REVIEW = "keep_a", "keep_b", "keep_both", "review"


@dataclass(frozen=True)
class Rule:
    """One validated rule on the driver; rule files are small."""

    name: str
    pattern: str
    source: str = ""
    detector: str = ""
    severity: str = ""
    tags: tuple[str, ...] = ()
    priority: int = 0
    metadata: dict = field(default_factory=dict, hash=False, compare=False)
