"""Rules against strings: the theta join ``search(rule.pattern, text)``.

engine ``python`` (default) runs Python's ``re`` in Arrow batches; ``native`` runs ``rlike`` on
rewritten patterns; ``auto`` uses ``rlike`` for patterns that can be rewritten and Python for the rest.

Both engines first look for literals of which every match must contain one, so that of n rules only
those with a literal present are searched: Python with one automaton pass over the lower-cased text,
the JVM with ``contains``. Where only equal keys meet, the rules of a key have a matcher of their own,
so a string is never held against rules of other keys.

Rules travel to the executors as one broadcast per block of ``RULES_PER_BLOCK``; the strings are
read in place and never shuffled. A matcher is built once per worker process and block.

Defined results: null texts match nothing; a rule counts once per string; rules whose pattern is
null or doesn't compile match nothing; extra columns are ignored; repeated strings give repeated
hits.
"""

from __future__ import annotations

import logging
import re
from collections import defaultdict
from collections.abc import Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.functions.patterns import compiled, required_literals, to_jvm
from rulesieve.session import spread

log = logging.getLogger("rulesieve.match")
RULES_PER_BLOCK = 20_000
SHORTEST_LITERAL = 3
#: Tests in one array of the native form, which keeps generated methods small.
TESTS_PER_ARRAY = 100


class Matcher:
    """Compiled rules (rule_id, pattern) with their prefilter."""

    def __init__(self, rules: list[tuple]):
        import ahocorasick

        self.always: list[tuple] = []
        self.folding: list[tuple] = []  # ignore case: the literal filter only holds for ASCII texts
        self.by_literal: dict[str, list[int]] = defaultdict(list)
        self.rules: list[tuple] = []
        for rule_id, pattern in rules:
            try:
                rule = (rule_id, compiled(pattern).search)
            except (re.error, RecursionError, OverflowError):
                continue
            literals, fold = required_literals(pattern)
            if not literals or min(map(len, literals)) < SHORTEST_LITERAL:
                self.always.append(rule)
                continue
            for literal in literals:
                self.by_literal[literal].append(len(self.rules))
            self.rules.append(rule)
            if fold:
                self.folding.append(rule)
        self.automaton = ahocorasick.Automaton()
        for literal, places in self.by_literal.items():
            self.automaton.add_word(literal, places)
        if self.by_literal:
            self.automaton.make_automaton()

    def hits(self, text: str) -> list:
        """The rules that fire on the text."""
        out = [r for r, search in self.always if search(text)]
        if self.by_literal:
            near: set[int] = set()
            for _, places in self.automaton.iter(text.lower()):
                near.update(places)
            rules = self.rules
            for n in near:
                r, search = rules[n]
                if search(text):
                    out.append(r)
        if self.folding and not text.isascii():
            seen = set(out)
            out += [r for r, search in self.folding if r not in seen and search(text)]
        return out


#: Matchers of this worker process by broadcast and key; those of the broadcast in use only.
_MATCHERS: dict[tuple, Matcher] = {}


def matcher_of(sent: tuple[str, dict], key: str | None) -> Matcher | None:
    """The matcher of one key of (name of the broadcast, rules by key); None where the key has no rules."""
    at = (sent[0], key)
    if at not in _MATCHERS:
        for old in [k for k in _MATCHERS if k[0] != sent[0]]:
            del _MATCHERS[old]
        if key not in sent[1]:
            return None
        _MATCHERS[at] = Matcher(sent[1][key])
    return _MATCHERS[at]


def match(entries: DataFrame, rules: DataFrame, entry_key: str = "entry_id", text: str = "text", rule_key: str = "rule_id", pattern: str = "pattern", engine: str = "python", partition: tuple[str, str] | None = None) -> DataFrame:
    """(entry_key, rule_key) of every rule that fires on an entry.

    ``partition`` = (column of entries, column of rules): only equal keys meet, null or empty as '_default'.
    """
    if engine not in ("python", "native", "auto"):
        raise ValueError(f"unknown engine {engine!r}")
    columns = [rule_key, pattern] + ([partition[1]] if partition else [])
    told = [tuple(r) for r in rules.where(F.col(pattern).isNotNull()).select(*columns).distinct().orderBy(rule_key).toLocalIterator()]
    told = [(i, p, (k[0] or "_default") if k else None) for i, p, *k in told]
    if not told:
        log.warning("no rules to match")
    used = [entry_key, text] + ([partition[0]] if partition else [])
    strings = spread(entries.where(F.col(text).isNotNull()).select(*dict.fromkeys(used)))
    jvm = {} if engine == "python" else jvm_forms(entries.sparkSession, [p for _, p, _ in told])
    native = [(i, p, k, jvm[p]) for i, p, k in told if p in jvm]
    slow = [r for r in told if r[1] not in jvm]
    if engine == "native" and slow:
        raise ValueError(f"{len(slow)} patterns have no JVM form; use engine='auto'")
    parts = []
    if slow or not native:
        for lo in range(0, max(1, len(slow)), RULES_PER_BLOCK):
            parts.append(_python(strings, slow[lo : lo + RULES_PER_BLOCK], entry_key, text, rule_key, rules, partition))
    if native:
        parts.append(_native(strings, native, entry_key, text, rule_key, rules, partition))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def jvm_forms(spark, patterns: list[str]) -> dict[str, str]:
    """Pattern to JVM form, of those that have one which the JVM accepts."""
    out = {}
    for p in dict.fromkeys(patterns):
        if (form := to_jvm(p)) is not None:
            try:
                spark._jvm.java.util.regex.Pattern.compile(form)
            except Exception:  # the JVM's own limits: Python takes the pattern
                continue
            out[p] = form
    return out


def _python(strings: DataFrame, told: list[tuple], entry_key: str, text: str, rule_key: str, rules: DataFrame, partition) -> DataFrame:
    by_key: dict[str | None, list[tuple]] = defaultdict(list)
    for rule_id, pattern, key in told:
        by_key[key].append((rule_id, pattern))
    sent = strings.sparkSession.sparkContext.broadcast((uuid4().hex, dict(by_key)))
    kinds = [strings.schema[entry_key].dataType.simpleString(), rules.schema[rule_key].dataType.simpleString()]
    rule_type = pa.int32() if kinds[1] == "int" else pa.string() if kinds[1] == "string" else pa.int64()
    keyed = [F.coalesce(F.nullif(F.col(partition[0]), F.lit("")), F.lit("_default"))] if partition else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rule = [], []
            texts = batch.column(1).to_pylist()
            keys = batch.column(2).to_pylist() if partition else [None] * len(texts)
            for i, (t, k) in enumerate(zip(texts, keys, strict=True)):
                if matcher := matcher_of(sent.value, k):
                    found = matcher.hits(t)
                    at += [i] * len(found)
                    rule += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(rule, rule_type)], ["e", "r"])

    out = strings.select(F.col(entry_key), F.col(text), *keyed).mapInArrow(run, f"e {kinds[0]}, r {kinds[1]}")
    return out.select(F.col("e").alias(entry_key), F.col("r").alias(rule_key))


def _quoted(value: str) -> str:
    """A SQL literal; dollar signs are escaped, as SQL text has variables."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _native(strings: DataFrame, told: list, entry_key: str, text: str, rule_key: str, rules: DataFrame, partition) -> DataFrame:
    """One scan for all rules; a rule's literals are looked for before its pattern is run.

    The tests are written as SQL text, a few hundred at a time, instead of thousands of calls into the
    JVM. JVM forms hold neither quotes nor line ends, so they stand in raw literals.
    """
    kind = rules.schema[rule_key].dataType.simpleString()
    tests = []
    for rule_id, pattern, own, jvm in told:
        literals, fold = required_literals(pattern)
        conditions = [] if own is None else [f"_key = {_quoted(own)}"]
        if literals and min(map(len, literals)) >= SHORTEST_LITERAL and len(literals) <= 4:
            holds = [f"contains(_low, {_quoted(x)})" for x in sorted(literals)]
            # a case-blind pattern may take a character beyond ASCII for a letter
            conditions.append(f"({' OR '.join(holds + ['_wide'] * fold)})")
        conditions.append(f"rlike(_text, r'{jvm}')")
        value = _quoted(rule_id) if kind == "string" else str(rule_id)
        tests.append(f"CASE WHEN {' AND '.join(conditions)} THEN CAST({value} AS {kind}) END")
    arrays = [f"array_compact(array({', '.join(tests[lo : lo + TESTS_PER_ARRAY])}))" for lo in range(0, len(tests), TESTS_PER_ARRAY)]
    key = F.coalesce(F.nullif(F.col(partition[0]), F.lit("")), F.lit("_default")) if partition else F.lit(None).cast("string")
    wide = strings.select(F.col(entry_key).alias("_entry"), F.col(text).alias("_text"), F.lower(text).alias("_low"), (F.length(text) != F.octet_length(text)).alias("_wide"), key.alias("_key"))
    return wide.select(F.col("_entry").alias(entry_key), F.explode(F.expr(f"concat({', '.join(arrays)})")).alias(rule_key))
