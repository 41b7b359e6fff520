"""Evaluation texts leaking into training text.

Every window of as many words as the item's, and of as many fewer or more as edits are allowed, is
embedded by the CGK random walk, which turns an edit distance over words into a Hamming distance;
repeated bit sampling of the embedding gives LSH keys, as many repeats as the target recall needs
for the allowed edits (one for none, where equal windows have equal embeddings); every candidate is
verified exactly. A window with more words outside the items' vocabulary than edits are allowed can
match nothing and is not embedded; nor is, with edits, one that holds no run of the items' as long
as k edits must leave whole in n words, (n - k) / (k + 1) rounded up.

The items are a stated query set. As long as their windows are no more than one block, whose number
is measured first, every task holds their index, documents are read once and in place, and only
(document, item) matches are shuffled. More items than that are held nowhere: the LSH keys of both
sides are joined by a shuffle, and every pair that shares a key is verified on the texts.

Defined results: null, empty and short texts match nothing; null ids are kept as ids of their own
only for documents; repeated rows count once; empty tables give an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rulesieve.session import spread

WORD = re.compile(r"[^\W_]+")
WINDOWS_PER_BLOCK = 500_000
CHARS_PER_CHUNK = 4_000_000
CANDIDATES_AT_ONCE = 200_000


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, lower case."""
    return WORD.findall(text.lower())


class Vocabulary(dict):
    def __missing__(self, word: str) -> int:
        return -1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def cgk(windows: np.ndarray, turn: int) -> np.ndarray:
    """CGK embedding of rows of word ids: at step j the walk shows its word and moves on by a random bit of (word, j)."""
    rows, n = windows.shape
    padded = np.concatenate([windows, np.full((rows, 1), -2, windows.dtype)], axis=1).astype(np.int64)
    at, every = np.zeros(rows, np.int64), np.arange(rows)
    shown = np.empty((rows, 3 * n), np.int64)
    for j in range(3 * n):
        word = padded[every, at]
        shown[:, j] = word
        bit = _mix(word.astype(np.uint64) + np.uint64((turn * 3 * n + j + 1) * 0x632BE59BD9B4E019 % 2**64)) & np.uint64(1)
        at = np.minimum(at + bit.astype(np.int64), n)
    return shown


def sample(shown: np.ndarray, turn: int, coordinates: int) -> np.ndarray:
    """LSH key: a hash of ``coordinates`` sampled positions of the embedding."""
    at = np.random.default_rng(turn).choice(shown.shape[1], coordinates, replace=False)
    key = np.zeros(len(shown), np.uint64)
    for a in np.sort(at):
        key = _mix(key * np.uint64(0x100000001B3) + shown[:, a].astype(np.uint64))
    return key


def runs(ids: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each place on, along the last axis."""
    most = ids.shape[-1] - length + 1
    key = np.zeros((*ids.shape[:-1], most), np.uint64)
    for j in range(length):
        key = _mix(key * np.uint64(0x100000001B3) + ids[..., j : j + most].astype(np.int64).astype(np.uint64))
    return key


def repeats(n: int, edits: int, coordinates: int, recall: float) -> int:
    """Repeats needed: an embedding of 3n symbols differs in at most about 4 k^2 of them with constant probability for k edits."""
    if not edits:
        return 1
    same = max(0.05, 1 - 4 * edits * edits / (3 * n)) ** coordinates * 0.5
    return max(1, ceil(log(1 - recall) / log(1 - same)))


def edit_distance(a: np.ndarray, b: np.ndarray) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def within(a: np.ndarray, b: np.ndarray, edits: int) -> np.ndarray:
    """Whether the edit distance of each row of ``a`` from that of ``b`` is at most ``edits``: the band of the usual table, for all rows at once."""
    far = np.full(len(a), edits + 1, np.int16)
    row = {j: np.full(len(a), j, np.int16) for j in range(min(edits, b.shape[1]) + 1)}
    for i in range(1, a.shape[1] + 1):
        now = {}
        for j in range(max(0, i - edits), min(b.shape[1], i + edits) + 1):
            if j:
                now[j] = np.minimum(np.minimum(row.get(j, far), now.get(j - 1, far)) + 1, row.get(j - 1, far) + (a[:, i - 1] != b[:, j - 1]))
            else:
                now[j] = np.full(len(a), i, np.int16)
        row = now
    return row.get(b.shape[1], far) <= edits


class ItemIndex:
    """Windows of the items of one block with their LSH keys."""

    def __init__(self, items: list[tuple[int, str]], n: int, edits: int, coordinates: int, recall: float):
        self.n, self.edits, self.coordinates = n, edits, min(coordinates, 3 * n)
        self.turns = repeats(n, edits, self.coordinates, recall)
        self.vocabulary = Vocabulary()
        rows: dict[tuple[tuple[int, ...], int], None] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text or "")]
            for i in range(len(ids) - n + 1):
                rows[tuple(ids[i : i + n]), item] = None
        self.windows = np.array([w for w, _ in rows], np.int32).reshape(-1, n)
        self.run = max(1, ceil((n - edits) / (edits + 1)))
        self.runs = np.unique(runs(self.windows, self.run)) if 0 < edits < n else None
        self.owner = np.array([i for _, i in rows], np.int64)
        self.keys = []
        for t in range(self.turns):
            key = sample(cgk(self._padded(self.windows), t), t, self.coordinates)
            order = np.argsort(key, kind="stable")
            self.keys.append((key[order], order))

    def _padded(self, windows: np.ndarray) -> np.ndarray:
        """Windows of any length at the longest one's width, so that all walks have the same steps."""
        return np.pad(windows, ((0, 0), (0, self.n + self.edits - windows.shape[1])), constant_values=-2)

    def match(self, texts: list[str]) -> Iterator[tuple[int, int]]:
        """(number of the text, item) of every verified match."""
        if not len(self.windows):
            return
        told = [words(t) for t in texts]
        size = np.array([len(w) for w in told], np.int64)
        total = int(size.sum())
        shortest = max(1, self.n - self.edits)
        if total < shortest:
            return
        ids = np.fromiter(map(self.vocabulary.__getitem__, chain.from_iterable(told)), np.int32, total)
        owner = np.repeat(np.arange(len(texts)), size)
        strange = np.concatenate([[0], np.cumsum(ids < 0)])
        known = None if self.runs is None else np.concatenate([[0], np.cumsum(np.isin(runs(ids, self.run), self.runs))])
        found = set()
        for length in range(shortest, min(self.n + self.edits, total) + 1):
            near = (strange[length:] - strange[:-length] <= self.edits) & (owner[: total - length + 1] == owner[length - 1 :])
            if known is not None:
                last = length - self.run + 1
                near &= known[last:] > known[:-last]
            self._search(ids, owner, np.flatnonzero(near), length, found)
        yield from sorted(found)

    def _search(self, ids: np.ndarray, owner: np.ndarray, starts: np.ndarray, length: int, found: set[tuple[int, int]]) -> None:
        """Adds the verified matches of the windows of ``length`` words at ``starts``."""
        for lo in range(0, len(starts), 100_000):
            at = starts[lo : lo + 100_000]
            windows = ids[at[:, None] + np.arange(length)]
            for t, (keys, order) in enumerate(self.keys):
                key = sample(cgk(self._padded(windows), t), t, self.coordinates)
                first, last = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
                hit = np.flatnonzero(first < last)
                part = np.cumsum(last[hit] - first[hit]) // CANDIDATES_AT_ONCE
                for some in np.split(hit, np.flatnonzero(np.diff(part)) + 1):
                    each = last[some] - first[some]
                    i = np.repeat(some, each)
                    k = order[np.arange(each.sum()) + np.repeat(first[some] - np.cumsum(each) + each, each)]
                    fresh = np.fromiter((p not in found for p in zip(owner[at[i]].tolist(), self.owner[k].tolist())), bool, len(i)) if self.edits else np.ones(len(i), bool)
                    i, k = i[fresh], k[fresh]
                    ok = within(windows[i], self.windows[k], self.edits)
                    found.update(zip(owner[at[i[ok]]].tolist(), self.owner[k[ok]].tolist()))


def _hashed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit word hashes of all texts, number of words of each)."""
    seen: dict[str, int] = {}
    told = [words(t) for t in texts]
    for w in chain.from_iterable(told):
        if w not in seen:
            seen[w] = xxh3_64_intdigest(w) >> 1
    size = np.array([len(w) for w in told], np.int64)
    return np.fromiter(map(seen.__getitem__, chain.from_iterable(told)), np.int64, int(size.sum())), size


def lsh_keys(texts: list[str], lengths: list[int], width: int, turns: int, coordinates: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, key) of the windows of every length, turn by turn; each once a text."""
    ids, size = _hashed(texts)
    owner = np.repeat(np.arange(len(texts)), size)
    for length in lengths:
        starts = np.flatnonzero(owner[: max(0, len(ids) - length + 1)] == owner[length - 1 :]) if len(ids) >= length else np.zeros(0, np.int64)
        for lo in range(0, len(starts), 100_000):
            at = starts[lo : lo + 100_000]
            windows = np.pad(ids[at[:, None] + np.arange(length)], ((0, 0), (0, width - length)), constant_values=-2)
            for t in range(turns):
                key = _mix(sample(cgk(windows, t), t, coordinates) + np.uint64(t)).view(np.int64)
                both = np.unique(np.stack([owner[at], key]), axis=1)
                yield both[0], both[1]


def holds(doc: list[str], item: list[str], n: int, edits: int) -> bool:
    """Whether the document has words within ``edits`` word edits of ``n`` consecutive words of the item; exact."""
    numbers = Vocabulary()
    b = np.array([numbers.setdefault(w, len(numbers)) for w in item], np.int32)
    a = np.fromiter(map(numbers.__getitem__, doc), np.int32, len(doc))
    if len(b) < n:
        return False
    own = np.lib.stride_tricks.sliding_window_view(b, n)
    run = max(1, ceil((n - edits) / (edits + 1)))
    known = runs(np.ascontiguousarray(own), run)
    for length in range(max(1, n - edits), min(n + edits, len(a)) + 1):
        windows = np.lib.stride_tricks.sliding_window_view(a, length)
        # k edits leave a run of words whole: only windows that hold one of an item's window meet it
        inside = runs(np.ascontiguousarray(windows), min(run, length))
        for k in np.flatnonzero(np.isin(inside, known).any(axis=1)):
            near = own[np.isin(known, inside[k]).any(axis=1)]
            if len(near) and within(np.repeat(windows[k][None], len(near), 0), near, edits).any():
                return True
    return False


def _joined(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, n: int, edits: int, coordinates: int, recall: float) -> DataFrame:
    """(d, i): the LSH keys of both sides joined, every pair that meets verified on its texts."""
    coordinates = min(coordinates, 3 * n)
    turns = repeats(n, edits, coordinates, recall)

    def keyed(lengths: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                lo = chars = 0
                for hi, t in enumerate(texts, 1):
                    chars += len(t)
                    if chars >= CHARS_PER_CHUNK or hi == len(texts):
                        for row, key in lsh_keys(texts[lo:hi], lengths, n + edits, turns, coordinates):
                            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + lo)), pa.array(key)], ["row", "key"])
                        lo, chars = hi, 0

        return run

    # a row is known by a hash of its id and text, so that null ids and repeated ids keep apart
    named = lambda df, own, name: df.select(F.col(own).alias(name), F.col(text).alias(f"{name}_text")).where(F.col(text).isNotNull()).distinct().withColumn(f"{name}_row", F.xxhash64(name, f"{name}_text"))
    left, right = named(docs, doc_id, "d"), named(items, item_id, "i")
    shapes = list(range(max(1, n - edits), n + edits + 1))
    of = lambda df, name, lengths: df.select(f"{name}_row", f"{name}_text").mapInArrow(keyed(lengths), "row bigint, key bigint").withColumnRenamed("row", f"{name}_row")
    pairs = of(left, "d", shapes).join(of(right, "i", [n]), "key").select("d_row", "i_row").distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [holds(words(a), words(b), n, edits) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["d", "i"]).filter(pa.array(ok, pa.bool_()))

    kinds = f"d {docs.schema[doc_id].dataType.simpleString()}, i {items.schema[item_id].dataType.simpleString()}"
    return pairs.join(left, "d_row").join(right, "i_row").select("d", "i", "d_text", "i_text").mapInArrow(verify, kinds)


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str, n: int = 13, edits: int = 0, coordinates: int = 8, recall: float = 0.99, windows_per_block: int = WINDOWS_PER_BLOCK) -> DataFrame:
    """(doc_id, item_id) of documents with consecutive words within ``edits`` word edits of ``n`` consecutive words of an item."""
    kind = {c: df.schema[c].dataType.simpleString() for df, c in ((docs, doc_id), (items, item_id))}
    given = items.select(item_id, text).where(F.col(text).isNotNull() & F.col(item_id).isNotNull()).distinct()
    # a word has a character and something between it and the next: windows are at most half the characters
    most = given.agg(F.sum(F.floor(F.length(text) / 2) + 1)).first()[0] or 0
    if most > windows_per_block:
        out = _joined(docs, given, doc_id, item_id, text, n, edits, coordinates, recall)
    else:
        index = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r[0], r[1]) for r in given.collect()], n, edits, coordinates, recall))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, texts = batch.column(0), batch.column(1).to_pylist()
                lo, chars, rows = 0, 0, []
                for hi, t in enumerate(texts, 1):
                    chars += len(t or "")
                    if chars >= CHARS_PER_CHUNK or hi == len(texts):
                        rows += [(lo + i, item) for i, item in index.value.match([x or "" for x in texts[lo:hi]])]
                        lo, chars = hi, 0
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in rows], pa.int64())), pa.array([i for _, i in rows], pa.int64())], ["d", "i"])

        out = spread(docs.select(doc_id, text).where(F.col(text).isNotNull())).mapInArrow(run, f"d {kind[doc_id]}, i bigint")
    return out.distinct().select(F.col("d").alias(doc_id), F.col("i").cast(kind[item_id]).alias(item_id))
