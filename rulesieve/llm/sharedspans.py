"""Long exact spans shared between records.

Prefix-partitioned suffix trees, over sampled suffixes. Suffixes are taken at anchors only: of every
``span`` characters the leftmost of the smallest ``prefix``-character hashes is one, so a span of
that length has the same anchor at the same place wherever it stands. (All suffixes would be a
shuffle of hundreds of times the input.) Anchors with equal prefixes are a group; groups of one text
only are dropped before any text moves.

A group that is larger than ``group_rows`` is split by longer prefixes. The spans of an anchor start
0 to ``span - prefix`` characters before it; a cell is a range of these starts, and all its spans
hold the same stretch of ``span`` less the range's width around the anchor, which is the cell's
prefix. Halving the range doubles what must be equal, so groups fall apart until they fit; a range of
one start is a single node of the tree and is only counted, never held.

In a group, the texts behind and before the anchors are sorted, and the common lengths of neighbours
give the trees' internal nodes; a span is shared where a node at least ``span`` deep has two texts
below it. Characters are compared, not hashes; prefixes of groups are hashed to 128 bits only where a
node is counted. All spans of one anchor overlap, so an anchor yields one interval: its first to its
last shared span.

Equal texts are folded into one before anything else.

Defined results: null texts and texts shorter than the span have no row; equal texts share all
their characters; an id given twice with one text counts as one record; a null id has no row and is
no other record; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.session import cut, spread

PREFIX = 100
CHARS_PER_CHUNK = 1_000_000
#: Suffixes that one task holds at once; larger groups are split by longer prefixes.
GROUP_ROWS = 4000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            grown = np.full(n, base, np.uint64)
            grown[0] = 1
            _POWERS[i] = np.multiply.accumulate(grown)
    return _POWERS[0][:n], _POWERS[1][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def sums(texts: list[str]) -> np.ndarray:
    """Prefix sums of code point times power; a difference times an inverse power hashes any span."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) + np.uint64(1)
    power, _ = _powers(len(points) + 1)
    out = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(points * power[:-1], out=out[1:])
    return out


def span_hashes(total: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
    _, inverse = _powers(len(total))
    if isinstance(starts, slice):
        return _mix((total[length:] - total[:-length]) * inverse[: len(total) - length])
    return _mix((total[starts + length] - total[starts]) * inverse[starts])


def anchors(texts: list[str], span: int, prefix: int) -> tuple[np.ndarray, ...]:
    """(text number, position, prefix hash, first span start, last span start) of every anchor.

    The spans of an anchor are those whose smallest prefix it is; each span has one anchor.
    """
    none = np.zeros(0, np.int64)
    size = np.array([len(t) for t in texts], np.int64)
    if not size.sum() or int(size.max()) < span:
        return none, none, none, none, none
    total = sums(texts)
    h = span_hashes(total, slice(None), prefix)
    width, best, at, step = span - prefix + 1, h, np.arange(len(h), dtype=np.int32), 1

    def least(shift: int):
        take = best[shift:] < best[:-shift]
        return np.where(take, best[shift:], best[:-shift]), np.where(take, at[shift:], at[:-shift])

    while step * 2 <= width:
        best, at = least(step)
        step *= 2
    if width > step:
        best, at = least(width - step)
    owner = np.repeat(np.arange(len(texts)), size)
    begin = np.cumsum(size) - size
    spans = np.flatnonzero(owner[: len(owner) - span + 1] == owner[span - 1 :])
    if not len(spans):
        return none, none, none, none, none
    own = at[spans].astype(np.int64)
    cutat = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    ends = np.concatenate([cutat[1:], [len(own)]]) - 1
    pos, first, last = own[cutat], spans[cutat], spans[ends]
    text = owner[pos]
    return text, pos - begin[text], h[pos].astype(np.int64), first - begin[text], last - begin[text]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo = chars = 0
    for hi, t in enumerate(texts, 1):
        chars += len(t)
        if chars >= CHARS_PER_CHUNK or hi == len(texts):
            yield lo, hi
            lo, chars = hi, 0


def _common(a: str, b: str) -> int:
    """Length of the common prefix."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most
    low, high = 0, most  # a[:low] is common, a[:high] isn't
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid)
    return low


def _tree(group: list[int], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(order, common length with the one before) of the texts sorted within their groups: the groups' suffix trees in array form."""
    order = sorted(range(len(texts)), key=lambda i: (group[i], texts[i]))
    common = np.zeros(len(order), np.int64)
    for n in range(1, len(order)):
        i, j = order[n - 1], order[n]
        common[n] = _common(texts[i], texts[j]) if group[i] == group[j] else -1
    common[:1] = -1
    return np.array(order, np.int64), common


def shared_in_groups(group: list[int], key: np.ndarray, pos: np.ndarray, first: np.ndarray, last: np.ndarray, texts: list[str], text_at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last shared span start of every anchor (-1 where none); ``first`` to ``last`` are the starts in question, text_at the text's own start."""
    split = (pos - text_at).tolist()
    behind, after = _tree(group, [t[k:] for t, k in zip(texts, split, strict=True)])
    before, ahead = _tree(group, [t[:k][::-1] for t, k in zip(texts, split, strict=True)])
    low, high = np.full(len(texts), -1, np.int64), np.full(len(texts), -1, np.int64)
    right, left = np.empty(len(texts), np.int64), np.empty(len(texts), np.int64)
    for back in range(int((pos - last).min()), int((pos - first).max()) + 1):
        start = pos - back
        use = np.flatnonzero((start >= first) & (start <= last))
        if len(use) < 2:
            continue
        # nodes at this depth: suffixes alike for span - back characters behind the anchor and back before it
        right[behind] = np.cumsum(after < span - back)
        left[before] = np.cumsum(ahead < back)
        node = right[use] * (len(texts) + 1) + left[use]
        order = np.lexsort((key[use], node))
        n, k = node[order], key[use][order]
        same = n[1:] == n[:-1]
        heads = np.flatnonzero(np.concatenate([[True], ~same]))
        tails = np.concatenate([heads[1:], [len(n)]]) - 1
        hit = use[order[np.repeat(k[heads] != k[tails], tails - heads + 1)]]
        fresh = hit[high[hit] < 0]
        high[fresh] = start[fresh]  # starts fall as the way back grows
        low[hit] = start[hit]
    return low, high


ROW = "h binary, key bigint, pos int, first int, last int, at int, t string"


def _grouped(rows: DataFrame, group_rows: int) -> DataFrame:
    """(h, rows, whether it holds two texts) of every group."""
    return rows.groupBy("h").agg(F.count("*").alias("m"), (F.min("key") != F.max("key")).alias("two")).where("two").select("h", "m", (F.col("m") > group_rows).alias("large"))


def _cells(near: DataFrame, span: int, lo: int, hi: int) -> DataFrame:
    """The rows as members of the cell of span starts ``lo`` to ``hi`` characters before the anchor, grouped by the cell's prefix."""
    first, last = F.greatest("first", F.col("pos") - hi), F.least("last", F.col("pos") - lo)
    prefix = F.substring(F.col("t"), F.col("pos") - lo - F.col("at") + 1, F.lit(span - (hi - lo)))
    h = F.unhex(F.md5(F.concat_ws("|", F.hex("h"), F.lit(lo), F.lit(hi), prefix)))
    cell = near.withColumns({"first": first.cast("int"), "last": last.cast("int")}).where("first <= last")
    return cell.withColumn("h", h).select("h", "key", "pos", "first", "last", "at", "t")


def _intervals(near: DataFrame, span: int, lo: int, hi: int, group_rows: int) -> list[DataFrame]:
    """Frames of (key, lo, hi) of shared spans of the groups' anchors; groups that are too large are split."""
    if lo == hi:  # one start: a node of the tree, counted and not held
        nodes = _grouped(near, group_rows)
        return [near.join(nodes.select("h"), "h", "left_semi").select("key", F.col("first").cast("bigint").alias("lo"), (F.col("first") + span).cast("bigint").alias("hi"))]
    sized = _grouped(near, group_rows)
    small = near.join(sized.where("NOT large").select("h"), "h", "left_semi")
    out = [_compared(small, span)]
    if not sized.where("large").isEmpty():
        large = cut(near.join(sized.where("large").select("h"), "h", "left_semi"))
        mid = (lo + hi) // 2
        for a, b in ((lo, mid), (mid + 1, hi)):
            out += _intervals(_cells(large, span, a, b), span, a, b, group_rows)
    return out


def _compared(rows: DataFrame, span: int) -> DataFrame:
    def subtree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            h = batch.column(0)
            if sum(b.num_rows for b in held) >= GROUP_ROWS and h[0] != h[len(h) - 1]:
                told = h.to_pylist()
                end = next(n for n in range(len(told) - 1, 0, -1) if told[n - 1] != told[-1])
                yield from compare([*held[:-1], batch.slice(0, end)])
                held = [batch.slice(end)]
        yield from compare(held)

    def compare(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if parts:
            whole = pa.Table.from_batches(parts)
            numbers: dict[bytes, int] = {}
            group = [numbers.setdefault(h, len(numbers)) for h in whole.column(0).to_pylist()]
            key, pos, first, last, at = (whole.column(i).to_numpy().astype(np.int64) for i in range(1, 6))
            low, high = shared_in_groups(group, key, pos, first, last, whole.column(6).to_pylist(), at, span)
            use = low >= 0
            yield pa.RecordBatch.from_arrays([pa.array(key[use]), pa.array(low[use]), pa.array(high[use] + span)], ["key", "lo", "hi"])

    return rows.select("h", "key", "pos", "first", "last", "at", "t").repartition("h").sortWithinPartitions("h").mapInArrow(subtree, "key bigint, lo bigint, hi bigint")


def shared_chars(docs: DataFrame, doc_id: str, text: str, span: int = 300, prefix: int = PREFIX, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, shared_chars) of every record with a character in a shared span."""
    id_kind = docs.schema[doc_id].dataType.simpleString()
    whole = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where(F.length("t") >= span).withColumn("key", F.xxhash64("t"))
    ids = whole.select("d", "key", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("n"))
    folded = cut(ids.groupBy("key", "digest").agg(F.min("d").alias("d"), F.max("d").alias("last"), F.first("n").alias("n")))
    copies = folded.where(~F.col("d").eqNullSafe(F.col("last"))).select("key", "digest")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for lo, hi in _chunks(texts):
                number, pos, h, first, last = anchors(texts[lo:hi], span, prefix)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(keys[lo:hi][number]), *(pa.array(x.astype(np.int32)) for x in (pos, first, last))], ["h", "key", "pos", "first", "last"])

    # anchors are found in one pass and kept; the texts stay where they are
    found = cut(spread(whole.select("key", "t")).mapInArrow(find, "h bigint, key bigint, pos int, first int, last int"))
    twice_seen = found.groupBy("h").agg(F.min("key").alias("k1"), F.max("key").alias("k2")).where("k1 <> k2").select("h")
    # sets, as copies of a text give their anchors again
    mine = found.join(twice_seen, "h", "left_semi").groupBy("key").agg(F.collect_set(F.struct("h", "pos", "first", "last")).alias("a"))
    mine = mine.join(folded.select("key", "d"), "key")

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]

        def told(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["h", "key", "pos", "first", "last", "at", "t"])

        for batch in batches:
            rows: list[tuple] = []
            for key, t, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                for a in at:
                    rows.append((a["h"].to_bytes(8, "big", signed=True), key, a["pos"], a["first"], a["last"], a["first"], t[a["first"] : a["last"] + span]))
                    if len(rows) >= 5000:
                        yield told(rows)
                        rows = []
            yield told(rows)

    near = cut(whole.join(mine.drop("key"), "d").select("key", "t", "a").mapInArrow(context, ROW))
    covered = merged_length(reduce(DataFrame.union, _intervals(near, span, 0, span - prefix, group_rows)), "key")
    twice = ids.join(copies, ["key", "digest"], "left_semi").select("d", F.col("n").alias("shared_chars")).distinct()
    once = folded.join(copies, ["key", "digest"], "left_anti").join(covered, "key").select("d", "shared_chars")
    return twice.union(once).select(F.col("d").cast(id_kind).alias(doc_id), "shared_chars")


def merged_length(intervals: DataFrame, key: str) -> DataFrame:
    """(key, shared_chars): length of the union of the key's intervals, merged in the JVM."""
    sorted_ = F.array_sort(F.collect_set(F.struct(F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))))
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("end"))
    add = lambda acc, x: F.struct(
        (acc["n"] + F.greatest(F.lit(0).cast("bigint"), x["hi"] - F.greatest(x["lo"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["hi"]).alias("end")
    )
    return intervals.groupBy(key).agg(sorted_.alias("s")).select(key, F.aggregate("s", zero, add)["n"].alias("shared_chars"))
