"""Encoding of a corpus with a public byte-level BPE vocabulary, and decoding as a stream.

The merges are compiled into a finite-state transducer over the bytes of one pretoken. A state is
the set of live readings: every position at which the last certain token may end, with the tokens
since the last emission and the bytes read behind it. Transitions are determinised lazily and kept;
a token is emitted as soon as all live readings share it, which needs no more lookahead than the
longest vocabulary entry. A reading may append a token only where the pair (last token, token) is
itself what merging gives for its bytes, so the transducer's output is the merge order's result.
A bounded memo of whole pretokens stands in front of the transducer; both are bounded in bytes and
begin anew when full, which changes nothing in what they give.

Defined results: null and empty texts give the empty list; special tokens in a text are ordinary
text; lone surrogates cannot occur in Spark strings. One row per input row and id.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from rulesieve.session import spread

#: Split of the published byte-level vocabularies into pretokens (fixed value).
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same split for texts of ASCII only, spelled without properties; white space is listed because Python's \\s has more.
PRETOKEN_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t-\rA-Za-z0-9]+|[ \t-\r]+(?![^ \t-\r])|[ \t-\r]+"
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes that the memo and the automaton of one worker may take, by estimate; whichever is full begins anew.
MEMO_BYTES, STATE_BYTES = 96 << 20, 96 << 20


def read_vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Transducer:
    """Lazily determinised transducer; ``encode`` maps the bytes of one pretoken to its token ids."""

    def __init__(self, ranks: dict[bytes, int], most_bytes: int = STATE_BYTES):
        self.ranks, self.most_bytes = ranks, most_bytes
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.longer = {b[:k] for b in ranks for k in range(1, len(b))}  # proper prefixes: reading on may still give a token
        self._reset()

    def _reset(self) -> None:
        """Forgets all states found so far; what is encoded doesn't depend on them."""
        self.fits: dict[tuple[int, int], bool] = {}
        self.whole: dict[int, bool] = {}
        self.states: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.steps: list[dict[int, tuple[int, tuple[int, ...]]]] = []
        self.held = 0
        # a reading: (tokens since the last emission, last emitted token or -1, bytes behind them)
        self.start = self._state(((), -1, b""),)

    def _state(self, *readings) -> int:
        key = tuple(sorted(readings))
        if key not in self.states:
            self.states[key] = len(self.keys)
            self.keys.append(key)
            self.steps.append({})
            self.held += 300 + sum(200 + 32 * len(t) + len(w) for t, _, w in key)
        return self.states[key]

    def merged(self, data: bytes) -> list[int]:
        """The merge order applied literally; for short inputs."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def _reachable(self, token: int) -> bool:
        if token not in self.whole:
            self.whole[token] = self.merged(self.bytes_of[token]) == [token]
            self.held += 100
        return self.whole[token]

    def _fit(self, a: int, b: int) -> bool:
        if a < 0:
            return True
        if (a, b) not in self.fits:
            self.fits[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            self.held += 180
        return self.fits[a, b]

    def _step(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        one, live, ended = bytes((byte,)), [], None
        for tokens, last, behind in self.keys[state]:
            word = behind + one
            token = self.ranks.get(word)
            # of the readings that may append a token here exactly one is the merge order's
            if ended is None and token is not None and self._fit(tokens[-1] if tokens else last, token) and self._reachable(token):
                ended = ((*tokens, token), last, b"")
            if word in self.longer:
                live.append((tokens, last, word))
        if ended is None:
            raise ValueError("the vocabulary lacks a byte")
        live.append(ended)
        common = 0
        shortest = min(len(t) for t, _, _ in live)
        while common < shortest and len({t[common] for t, _, _ in live}) == 1:
            common += 1
        if common:
            sure = live[0][0][:common]
            return self._state(*[(t[common:], sure[-1], w) for t, _, w in live]), sure
        return self._state(*live), ()

    def encode(self, data: bytes) -> tuple[int, ...]:
        if self.held > self.most_bytes:
            self._reset()
        out: list[int] = []
        state, steps = self.start, self.steps
        for byte in data:
            to = steps[state].get(byte)
            if to is None:
                to = steps[state][byte] = self._step(state, byte)
                self.held += 250
                if self.held > 2 * self.most_bytes:
                    # within one very long word: carry the readings over to a new automaton
                    key = self.keys[to[0]]
                    self._reset()
                    steps, to = self.steps, (self._state(*key), to[1])
            state, sure = to
            if sure:
                out += sure
        for tokens, _, behind in self.keys[state]:
            if not behind:
                out += tokens
                return tuple(out)
        return tuple(out)


class Memo(dict):
    """Pretoken to the bytes of its ids (little-endian 64 bit); bounded in bytes, filled by the transducer."""

    def __init__(self, machine: Transducer, most: int):
        super().__init__()
        self.machine, self.most, self.held = machine, most, 0

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.machine.encode(word.encode()), "<i8").tobytes()
        size = 250 + 4 * len(word) + len(ids)
        if size > self.most // 64:
            return ids  # too long to be kept
        self.held += size
        if self.held > self.most:
            self.clear()
            self.held = size
        self[word] = ids
        return ids


class Encoder:
    """Texts to ids: pretokens, memo, transducer."""

    def __init__(self, ranks: dict[bytes, int], memo_bytes: int = MEMO_BYTES):
        self.machine = Transducer(ranks)
        self.split, self.split_ascii = regex.compile(PRETOKEN).findall, re.compile(PRETOKEN_ASCII).findall
        self.memo = Memo(self.machine, memo_bytes)

    def encode_bytes(self, text: str | None) -> bytes:
        if not text:
            return b""
        words = self.split_ascii(text) if text.isascii() else self.split(text)
        return b"".join(map(self.memo.__getitem__, words))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<i8").tolist()


class Utf8Machine:
    """Incremental UTF-8 state machine: bytes in, complete characters out, whatever the chunks.

    State: (bytes still missing, code point so far, least and greatest allowed next byte). An
    invalid sequence gives U+FFFD, as the standard's maximal-subpart rule asks.
    """

    def __init__(self) -> None:
        self.missing, self.point, self.low, self.high = 0, 0, 0x80, 0xBF

    def _lead(self, b: int, out: list[str]) -> None:
        if b < 0x80:
            out.append(chr(b))
        elif 0xC2 <= b <= 0xDF:
            self.missing, self.point = 1, b & 0x1F
        elif 0xE0 <= b <= 0xEF:
            self.missing, self.point = 2, b & 0x0F
            self.low, self.high = (0xA0 if b == 0xE0 else 0x80), (0x9F if b == 0xED else 0xBF)
        elif 0xF0 <= b <= 0xF4:
            self.missing, self.point = 3, b & 0x07
            self.low, self.high = (0x90 if b == 0xF0 else 0x80), (0x8F if b == 0xF4 else 0xBF)
        else:
            out.append("�")

    def feed(self, data: bytes) -> str:
        out: list[str] = []
        for b in data:
            if not self.missing:
                self._lead(b, out)
            elif self.low <= b <= self.high:
                self.point, self.missing = self.point << 6 | b & 0x3F, self.missing - 1
                self.low, self.high = 0x80, 0xBF
                if not self.missing:
                    out.append(chr(self.point))
            else:
                out.append("�")
                self.missing, self.low, self.high = 0, 0x80, 0xBF
                self._lead(b, out)
        return "".join(out)

    def end(self) -> str:
        left, self.missing = self.missing, 0
        self.low, self.high = 0x80, 0xBF
        return "�" if left else ""


def decode_stream(ids: Iterator[int], tokens: dict[int, bytes]) -> Iterator[str]:
    machine = Utf8Machine()
    for i in ids:
        if text := machine.feed(tokens[i]):
            yield text
    if text := machine.end():
        yield text


_ENCODERS: dict[int, Encoder] = {}


def _encoder(ranks: dict[bytes, int]) -> Encoder:
    """One encoder per worker process and vocabulary: states found for one task serve the next."""
    key = hash(frozenset(ranks.items()))
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(ranks)
    return _ENCODERS[key]


def _vocabulary(df: DataFrame, path: str):
    """One broadcast per call; its size is that of the vocabulary file, whatever the corpus."""
    return df.sparkSession.sparkContext.broadcast(read_vocabulary(path))


def encode_corpus(df: DataFrame, id_column: str, text_column: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, ids array<bigint>) of every row."""
    ranks = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            ids = [encoder.encode_bytes(t) for t in batch.column(1).to_pylist()]
            ends = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 8 for x in ids], out=ends[1:])
            flat = np.frombuffer(b"".join(ids), "<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["id", "ids"])

    kind = df.schema[id_column].dataType.simpleString()
    out = spread(df.select(id_column, text_column)).mapInArrow(run, f"id {kind}, ids array<bigint>")
    return out.withColumnRenamed("id", id_column)


def decode_corpus(df: DataFrame, id_column: str, ids_column: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """(id, text) of every row of ids; the inverse of :func:`encode_corpus` with '' for the empty list."""
    ranks = _vocabulary(df, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = {i: b for b, i in ranks.value.items()}
        for batch in batches:
            texts = ["".join(decode_stream(iter(x or ()), tokens)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
