"""Encoding against the reference encoder of the published library, and exact round trips."""

import random
from pathlib import Path

import pytest

from rulesieve.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not Path(T.DEFAULT_VOCABULARY).exists(), reason="no vocabulary here")


@pytest.fixture(scope="module")
def ranks():
    return T.read_vocabulary(T.DEFAULT_VOCABULARY)


def texts():
    rng = random.Random(2)
    soup = "aeibcdt hnorsl  the ing 019éß漢😀\t\n\r'’_-=/{\x0b\x1c\xa0 "
    parts = ["th", "er", "in", "ation", "zz", "é", "漢字", "'ll", "'s", " 1234", "\r\n", "<|endoftext|>", "   "]
    return [None, "", " ", "\n\n", "x" * 3000, "<|endoftext|>"] + ["".join(rng.choices(list(soup), k=rng.randrange(1, 60))) for _ in range(300)] + ["".join(rng.choices(parts, k=rng.randrange(1, 15))) for _ in range(300)]


def test_equals_the_published_encoder(ranks):
    import tiktoken

    other = tiktoken.Encoding("o", pat_str=T.PRETOKEN, mergeable_ranks=ranks, special_tokens={})
    encoder = T.Encoder(ranks, memo_bytes=5000)
    for t in texts():
        assert encoder.encode(t) == (other.encode_ordinary(t) if t else []), t


def test_full_automata_begin_anew(ranks):
    rng = random.Random(3)
    wide, narrow = T.Transducer(ranks), T.Transducer(ranks, most_bytes=20_000)
    for _ in range(150):
        data = "".join(rng.choices("aeibcdt hnorslé漢😀ß", k=rng.randrange(1, 400))).encode()
        assert wide.encode(data) == narrow.encode(data)
        assert narrow.held <= 2 * 20_000 + 5_000
    memo = T.Memo(wide, 10_000)
    for n in range(500):
        memo[f"word{n}"]
        assert memo.held <= 10_000 and memo["x" * 300] and "x" * 300 not in memo


def test_round_trip_in_pieces(ranks):
    encoder = T.Encoder(ranks)
    tokens = encoder.machine.bytes_of
    for t in texts():
        assert "".join(T.decode_stream(iter(encoder.encode(t)), tokens)) == (t or "")


def test_the_machine_equals_the_standard_decoder():
    rng = random.Random(4)
    for _ in range(2000):
        data = bytes(rng.choice([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0xFF, 0xE2, 0x82, 0xAC]) for _ in range(rng.randrange(9)))
        m = T.Utf8Machine()
        got = "".join(m.feed(data[i : i + 1]) for i in range(len(data))) + m.end()
        assert got == data.decode("utf-8", "replace"), data


def test_frames(spark):
    rows = [(i, t, [1], "x") for i, t in enumerate(texts()[:20])] + [(0, None, [1], "again"), (None, "hi", [1], "no id")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, id string")
    coded = T.encode_corpus(df, "doc_id", "text")
    assert coded.dtypes == [("doc_id", "bigint"), ("ids", "array<bigint>")] and coded.count() == len(rows)
    assert all(r["ids"] == [] for r in coded.where("doc_id IN (0, 1)").collect())
    back = {r["doc_id"]: r["text"] for r in T.decode_corpus(coded, "doc_id", "ids").collect()}
    assert back == {r[0]: r[1] or "" for r in rows}
    assert T.encode_corpus(df.limit(0), "doc_id", "text").isEmpty()
