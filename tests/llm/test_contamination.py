"""Leaks against a scan of all windows, and recall with edits."""

import random

import numpy as np

from rulesieve.llm import contamination as C

WORDS = [f"w{i}" for i in range(60)]


def windows(text, n):
    w = C.words(text or "")
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def data():
    rng = random.Random(1)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(5, 45)))) for i in range(30)] + [(90, None), (91, ""), (0, "other text under the same id " * 4)]
    docs = []
    for d in range(120):
        text = rng.choices(WORDS, k=rng.randrange(0, 80))
        if d % 3 == 0:
            source = (rng.choice(items)[1] or "").split()
            lo = rng.randrange(max(1, len(source) - 12))
            text[3:3] = source[lo : lo + rng.randrange(8, 30)]
        docs.append((d, rng.choice([" ", ", ", "\r\n", " — "]).join(text).title()))
    return docs + [(500, None), (501, ""), docs[0], (None, items[3][1]), (502, "x " * 200_000 + items[4][1])], items


def frames(spark):
    docs, items = data()
    return spark.createDataFrame([(*r, 7) for r in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame([(*r, "z") for r in items], "item_id bigint, text string, doc_id string")


def test_exact_against_brute_force(spark):
    docs, items = data()
    want = {(d, i) for d, t in docs for i, u in items if windows(t, 13) & windows(u, 13)}
    d, i = frames(spark)
    for block in (500_000, 40):
        got = [tuple(r) for r in C.leaks(d, i, "doc_id", "item_id", "text", windows_per_block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert C.leaks(d.limit(0), i, "doc_id", "item_id", "text").isEmpty() and C.leaks(d, i.limit(0), "doc_id", "item_id", "text").isEmpty()


def test_recall_with_one_edit():
    rng = random.Random(9)
    items = [(i, " ".join(rng.sample(WORDS, 13))) for i in range(150)]
    index = C.ItemIndex(items, 13, 1, 6, 0.95)
    changed = []
    for _, t in items:
        w = t.split()
        w[rng.randrange(13)] = rng.choice(["new", rng.choice(WORDS)])
        changed.append(" ".join(w))
    found = set(index.match(changed))
    assert np.mean([(i, i) in found for i in range(150)]) >= 0.9
    assert all(C.edit_distance(np.array(C.words(changed[d])), np.array(C.words(items[i][1]))) <= 2 for d, i in found)


def test_embedding_keeps_equal_and_near_windows_near():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1000, (200, 13)).astype(np.int32)
    b = a.copy()
    b[:, 6] = 5000
    far = rng.integers(0, 1000, (200, 13)).astype(np.int32)
    distance = lambda x, y: (C.cgk(x, 0) != C.cgk(y, 0)).mean()
    assert distance(a, a.copy()) == 0 and distance(a, b) < 0.6 * distance(a, far)


def test_words():
    assert C.words("Ä_b-c1 ÉT漢字 ٣") == ["ä", "b", "c1", "ét漢字", "٣"]


def test_recall_of_each_kind_of_edit():
    rng = random.Random(4)
    items = [(i, " ".join(rng.sample(WORDS, 13))) for i in range(300)]
    index = C.ItemIndex(items, 13, 1, 6, 0.95)
    for kind in ("changed", "dropped", "added"):
        edited = []
        for _, t in items:
            w, at = t.split(), rng.randrange(1, 12)
            w[at : at + (kind != "added")] = [] if kind == "dropped" else ["new"]
            edited.append(" ".join(w))
        found = set(index.match(edited))
        assert np.mean([(i, i) in found for i in range(300)]) >= 0.95


def test_dropped_word_of_a_longer_passage():
    passage = WORDS[:20]
    index = C.ItemIndex([(7, " ".join(passage))], 13, 1, 6, 0.95)
    assert list(index.match([" ".join(["x"] * 5 + passage[:10] + passage[11:] + ["y"] * 5)])) == [(0, 7)]
    assert list(index.match([" ".join(passage[:12])])) == [(0, 7)] and not list(index.match([" ".join(passage[:11])]))


def test_within_is_the_edit_distance():
    rng = np.random.default_rng(2)
    for width, edits in ((12, 1), (13, 1), (14, 1), (13, 0), (11, 2)):
        a, b = rng.integers(0, 3, (200, width)), rng.integers(0, 3, (200, 13))
        a[:120, :11] = b[:120, :11]
        assert C.within(a, b, edits).tolist() == [C.edit_distance(x, y) <= edits for x, y in zip(a, b, strict=True)]


def test_many_items_are_joined_by_their_keys(spark):
    """More windows than one block: no index is held anywhere; edits of each kind are found."""
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.sample(vocabulary, 16))) for i in range(60)] + [(99, None), (98, "short")]
    docs, want = [], set()
    for d, (i, t) in enumerate(items[:60]):
        w, at = t.split(), 8
        w[at : at + (d % 3 != 2)] = [] if d % 3 == 1 else ["new"]
        docs.append((d, " ".join(rng.choices(vocabulary, k=10) + w + rng.choices(vocabulary, k=10))))
        want.add((d, i))
    docs += [(500, None), (None, items[3][1])]
    d, i = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {tuple(r) for r in C.leaks(d, i, "doc_id", "item_id", "text", edits=1, coordinates=6, recall=0.95, windows_per_block=10).collect()}
    texts = dict(items)
    assert all(C.holds(C.words(dict(docs)[a]), C.words(texts[b]), 13, 1) for a, b in got)
    exact = {(a, b) for a, t in docs for b, u in items if t and u and C.holds(C.words(t), C.words(u), 13, 1)}
    assert (None, 3) in got and len(got & exact) / len(exact) >= 0.95 and len(exact) > 20


def test_holds_is_exact():
    rng = random.Random(2)
    for _ in range(60):
        a, b = rng.choices("abc", k=rng.randrange(9)), rng.choices("abc", k=rng.randrange(4, 8))
        for edits in (0, 1):
            want = any(C.edit_distance(np.array(a[x:y]), np.array(b[z : z + 4])) <= edits for x in range(len(a)) for y in range(x + 1, len(a) + 1) for z in range(len(b) - 3))
            assert C.holds(a, b, 4, edits) == want
