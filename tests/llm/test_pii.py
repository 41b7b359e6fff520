"""Personal information: kinds, near misses, names that no list knows, skip edges, redaction."""

import random

import pytest

from rulesieve.llm import pii

GIVEN = ["Olga", "Emma", "Jürgen", "Zoé", "Otto", "Silke", "Mateo", "Nadine", "Peter", "Laura", "Pierre", "Marta", "Hugo", "Karin", "Omar", "Lars"]
FAMILY = [a + b for a in ("Ander", "Bent", "Carl", "Dun", "Ehr", "Fair", "Gold", "Hart", "Kess", "Lind", "Mor", "Nor") for b in ("mann", "ley", "sen", "field", "berg", "ham")]
#: In no list of the module and in no sample.
NEW_GIVEN = ["Tarquin", "Wilhelmine", "Ottoline", "Fenja", "Aurèle", "Ximena", "Bastien", "Solveig", "Dagny", "Leocadia"]
NEW_FAMILY = [a + b for a in ("Pem", "Ross", "Stav", "Tor", "Vel", "Wyn") for b in ("mann", "ley", "sen", "field", "berg", "ham")]
FORMS = ["Please ask {} about it.", 'assignee: "{}"', "Mr {} complained.", "Laut Herrn {} stimmt das.", "approved_by={} ticket=5", "<td>{}</td>", "The escalation came from {}, not from us.", "Mme {} habite ici.", "// Author: {}", "name: {}"]
THINGS = ["Beacon", "Vault", "Relay", "Compass", "Gate Crew", "Road Works"]
STEMS = ["Wugou", "Vossi", "Kona", "Draelu", "Prixo", "Zumar", "Qobel", "Tiaru"]
PLAIN = ["The {s} {t} dashboard moved.", "Ticket 1234567890 was opened by the {s} {t} queue.", "npm i @a/b@1.2.3 failed for {s} {t}", "clone git@git.x.example:a/b.git now", "git clone git@host.example:group/c.git", "url https://u:pw9@db.x.example:5432/x", "pip install https://me:tok@pip.example/a.zip", "Part no 123-456-789 replaced 4.", "Part no 987-654-321 replaced 53 of it.", "INFO etag=9f86d081884c7d65 took 12 ms", "Reviewers from {s} {t} asked.", "the beacon, the vault, the relay, the compass, the gate crew and road works"]
DATA = ["Her SSN field read 123-45-6789 today.", "Call 01632 960 503 now.", "He moved to 12 Elm Street, Newby last year.", "mail to ann@example.org today",
    "mail ann (at) mx (dot) example (dot) org on Friday", "user=bob-3[at]example.org rule", "mail=bob%40example.org&t=4", "call +44 (0)1632 960001 or (303) 555-0101 now", "au 06.39.98.10.20.", "tel +33 1 99 00 12 34",
    "field read QQ 98 76 54 B before", "national id QQ112233C was pasted", "vive en Calle Elm 6, 3º A, 13611 Westerdorf.", "habite au 9 bis, quai des Elm, 12345 Newby.", "geht an Elmweg 3a, 10001 Newby, bitte"]


def written(rng, given, family):
    a, b = rng.choice(given), rng.choice(family)
    return rng.choice([f"{a} {b}", f"{a} {b}", f"{a} {b}", f"{b}, {a}", f"{a[0]}. {b}", f"{a} van {b}", f"{a} {b}".upper()])


def sample(seed, n, given=GIVEN, family=FAMILY):
    """(rows, names as (row, start))"""
    rng = random.Random(seed)
    rows, names = [], []
    for _ in range(n):
        name, form = written(rng, given, family), rng.choice(FORMS)
        names.append((len(rows), form.index("{}")))
        rows.append((form.format(name), None))
        rows.append((rng.choice(PLAIN).format(s=rng.choice(STEMS), t=rng.choice(THINGS)), rng.choice([None, "", "pii"])))
        rows.append((rng.choice(DATA), None))
    return rows, names


@pytest.fixture(scope="module")
def model():
    return pii.fit(sample(1, 500)[0])


def spans(model, rows, **how):
    return list(pii.spans([pii.document(*r) for r in rows], rows, model, **how))


def found(model, text, label=None, **how):
    return {(("text", "label")[f], k, (text, label)[f][s:e]) for _, f, k, s, e in spans(model, [(text, label)], **how)}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to a.b+c@mail.example.net now", {("email", "a.b+c@mail.example.net")}),
        ("mail holberg.e (at) mx (dot) ceirnal (dot) test on Monday", {("email", "holberg.e (at) mx (dot) ceirnal (dot) test")}),
        ("user=ann-9[at]example.org next", {("email", "ann-9[at]example.org")}),
        ("GET /reset?mail=ann%40example.org&t=1", {("email", "ann%40example.org")}),
        ("git clone https://user:pw@git.x.example/a.git", set()),
        ("clone git@git.x.example:a/b.git", set()),
        ("call +44 (0)1632 960305 or (212) 555-0175 or 06.39.98.70.63", {("phone", "+44 (0)1632 960305"), ("phone", "(212) 555-0175"), ("phone", "06.39.98.70.63")}),
        ("Part no 523-188-367 replaced 97102", set()),
        ("Her SSN field read 123-45-6789 before", {("id_number", "123-45-6789")}),
        ("national id QQ 12 34 56 A was pasted", {("id_number", "QQ 12 34 56 A")}),
        ("He moved to Flat 3, 12 Elm Street, Newby last year", {("address", "Flat 3, 12 Elm Street, Newby")}),
        ("geht an Heronweg 33a, 10010 Fernston, bitte", {("address", "Heronweg 33a, 10010 Fernston")}),
        ("vive en Calle Saddle 28, 8º B, 11748 Altby.", {("address", "Calle Saddle 28, 8º B, 11748 Altby")}),
        ("habite au 38 bis, quai des Brook, 45004 Oldston.", {("address", "38 bis, quai des Brook, 45004 Oldston")}),
        ("dashboard moved next to Drae Street in the view", set()),
        ("Mr Olga Hartmann complained.", {("person_name", "Olga Hartmann")}),
        ('assignee: "Hartmann, Hugo"', {("person_name", "Hartmann, Hugo")}),
    ],
)
def test_kinds(model, text, want):
    assert {(k, v) for _, k, v in found(model, text)} == want


def test_local_parts_of_any_length(model):
    local = "a" * 400 + ".b" * 50
    assert found(model, f"mail to {local}@example.org today") == {("text", "email", f"{local}@example.org")}
    assert found(model, "see https://host.example/" + "p" * 900 + " and mail to ann@example.org today") == {("text", "email", "ann@example.org")}


def test_names_that_no_list_knows(model):
    """Given names outside the list and surnames outside the sample: endings, shapes and surroundings must do."""
    assert not {n.lower() for n in NEW_GIVEN} & pii.GIVEN and not set(NEW_FAMILY) & set(FAMILY)
    rows, names = sample(7, 400, NEW_GIVEN, NEW_FAMILY)
    got = {(i, s) for i, _, k, s, _ in spans(model, rows) if k == "person_name"}
    assert len(got & set(names)) / len(names) >= 0.9
    assert len(got & set(names)) / len(got) >= 0.9


def test_names_grow_from_the_list():
    docs = [pii.document(t, None) for t in ("ask Olga Hartmann", "ask Fenja Hartmann", "ask Fenja Velsen", "ask Dagny Velsen", "see Kona Beacon", "the beacon of Kona Vault")]
    names = pii.Names(docs)
    assert names.given == {"olga", "fenja", "dagny"} and names.family == {"hartmann", "velsen"}


def test_skip_edges_change_finds(model):
    """A surname alone is a mention where the document has the full name; without skip edges most are missed."""
    forms = ["Later {} said so.", "{} knows it.", "It fires, says {} now."]
    rows = [(f"Please ask {g} {f} about it. {again.format(f)}", None) for again in forms for g in GIVEN[:8] for f in ("Kessley", "Nornham", "Bentberg")]
    got = {ties: sum(k == "mention" for _, _, k, *_ in spans(model, rows, ties=ties)) for ties in (True, False)}
    assert got[True] >= 0.85 * len(rows) and got[False] <= 0.5 * len(rows)
    red = pii.replaced(rows[0][0], [(s, e, k) for _, _, k, s, e in spans(model, rows[:1])])
    assert red == "Please ask [PERSON_NAME] about it. Later [PERSON_NAME] said so."


def test_equal_and_similar_tokens_are_tied():
    assert pii.skips(["Olga", "x", "Olga", "y", "OLGA"]) == [(0, 2), (2, 4)]
    assert pii.skips(["Jürgens", "x", "Jurgen's", "of", "of", "The", "x", "The"]) == [(0, 2)]
    one, two = (pii.document(t, None)[-1] for t in ("call 0163 296 0503", "0163-296-0503"))
    assert pii.skips([one, "a", two]) == [(0, 2)]
    assert pii.tie(pii.document("bob (at) x (dot) org", None)[0]) == pii.tie(pii.document("Bob@x.org", None)[0]) != ""


def test_offsets_are_code_points_and_labels_are_searched(model):
    text = "😀 é漢 mail to ann@example.org"
    assert [(s, e) for *_, s, e in spans(model, [(text, None)])] == [(13, 28)]
    assert found(model, None, "Call 01632 960 503 now") == {("label", "phone", "01632 960 503")}
    assert found(model, None, None) == set() and found(model, "", "") == set()


def test_tokens_and_positions_agree():
    for t, lab in sample(4, 100)[0] + [("l'appel d'Olga, 5x of b8e-é  and\r\n\tO'Neil-Berg 12/3", "x")]:
        for x in (t, lab):
            if x:
                assert len(pii.document(x, None)) == len(at := pii.positions(x, pii.candidates(x))) and all(a < b for a, b in at)


def test_control_characters(model):
    text = "\x01 \x02x\x03 \x00 mail to \x01ann@example.org\x01 today"
    assert found(model, text, "\x01\x02") == {("text", "email", "ann@example.org")}
    assert found(model, "\x01", "\x03") == set()


def test_a_very_long_text(model):
    text = "lorem ipsum " * 30_000 + "mail to ann@example.org" + " dolor" * 30_000
    assert {v for *_, v in found(model, text)} == {"ann@example.org"}


def test_frames(spark):
    rows = [(i, t, lab, 5, "a") for i, (t, lab) in enumerate(sample(3, 60)[0])] + [(900, None, None, 5, "a"), (901, "Call 01632 960 503 now.", "SSN field read 123-45-6789", 5, "a"), (None, "mail to ann@example.org today", None, 5, "a")]
    df = spark.createDataFrame(rows, "entry_id bigint, text string, label string, start_at int, k string")
    got = pii.find(df, "entry_id", sample_rows=150)
    assert {("phone", 5), ("id_number", 15)} <= {(r["pii_kind"], r["start_at"]) for r in got.where("entry_id = 901").collect()}
    assert got.where("entry_id = 900").isEmpty() and got.where("entry_id IS NULL").count() == 1
    red = pii.redact(df, sample_rows=150)
    assert red.schema == df.schema and red.count() == len(rows)
    r = red.where("entry_id = 901").first()
    assert (r["text"], r["label"]) == ("Call [PHONE] now.", "SSN field read [ID_NUMBER]")
    assert pii.find(df.limit(0), "entry_id").isEmpty()
    # equal rows: the sample is never empty
    same = spark.range(500).selectExpr("5L AS entry_id", "'mail to ann@example.org today' AS text", "CAST(NULL AS STRING) AS label")
    assert pii.find(same, "entry_id", sample_rows=50).count() == 500
