"""Personal information inside free text: find it and put typed placeholders in its place.

A text and its label are one document of a skip-chain CRF over all their tokens. What has the form
of a mail address, of a group of digits as in phone and identity numbers, or of a street with a
house number is one token; the field decides from its form and its surroundings whether it is
personal data, and which words are a person's name. Equal and similar capitalised words (case,
accents and a plural or possessive s aside) and candidates that say the same are tied by skip edges,
so that a surname alone is known as a name by the full name elsewhere in the document.

It is fitted on a bounded sample. Where telling words stand nearby, or a form says enough, the
sample's labels are known; elsewhere they stay open. Names are labelled from a short list of common
given names and from what the sample shows beside them; half of these words are hidden from the
features, so that endings, shapes and surroundings must do.

Defined results: null and empty texts hold nothing; a row delivered twice counts once; offsets are
code points; extra columns are carried through by :func:`redact`, which also replaces a surname
that is known by a full name. No text is cut, whatever its length. One map over the rows; only the
finds are shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.llm.crf import SkipChain
from rulesieve.session import hash_sample, spread

#: Rows the field is fitted on, and rows the names are grown from, at most.
SAMPLE_ROWS, NAME_ROWS = 6000, 24_000
LABELS = ("O", "email", "phone", "id_number", "address", "B", "I")
O, EMAIL, PHONE, ID, ADDRESS, B, I = range(7)  # noqa: E741
KINDS = ("email", "phone", "id_number", "address", "person_name")

# Fixed values, used for the sample's labels only: common given names of the languages served.
GIVEN = frozenset(
    """james john robert michael william david richard joseph thomas charles daniel matthew anthony steven paul andrew joshua kenneth kevin brian george edward
    mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy sandra ashley emily donna michelle carol amanda laura helen anna rachel emma olivia
    peter andreas wolfgang klaus jürgen hans stefan martin christian frank uwe dieter matthias sebastian jan tobias felix lukas jonas leon max moritz otto karl
    ursula monika petra sabine renate karin gisela katja julia lena hannah hanna marie johanna greta ilse heike anke silke nadine
    jean pierre michel philippe alain nicolas christophe laurent olivier julien antoine hugo louis pascal françois andré
    nathalie isabelle sylvie catherine valérie sophie camille chloé léa élodie claire thérèse lucie zoé
    antonio josé manuel francisco juan pedro miguel carlos jesús alejandro javier sergio pablo diego rafael fernando álvaro mateo
    carmen maría josefa dolores pilar teresa cristina marta elena lucía paula raquel beatriz rosa marina nuria
    omar ali mohammed ahmed fatima aisha leila samir karim yusuf ivan olga nina marek pavel lars nils ingrid""".split()
)
PARTICLES = frozenset("van von de der den del di da la le el al ben bin ten zu dos du".split())
TITLES = frozenset("mr mrs ms mme mlle dr prof herr herrn frau don doña señor señora sr sra sir miss madame monsieur".split())

# Fixed values, used for the sample's labels only: words that tell what a number beside them is.
PHONE_WORDS = frozenset(
    "phone tel telephone mobile cell cellphone fax call calls caller calling called dial ring sms text hotline number telefon telefonisch handy rufnummer anrufen erreichbar ruf téléphone téléphoner appeler appelez joindre rappeler portable teléfono móvil llame llamar llámeme".split()
)
ID_WORDS = frozenset("ssn social sociale sécurité sozialversicherung national insurance nino passport identity identification steuer tax fiscal dni nif nie nir insee ausweis taxpayer identidad".split())
OTHER_NUMBERS = frozenset(
    "ticket order build batch total invoice part serial version port retry isbn sku tracking vorgang bestellung rechnung auftrag commande facture pedido factura error count size bytes score coordinates seed commit sid queue timestamp took ms issn ean".split()
)
PLACE_WORDS = frozenset("address lives living live moved home street ship shipped deliver delivery lieferung wohnhaft wohnt adresse anschrift habite domicilié demeurant vive domicilio dirección reside resident".split())

_STREET_EN = r"(?:street|road|lane|avenue|drive|terrace|court|close|way|boulevard|square|place|crescent|gardens|st|rd|ln|ave|dr|ter|ct|cl|blvd|sq|pl)\b\.?"
_CAP = r"[^\W\d_a-zß-ÿ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_CITY = rf"{_CAP}(?: {_CAP})?"
_EN = rf"(?:(?i:flat|apt|unit|suite|apartment)\.? ?\d+[A-Za-z]?, ?)?\d{{1,5}}[A-Za-z]?(?:[-/]\d{{1,4}})? (?:{_CAP} ){{1,3}}(?i:{_STREET_EN})(?:, {_CITY}(?:, [A-Z]{{2}} \d{{5}}(?:-\d{{4}})?| [A-Z]{{1,2}}\d[\dA-Z]? \d[A-Z]{{2}})?)?"
_DE = rf"{_CAP}(?:[ -]{_CAP})?(?:[Ss]tra(?:ss|ß)e|str\.|weg|gasse|allee|platz|ring|damm|ufer|STRASSE|WEG|GASSE|ALLEE|PLATZ) \d{{1,4}} ?[a-zA-Z]?\b(?:, \d{{4,5}} {_CITY})?"
_DE2 = rf"(?:{_CAP}(?:er|ER)) (?:Stra(?:ss|ß)e|Weg|Gasse|Allee|Platz|Ring|Damm|Ufer) \d{{1,4}} ?[a-zA-Z]?\b(?:, \d{{4,5}} {_CITY})?"
_ES = rf"(?:Calle|Avenida|Avda\.?|Plaza|Paseo|Carrer|Ronda|Camino|CALLE|AVENIDA|PLAZA|PASEO|C/)(?: (?:de|del|la|las|los|el))* {_CAP}(?: {_CAP})?,? (?:n\.?º ?)?\d{{1,4}}(?:, \d{{1,2}}º(?: ?[A-Z])?)?(?:, \d{{5}} {_CITY})?"
_FR = rf"\d{{1,4}}(?: ?(?:bis|ter|quater))?,? (?i:rue|quai|avenue|place|boulevard|chemin|allée|impasse|cours|square|route)(?: (?:de la|de l['’]|des|du|de|d['’]|la|le|les))? ?{_CAP}(?: {_CAP})?(?:, \d{{5}} {_CITY})?"
_AT = r"(?:[@＠]| ?[\[({<] ?(?i:at) ?[\])}>] ?|%40|&#64;|&#x40;|&commat;|\\u0040|=40| (?i:at) )"
_DOT = r"(?:\.| ?[\[({<] ?(?i:dot) ?[\])}>] ?|%2[Ee]|&#46;|&period;| (?i:dot) )"
AT = re.compile(_AT)
HOST = re.compile(rf"[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)*?{_DOT}[A-Za-z]{{2,}}(?:{_DOT}[A-Za-z]{{2,}})*(?![\w@-])")
LOCAL_END = re.compile(r"[A-Za-z0-9_+%.-]+\Z")
DOT_END = re.compile(rf"{_DOT}\Z")
_PHONE = (
    r"(?:(?:\+|00)\d{1,3}(?:[ .-]?\(0\))?(?:[ ./-]?\(?\d{1,5}\)?){1,6}"
    r"|\(\d{3}\) ?\d{3}[-. ]\d{4}|(?:1[-. ])?\d{3}[-. ]\d{3}[-. ]\d{4}|0\d(?:[ .-]\d\d){4}|\(0\d{2,4}\)[ /-]?\d{3,8}(?:[ -]\d{2,6})?|0\d{2,4}[ /-]\d{3,8}(?:[ -]\d{2,6})?)(?![\w-]|[.:]\d)"
)
_NUMBER = r"(?:\d{3}-\d\d-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d\d ?\d{3} ?\d{3} ?\d\d|\d\d \d{3} \d{3} \d{3}|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d{3}-\d{3,5}-\d{3,4}|\d{7,15})(?![\w-]|[.:/]\d)"
NUMBERS = re.compile(rf"(?=[\d+(A-Z])(?:(?<![\w.+/=-])(?:{_NUMBER}|{_PHONE})|(?<==){_PHONE})")
#: What a text must hold somewhere, in small letters, for a mail address (1) or an address (2) to be looked for.
TRIGGERS = {
    1: ("@", "＠", "%40", "&#64;", "&#x40;", "&commat;", "\\u0040", "=40", " at ", "at)", "at]", "at}", "at>"),
    2: (
        *(w + e for w in " street, road, lane, avenue, drive, terrace, court, close, way, boulevard, square, place, crescent, gardens, st, rd, ln, ave, dr, ter, ct, cl, blvd, sq, pl".split(",") for e in " ,.;:|<\"'\n)"),
        *(w for w in "weg ,strasse ,straße ,gasse ,allee ,platz ,ring ,damm ,ufer ,str. ".split(",")),
        *(w for w in "calle ,avenida ,avda,plaza ,paseo ,carrer ,ronda ,camino ,c/".split(",")),
        *(w for w in " rue, quai, place, chemin, allée, impasse, cours, square, route".split(",")),
    ),
}
#: Six digits with no more than signs between them, as every phone and identity number has.
DIGITS = re.compile(r"\d(?:[ ()./-]{0,3}\d){5}[\d ()./-]*")
SIX = re.compile(r"\d[\d ()./-]{5}")
FORM = str.maketrans("012345678" + "bcdefghijklmnopqrstuvwxyz" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "9" * 9 + "a" * 25 + "A" * 26)
NO_WORDS = str.maketrans("", "", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
ADDRESS_FORM = re.compile(rf"(?<!\w)(?:{_EN}|{_FR}|{_ES}|{_DE}|{_DE2})")
#: Words, with digits in them or not, joined by hyphens or apostrophes; an elided article is a token of its own; every other sign too.
PLAIN = re.compile(r"[ldjcmnt]['’](?=[^\W\d_])|[^\W_]+(?:['’-][^\W_]+)*|[^\s\x01-\x03]")
#: Marks within tokens; as characters of a text they are passed over.
CANDIDATE = "\x01"
HIDDEN = "\x02"
BETWEEN = "\x03"
#: Tokens on either side of a candidate whose words its features name.
NEAR = 6


def canonical(token: str) -> str:
    """The token as the field knows it: digits are all alike, and so are words with digits in them."""
    if token[0] == CANDIDATE or not token[-1].isalnum() or token.isalpha():
        return token
    bare = token.replace("-", "")
    if bare.isdigit():
        return NINES("9", token)
    return "a9" if any(map(str.isdigit, bare)) else token


NINES = re.compile(r"\d").sub


def _triggers():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for flag, words in TRIGGERS.items():
        for w in words:
            machine.add_word(w, flag)
    machine.make_automaton()
    return machine


_MACHINE = _triggers()


def _local_start(text: str, at: int) -> int:
    """Where the local part that ends at ``at`` begins, its dots written in any form; ``at`` where there is none."""
    start = at
    while True:
        low = start
        while low and (text[low - 1].isascii() and (text[low - 1].isalnum() or text[low - 1] in "_+%-.")):
            low -= 1
        if low == start:
            return at if start == at else start
        start = low
        dot = DOT_END.search(text, max(0, start - 12), start)  # no form of a dot is longer
        before = dot.start() if dot else 0
        if not dot or not before or not (text[before - 1].isascii() and (text[before - 1].isalnum() or text[before - 1] in "_+-")):
            return start
        start = before


def mails(text: str) -> Iterator[tuple[int, int]]:
    """What has the form of a mail address, found from its at-sign outwards; in URLs and repository addresses too."""
    for m in AT.finditer(text):
        host = HOST.match(text, m.end())
        if not host or (m[0].lower() == " at " and " dot " not in host[0].lower()):
            continue
        start = _local_start(text, m.start())
        while start < m.start() and not text[start].isalnum():
            start += 1
        if start < m.start():
            yield start, host.end()


def numbers(text: str) -> Iterator[tuple[int, int]]:
    """Groups of digits in the form of phone and identity numbers; looked for around six digits with signs between."""
    done = 0
    for m in DIGITS.finditer(text) if SIX.search(text) else ():
        if m.end() > done:
            for n in NUMBERS.finditer(text, max(done, m.start() - 4), min(len(text), m.end() + 6)):
                if not (n.end() == m.end() + 6 < len(text)):
                    yield n.span()
                    done = n.end()


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, form) of single-token candidates in order, without overlaps; mail first, then addresses, then numbers."""
    flags = 0
    for _, flag in _MACHINE.iter(text.lower() + " "):
        flags |= flag
    found = [(a, b, "email") for a, b in mails(text)] if flags & 1 else []
    if flags & 2:
        found += [(m.start(), m.end(), "address") for m in ADDRESS_FORM.finditer(text)]
    found += [(a, b, "number") for a, b in numbers(text)]
    if len(found) < 2:
        return found
    rank = {"email": 0, "address": 1, "number": 2}
    kept: list[tuple[int, int, str]] = []
    for c in sorted(found, key=lambda c: (c[0], rank[c[2]])):
        while kept and c[0] < kept[-1][1] and rank[c[2]] < rank[kept[-1][2]]:
            kept.pop()
        if not kept or c[0] >= kept[-1][1]:
            kept.append(c)
    return kept


def tokens(text: str, found: list[tuple[int, int, str]]) -> list[str]:
    """The text's tokens. A candidate's holds its kind, its value and what stands around it."""
    out: list[str] = []
    if not found:
        return PLAIN.findall(text)
    places: list[int] = []
    at = 0
    for a, b, _ in found:
        out += PLAIN.findall(text, at, a)
        places.append(len(out))
        out.append("")
        at = b
    out += PLAIN.findall(text, at)
    for (a, b, kind), k in zip(found, places, strict=True):
        left = " ".join([w for w in out[max(0, k - NEAR) : k] if w[:1].isalpha()]).lower().replace("-", " ")
        right = " ".join([w for w in out[k + 1 : k + 1 + NEAR // 2] if w[:1].isalpha()]).lower().replace("-", " ")
        glued = "" if not a or text[a - 1].isspace() else text[max(0, a - 80) : a].split()[-1].translate(NO_WORDS)[-6:]
        tail = text[b : b + 1]
        behind = tail + ("a" if text[b + 1 : b + 2].isalnum() else "") if tail and not tail.isspace() else ""
        out[k] = CANDIDATE.join(("", kind, text[a:b], f"{glued} {behind}".replace(CANDIDATE, ""), left, right))
    return out


def positions(text: str, found: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Start and end of every token of :func:`tokens`."""
    out: list[tuple[int, int]] = []
    at = 0
    for a, b, _ in found:
        out += [m.span() for m in PLAIN.finditer(text, at, a)]
        out.append((a, b))
        at = b
    return out + [m.span() for m in PLAIN.finditer(text, at)]


def shape(token: str) -> int:
    if token[0] == CANDIDATE:
        return {"email": 10, "number": 11, "address": 12}[token.split(CANDIDATE, 2)[1]]
    if token[0] == HIDDEN:
        token = token[1:]
    if token == BETWEEN:
        return 15
    if token.isalpha() or "'" in token or "’" in token or "-" in token[1:]:
        low = token.lower()
        if token == low:
            return 9 if low in PARTICLES else 1
        if token.isupper():
            return 4 if len(token) == 1 else 3
        return 2 if token[0].isupper() else 5
    if token.isdigit():
        return 6
    return {".": 7, ",": 8}.get(token, 14 if token[0].isalnum() and not token.replace("-", "").isdigit() else 6 if token[0].isdigit() else 13)


def features(token: str) -> list[str]:
    if token[0] == CANDIDATE:
        _, kind, value, glued, left, right = token.split(CANDIDATE)
        form = value.translate(FORM) if kind == "number" else value.translate(NO_WORDS)
        out = [f"k:{kind}", f"f:{kind}:{form}", f"g:{kind}:{glued}", f"before:{kind}:{glued.partition(' ')[0]}", f"behind:{kind}:{glued.partition(' ')[2]}", f"n:{kind}:{form.count('9')}", f"x:{kind}:{value[:1]}"]
        out += [f"l:{kind}:{w}" for w in set(left.split())] + [f"r:{kind}:{w}" for w in set(right.split())]
        if left:
            out.append(f"ll:{kind}:{left.rsplit(' ', 1)[-1]}")
        return out
    if token == BETWEEN:
        return ["between"]
    hidden = token[0] == HIDDEN
    word = token[1:] if hidden else token
    form = f"s:{shape(word)}"
    if not word[0].isalpha():
        return [form, f"w:{word[:12]}"]
    low = word.lower()
    part = low.rpartition("-")[2]
    out = [form, f"e2:{form}{part[-2:]}", f"e3:{form}{part[-3:]}", f"b3:{form}{low[:3]}", f"b4:{form}{low[:4]}"]
    if not hidden:
        out.append(f"w:{low}")
        if low in TITLES:
            out.append("title")
    return out


def allowed(token: str) -> tuple[int, ...]:
    if token[0] == CANDIDATE:
        return {"email": (O, EMAIL), "number": (O, PHONE, ID), "address": (O, ADDRESS)}[token.split(CANDIDATE, 2)[1]]
    return (O,) if token == BETWEEN else (O, B, I)


def tie(token: str) -> str:
    """What equal and similar tokens share; '' for tokens that are not tied."""
    if token[0] == CANDIDATE:
        _, kind, value, *_ = token.split(CANDIDATE)
        if kind == "number":
            return "#" + re.sub(r"\D", "", value)[-8:]
        return kind + re.sub(_AT, "@", re.sub(_DOT, ".", value)).lower()
    if len(token) < 4 or not token[0].isupper():
        return ""
    low = token.casefold()
    if not low.isascii():
        low = "".join(c for c in unicodedata.normalize("NFKD", low) if not unicodedata.combining(c))
    low = re.sub(r"['’]s?$", "", low)
    return low[:-1] if low[-1:] == "s" and len(low) > 4 else low


class _Ties(dict):
    def __missing__(self, token: str) -> str:
        if len(self) > 200_000:
            self.clear()
        key = self[token] = tie(token.lstrip(HIDDEN)) if token else ""
        return key


_TIES = _Ties()


def skips(words: list[str]) -> list[tuple[int, int]]:
    """Places with the same tie, each with its next occurrence."""
    last: dict[str, int] = {}
    out = []
    for i, key in enumerate(map(_TIES.__getitem__, words)):
        if key:
            if key in last and i - last[key] > 1:
                out.append((last[key], i))
            last[key] = i
    return out


class Document(list):
    """Tokens of both fields, with a token between them; ``found`` are the candidates of each field."""

    def __init__(self, text: str | None, label: str | None):
        self.found = (candidates(text) if text else [], candidates(label) if label else [])
        super().__init__(tokens(text, self.found[0]) if text else ())
        if label and (told := tokens(label, self.found[1])):
            self.append(BETWEEN)
            self += told


document = Document


class Names:
    """Given names and surnames of a sample: grown from common given names by what stands beside them.

    A word before known surnames is a given name; a word behind a given name is a surname. When
    nothing more is found so, words that begin and end as several known surnames do count as
    surnames too. Words that the sample also writes small, and titles, are neither.
    """

    def __init__(self, docs: list[list[str]], given: frozenset[str] = GIVEN):
        small = {w for d in docs for w in d if w[0].islower()}
        beside: dict[str, Counter] = defaultdict(Counter)
        for d in docs:
            for k, w in enumerate(d):
                if (first := self._given(w)) and first not in small and first not in TITLES:
                    n = self._behind(d, k)
                    if n and (last := self._surname(d[n])) and last not in small and last not in TITLES:
                        beside[first][last] += 1
        self.given, self.family = set(), set()
        fresh = {g for g in beside if g in given}
        alike: set[str] = set()
        while fresh:
            self.given |= fresh
            self.family |= {b for a in fresh for b in beside[a]}
            fresh = {a for a in beside.keys() - self.given if self._share(beside[a], self.family) >= 1 / 6}
            if not fresh:
                begins, ends = Counter(b[:3] for b in self.family), Counter(b[-3:] for b in self.family)
                alike = {b for of in beside.values() for b in of if begins[b[:3]] > 2 and ends[b[-3:]] > 2} | self.family
                fresh = {a for a in beside.keys() - self.given if self._share(beside[a], alike) > 1 / 2}

    @staticmethod
    def _share(of: Counter, known: set[str]) -> float:
        return sum(n for b, n in of.items() if b in known) / sum(of.values())

    @staticmethod
    def _given(w: str) -> str:
        return w.lower() if len(w) > 1 and w[0].isupper() and w.isalpha() else ""

    @staticmethod
    def _surname(w: str) -> str:
        w = re.sub(r"['’]s$", "", w)
        return w.lower() if len(w) > 2 and w[0].isupper() and w.replace("-", "").isalpha() else ""

    @staticmethod
    def _behind(d: list[str], k: int) -> int:
        """Place of the word that a given name at ``k`` would have as surname, or 0."""
        n = k + 1
        if n + 1 < len(d) and len(d[n]) == 1 and d[n].isupper() and d[n + 1] == ".":
            n += 2
        while n < len(d) and d[n].lower() in PARTICLES and n - k < 5:
            n += 1
        return n if n < len(d) and d[n][0].isupper() else 0

    def _family(self, word: str) -> bool:
        low = re.sub(r"['’]s$", "", word.lower())
        return word[0].isupper() and (low in self.family or ("-" in low and any(p in self.family for p in low.split("-"))))

    def end(self, d: list[str], k: int) -> int:
        """Place behind the full name that begins at ``k``, or 0."""
        w, after = d[k], lambda n: d[n] if n < len(d) else " "

        def surname(n: int) -> int:
            while n < len(d) and d[n].lower() in PARTICLES:
                n += 1
            return n + 1 if n < len(d) and self._family(d[n]) else 0

        if w[0].isupper() and w.lower() in self.given:
            return surname(k + 3 if len(after(k + 1)) == 1 and after(k + 1).isupper() and after(k + 2) == "." else k + 1)
        if len(w) == 1 and w.isupper() and after(k + 1) == ".":
            n = surname(k + 2)
            if n and not (after(n) == "," and after(n + 1).lower() in self.given):  # "M. Surname, Given" begins with a title
                return n
            return 0
        if (w[0].isupper() or w in ("van", "von")) and (n := surname(k)) and after(n) == "," and after(n + 1)[0].isupper() and after(n + 1).lower() in self.given:
            return n + 2
        return 0


def known(d: list[str], names: Names) -> list:
    """What the sample's labels say of a document: a label, or the labels a place may have."""
    out: list = [O] * len(d)
    for i, w in enumerate(d):
        if w[0] == CANDIDATE:
            out[i] = _known_candidate(w)
    k = 0
    full: set[str] = set()
    while k < len(d):
        if n := names.end(d, k):
            out[k], out[k + 1 : n] = B, [I] * (n - k - 1)
            full |= {t for x in d[k:n] if (t := tie(x))}
            k = n
            continue
        if k + 1 < len(d) and d[k][0].isupper() and d[k + 1][0].isupper() and d[k][0] != CANDIDATE:
            a, b = d[k].lower(), d[k + 1].lower()
            if (a in names.given) != (b in names.family) and a not in TITLES and out[k] == O:
                out[k], out[k + 1] = (O, B), (O, I)  # half a name is known: open
        k += 1
    # a part of a full name that stands alone elsewhere in the document is a mention of it
    for i, w in enumerate(d):
        if out[i] == O and w[0].isupper() and tie(w) in full:
            out[i] = B
    return out


def _known_candidate(token: str):
    _, kind, value, glued, left, right = token.split(CANDIDATE)
    words = left.split()
    near, last = set(words[-4:]) | set(right.split()[:1]), words[-1] if words else ""
    if kind == "email":
        return O if "://" in glued or glued.endswith(" :a") else EMAIL
    if kind == "address":
        if near & PLACE_WORDS or re.search(r"\d{4,5}|, ", value):
            return ADDRESS
        return (O, ADDRESS)
    digits = sum(c.isdigit() for c in value)
    phone, ident = bool(near & PHONE_WORDS), bool(near & ID_WORDS)
    named = words[-2] if last in ("no", "nr", "number", "nummer", "numéro", "número") and len(words) > 1 else last
    if named in OTHER_NUMBERS or (named in ("id", "no", "nr") and not ident and not phone and value.isdigit()):
        return O
    if re.match(r"\+\d|\(\d{3}\) |\(0\d|0\d( \d\d){4}|0\d(\.\d\d){4}", value):
        return PHONE
    if re.fullmatch(r"\d{3}-\d\d-\d{4}|[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D]|[12] ?\d\d ?(?:0[1-9]|1[0-2]) ?\d\d ?\d{3} ?\d{3} ?\d\d|\d{8}-?[A-Z]|[XYZ]-?\d{7}-?[A-Z]|\d\d \d{3} \d{3} \d{3}", value):
        return ID
    if set(words[-2:]) & OTHER_NUMBERS and not phone and not ident:
        return O
    if ident and not phone and digits >= 8:
        return ID
    if phone and not ident and 7 <= digits <= 15:
        return PHONE if re.search(r"[ ().+/-]", value) or digits >= 10 else (O, PHONE)
    if value.isdigit() and digits != 11 and not phone and not ident:
        return O
    return (O, PHONE, ID)


def hidden(d: list[str], labels: list) -> list[str]:
    """The document with half of its names' words (by hash) hidden from the features."""
    return [HIDDEN + w if labels[i] in (B, I) and w[0].isalpha() and crc32(w.lower().encode()) % 2 else w for i, w in enumerate(d)]


def varied(d: list[str], labels: list, turn: int, families: list[str]) -> tuple[list[str], list] | None:
    """The document with its names of the form "given surname" written another way; the rarer forms become as frequent.

    In one turn of six the names stay and a surname follows alone: its own, which is a mention, or
    another of the sample's, which is none.
    """
    out, told, k, last = [], [], 0, ""
    way = turn % 6
    while k < len(d):
        plain = labels[k] == B and k + 1 < len(d) and labels[k + 1] == I and (k + 2 == len(d) or labels[k + 2] != I) and d[k + 1][0].isupper() and len(d[k]) > 1
        if plain:
            given, last, middle = d[k], d[k + 1], "ABCDEFGHJKLMNOPRSTVWZ"[(turn + k) % 21]
            particle = sorted(PARTICLES)[(turn + k) % len(PARTICLES)]
            new = [[last, ",", given], [given[0], ".", last], [given, middle, ".", last], [given, particle, last], [given.upper(), last.upper()], [given, last]][way]
            out += new
            told += [B] + [I] * (len(new) - 1)
            k += 2
        else:
            out.append(d[k])
            told.append(labels[k])
            k += 1
    if not last:
        return None
    if way == 5:
        word = last if turn % 12 < 6 else families[turn % len(families)].capitalize()
        small = [w for w in d if w.islower() and w.isalpha()] or ["so"]
        before, after = small[turn % len(small)], small[(turn // 7) % len(small)]
        out += [".", before.capitalize(), word, after] if turn % 5 < 3 else [".", word, after, before]
        told += [O, O, B if word == last else O, O] if turn % 5 < 3 else [O, B if word == last else O, O, O]
    return out, told


def fit(rows: list[tuple[str | None, str | None]], rounds: int = 6, sample_rows: int = SAMPLE_ROWS) -> SkipChain:
    """Names are grown from all rows, the field is fitted on the first ``sample_rows``."""
    docs = [document(*r) for r in rows]
    names = Names([d for d in docs if d])
    use = [(d, known(d, names)) for d in docs[:sample_rows] if d]
    # of the documents in which nothing is found or could be, one in three suffices
    use = [(d, y) for n, (d, y) in enumerate(use) if n % 3 == 0 or any(v != O or w[0] == CANDIDATE for v, w in zip(y, d, strict=True)) or any(a[0].isupper() and b[0].isupper() for a, b in zip(d, d[1:], strict=False))]
    named, families = [(d, y) for d, y in use if B in y], sorted(names.family)
    more = [v for n, (d, y) in enumerate(named) for turn in (n, n + 3, 6 * n + 5) if (v := varied(d, y, turn, families))]
    field = SkipChain(LABELS, features, shape, allowed, canonical)
    outside = [k for k in range(len(LABELS)) if k not in (B, I)]
    field.moves[outside, I] = field.begin[I] = -6  # a name goes on only where one began
    both = [(hidden(d, y), y) for d, y in use + more]
    return field.fit([d for d, _ in both], [y for _, y in both], rounds=rounds, batch=96, rate=0.4, skips=skips)


Find = tuple[int, int, str, int, int]


def spans(docs: list[Document], rows: list[tuple[str | None, str | None]], model: SkipChain, ties: bool = True) -> Iterator[Find]:
    """(number of the document, field, kind, start, end) of every find; field 0 is the text, 1 the label.

    Kind 'mention' is a single word that is part of a person's name; the others are KINDS.
    """
    model.forget()
    edges = [skips(d) for d in docs] if ties else [[]] * len(docs)
    for i, marginal in enumerate(model.marginals(docs, edges, rest=O)):
        if marginal is None or not len(marginal):
            continue
        best = marginal.argmax(1)
        if not best.any():
            continue
        d, (text, label) = docs[i], rows[i]
        where = [(0, *p) for p in positions(text, d.found[0])] if text else []
        if len(where) < len(d):
            where = [*where, (-1, 0, 0), *((1, *p) for p in positions(label, d.found[1]))]
        k = 0
        while k < len(d):
            y, (field, start, end) = best[k], where[k]
            if y in (EMAIL, PHONE, ID, ADDRESS):
                yield i, field, LABELS[y], start, end
            elif y == B:
                n = k + 1
                while n < len(d) and best[n] == I and where[n][0] == field:
                    n += 1
                named = [w for w in d[k:n] if w[0].isupper() and w[0].isalpha()]
                if len(named) >= 2 and any(len(w) > 2 for w in named) and d[n - 1][0].isalpha():
                    yield i, field, "person_name", start, where[n - 1][2]
                elif n == k + 1 and len(d[k]) > 2:
                    yield i, field, "mention", start, end
                k = n - 1
            k += 1


def _fitted(entries: DataFrame, key: str, text: str, label: str, sample_rows: int):
    rows = hash_sample(entries.where(F.col(text).isNotNull()), key, [text, label], max(sample_rows, NAME_ROWS))
    return entries.sparkSession.sparkContext.broadcast(fit(rows, sample_rows=sample_rows))


def find(entries: DataFrame, key: str, text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(key, field_name, pii_kind, start_at, end_at) of every occurrence."""
    model = _fitted(entries, key, text, label, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True))
            found = [f for f in spans([document(*r) for r in rows], rows, model.value) if f[2] != "mention"]
            at = [batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))]
            at += [pa.array([("text", "label")[f[1]] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(at + [pa.array([f[k] for f in found], pa.int64()) for k in (3, 4)], ["k", "field_name", "pii_kind", "start_at", "end_at"])

    kind = entries.schema[key].dataType.simpleString()
    return spread(entries.select(key, text, label)).mapInArrow(run, f"k {kind}, field_name string, pii_kind string, start_at bigint, end_at bigint").withColumnRenamed("k", key)


def replaced(text: str | None, finds: list[tuple[int, int, str]]) -> str | None:
    if not finds:
        return text
    parts, at = [], 0
    for start, end, kind in sorted(finds):
        parts += [text[at:start], f"[{'PERSON_NAME' if kind == 'mention' else kind.upper()}]"]
        at = end
    return "".join([*parts, text[at:]])


def redact(entries: DataFrame, key: str = "entry_id", text: str = "text", label: str = "label", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The same rows and columns, text and label with a placeholder for every find."""
    model = _fitted(entries, key, text, label, sample_rows)
    names = entries.columns
    at = [names.index(text), names.index(label)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in at), strict=True))
            finds: dict[tuple[int, int], list] = {}
            for i, field, kind, start, end in spans([document(*r) for r in rows], rows, model.value):
                finds.setdefault((i, field), []).append((start, end, kind))
            columns = list(batch.columns)
            for field, i in enumerate(at):
                columns[i] = pa.array([replaced(r[field], finds.get((n, field), [])) for n, r in enumerate(rows)], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return spread(entries).mapInArrow(run, entries.schema)
