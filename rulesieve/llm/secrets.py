"""Credentials embedded in source code: find them and redact them, the code around stays whole.

Candidates are values in the places where credentials stand: assignments to telling names (English,
German, French, Spanish), flags, headers, the user part of URLs, calls, tags, and tokens of known
make. A logistic regression scores each from the likelihood of its characters under a Markov chain
of ordinary words, from its characters themselves, from the identifiers around it and from the path
or source of the text. Words are counted in all texts, and it is fitted on all candidates of the
table, labelled weakly by patterns, which stay silent where they don't know and are no features; it
is calibrated on a fifth held out by hash, and a candidate whose calibrated score is at least one
half is a credential. Private keys are known by
their armour, which reaches as far as lines of base64 follow.

Defined results: null and empty texts hold nothing; lines end in ``\\n`` and count from 1; a row
delivered twice counts once; only the value is replaced, so quotes, names and line ends stay;
extra columns are carried through. One map finds the candidates and checkpoints them packed, sums of
a fixed size go to the driver for each step of the fitting, one more map scores; only finds are shuffled.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter, deque
from collections.abc import Callable, Iterable, Iterator
from itertools import batched
from math import exp, isqrt, log, log2
from string import ascii_lowercase
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rulesieve.session import cut, hash_sample, spread

SIZE = 1 << 16
#: Characters that ``word_pairs`` counts, as first and as second of a pair.
FROM, TO = "^" + ascii_lowercase, "$" + ascii_lowercase
#: Marks of candidates besides their label: private keys, those without a label, what the held-out ones' labels are raised by.
ARMOUR, OPEN, HELD = -2, -1, 2
#: Weight of the squared weights in the loss; what a step must have to gain for each candidate, else the fitting ends.
RIDGE, TOLERANCE = 0.03, 1e-4
#: Tasks whose sums the driver adds up itself, at most.
FAN = 16
#: Words before a value, on its line, that its features name.
NEAR = 4

BEGIN = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
#: One line of armour: its end, real or escaped; signs of quoting, commenting or joining; base64 or a header.
_BREAK = r"(?:\r?\n|(?:\\\\?r)?\\\\?n|\Z)"
BODY = re.compile(rf"(?P<lead>[ \t>#*|\"'+,;/]*)(?:(?P<data>[A-Za-z0-9+/]{{16,}}={{0,2}}|[A-Za-z0-9+/]{{2,}}={{1,2}})|(?:Proc-Type|DEK-Info|Comment|Version)\s*:[^\n]*?|)(?P<tail>[ \t\"'+,;\\]*?){_BREAK}")
SHORT = re.compile(rf"[ \t>#*|\"'+,;/]*(?P<data>[A-Za-z0-9+/]+={{0,2}})[ \t\"'+,;\\]*?{_BREAK}(?=[ \t>#*|\"'+,;/]*-----END )")
END = re.compile(r"[ \t>#*|\"'+,;/]*-----END ([A-Z0-9 ]+)-----")
#: Makes of token that are known by their look (fixed values).
MAKE = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|xox[abeprs]-[A-Za-z0-9-]{16,}"
    r"|A(?:KIA|SIA)[A-Z0-9]{16}|AIza[\w-]{24,}|eyJ[\w-]{8,}={0,2}\.[\w-]{8,}={0,2}\.[\w-]{8,}|[a-z]{2,8}_(?:pat|prod|live|test|key|sec|secret|token)_[A-Za-z0-9]{16,})(?![A-Za-z0-9_])"
)
_V = r"[^\s\"'`<>,;(){}\[\]&|\\]+"
#: Telling parts of names, small letters (fixed values).
TELLING = ("pass", "pwd", "pw", "secret", "token", "key", "auth", "cred", "api", "kennwort", "geheim", "schlüssel", "contraseña", "clave", "secreto", "mdp", "motdepasse", "mot_de_passe", "jeton")
_TELLING = "(?i:" + "|".join(re.escape(w) for w in sorted(TELLING, key=len, reverse=True)) + ")"
#: place -> (words one of which the text must hold, in small letters; pattern with value v and name k)
PLACES = {
    "url": (("://",), re.compile(r"://[^\s/:@\"'`<>]*:(?P<v>[^\s@/\"'`<>]+)@")),
    "assign": (TELLING, re.compile(rf"(?P<k>{_TELLING}[\w.\-]*)[\"'\])]*\s*(?:=>|:=|==?|:)\s*(?:[rbfuRBFU]{{0,2}}[\"'`]{{1,3}}|\(\s*[\"'`])?(?P<v>{_V})")),
    "flag": (("-p", "pass", "pwd", "token", "secret", "key"), re.compile(rf"(?<![\w-])--?(?P<k>(?:[\w-]*-)?(?i:password|passwd|passphrase|pass|pwd|token|secret|api-?key|p))(?:[\"'],\s*[\"']|[= ]\s*[\"']?)(?P<v>{_V})")),
    "user": (("-u", "--user"), re.compile(rf"(?<![\w-])(?:-u|--user)[= ]\s*[\"']?[\w.@-]+:(?P<v>{_V})")),
    "header": (("bearer", "basic", "token"), re.compile(r"(?i:bearer|basic|token)\s+(?P<v>[A-Za-z0-9._~+/=-]{8,})")),
    "spoken": (("passw", "pwd", "secret", "token", "kennwort", "clave", "contraseña", "mot de passe"), re.compile(rf"(?i)(?<![\w-])(?P<k>password|passwort|passwd|pwd|secret|token|kennwort|clave|contraseña|mot de passe)\s+(?:(?:is|ist|lautet|es|est)\s+)?[\"'`]?(?P<v>{_V})")),
    "call": (("credential", "auth", "login", "property", "password"), re.compile(r"(?P<k>\w*(?i:credential|auth|login|property|password)\w*)\s*=?\s*\(\s*[\"'][^\"']*[\"']\s*,\s*[\"'](?P<v>[^\"']+)[\"']")),
    "tag": (("<",), re.compile(rf"<(?P<k>\w*{_TELLING}\w*)>(?P<v>[^<\s]+)</")),
    "env": (("value",), re.compile(rf"(?:name|key)[\"']?\s*[:=]\s*[\"']?(?P<k>[\w.\-]*{_TELLING}[\w.\-]*)[\"']?[,\s]+[\"']?value[\"']?\s*[:=]\s*[\"']?(?P<v>{_V})")),
    "glued": (("mysql", "mariadb"), re.compile(rf"(?:mysql\w*|mariadb\w*)\b[^\n|;]*?\s-p(?P<v>{_V})")),
    "hook": (("://hook",), re.compile(r"https?://hooks?\.[^\s\"'`<>]*/(?P<v>[A-Za-z0-9_-]{12,})")),
    "make": (("gh", "glpat-", "k_live_", "k_test_", "xox", "akia", "asia", "aiza", "eyj", "_pat_", "_prod_", "_live_", "_test_", "_key_", "_sec_", "_secret_", "_token_"), MAKE),
}

# What follows serves the labels only.
STAND_IN = re.compile(
    r"(?i)^(?:(?:change|replace|insert|put|your|my|enter)(?:[\W_].*|me|this|here)?|dummy\w*|example\w*|sample\w*|test(?:ing)?|todo|tbd|fixme|none|null|nil|undefined|true|false|n/?a|redacted|hidden|masked|secret|password|passwd|token|key|changeme|foo(?:bar)?|placeholder|unset|empty)$"
    r"|^(.)\1{3,}$|^[.*x#?-]+$|_HERE$|<|>"
)
REFERENCE = re.compile(
    r"^\$\{?[A-Za-z_]\w*\}?$|^%[A-Za-z_]+%$|^%\(|^![A-Za-z]+$|\$\{|\{\{|^(?:os|process|settings|config|env|var|vars|self|this|System|getpass|vault|secrets?|data|local|module|args|request|ENC_REF|arn)(?:[.\[(:]|$)"
    r"|^[A-Za-z_]+(?:\.[A-Za-z_]+)+$|^[/~][\w.-]+(?:/[\w.-]*)*$|^kv/"
)
CRYPT = re.compile(r"^\$\d\w*\$")
UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
NUMBER = re.compile(r"[\d.,]+")
WORDS = re.compile(r"[A-Z]?[a-zß-ÿ]+|[A-Z]+(?![a-z])|\d+")
#: Words beside a value that say it is none: hashes, public halves, identifiers, settings about secrets.
OTHERWISE = frozenset(
    "hash digest checksum sha sha1 sha256 sha512 md5 etag integrity public pub cache partition primary idempotency foreign sort fingerprint type count length len size min max name label id uuid url uri path file commit version expires ttl limit field header prompt title placeholder signature sig cert certificate hint policy author authors".split()
)
PASSWORD_WORDS = frozenset("password passwd passwort kennwort pass pwd pw passphrase contraseña clave mdp motdepasse".split())
TELLING_WORDS = PASSWORD_WORDS | frozenset("secret token key apikey auth authtoken credential credentials access bearer basic private signing geheimnis schlüssel secreto jeton".split())


class Candidate(NamedTuple):
    start: int
    end: int
    place: str
    name: str
    parts: tuple[tuple[int, int], ...]  # what redaction replaces


def split_words(name: str) -> list[str]:
    return [w.lower() for w in WORDS.findall(name)]


def base_of_line(text: str, at: int) -> int:
    return text.rfind("\n", 0, at) + 1


def armours(text: str) -> Iterator[tuple[int, int, str, tuple[tuple[int, int], ...]]]:
    """(start, end, kind, places of base64) of every armoured block, closed or not."""
    done = 0
    for m in BEGIN.finditer(text):
        if m.start() < done:
            continue
        at = m.end()
        parts: list[tuple[int, int]] = []
        gap = re.compile(r"[ \t\"'+,;\\]*?" + _BREAK).match(text, at)
        end = at
        if gap:
            at = gap.end()
            while at < len(text) and not END.match(text, at) and (line := BODY.match(text, at) or SHORT.match(text, at)) and line.end() > at:
                if line.groupdict().get("data"):
                    parts.append(line.span("data"))
                    end = line.end("data")
                at = line.end()
        elif inline := re.compile(r"\s*([A-Za-z0-9+/= ]{16,}?)\s*(?=-----END )").match(text, at):
            parts, at = [inline.span(1)], inline.end()
            end = at
        if (close := END.match(text, at)) and close[1] == m[1]:
            end = close.end()
        done = end
        yield m.start(), end, m[1], tuple(parts)


def _quoted_end(text: str, start: int, quote: str) -> int:
    """Where the quote that stands before ``start`` closes on its line; 0 where it doesn't."""
    at = start
    while at < len(text) and text[at] not in (quote, "\n"):
        at += 2 if text[at] == "\\" else 1
    return at if at < len(text) and text[at] == quote else 0


def _machine():
    import ahocorasick

    machine = ahocorasick.Automaton()
    flags: Counter = Counter()
    for n, (words, _) in enumerate(PLACES.values()):
        for w in words:
            flags[w] |= 1 << n
    for w, flag in flags.items():
        machine.add_word(w, flag)
    machine.add_word("-----begin ", 1 << len(PLACES))
    machine.make_automaton()
    return machine


_MACHINE = _machine()


def candidates(text: str) -> list[Candidate]:
    """Every candidate in order; what armour encloses holds none, a private key's armour is one."""
    flags = 0
    for _, flag in _MACHINE.iter(text.lower()):
        flags |= flag
    out: list[Candidate] = []
    begins: list[int] = []
    ends: list[int] = []
    if flags >> len(PLACES):
        for a, b, kind, parts in armours(text):
            begins.append(a)
            ends.append(b)
            if "PRIVATE KEY" in kind and parts:
                out.append(Candidate(a, b, "armour", kind, parts))
    for n, (place, (_, pattern)) in enumerate(PLACES.items()):
        if not flags >> n & 1:
            continue
        for m in pattern.finditer(text):
            start, end = m.span("v") if place != "make" else m.span()
            name = m["k"] if "k" in pattern.groupindex else ""
            if place == "assign":
                at = m.start()
                while at and (text[at - 1].isalnum() or text[at - 1] in "_.-"):
                    at -= 1
                name = text[at : m.start()] + name
            quote = text[start - 1 : start]
            if quote in ("'", '"', "`") and place not in ("make", "url", "hook", "call") and (close := _quoted_end(text, start, quote)):
                end = close  # a quoted value goes to its closing quote, blanks included
            while end > start and text[end - 1] in ".:" and text[end : end + 1] != quote:
                end -= 1
            k = bisect_right(begins, start) - 1
            if end > start and not (k >= 0 and start < ends[k]):
                out.append(Candidate(start, end, place, name, ((start, end),)))
    out.sort(key=lambda c: (c.start, -c.end))
    kept: list[Candidate] = []
    for c in out:
        if not kept or c.start >= kept[-1].end:
            kept.append(c)
        elif c.place == "make" and kept[-1].place != "armour" or c.place == "url" and kept[-1].place in ("assign", "flag"):
            kept[-1] = c  # the token or password inside a longer value
    return kept


def weak(value: str, place: str, name: str) -> bool | None:
    """The pattern label of a candidate; None where the patterns don't know."""
    words = split_words(name)
    if MAKE.fullmatch(value):
        return True
    if STAND_IN.search(value) or REFERENCE.search(value) or UUID.fullmatch(value):
        return False
    if set(words) & OTHERWISE or NUMBER.fullmatch(value) or CRYPT.search(value):
        return False
    telling = bool(set(words) & TELLING_WORDS)
    mixed = any(c.isdigit() for c in value) or (any(c.isupper() for c in value[1:]) and any(c.islower() for c in value))
    if " " in value:
        # a passphrase, a prompt or a sentence
        return True if words and words[-1] in PASSWORD_WORDS and mixed and len(value.split()) >= 3 and value[-1] not in ".!?:" else False if not telling else None
    if place in ("url", "user", "tag", "flag", "call", "glued"):
        return True if len(value) >= 6 and (mixed or re.search(r"[!_-]", value)) else False if value.isalpha() and value.islower() else None
    if place in ("assign", "spoken", "env"):
        if telling and mixed:
            return True if len(value) >= 6 else None
        return False
    return len(value) >= 12 and mixed


class Markov:
    """Character bigrams of ordinary words, add-one smoothed."""

    def __init__(self, counts: np.ndarray):
        """From what ``word_pairs`` counted."""
        pairs = {(FROM[a], TO[b]): int(n) for (a, b), n in np.ndenumerate(counts) if n}
        ones: Counter = Counter()
        for (a, _), n in pairs.items():
            ones[a] += n
        self.pairs = {p: log((n + 1) / (ones[p[0]] + 64)) for p, n in pairs.items()}
        self.floor = {a: log(1 / (n + 64)) for a, n in ones.items()}

    def per_char(self, value: str) -> float:
        total = sum(self.pairs.get((a, b), self.floor.get(a, -4.2)) for a, b in zip("^" + value, value + "$", strict=True))
        return total / (len(value) + 1)


def word_pairs(texts: Iterable[str | None]) -> np.ndarray:
    """How often one character follows another in words of two small letters or more; 0 is a word's border."""
    told = np.frombuffer(("\n" + "\n".join(t for t in texts if t) + "\n").encode("utf-8", "surrogatepass"), np.uint8)
    codes = np.where((told >= ord("a")) & (told <= ord("z")), told - 96, 0).astype(np.uint8)
    alone = (codes[1:-1] > 0) & (codes[:-2] == 0) & (codes[2:] == 0)
    codes[1:-1][alone] = 0
    counts = np.zeros(27 * 27, np.int64)
    for at in range(0, len(codes) - 1, 1 << 20):
        some = codes[at : at + (1 << 20) + 1].astype(np.uint16)
        counts += np.bincount(some[:-1] * 27 + some[1:], minlength=27 * 27)
    counts[0] = 0
    return counts.reshape(27, 27)


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values())


def last_words(text: str, at: int, count: int = NEAR) -> list[str]:
    """The last words before ``at`` on its line."""
    begin, reach = base_of_line(text, at), 64
    while True:
        low = max(begin, at - reach)
        words = split_words(text[low:at])
        if low == begin or len(words) > count:
            return words[-count:]
        reach *= 4


def outline(value: str) -> str:
    """The value with its runs of like characters shortened to their kind and, up to eight, their length."""
    return re.sub(r"[A-Z]+|[a-z]+|\d+|\s+", lambda m: ("A" if m[0][0].isupper() else "a" if m[0][0].islower() else "9" if m[0][0].isdigit() else " ") + (str(len(m[0])) if len(m[0]) < 8 else "+"), value)


def features(text: str, c: Candidate, source: str, markov: Markov) -> list[str]:
    """Names of what is seen of a candidate: its characters, the identifiers around it, the path."""
    place, value = c.place, text[c.start : c.end]
    words, near = split_words(c.name), last_words(text, c.start)
    classes = "".join(s for s, t in (("l", any(x.islower() for x in value)), ("u", any(x.isupper() for x in value)), ("d", any(x.isdigit() for x in value)), ("h", len(value) > 11 and not value.lower().strip("0123456789abcdef")), ("b", " " in value), ("s", not value.replace(" ", "").isalnum())) if t)
    chain = int(max(-6.0, markov.per_char(value)) * 2)
    long = min(len(value) // 4, 12)
    out = [f"place:{place}", f"classes:{classes}", f"len:{long}", f"chain:{chain}", f"entropy:{int(entropy(value) * 2)}", f"place+classes:{place}{classes}", f"len+classes:{long}{classes}", f"chain+classes:{chain}{classes}", f"chain+place:{chain}{place}"]
    low = value.lower()
    whole = outline(value)
    out += [f"outline:{whole}", f"kinds:{re.sub('[0-9+]', '', whole)}"]
    out += [f"3:{low[i : i + 3]}" for i in range(len(low) - 2)] if len(low) > 2 else [f"3:{low}"]
    out += [f"^:{low[:2]}", f"$:{low[-2:]}", f"first:{value[0]}", f"last:{value[-1]}", f"before:{text[c.start - 1 : c.start]}", f"after:{text[c.end : c.end + 1]}"]
    out += [f"v:{w}" for w in split_words(value)]
    out += [f"name:{w}" for w in words] + [f"near:{w}" for w in near]
    if words:
        out += [f"last:{words[-1]}", f"last+classes:{words[-1]}{classes}", f"last+outline:{words[-1]}{re.sub('[0-9+]', '', whole)[:3]}{long}"]
    path = re.search(r"\.(\w{1,10})$", source or "")
    out.append(f"path:{path[1] if path else (source or '').split('-')[0][:12]}")
    return out


def _ids(names: list[str]) -> list[int]:
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SIZE for n in names]


class Block(NamedTuple):
    """What fitting needs of many candidates."""

    ids: np.ndarray  # of all, one behind the other
    sizes: np.ndarray  # how many ids each has
    labels: np.ndarray  # ARMOUR, OPEN, the label, or HELD more than the label


def seen_in(rows: Iterable[tuple[str | None, str | None]], markov: Markov) -> pa.RecordBatch:
    """Every candidate of (text, source) rows: its row, field and line, what redaction replaces, features and label."""
    at_row, fields, lines, parts, ids, labels = [], [], [], [], [], []
    for i, row in enumerate(rows):
        for field, told in enumerate(row):
            line, at = 1, 0
            for c in candidates(told) if told else ():
                line, at = line + told.count("\n", at, c.start), c.start
                mine = array("H", () if c.place == "armour" else _ids(features(told, c, row[1] or "", markov)))
                label = ARMOUR if c.place == "armour" else weak(told[c.start : c.end], c.place, c.name)
                at_row.append(i)
                fields.append(field)
                lines.append(line)
                parts.append([x for part in c.parts for x in part])
                ids.append(np.frombuffer(mine, np.uint16))
                labels.append(OPEN if label is None else label if label == ARMOUR else label + HELD * (zlib.crc32(mine) % 5 == 0))
    ends = np.cumsum([0, *map(len, ids)])
    told_ids = pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.uint16), *ids])))
    return pa.RecordBatch.from_arrays(
        [pa.array(at_row, pa.int64()), pa.array(fields, pa.int8()), pa.array(lines, pa.int64()), pa.array(parts, pa.list_(pa.int64())), told_ids, pa.array(labels, pa.int8())],
        ["row", "field", "line", "parts", "ids", "label"],
    )


def block_of(seen: pa.RecordBatch) -> Block:
    ids = seen.column("ids")
    return Block(ids.values.to_numpy(), np.diff(ids.offsets.to_numpy()), seen.column("label").to_numpy())


def packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpacked(told: pa.BinaryScalar) -> pa.RecordBatch:
    return pa.ipc.open_stream(told.as_buffer()).read_next_batch()


def raws(block: Block, w: np.ndarray) -> np.ndarray:
    """Every candidate's sum of weights."""
    return np.bincount(np.repeat(np.arange(len(block.sizes)), block.sizes), weights=w[block.ids], minlength=len(block.sizes)) + w[SIZE]


# Sums over blocks, of which each pass over the table takes one.
def tally(blocks: Iterable[Block]) -> np.ndarray:
    """How many features stand in candidates to fit on with each feature, and with any; then how many are to fit on and how many false and true ones are held out."""
    out = np.zeros(SIZE + 4)
    for b in blocks:
        use = (b.labels == 0) | (b.labels == 1)
        sizes = np.where(use, b.sizes + 1, 0)
        out[:SIZE] += np.bincount(b.ids, weights=np.repeat(sizes, b.sizes), minlength=SIZE)
        out[SIZE:] += sizes.sum(), use.sum(), (b.labels == HELD).sum(), (b.labels == HELD + 1).sum()
    return out


def losses(blocks: Iterable[Block], w: np.ndarray) -> np.ndarray:
    """Gradient of the logistic loss over the candidates to fit on; then the loss."""
    out = np.zeros(SIZE + 2)
    for b in blocks:
        use = (b.labels == 0) | (b.labels == 1)
        x, y = raws(b, w), b.labels == 1
        gap = np.where(use, 1 / (1 + np.exp(-np.clip(x, -30, 30))) - y, 0.0)
        out[:SIZE] += np.bincount(b.ids, weights=np.repeat(gap, b.sizes), minlength=SIZE)
        out[SIZE] += gap.sum()
        out[SIZE + 1] += np.logaddexp(0, np.where(y, -x, x))[use].sum()
    return out


def calibration(blocks: Iterable[Block], w: np.ndarray, scale: float, shift: float, false: float, true: float) -> np.ndarray:
    """Loss of the candidates held out against Platt's targets, its gradient and its second derivatives."""
    out = np.zeros(6)
    for b in blocks:
        held = b.labels >= HELD
        x, t = raws(b, w)[held], np.where(b.labels[held] == HELD, false, true)
        z = scale * x + shift
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        q = p * (1 - p)
        out += [(np.logaddexp(0, z) - t * z).sum(), ((p - t) * x).sum(), (p - t).sum(), (q * x * x).sum(), (q * x).sum(), q.sum()]
    return out


class Model:
    """Logistic regression on hashed features with Platt calibration."""

    def __init__(self, markov: Markov):
        self.markov, self.w = markov, np.zeros(SIZE + 1)
        self.scale, self.shift = 1.0, 0.0

    def fit(self, total: Callable[..., np.ndarray]) -> Model:
        """``total`` gives one of the sums above over all blocks, from the arguments that follow the blocks."""
        counts = total(tally)
        self._weights(total, 1 / (counts[: SIZE + 1] / 4 + RIDGE), TOLERANCE * counts[SIZE + 1])
        if counts[SIZE + 2 :].all():
            self._calibrate(total, *counts[SIZE + 2 :])
        return self

    def _weights(self, total: Callable[..., np.ndarray], scales: np.ndarray, enough: float) -> None:
        """The least loss with a ridge, by L-BFGS on features scaled by a bound of the curvature, until a step has no more than ``enough`` to gain."""

        def value(w: np.ndarray) -> tuple[float, np.ndarray]:
            sums = total(losses, w)
            return float(sums[-1] + RIDGE / 2 * (w @ w)), sums[:-1] + RIDGE * w

        past: deque = deque(maxlen=10)
        loss, slope = value(self.w)
        while True:
            way, shares = -slope, []
            for s, y in reversed(past):
                shares.append((s @ way) / (s @ y))
                way = way - shares[-1] * y
            way = way * scales * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ (scales * past[-1][1])) if past else 1.0)
            for (s, y), share in zip(past, reversed(shares), strict=True):
                way = way + (share - (y @ way) / (s @ y)) * s
            step, down = 1.0, float(slope @ way)
            if -down <= enough:
                return
            while True:
                w = self.w + step * way
                now, then = value(w)
                if now <= loss + 1e-4 * step * down or step < 1e-6:
                    break
                step /= 2
            if now >= loss:
                return
            if (w - self.w) @ (then - slope) > 0:
                past.append((w - self.w, then - slope))
            self.w, loss, slope = w, now, then

    def _calibrate(self, total: Callable[..., np.ndarray], false: float, true: float) -> None:
        """Platt's scale and shift by Newton steps."""
        at, targets = np.array([self.scale, self.shift]), (1 / (false + 2), (true + 1) / (true + 2))
        sums = total(calibration, self.w, *at, *targets)
        while True:
            way = -np.linalg.solve([[sums[3] + 1e-9, sums[4]], [sums[4], sums[5] + 1e-9]], sums[1:3])
            step = 1.0
            while (now := total(calibration, self.w, *(at + step * way), *targets))[0] > sums[0] and step > 1e-6:
                step /= 2
            gain = sums[0] - now[0]
            if gain > 0:
                at, sums = at + step * way, now
            if gain <= 1e-3 * sums[0]:
                break
        self.scale, self.shift = max(float(at[0]), 0.05), float(at[1])

    def raw(self, ids: list[int]) -> float:
        return float(self.w[ids].sum() + self.w[SIZE])

    def score(self, ids: list[int]) -> float:
        return 1 / (1 + exp(-max(-30.0, min(30.0, self.scale * self.raw(ids) + self.shift))))

    def found(self, seen: pa.RecordBatch) -> np.ndarray:
        """Places of the candidates that are credentials."""
        block = block_of(seen)
        return np.flatnonzero((block.labels == ARMOUR) | (self.scale * raws(block, self.w) + self.shift >= 0))


def fit(rows: list[tuple[str | None, str | None]]) -> Model:
    """From rows of (text, source) at hand."""
    markov = Markov(word_pairs(text for text, _ in rows))
    block = block_of(seen_in(rows, markov))
    return Model(markov).fit(lambda f, *given: f([block], *given))


def total_of(frame: DataFrame, column: str, f: Callable[..., np.ndarray], *given: object) -> np.ndarray:
    """The sum of what ``f`` gives for a column's arrays in each task; sums of many tasks are added up by tasks first."""
    sent = frame.sparkSession.sparkContext.broadcast(given)
    schema = "part int, sums binary"

    def told(part: int, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], ["part", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = f((batch.column(0) for batch in batches), *sent.value)
        yield told(TaskContext.get().partitionId(), sums.astype(float))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["part"], r["sums"]) for batch in batches for r in batch.to_pylist())
        if rows:
            yield told(rows[0][0], sum(np.frombuffer(b) for _, b in rows))

    sums = frame.select(column).mapInArrow(run, schema)
    if (tasks := frame.rdd.getNumPartitions()) > FAN:
        sums = sums.repartition(min(isqrt(tasks), FAN), "part").mapInArrow(add, schema)
    rows = sorted((r["part"], bytes(r["sums"])) for r in sums.collect())
    sent.destroy()
    return sum((np.frombuffer(b) for _, b in rows), f((), *given).astype(float))


def _pairs(columns: Iterable[pa.Array]) -> np.ndarray:
    return sum((word_pairs(texts.to_pylist()) for texts in columns), np.zeros((27, 27), np.int64)).ravel()


def _over_seen(columns: Iterable[pa.Array], f: Callable[..., np.ndarray], *given: object) -> np.ndarray:
    return f((block_of(unpacked(told)) for column in columns for told in column), *given)


def modelled(entries: DataFrame, key: str, carried: list[str], text: str, source: str, sample_rows: int | None) -> tuple[DataFrame, Broadcast]:
    """Batches of rows (carried columns) with their candidates, packed, and the model fitted on all of them.

    Candidates are found once: fitting reads their features from the checkpoint, as often as it takes steps.
    Only a caller that names ``sample_rows`` has the model fitted on so many rows.
    """
    spark = entries.sparkSession
    if sample_rows is None:
        model = Model(Markov(total_of(entries, text, _pairs).reshape(27, 27)))
    else:
        model = fit(hash_sample(entries.where(F.col(text).isNotNull()), key, [text, source], sample_rows))
    markov = spark.sparkContext.broadcast(model.markov)
    columns = list(dict.fromkeys([*carried, text, source]))
    at, more, width = columns.index(text), columns.index(source), len(carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = seen_in(zip(batch.column(at).to_pylist(), batch.column(more).to_pylist(), strict=True), markov.value)
            rows = pa.RecordBatch.from_arrays(batch.columns[:width], schema=pa.schema(list(batch.schema)[:width]))
            yield pa.RecordBatch.from_arrays([pa.array([packed(rows)], pa.binary()), pa.array([packed(seen)], pa.binary())], ["rows", "seen"])

    seen = spread(entries.select(*columns)).mapInArrow(run, "rows binary, seen binary")
    if sample_rows is None:
        seen = cut(seen)
        model.fit(lambda f, *given: total_of(seen, "seen", _over_seen, f, *given))
    return seen, spark.sparkContext.broadcast(model)


def secrets(text: str | None, source: str | None, model: Model) -> list[Candidate]:
    """Every credential."""
    if not text:
        return []
    return [c for c in candidates(text) if c.place == "armour" or model.score(_ids(features(text, c, source or "", model.markov))) >= 0.5]


def find(entries: DataFrame, key: str, text: str = "text", source: str = "source", sample_rows: int | None = None) -> DataFrame:
    """(key, field_name, line_no) of every line in which a credential starts; a line may come out twice."""
    seen, model = modelled(entries, key, [key], text, source, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told, marks in zip(batch.column(0), batch.column(1), strict=True):
                marks = unpacked(marks)
                marks = marks.select(["row", "field", "line"]).take(pa.array(model.value.found(marks)))
                names = pa.array(["text", "source"]).take(marks.column("field"))
                yield pa.RecordBatch.from_arrays([unpacked(told).column(0).take(marks.column("row")), names, marks.column("line")], ["k", "field_name", "line_no"])

    kind = entries.schema[key].dataType.simpleString()
    return seen.mapInArrow(run, f"k {kind}, field_name string, line_no bigint").withColumnRenamed("k", key)


def lines_of(text: str, found: list[Candidate]) -> list[int]:
    """Numbers of the lines in which the finds start, each once; finds are in order."""
    out: list[int] = []
    line, at = 1, 0
    for c in found:
        line, at = line + text.count("\n", at, c.start), c.start
        if not out or out[-1] != line:
            out.append(line)
    return out


def without(text: str, parts: Iterable[tuple[int, int]], mark: str) -> str:
    """The text with the mark for each part."""
    out, at = [], 0
    for a, b in parts:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def replaced(text: str | None, source: str | None, model: Model, mark: str = "REDACTED") -> str | None:
    """The text with every credential replaced; of a private key only its base64, so the block still parses as one."""
    return without(text, (part for c in secrets(text, source, model) for part in c.parts), mark) if text else text


def redact(entries: DataFrame, key: str = "entry_id", text: str = "text", source: str = "source", sample_rows: int | None = None, mark: str = "REDACTED") -> DataFrame:
    """The same rows and columns with every credential in text and source replaced."""
    seen, model = modelled(entries, key, entries.columns, text, source, sample_rows)
    places = [entries.columns.index(text), entries.columns.index(source)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told, marks in zip(batch.column(0), batch.column(1), strict=True):
                rows, marks = unpacked(told), unpacked(marks)
                marks = marks.select(["row", "field", "parts"]).take(pa.array(model.value.found(marks)))
                parts: tuple[dict[int, list[int]], ...] = {}, {}
                for i, field, some in zip(*(marks.column(c).to_pylist() for c in ("row", "field", "parts")), strict=True):
                    parts[field].setdefault(i, []).extend(some)
                columns = list(rows.columns)
                for at, cuts in zip(places, parts, strict=True):
                    texts = columns[at].to_pylist()
                    for i, some in cuts.items():
                        texts[i] = without(texts[i], batched(some, 2), mark)
                    columns[at] = pa.array(texts, columns[at].type)
                yield pa.RecordBatch.from_arrays(columns, schema=rows.schema)

    return seen.mapInArrow(run, entries.schema)
