"""Personal data by weak supervision.

Base patterns find emails, IP addresses, card and phone numbers; those spans always
count. Wider patterns propose further spans: addresses that are spelled out, numbers in other
forms, and secrets (long values of letters and digits, as keys and tokens are). Labelers
vote on every span, base or proposed: the base pattern, a checksum or
range, a gazetteer (``Gazetteer``: top-level domains, card issuers, calling codes, names
of keys), the words before it, and how it stands in the text. Spark counts the votes over all documents, by kind
and vote pattern with the span's form and context; expectation-maximisation on these counts
estimates how reliable each labeler is and how likely each pattern is a hit. A logistic
regression on the same counts, weighted by those likelihoods, is the final span
classifier. It sees, besides the votes, the length of the span and the word before it (by
hash), which no labeler votes on. Proposed spans that it accepts join the base spans.

There are at most PATTERNS (kind, votes, form, context) rows, whatever the input: only they
reach the driver. Texts are read once; the spans of a document stay on one row.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stage, python_tasks

KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = 4  # kinds with a base pattern; spans of the others are only proposed
# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# What else may be one. An address that is spelled out says "dot" before its last part, or
# stands in brackets; up to three more parts on either side of the "at".
_AT, _DOT = r"(?: ?@ ?| ?[(\[]at[)\]] ?| at )", r"(?: ?[(\[]dot[)\]] ?| dot |\.)"
WIDE = {
    "email": re.compile(
        rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-]+(?:{_DOT}[A-Za-z0-9_%+-]+){{0,3}}{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+){{0,3}}{_DOT}[A-Za-z]{{2,24}}(?![A-Za-z0-9])", re.I),
    "ip": re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])"),
    "card": re.compile(r"(?<![0-9])(?:[0-9]{4}(?:[ .-]?[0-9]{3,4}){3,4}|3[47][0-9]{2}[ .-]?[0-9]{6}[ .-]?[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9A-Za-z.])(?:\+|00)?\(?[0-9]{2,4}\)?(?:[ ./-]{1,2}[0-9]{2,4}){2,4}(?![0-9A-Za-z])"),
    "secret": re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])"),
}
_SPELLED = re.compile(r" dot |[(\[](?:at|dot)[)\]]| @|@ ", re.I)
_DATE = re.compile(r"(?:19|20)[0-9]{2}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:19|20)[0-9]{2}")
_NAMED = re.compile(r"([A-Za-z][A-Za-z0-9_.-]*)[\"']? ?(?:=|:|=>) ?[\"']?$")


class Gazetteer(NamedTuple):
    """What the lists say; give others where a corpus needs them."""

    domains: frozenset = frozenset("com org net edu gov mil int info biz io ai app dev eu example test".split())
    # card issuers: first digits from, to (inclusive)
    issuers: tuple = (("4", "4"), ("51", "55"), ("2221", "2720"), ("34", "34"), ("37", "37"), ("36", "36"), ("38", "39"), ("300", "305"), ("3528", "3589"), ("6011", "6011"), ("644", "649"), ("65", "65"), ("62", "62"), ("50", "50"), ("56", "58"))
    # calling codes: of one digit, of two digits, first two digits of those of three
    codes: tuple = (
        frozenset("17"),
        frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()),
        frozenset("21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()),
    )
    keys: frozenset = frozenset("token secret password passwd pwd passphrase key apikey auth authorization bearer credential credentials".split())
    prefixes: tuple = ("AKIA", "AIza", "ghp_", "gho_", "sk_", "sk-", "pk_", "xox", "eyJ")
    digests: frozenset = frozenset("sha sha1 sha256 md5 crc hash commit checksum digest etag uuid guid revision integrity".split())

    def calling(self, digits: str) -> bool:
        return digits[:1] in self.codes[0] or digits[:2] in self.codes[1] or digits[:2] in self.codes[2]

    def issuer(self, digits: str) -> bool:
        return any(a <= digits[: len(a)] <= b for a, b in self.issuers)


def gazetteer(spark) -> Gazetteer:
    """The default lists, with the countries of Java's locales as top-level domains."""
    countries = {c.lower() for c in spark._jvm.java.util.Locale.getISOCountries()} | {"uk"}
    return Gazetteer(domains=Gazetteer().domains | countries)


CUES = {
    "email": set("email mail e-mail contact write correo courriel schreiben".split()),
    "ip": set("ip address host server addr login dirección adresse".split()),
    "card": set("card visa mastercard amex credit carte karte tarjeta".split()),
    "phone": set("phone tel call mobile fax telephone téléphone telefon teléfono móvil".split()),
    "secret": set("token secret password passwd key bearer auth credential login geheim passwort contraseña clave".split()),
}
AGAINST = set("version v release isbn issn order invoice ref id no article chapter section build rev page lines".split())
LABELERS = 5
FORMS = 4  # length of the span in classes
CONTEXTS = 32  # the word before the span, by hash; 0: none
PATTERNS = len(KINDS) * 3**LABELERS * FORMS * CONTEXTS
ROUNDS = 50
# IP has the same matches from the start of a run of digits only, as what follows its
# first part stands after the run; a try at each digit would be quadratic in long runs.
_IP_STARTS = re.compile(r"(?<![0-9])" + IP.pattern)
_BEFORE = re.compile(r"[^\W\d_][\w-]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    """Matches of EMAIL: at each @, from the start of the run of characters before it."""
    at, end = text.find("@"), 0
    while at >= 0:
        i = at
        while i > end and (text[i - 1] in "._%+-" or text[i - 1].isascii() and text[i - 1].isalnum()):
            i -= 1
        m = EMAIL.match(text, i) if i < at else None
        if m:
            yield m.span()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points: leftmost, non-overlapping within a kind; a match
    that fails its check is dropped without another try."""
    out = [(0, *s) for s in _emails(text)]
    for m in _IP_STARTS.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0]) if len(m[0]) <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def _value_votes(text: str, start: int, span: str, lists: Gazetteer) -> tuple[int, int, int]:
    """Votes on a secret: of its characters, of the lists, of a name that it is given to."""
    parts = [x for x in re.split(r"[/_+=-]+", span) if len(x) >= 8]
    mixed = any(not (x.isalpha() or x.isdigit()) for x in parts)
    named = _NAMED.search(text[max(0, start - 48) : start])
    names = {x for x in re.split(r"[^a-z0-9]+", named[1].lower()) if x} if named else set()
    digest = bool(names & lists.digests)
    listed = 0 if digest else 2 if names & lists.keys or span.startswith(lists.prefixes) else 1
    return (2 if mixed and len(set(span)) >= 8 else 0), listed, (0 if digest else 2 if named else 1)


def _votes(text: str, kind: int, start: int, end: int, base: bool, lists: Gazetteer = Gazetteer()) -> int:
    """The labelers' votes (0 against, 1 none, 2 for), the form and the context, as one number."""
    span, name = text[start:end], KINDS[kind]
    digits = _digits(span)
    before = [w.lower() for w in _BEFORE.findall(text[max(0, start - 40) : start])[-4:]]
    words = set(before)
    context = 2 if words & CUES[name] else 0 if words & AGAINST else 1
    if kind == 0:
        check = 2 if "@" in span and ".." not in span else 1
        listed = 2 if re.split(r"[^A-Za-z]+", span)[-1].lower() in lists.domains else 0
    elif kind == 1:
        parts = [int(p) for p in re.findall(r"[0-9]{1,9}", span)]
        check = 2 if len(parts) == 4 and max(parts) <= 255 else 0
        listed = 2 if 0 < parts[0] < 224 and parts[0] != 127 else 0
    elif kind == 2:
        check = 2 if luhn(digits) and 13 <= len(digits) <= 19 else 0
        listed = 2 if lists.issuer(digits) else 0
    elif kind == 3:
        check = 2 if 8 <= len(digits) <= 15 else 0
        listed = 1 if span[0] != "+" and not span.startswith("00") else 2 if lists.calling(digits.lstrip("0")) else 0
    else:
        check, listed, given = _value_votes(text, start, span, lists)
        context = max(context, given) if given else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    alone = (not left or left.isspace() or left in "(<\"'") and (not right or right.isspace() or right in ").,;:>\"'!?")
    stands = 2 if alone else 0 if left.isalnum() or right.isalnum() else 1
    number = kind
    for v in (2 if base else 0 if kind < BASE_KINDS else 1, check, listed, context, stands):
        number = number * 3 + v
    word = 1 + zlib.crc32(before[-1].encode()) % (CONTEXTS - 1) if before else 0
    return (number * FORMS + min(FORMS - 1, (end - start) // 8)) * CONTEXTS + word


def _possible(kind: int, span: str, lists: Gazetteer) -> bool:
    """Whether a proposal is worth a vote: no prose as an address, no date or account number
    as a phone number, no word or plain number as a secret."""
    if kind == 0:
        return "@" in span or span.rsplit(" ", 1)[-1].rsplit(".", 1)[-1].strip("()[]").lower() in lists.domains
    if kind == 3:
        groups = re.findall(r"[0-9]+", span)
        return not _DATE.search(span) and (span[0] in "+(" or span.startswith("00") or not all(len(g) == 4 for g in groups[:-1]))
    if kind == 4:
        return any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
    return True


def candidates(text: str, lists: Gazetteer = Gazetteer()) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, base, pattern) of base spans and of proposed ones that no base
    span and no earlier proposal overlaps."""
    base = base_spans(text)
    out = [(k, s, e, 1, _votes(text, k, s, e, True, lists)) for k, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    found = []
    digits = any(c in text for c in "0123456789")
    for k, name in enumerate(KINDS):
        if digits if k else _SPELLED.search(text):
            found += [(k, *m.span()) for m in WIDE[name].finditer(text) if _possible(k, m[0], lists)]
    starts = np.array([s for s, _ in taken], np.int64)
    done: list[tuple[int, int]] = []
    for k, s, e in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        i = int(np.searchsorted(starts, e))
        if i and taken[i - 1][1] > s or done and done[-1][1] > s:
            continue
        if any(b > s for _, b in taken[max(0, i - 4) : i]):
            continue
        done.append((s, e))
        out.append((k, s, e, 0, _votes(text, k, s, e, False, lists)))
    return out


_ROW = "doc_id long, spans array<struct<kind: int, start: long, stop: long, base: int, pattern: int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("base", pa.int32()), ("pattern", pa.int32())]))


def _find(lists: Gazetteer):
    def run(batches):
        names = ("kind", "start", "stop", "base", "pattern")
        for b in batches:
            spans = [[dict(zip(names, c)) for c in candidates(t or "", lists)] for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(spans, _SPAN)], names=["doc_id", "spans"])

    return run


def _unpack(pattern: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kind, votes (a column for each labeler), form and context."""
    context, x, votes = pattern % CONTEXTS, pattern // CONTEXTS, []
    form, x = x % FORMS, x // FORMS
    for _ in range(LABELERS):
        votes.append(x % 3)
        x = x // 3
    return x, np.stack(votes[::-1], 1), form, context


def learn(pattern: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each of the patterns, the classifier's probability that it is personal data."""
    if len(pattern) == 0:
        return np.zeros(0)
    kind, votes, _, _ = _unpack(pattern)
    # expectation-maximisation: per labeler the chances of each vote on hits and on others
    hit = np.array([[0.1, 0.3, 0.6]] * LABELERS)
    other = hit[:, ::-1].copy()
    prior = np.full(len(KINDS), 0.5)
    for _ in range(ROUNDS):
        lh = np.log(prior[kind]) + sum(np.log(hit[j][votes[:, j]]) for j in range(LABELERS))
        lo = np.log(1 - prior[kind]) + sum(np.log(other[j][votes[:, j]]) for j in range(LABELERS))
        p = 1 / (1 + np.exp(np.clip(lo - lh, -50, 50)))
        a, b = p * count, (1 - p) * count
        # votes of the first guess count as pseudo-counts, so that no chance becomes zero
        for j in range(LABELERS):
            h, o = (np.array([w[votes[:, j] == v].sum() for v in range(3)]) for w in (a, b))
            hit[j], other[j] = (h + [1, 3, 6]) / (h.sum() + 10), (o + [6, 3, 1]) / (o.sum() + 10)
        for k in range(len(KINDS)):
            prior[k] = (a[kind == k].sum() + 1) / (count[kind == k].sum() + 2)

    # the final classifier: logistic regression on the votes, kind, form and context, by Newton's method
    k, v, f, c = _unpack(pattern)
    one_of = lambda x, n: (x[:, None] == np.arange(n)).astype(float)
    x = np.concatenate([np.ones((len(k), 1)), one_of(k, len(KINDS)), one_of(f, FORMS), one_of(c, CONTEXTS), *[(v == u).astype(float) for u in (0, 2)]], 1)
    w = np.zeros(x.shape[1])
    weight = count / count.sum() * min(count.sum(), 10_000)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (weight * q * (1 - q))[:, None]) + 0.1 * np.eye(len(w)), x.T @ (weight * (p - q)) - 0.1 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))


_OUT = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, secrets string, personal boolean"


def _report(accepted):
    """``accepted``: the patterns of proposed spans that count, sorted."""

    def run(batches):
        yes = accepted.value
        for b in batches:
            rows = []
            for doc, spans in zip(b.column("doc_id").to_pylist(), b.column("spans").to_pylist()):
                base = sorted((s["kind"], s["start"], s["stop"]) for s in spans if s["base"])
                wide = [s for s in spans if not s["base"]]
                found = np.isin([s["pattern"] for s in wide], yes) if wide else ()
                more = [(s["kind"], s["start"], s["stop"]) for s, y in zip(wide, found) if y]
                secret = [s for s in more if s[0] >= BASE_KINDS]
                more = [s for s in more if s[0] < BASE_KINDS]
                say = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(x))
                n = [sum(k == i for k, _, _ in base) for i in range(BASE_KINDS)]
                rows.append((doc, *n, hashlib.sha256(say(base).encode()).hexdigest(), say(base + more), len(more), say(secret), bool(base or more or secret)))
            cols = list(zip(*rows)) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[c.split()[0] for c in _OUT.split(", ")])

    return run


def find(docs: DataFrame, lists: Gazetteer | None = None) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; other columns are ignored): ``doc_id,
    n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, secrets, personal``.

    Spans are ``kind:start:end`` in code points, end exclusive, by kind, then start; secrets,
    for which there is no base pattern, are in a column of their own; ``personal`` says
    whether there is any span. Equal words in equal places have equal verdicts, so that repeated rows come back repeated.
    A null text counts as empty. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    python_tasks(spark)
    stage = Stage(spark, "pii")
    lists = lists or gazetteer(spark)
    found = stage.put(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_find(lists), _ROW), "spans")
    counts = found.select(F.explode("spans.pattern").alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").toArrow()
    pattern = counts.column("pattern").to_numpy().astype(np.int64)
    chance = learn(pattern, counts.column("n").to_numpy().astype(float))
    return found.mapInArrow(_report(spark.sparkContext.broadcast(pattern[chance >= 0.5])), _OUT)
