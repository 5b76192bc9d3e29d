"""Personal data by weak supervision.

Four fixed patterns (e-mail, IP address, payment card, phone) give the base spans, which always stay.
Looser candidate patterns give further spans.  On both five labelers vote yes, no or nothing: the strict
form of the pattern, a gazetteer, cue words before the span, the mix of characters, and repetition.
The vote patterns are counted over all documents; expectation-maximisation on these counts estimates how
reliable each labeler is (:func:`reliabilities`), and a logistic classifier is trained on its posteriors.
Its decision per vote pattern is applied to the candidates.  Both are fitted on a table of counts whose size
the labelers bound (kinds x 3^5 x 4), not the data.  Cue words are whole words among the last CUE_WORDS
before the span.

Defined results: a null or empty text has no spans; spans are code points, end exclusive; a candidate that
touches a base span, or an earlier candidate, is dropped; repeated rows are treated one by one; other
columns are ignored (kept by :func:`redact`); an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored, table

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "key", "secret", "ssn", "number", "name", "address")

_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match begins with a run of digits and takes whole runs, so other starts need no try
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A local part is looked for in so many characters before the @ at first, and in more while it fills them.
_LOOK = 64


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if k % 2:
            n = n * 2 - 9 if n > 4 else n * 2
        total += n
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """What ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`` finds, looked for around each @ only."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        look = _LOOK
        while True:
            low = max(done, at - look)
            m = _LOCAL_TAIL.search(text[low:at]) if low < at else None
            if not m or m.start() or low == done:
                break
            look *= 4
        if m and (d := _DOMAIN.match(text, at)):
            out.append((low + m.start(), d.end()))
            done = d.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


#: Gazetteers (fixed values).
HONORIFICS = ("Mr", "Mrs", "Ms", "Dr", "Prof")
FIRST_NAMES = frozenset(
    "James Mary John Patricia Robert Jennifer Michael Linda William Elizabeth David Barbara Richard Susan Joseph Jessica Thomas Sarah Charles Karen "
    "Daniel Nancy Matthew Lisa Anthony Margaret Mark Betty Paul Sandra Steven Ashley Andrew Emily George Donna Edward Carol Brian Ruth Kevin Sharon "
    "Anna Maria Peter Marie Jean Pierre Michel Philippe Sophie Isabelle Claire Julien Hans Klaus Jürgen Wolfgang Heike Petra Sabine Ursula Stefan Anja "
    "Carlos Juan Luis Carmen José Antonio Manuel Francisco Javier Miguel Ana Isabel Pilar Laura Marta Lucia Pablo Diego Elena Rosa".split()
)
STREETS = ("Street", "St", "Avenue", "Ave", "Road", "Rd", "Lane", "Boulevard", "Drive")
KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "sk-", "xoxb-", "AIza")
SECRET_WORDS = ("password", "passwd", "pwd", "secret", "token", "api_key", "apikey")
PLACEHOLDERS = frozenset("password passwd secret token none null true false required optional changeme example string value hidden redacted".split())
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name io dev app co ai me tv eu us uk de fr es it nl be at ch pl se no dk fi pt ie cz ru ua cn jp kr in br mx ar au nz ca za".split())
CALLING_CODES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "94", "98")
#: First digits of card numbers: Visa, American Express, Mastercard, Discover, JCB, UnionPay.
ISSUERS = ("4", "34", "37", "51", "52", "53", "54", "55", "22", "23", "24", "25", "26", "27", "6011", "64", "65", "35", "62")
CUES = frozenset("password passwd pwd key apikey token secret credential credentials login call tel telephone phone fax mobile ssn social security contact name address lives dear email mail mailto write ip server host card visa mastercard credit payment reach".split())
COUNTER_CUES = frozenset("version v release isbn issn page figure table section order item chapter sku build part".split())
#: Words before a span that are looked at for cues.
CUE_WORDS = 6

_KEY = re.compile(r"(?:AKIA|ASIA|ghp_|gho_|sk-|xoxb-|AIza)[A-Za-z0-9_-]{12,}")
_ASSIGNED = re.compile(r"[=:]\x20?([^\s\"',;]{4,})")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NUMBER = re.compile(r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?")
_ADDRESS = re.compile(r"(?<![0-9])[0-9]{1,5}\x20[A-Z][a-z]+(?:\x20[A-Z][a-z]+)?\x20(?:Street|St|Avenue|Ave|Road|Rd|Lane|Boulevard|Drive)\b")


def candidates(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of the looser patterns, by start, none touching another or one of ``taken``."""
    found = []
    if any(s in text for s in KEY_STARTS):
        found += [("key", m.start(), m.end()) for m in _KEY.finditer(text)]
    if "=" in text or ":" in text:
        found += [("secret", m.start(1), m.end(1)) for m in _ASSIGNED.finditer(text) if text[max(0, m.start() - 10) : m.start()].lower().endswith(SECRET_WORDS)]
    if "-" in text:
        found += [("ssn", m.start(), m.end()) for m in _SSN.finditer(text)]
    found += [("number", m.start(), m.end()) for m in _NUMBER.finditer(text)]
    if any(h in text for h in HONORIFICS):
        found += [("name", m.start(), m.end()) for m in _NAME.finditer(text)]
    if any(s in text for s in STREETS):
        found += [("address", m.start(), m.end()) for m in _ADDRESS.finditer(text)]
    if not found:
        return []
    blocks, out, end = sorted((a, b) for _, a, b in taken), [], 0
    for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2], x[0])):
        if a >= end and not any(a < y and x < b for x, y in blocks):
            out.append((kind, a, b))
            end = b
    return out


LABELERS = 5


_WORD = re.compile(r"[a-z]+")
#: No more characters than this hold the words looked at for cues.
_CUE_LOOK = 16 * CUE_WORDS


def _cue(text: str, a: int) -> int:
    """The vote of the words before position ``a``."""
    low = max(0, a - _CUE_LOOK)
    before = text[low:a].lower()
    if low and before[:1].isalpha():  # the first word may be cut
        before = before.lstrip("abcdefghijklmnopqrstuvwxyz")
    words = _WORD.findall(before)[-CUE_WORDS:]
    return 0 if any(w in COUNTER_CUES for w in words) else 1 if any(w in CUES for w in words) else 2


_STRICT = {
    "email": re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9_%+-]|\.(?!\.)){0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z]{2,24}"),
    "ip": re.compile(r"(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])(?:\.(?:0|[1-9][0-9]{0,2})){3}"),
    "key": re.compile(r"(?:AKIA|ASIA)[0-9A-Z]{16}|gh[po]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xoxb-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}"),
    "ssn": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}"),
    "number": re.compile(r"\(?[2-9].*"),
    "name": re.compile(r"\S+ \S+ \S+"),
    "address": re.compile(r"[1-9][0-9]{0,4} .* (?:Street|Avenue|Road|Lane|Boulevard|Drive)"),
}


def votes(text: str, kind: str, a: int, b: int) -> tuple[int, ...]:
    """1 yes, 0 no, 2 nothing, of each labeler: strict form, gazetteer, cues, mix of characters, repetition."""
    span = text[a:b]
    digits = [c for c in span if "0" <= c <= "9"]
    if kind in _STRICT:
        strict = int(bool(_STRICT[kind].fullmatch(span)))
    elif kind == "card":
        strict = int(len(digits) == 16)
    elif kind == "phone":
        strict = int(9 <= len(digits) <= 13)
    else:
        strict = int(len(span) >= 6)
    gazetteer = 2
    if kind == "email":
        gazetteer = 1 if span.rpartition(".")[2].lower() in TOP_DOMAINS else 2
    elif kind == "card":
        gazetteer = int("".join(digits).startswith(ISSUERS))
    elif kind == "phone":
        gazetteer = 1 if "".join(digits).startswith(CALLING_CODES) else 2
    elif kind == "name":
        gazetteer = 1 if any(w in FIRST_NAMES for w in span.split()) else 2
    elif kind == "secret":
        gazetteer = 0 if span.strip("<>[](){}*.").lower() in PLACEHOLDERS else 2
    classes = sum((bool(digits), any(c.islower() for c in span), any(c.isupper() for c in span)))
    mix = int(classes >= 2) if kind in ("key", "secret") else 2
    varied = len(set(digits or span))
    repetition = 0 if varied <= 2 else 1 if varied >= 5 else 2
    return strict, gazetteer, _cue(text, a), mix, repetition


def key_of(kind: str, v: tuple[int, ...], length: int) -> int:
    """Kind, votes and length class of a candidate as one number."""
    k = KINDS.index(kind)
    for x in v:
        k = k * 3 + x
    return k * 4 + min(3, length // 12)


def key_parts(key: int) -> tuple[int, list[int], int]:
    key, size = divmod(key, 4)
    v = []
    for _ in range(LABELERS):
        key, x = divmod(key, 3)
        v.append(x)
    return key, v[::-1], size


#: So many votes the belief before any data counts.
BELIEF = 10.0


def em(counts: dict[int, int], rounds: int = 50) -> tuple[dict[int, float], np.ndarray, float]:
    """Posterior of each key, (labeler, truth) -> rate of yes votes among its votes, and the prior."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], dtype=float)
    v = np.array([key_parts(k)[1] for k in keys]).reshape(len(keys), LABELERS)
    yes, no = v == 1, v == 0
    rate, prior = np.tile([0.2, 0.8], (LABELERS, 1)), 0.5
    post = np.full(len(keys), 0.5)
    for _ in range(rounds):
        log = [math.log(1 - prior) + yes @ np.log(rate[:, 0]) + no @ np.log(1 - rate[:, 0]), math.log(prior) + yes @ np.log(rate[:, 1]) + no @ np.log(1 - rate[:, 1])]
        post = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        for t, w in ((0, n * (1 - post)), (1, n * post)):
            # a weak belief that labelers are right keeps rare votes from being turned round
            rate[:, t] = (w @ yes + BELIEF * (0.2, 0.8)[t]) / (w @ (yes | no) + BELIEF)
        prior = min(0.99, max(0.01, (n @ post + 1) / (n.sum() + 2)))
    return dict(zip(keys, post.tolist(), strict=True)), rate, prior


def train(counts: dict[int, int], rounds: int = 300) -> dict[int, bool]:
    """Decision of the final classifier for each key: logistic regression on kind, votes and length, fitted to the posteriors."""
    if not counts:
        return {}
    post, _, _ = em(counts)
    keys = sorted(counts)
    x = np.zeros((len(keys), 1 + len(KINDS) + 2 * LABELERS + 4))
    for r, k in enumerate(keys):
        kind, v, size = key_parts(k)
        x[r, 0] = x[r, 1 + kind] = x[r, -4 + size] = 1
        for j, vote in enumerate(v):
            if vote < 2:
                x[r, 1 + len(KINDS) + 2 * j + vote] = 1
    n = np.log1p(np.array([counts[k] for k in keys], dtype=float))  # a pattern counts by its order of magnitude, so that rare kinds are learnt too
    n, y, w = n / n.sum(), np.array([post[k] for k in keys]), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        w -= 2.0 * (x.T @ (n * (p - y)) + 1e-4 * w)
    return {k: bool(z > 0) for k, z in zip(keys, x @ w, strict=True)}


def _text_column(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def reliabilities(counts: dict[int, int]) -> dict[str, tuple[float, float]]:
    """For each labeler the estimated share of yes votes on spans that are none, and on true ones."""
    _, rate, _ = em(counts)
    return dict(zip(("strict", "gazetteer", "cues", "mix", "repetition"), map(tuple, rate.tolist()), strict=True))


FOUND_SCHEMA = "doc_id long, base array<struct<kind: int, start: long, end: long, key: int>>, candidates array<struct<kind: int, start: long, end: long, key: int>>"


def find(docs: DataFrame) -> DataFrame:
    """Base spans and candidates with their vote patterns, without the texts."""

    def run(batches):
        import pyarrow as pa

        spans = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.int32())]))
        voted = lambda text, found: [{"kind": KINDS.index(k), "start": s, "end": e, "key": key_of(k, votes(text, k, s, e), e - s)} for k, s, e in found]
        for batch in batches:
            base, more = [], []
            for text in batch.column(1).to_pylist():
                b = base_spans(text or "")
                base.append(voted(text, b))
                more.append(voted(text, candidates(text or "", b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, spans), pa.array(more, spans)], ["doc_id", "base", "candidates"])

    return _text_column(docs).mapInArrow(run, FOUND_SCHEMA)


def pattern_counts(found: DataFrame) -> dict[int, int]:
    """How often each vote pattern stands, base spans included; bounded by the number of patterns."""
    rows = found.select(F.explode(F.concat("base.key", "candidates.key")).alias("key")).groupBy("key").count().collect()
    return {r["key"]: r["count"] for r in rows}


def decide(found: DataFrame) -> dict[int, bool]:
    """The classifier's decision per vote pattern, from counts over all spans."""
    return train(pattern_counts(found))


def pii(docs: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans of each document."""
    found = stored(find(docs), "pii")
    good = [k for k, yes in decide(found).items() if yes]

    def text(spans, names):
        kinds = F.array(*[F.lit(n) for n in names])
        return F.array_join(F.transform(F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))), lambda x: F.concat_ws(":", F.get(kinds, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")

    kept = F.filter("candidates", lambda x: x["key"].isin(good)) if good else F.filter("candidates", lambda x: F.lit(False))
    every = F.concat("base", kept)
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(text(F.col("base"), BASE_KINDS), 256).alias("base_sha256"), text(every, KINDS).alias("spans"), F.size(every).cast("long").alias("n_spans"))


def _of_kind(k: int):
    return lambda x: x["kind"] == k


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every found span replaced by its kind in brackets; n_chars follows the text, all columns stay."""
    counted = stored(find(docs).select("base", "candidates"), "pii-votes")
    good = {k for k, yes in decide(counted).items() if yes}
    discard(counted)
    place, schema = docs.columns.index("text"), docs.schema

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = []
            for text in batch.column(place).to_pylist():
                if text:
                    spans = base_spans(text)
                    spans += [s for s in candidates(text, spans) if key_of(s[0], votes(text, *s), s[2] - s[1]) in good]
                    parts, at = [], 0
                    for kind, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
                        if a >= at:
                            parts += [text[at:a], f"[{kind.upper()}]"]
                            at = b
                        elif b > at:
                            at = b  # base spans of two kinds may overlap
                    text = "".join(parts) + text[at:] if parts else text
                texts.append(text)
            columns = [pa.array(texts, pa.string()) if k == place else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op6_pii(spark, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


QUERIES = {"op6_pii": op6_pii}
ORACLE_SQL: dict[str, str] = {}
