"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score.

Base kinds, each leftmost and without overlaps: ``email``, ``ip`` (parts up to 255), ``card`` (13 to 19 digits that pass
Luhn), ``phone`` (``+`` and 9 to 15 digits). A base span always counts. The method adds spans of three weaker
patterns whose score reaches ``MIN_SCORE``: ``iban`` (mod 97, by itself enough), ``national_id`` and ``local_phone``
(too weak by shape, they need a context word within ``CONTEXT`` characters). Added spans never overlap a base span.

Every pattern is scanned in time linear in the text: a pattern only starts where a run of its characters starts, and an
e-mail address is grown around its ``@``. Work is row-local, nothing is shuffled, and a task holds one Arrow batch.

Defined cases: a null or empty text has no spans; positions are code points, ends exclusive; repeated rows give
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_by_value

#: Fixed kinds in the order of the result, base kinds first.
BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
MIN_SCORE = 0.6
CONTEXT = 40
#: Score of a span by its shape and checksum, and what a context word adds.
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "national_id": 0.3, "local_phone": 0.3}
BOOST = 0.4
#: Fixed context words.
WORDS = {
    "email": "mail e-mail email contact write",
    "ip": "ip address host server login",
    "card": "card credit visa mastercard payment paid",
    "phone": "phone call tel mobile fax contact whatsapp",
    "iban": "iban account bank konto compte cuenta",
    "national_id": "ssn social security tax passport identity",
    "local_phone": "phone call tel telephone mobile fax whatsapp",
}

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+(-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_ANY_WORD = re.compile(r"[A-Za-z-]+")
_WORD_SETS = {k: frozenset(v.split()) for k, v in WORDS.items()}


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        stop = at + 1
        if at >= end and (m := _DOMAIN.match(text, at)):
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, m.end()))
                end = stop = m.end()
        at = text.find("@", stop)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (n * 2 if n < 5 else n * 2 - 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    rest = 0
    for c in code[4:] + code[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, in the order of ``BASE`` and then of the text."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups()):
                out.append(("ip", m.start(), m.end()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() <= 37:
                digits = m[0].replace(" ", "").replace("-", "")
                if 13 <= len(digits) <= 19 and luhn(digits):
                    out.append(("card", m.start(), m.end()))
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _iban_end(text: str, start: int, end: int) -> int | None:
    """The longest valid account number that begins here and ends before a space or at the end of the match."""
    for stop in [end, *[i for i in range(end - 1, start + 14, -1) if text[i] == " "]]:
        code = text[start:stop].replace(" ", "")
        if len(code) >= 15 and mod97(code):
            return stop
    return None


def score(kind: str, text: str, start: int, end: int) -> float:
    """Shape score, raised when a context word of the kind stands near."""
    near = text[max(0, start - CONTEXT) : start] + " " + text[end : end + CONTEXT]
    words = {w.lower() for w in _ANY_WORD.findall(near)}
    return SCORES[kind] + (BOOST if words & _WORD_SETS[kind] else 0.0)


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans with their scores: base kinds as listed, then the added kinds; within a kind by start."""
    if not text:
        return []
    base = base_spans(text)
    out = [(k, a, b, round(min(1.0, score(k, text, a, b)), 2)) for k, a, b in base]
    if not _DIGIT.search(text):
        return out
    taken = sorted((a, b) for _, a, b in base)
    starts = [a for a, _ in taken]
    reach = list(accumulate((b for _, b in taken), max))  # the farthest end up to each start

    def free(a: int, b: int) -> bool:
        before = bisect_left(starts, b)
        return not before or reach[before - 1] <= a

    for kind, pattern in zip(ADDED, (_IBAN, _NATIONAL, _LOCAL_PHONE), strict=True):
        for m in pattern.finditer(text):
            a, b = m.start(), m.end()
            if kind == "iban":
                b = _iban_end(text, a, b) or 0
            if b and free(a, b) and (s := score(kind, text, a, b)) >= MIN_SCORE:
                out.append((kind, a, b, round(min(1.0, s), 2)))
    return out


def spans_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``spans``: an array of (kind, start, end, score) per document."""
    ship_by_value(__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            found = [
                [{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find(t.as_py())] for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=kind)], names=["doc_id", "spans"])

    narrow = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))
    id_type = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def op10_pii(docs: DataFrame) -> DataFrame:
    """Per document the counts and the digest of the base spans, and all spans as text."""
    found = spans_of(docs)
    parts = F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    n_base = F.size(F.filter("spans", lambda s: s["kind"].isin(*BASE)))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[count(k) for k in BASE],
        F.sha2(F.concat_ws(",", F.slice(parts, F.lit(1), n_base)), 256).alias("base_sha256"),
        F.concat_ws(",", parts).alias("spans"),
    )
