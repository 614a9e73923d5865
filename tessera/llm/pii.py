"""Personal data by anchor expansion.

One Aho-Corasick pass over each text finds the anchors: at-signs, plus signs,
digits, URL schemes and words that announce an identifier.  From each anchor a
small deterministic parser expands to the boundaries of the datum and validates
it, so text without anchors costs only the automaton.

Base kinds (leftmost, non-overlapping per kind, failing matches consumed):
``email``, ``ip``, ``card``, ``phone``.  Added kinds: ``iban`` (mod-97 valid),
``account`` (an identifier of six or more digits after an announcing word) and
``login`` (user information inside a URL).

Defined cases: a null or empty text has no spans; repeated rows are treated row
by row; an empty table gives an empty result; extra columns are not read.
Offsets are code points, the end exclusive.  Whole texts are scanned.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.textkit import bounded_batches, map_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "account", "login")
SPANS = "spans array<struct<kind:int,start:int,end:int>>"

#: Words that announce an account or identity number, in lower case.
CUES = ("account", "acct", "iban", "ssn", "passport", "social security", "konto", "compte", "cuenta", "ausweis", "pasaporte", "passeport")

_AT, _PLUS, _DIGIT, _SCHEME, _CUE = range(5)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_AFTER_CUE = re.compile(r"(?i:[ _-]?(?:number|nummer|numéro|número|nr|no|id))?\.? ?[:=#]? ?#?([A-Z]{0,3}[0-9](?:[ -]?[0-9A-Z]){5,33})(?![A-Za-z0-9])")
_LOGIN = re.compile(r"://([^\s/@\"'<>]+)@[A-Za-z0-9]")


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    found.add_word("@", (_AT, 1))
    found.add_word("+", (_PLUS, 1))
    found.add_word("://", (_SCHEME, 3))
    for digit in "0123456789":
        found.add_word(digit, (_DIGIT, 1))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (_CUE, len(form)))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _iban_valid(text: str) -> bool:
    text = text.replace(" ", "")
    return 15 <= len(text) <= 34 and int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def scan(text: str, anchors: ahocorasick.Automaton) -> list[tuple[int, int, int]]:
    """All spans (kind's number, start, end) of one text, by kind and start."""
    spans: list[tuple[int, int, int]] = []
    free_email = free_ip = free_card = free_phone = free_iban = free_account = run_end = 0
    for last, (what, size) in anchors.iter(text):
        if what == _DIGIT:
            if last < run_end:
                continue
            run_end = _DIGITS.match(text, last).end()
            if last >= free_ip and text.startswith(".", run_end) and (m := _IP.match(text, last)):
                free_ip = m.end()
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.groups()):
                    spans.append((1, last, free_ip))
            if last >= free_card and (m := _CARD.match(text, last)):
                free_card = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 16 <= len(digits) <= 19 and luhn(digits):
                    spans.append((2, last, free_card))
            start = last - 2
            if start >= free_iban and text[start:last].isalpha() and text[start:last].isascii() and not (start and text[start - 1].isalnum()):
                if (m := _IBAN.match(text, start)) and _iban_valid(m[0]):
                    free_iban = m.end()
                    spans.append((4, start, free_iban))
        elif what == _AT:
            start = last
            while start > free_email and text[start - 1] in _LOCAL:
                start -= 1
            if start < last and (m := _DOMAIN.match(text, last + 1)):
                free_email = m.end()
                spans.append((0, start, free_email))
        elif what == _PLUS:
            if last >= free_phone and (m := _PHONE.match(text, last)):
                free_phone = m.end()
                if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                    spans.append((3, last, free_phone))
        elif what == _SCHEME:
            if m := _LOGIN.match(text, last - 2):
                spans.append((6, m.start(1), m.end(1)))
        else:
            start = last - size + 1
            if last + 1 > free_account and not (start and text[start - 1].isalnum()) and (m := _AFTER_CUE.match(text, last + 1)):
                if sum(c.isdigit() for c in m[1]) >= 6:
                    free_account = m.end(1)
                    spans.append((5, m.start(1), free_account))
    spans.sort()
    return spans


def find_pii(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns and ``spans``, an array of (kind, start, end) by kind and start; kinds are numbered as in KINDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = automaton()
        kind = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            offsets, flat = [0], ([], [], [])
            for value in batch.column(len(keep)):
                for span in scan(value.as_py() or "", anchors):
                    for part, x in zip(flat, span, strict=True):
                        part.append(x)
                offsets.append(len(flat[0]))
            items = pa.StructArray.from_arrays([pa.array(p, pa.int32()) for p in flat], fields=list(kind))
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in range(len(keep))] + [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)], [*keep, "spans"])

    bounded_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return map_batches(chosen, run, f"{schema}, {SPANS}")


def spans_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def op5_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, the digest of the base spans and all spans for every document."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    count = lambda n: F.size(F.filter("spans", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *[count(n).alias(f"n_{k}") for n, k in enumerate(BASE_KINDS)],
        F.sha2(spans_text(F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )
