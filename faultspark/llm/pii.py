"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors in the whole text: at-signs, plus signs, digits, schemes and the words that announce an
account. From each anchor a local parser expands to the boundaries of an address and validates it; what an accepted or
rejected run has covered is not looked at again for that kind, which makes the spans leftmost and non-overlapping per kind.

Kinds email, ip, card and phone follow fixed patterns. The method adds url (scheme) and account (an announced identifier,
or an IBAN with valid check digits after its cue). Offsets are code points, ends exclusive.

Nulls and empty texts have no span. Rows are taken one by one, so ties, repeated rows and extra columns change nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from faultspark.llm.common import texts

KINDS = ("email", "ip", "card", "phone", "url", "account")
BASE = 4
# Words that announce an account number.
_CUES = "iban account acct konto kontonummer compte cuenta ssn passport".split()

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_SCHEME = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"[0-9][ ().0-9-]+(?<=[0-9])")
_REST = re.compile(r"[^\s<>\"'`{}|\\^]+")
_NUMBER = re.compile(r"(?:\s+(?:no|nr|number|num))?\.?\s{0,2}[:#=]?\s{0,2}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{2,4}){2,8}|[0-9][0-9 -]{4,30}[0-9])", re.I)


def _automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for key, kind in [("@", "at"), ("+", "plus"), ("://", "scheme")] + [(str(d), "digit") for d in range(10)]:
        a.add_word(key, (kind, len(key)))
    for cue in _CUES:
        for form in {cue, cue.upper(), cue.capitalize()}:
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban(text: str) -> bool:
    s = text.replace(" ", "").upper()
    if not 15 <= len(s) <= 34:
        return False
    rest = 0
    for c in s[4:] + s[:4]:
        rest = (rest * (10 if c.isdigit() else 100) + int(c, 36)) % 97
    return rest == 1


def spans(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)
    for last, (anchor, width) in automaton.iter(text):
        at = last - width + 1
        if anchor == "digit":
            if at >= done[1]:
                run = _DOTTED.match(text, at)
                groups = [at]
                for i in range(at, run.end()):
                    if text[i] == ".":
                        groups.append(i + 1)
                groups.append(run.end() + 1)
                for g in range(0, len(groups) - 4, 4):
                    parts = [text[groups[g + i]:groups[g + i + 1] - 1].lstrip("0") for i in range(4)]
                    if all(len(p) < 4 and int(p or "0") <= 255 for p in parts):
                        out.append((groups[g], 1, groups[g + 4] - 1))
                done[1] = run.end()
            if at >= done[2]:
                run = _DIGITS.match(text, at)
                done[2] = run.end() if run else at + 1
                if run:
                    digits = run[0].replace(" ", "").replace("-", "")
                    if 12 <= len(digits) <= 19 and luhn(digits):
                        out.append((at, 2, run.end()))
        elif anchor == "at":
            start = at
            while start > done[0] and text[start - 1] in _LOCAL:
                start -= 1
            domain = _DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                out.append((start, 0, domain.end()))
                done[0] = domain.end()
        elif anchor == "plus":
            run = _PHONE.match(text, at + 1) if at >= done[3] else None
            if run:
                done[3] = run.end()
                if 9 <= sum(c.isdigit() for c in run[0]) <= 15:
                    out.append((at, 3, run.end()))
        elif anchor == "scheme":
            start = at
            while start > done[4] and text[start - 1] in _SCHEME:
                start -= 1
            rest = _REST.match(text, last + 1)
            if rest and start < at:
                end = last + 1 + len(rest[0].rstrip(".,;:!?)]"))
                if end > last + 1:
                    out.append((start, 4, end))
                    done[4] = end
        elif at >= done[5] and not (at and text[at - 1].isalpha()):
            number = _NUMBER.match(text, last + 1)
            if number:
                value = number[1]
                if iban(value) if value[0].isalpha() else 6 <= sum(c.isdigit() for c in value) <= 20:
                    out.append((number.start(1), 5, number.end(1)))
                    done[5] = number.end(1)
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


SCHEMA = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of their spans, and all spans as kind:start:end: one narrow pass."""
    names = ["doc_id"] + [c.split()[0] for c in SCHEMA.split(", ")]

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton()
        for b in batches:
            every = [spans(t, automaton) for t in texts(b)]
            base = [[s for s in found if s[1] < BASE] for found in every]
            counts = [pa.array([sum(s[1] == k for s in found) for found in base], pa.int64()) for k in range(BASE)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *counts, pa.array([hashlib.sha256(joined(f).encode()).hexdigest() for f in base], pa.string()),
                 pa.array([joined(f) for f in every], pa.string())], names=names)

    return docs.select("doc_id", "text").mapInArrow(per_batch, f"doc_id {dict(docs.dtypes)['doc_id']}, {SCHEMA}")
