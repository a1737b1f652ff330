"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, digits, plus signs before digits, "://" and identifier cues.
From each anchor a local parser expands to both sides and validates what it found. The base kinds email, ip, card and phone
equal their patterns read from left to right without overlap within a kind; url and account are what schemes and cues add.
Work is linear in the text and nothing is kept between texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes

#: Kinds in their order of listing.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "url", "account")
#: Cues that announce an identifier, found in lower, title and upper case.
CUES = ("account", "acct", "iban", "ssn", "passport", "konto", "kontonummer", "cuenta", "compte", "token", "secret", "password", "passwd", "api_key", "api-key", "apikey")
SCHEMES = frozenset("http https ftp ftps sftp ssh ws wss ldap smb git".split())

_DIGITS = frozenset("0123456789")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.-]*$")
_AUTHORITY = re.compile(r"[^\s\"'<>|{}\\^`]+")
_SAYS = re.compile(r"(?:[\x20_-]?(?:no|nr|number|id))?\.?[\x20\t]?(?:[:=#]|is)[\x20\t]?[\"']?", re.I)
_RUN = re.compile(r"[A-Za-z0-9][A-Za-z0-9-]*(?:\x20(?=[0-9]{2})[A-Za-z0-9-]*)*", re.I)
_AUTOMATON = None


def _automaton():
    global _AUTOMATON
    if _AUTOMATON is None:
        import ahocorasick

        a = ahocorasick.Automaton()
        for d in _DIGITS:
            a.add_word(d, "digit")
            a.add_word(f"+{d}", "plus")
        a.add_word("@", "at")
        a.add_word("://", "scheme")
        for cue in CUES:
            for form in {cue, cue.title(), cue.upper(), cue.capitalize()}:
                a.add_word(form, "cue")
        a.make_automaton()
        _AUTOMATON = a
    return _AUTOMATON


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def find_spans(text: str | None) -> list[tuple[int, int, int]]:
    """(start, index of its kind in KINDS, end) of all spans in order; code points, end exclusive."""
    if not text:
        return []
    out: list[tuple[int, int, int]] = []
    done = [0] * len(KINDS)  # where each kind's last match ends, kept or dropped
    digit, poor = -2, 0
    for i, anchor in _automaton().iter(text):
        if anchor == "digit":
            run, digit = digit == i - 1, i
            if run:  # a later digit of a run matches only where its first one does
                continue
            if i >= done[1] and (m := _IP.match(text, i)):
                done[1] = m.end()
                if all(map(_byte, m[0].split("."))):
                    out.append((i, 1, m.end()))
            if i >= done[2] and (m := _CARD.match(text, i)):
                done[2] = m.end()
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    out.append((i, 2, m.end()))
        elif anchor == "at":
            if m := _DOMAIN.match(text, i + 1):
                start = i
                while start > done[0] and text[start - 1] in _LOCAL:
                    start -= 1
                if start < i:
                    done[0] = m.end()
                    out.append((start, 0, m.end()))
        elif anchor == "plus":
            if i > done[3] and (m := _PHONE.match(text, i - 1)):
                done[3] = m.end()
                if 9 <= sum(map(m[0].count, _DIGITS)) <= 15:
                    out.append((i - 1, 3, m.end()))
        elif anchor == "scheme":
            low = max(done[4], i - 8)
            if (s := _SCHEME.search(text[low : i - 2])) and s[0].lower() in SCHEMES and (m := _AUTHORITY.match(text, i + 1)):
                address = m[0].rstrip(".,;:!?)]*&%$#")
                host = re.split(r"[/?#]", address, maxsplit=1)[0].rpartition("@")[2].partition(":")[0]
                if "." in host.strip("."):
                    done[4] = i + 1 + len(address)
                    out.append((low + s.start(), 4, done[4]))
        elif i + 1 > done[5]:
            # A value begun inside one with too few digits is its tail and has no more: so each run is read once.
            if (says := _SAYS.match(text, i + 1)) and says.end() >= poor and (m := _RUN.match(text, says.end())):
                value = m[0].rstrip("-")
                if len(value) >= 6 and sum(map(value.count, _DIGITS)) >= 4:
                    done[5] = m.start() + len(value)
                    out.append((m.start(), 5, done[5]))
                else:
                    poor = m.start() + len(value)
    out.sort()
    return out


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end in order of start, then kind) for each row of docs.

    Null and empty texts have no spans; very long ones are searched whole, in one pass; a null doc_id stays null; repeated rows
    are repeated; no rows: no rows; other columns don't matter, whatever their names.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches):
            spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_spans(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(scan, f"doc_id {kind}, spans array<struct<kind:string,start:int,end:int>>")


def redacted(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; spans that overlap are replaced together, by the first's kind."""
    if not text:
        return text
    out, at, until = [], 0, 0
    for start, kind, end in find_spans(text):
        if start >= until:
            out += (text[at:start], f"<{KINDS[kind].upper()}>")
        at = until = max(until, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text replaced; all other columns, whatever their names, and rows as they are.

    Null and empty texts stay null and empty; very long ones are redacted whole; repeated rows change alike; no rows: no rows."""

    docs_text = docs.columns.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, docs_text):
            n = b.schema.get_field_index("text")
            yield b.set_column(n, b.schema.field(n), pa.array(map(redacted, b.column(n).to_pylist()), b.schema.field(n).type))

    return docs.mapInArrow(scan, docs.schema)
