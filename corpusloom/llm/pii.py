"""Personal data by anchor expansion.

An Aho-Corasick automaton finds anchors: at-signs, plus signs, digits, schemes and identifier cues. At each
anchor a deterministic parser expands to the left and right and validates what it finds; an anchor inside
what a parser of its kind has consumed is skipped, so matches of a kind are leftmost and don't overlap.

Kinds, in the order of spans with one start: email, ip, card, phone, then iban, ssn and account (a number
after a cue) and userinfo (a name with a password in an address). The last four need their cue, a checksum
or both.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows each give a row; an
empty table gives an empty one. Whole texts are read, row by row, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows, replace_column

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account", "userinfo")

DIGITS = frozenset("0123456789")
UPPER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
ALNUM = frozenset("abcdefghijklmnopqrstuvwxyz") | UPPER | DIGITS
LOCAL = ALNUM | frozenset("._%+-")
LABEL = ALNUM | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
USER = ALNUM | frozenset("._~%!$&()*+,;=-")

#: Cues and the parser each starts.
CUES = {
    "iban": "iban",
    "ssn": "ssn",
    "social security": "ssn",
    "account": "account",
    "acct": "account",
    "passport": "account",
    "customer no": "account",
}


def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for anchor in "@+0123456789":
        found.add_word(anchor, (1, anchor))
    found.add_word("://", (3, "://"))
    for cue in CUES:
        for form in {cue, cue.upper(), cue.capitalize(), cue.title()}:
            found.add_word(form, (len(form), CUES[cue]))
    found.make_automaton()
    return found


_anchors: list[ahocorasick.Automaton] = []


def anchors() -> ahocorasick.Automaton:
    """Built once in a worker."""
    if not _anchors:
        _anchors.append(_automaton())
    return _anchors[0]


def _run(text: str, at: int, chars: frozenset) -> int:
    n = len(text)
    while at < n and text[at] in chars:
        at += 1
    return at


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def iban_valid(raw: str) -> bool:
    return int("".join(str(int(c, 36)) for c in raw[4:] + raw[:4])) % 97 == 1


def parse_email(text: str, at: int, free: int) -> tuple[int, int] | None:
    """at: the at-sign. The local part goes no further left than free."""
    start = at
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    end = _run(text, at + 1, LABEL)
    if start == at or end == at + 1:
        return None
    labels = 1
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, LABEL)
        if more == end + 1:
            break
        end, labels = more, labels + 1
    return (start, end) if labels > 1 else None


def parse_ips(text: str, at: int) -> tuple[list[tuple[int, int]], int]:
    """Of the dotted chain of numbers that begins at a digit: its groups of four, each valid; the chain's end."""
    numbers = [(at, _run(text, at, DIGITS))]
    end = numbers[0][1]
    while end < len(text) and text[end] == ".":
        more = _run(text, end + 1, DIGITS)
        if more == end + 1:
            break
        numbers.append((end + 1, more))
        end = more
    good = []
    for i in range(0, len(numbers) - 3, 4):
        parts = numbers[i : i + 4]
        # a part with a long run of digits is not converted: its value is what follows leading zeros
        if all(len(p := text[a:b].lstrip("0")) <= 3 and int(p or "0") <= 255 for a, b in parts):
            good.append((parts[0][0], parts[3][1]))
    return good, end


def parse_card(text: str, at: int) -> tuple[int, bool]:
    """End of the run of digits with single blanks or hyphens between them; is it a card number?"""
    end, n = at + 1, len(text)
    digits = 1
    while end < n:
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < n and text[end + 1] in DIGITS:
            end += 2
        else:
            break
        digits += 1
    if 16 <= digits <= 19:
        return end, luhn("".join(c for c in text[at:end] if c in DIGITS))
    return end, False


def parse_phone(text: str, at: int) -> tuple[int, bool] | None:
    """at: the plus sign."""
    if at + 1 >= len(text) or text[at + 1] not in DIGITS:
        return None
    end = _run(text, at + 2, PHONE)
    while end > at + 3 and text[end - 1] not in DIGITS:
        end -= 1
    if end <= at + 3 or text[end - 1] not in DIGITS:
        return None
    return end, 8 <= sum(c in DIGITS for c in text[at:end]) <= 15


def _after_cue(text: str, at: int) -> int:
    """Past blanks, a few words such as `number` or `no.`, and a colon."""
    for word in ("", "number", "Number", "no.", "No.", "no", "#"):
        end = at
        while end < len(text) and text[end] in " \t":
            end += 1
        if word and text.startswith(word, end):
            at = end + len(word)
            break
    while at < len(text) and text[at] in " \t:=#":
        at += 1
    return at


def parse_cue(text: str, at: int, kind: str) -> tuple[int, int] | None:
    start = _after_cue(text, at)
    if kind == "ssn":
        end = start + 11
        t = text[start:end]
        plain = len(t) == 11 and t[3] == t[6] == "-" and all(c in DIGITS for c in t[:3] + t[4:6] + t[7:])
        return (start, end) if plain and t[:3] not in ("000", "666") and _run(text, end, ALNUM) == end else None
    if kind == "iban":
        raw, end = [], start
        while end < len(text) and len(raw) < 35 and (text[end] in UPPER or text[end] in DIGITS or text[end] == " "):
            if text[end] != " ":
                raw.append(text[end])
            end += 1
            if len(raw) >= 15 and raw[0] in UPPER and raw[1] in UPPER and (end == len(text) or text[end] not in ALNUM):
                if iban_valid("".join(raw)):
                    return start, end
        return None
    end, digits = start, 0
    while end < len(text) and (text[end] in ALNUM or text[end] == "-"):
        digits += text[end] in DIGITS
        end += 1
    while end > start and text[end - 1] == "-":
        end -= 1
    return (start, end) if digits >= 6 and end - start <= 34 else None


def parse_userinfo(text: str, at: int) -> tuple[int, int] | None:
    """at: what follows the scheme."""
    name = _run(text, at, USER)
    if name == at or name >= len(text) or text[name] != ":":
        return None
    end = _run(text, name + 1, USER)
    return (at, end) if end > name + 1 and end < len(text) and text[end] == "@" else None


def find_pii(text: str | None) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind as listed."""
    if not text:
        return []
    found: list[tuple[int, int, str]] = []
    email = ip = card = 0
    for last, (length, anchor) in anchors().iter(text):
        at = last - length + 1
        if anchor in DIGITS:
            if at >= ip:
                good, ip = parse_ips(text, at)
                found += [(s, e, "ip") for s, e in good]
            if at >= card:
                end, good = parse_card(text, at)
                if good:
                    found.append((at, end, "card"))
                card = end
        elif anchor == "@":
            if span := parse_email(text, at, email):
                found.append((*span, "email"))
                email = span[1]
        elif anchor == "+":
            if (got := parse_phone(text, at)) and got[1]:
                found.append((at, got[0], "phone"))
        elif anchor == "://":
            if span := parse_userinfo(text, last + 1):
                found.append((*span, "userinfo"))
        elif span := parse_cue(text, last + 1, anchor):
            found.append((*span, anchor))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(set(found), key=lambda s: (s[0], order[s[2]], s[1]))


def redact(text: str | None, spans: list[tuple[int, int, str]]) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of spans that overlap, by the first kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    start, end, kind = spans[0]
    for s, e, k in [*spans[1:], (len(text) + 1, 0, "")]:
        if s < end:
            end = max(end, e)
            continue
        out += [text[at:start], f"<{kind}>"]
        at, (start, end, kind) = end, (s, e, k)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"


def scan_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: the id, ``spans`` (kind, start, end, match) and ``redacted``."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column(1).to_pylist()
            spans = [find_pii(t) for t in texts]
            yield {
                "doc_id": b.column(0),
                "spans": [
                    [{"kind": k, "start": s, "end": e, "match": t[s:e]} for s, e, k in x]
                    for t, x in zip(texts, spans, strict=True)
                ],
                "redacted": [redact(t, x) for t, x in zip(texts, spans, strict=True)],
            }

    return map_batches(df, run, f"doc_id bigint, spans {SPANS}, redacted string")


def redact_column(df: DataFrame, text_col: str = "text") -> DataFrame:
    """df with its text column redacted; the other columns stay, whatever their names."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return replace_column(batch, at, [redact(t, find_pii(t)) for t in batch.column(at).to_pylist()])

    return map_rows(df, run)
