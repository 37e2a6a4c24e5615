"""Secret scan by multipart credential linking.

Three kinds of strong spans are always reported: ``assign`` (a key word with a value), ``access``
(access key ids) and ``hex`` (long hexadecimal runs). Weak candidates are reported only when a
complementary part stands near them: within one scope (a block between blank lines) the identifiers,
secrets and endpoints are joined on overlapping intervals, each widened by ``reach`` code points.

* ``weak_id``: a client, account, user or key id with a value;
* ``weak_secret``: a token of mixed characters, or the value of a cue such as ``pwd=``;
* ``weak_endpoint``: an address with a scheme.

An identifier is complementary to a secret; a secret to an identifier or an endpoint.

Defined results: a null or empty text has no spans; a null id is kept; repeated rows each give a row;
an empty table gives an empty one. Texts of any length are scanned whole, row by row, without a shuffle; the patterns take linear time.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "weak_endpoint")
STRONG = KINDS[:3]

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
WEAK_ID = re.compile(
    r"""\b(?:(?:client|account|access_?key|app|tenant)_?id|user(?:_?name)?|login)["']?\x20*[:=]\x20*["']?"""
    r"""([A-Za-z0-9@._-]{3,})""",
    re.A | re.I,
)
WEAK_SECRET_CUE = re.compile(
    r"""\b(?:pwd|pass|auth|bearer|credential|private_?key|signature)["']?(?:\x20*+[:=]\x20*+|\x20++)["']?([A-Za-z0-9+/_.=-]{8,})""",
    re.A | re.I,
)
WEAK_SECRET = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ENDPOINT = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\s\"'<>]{4,}", re.A)
BLANK = re.compile(r"\n[ \t\r]*\n")

#: Code points between complementary parts, at most.
REACH = 200
#: Bits a character that a weak secret without a cue has at least.
ENTROPY = 3.5


def entropy(token: str) -> float:
    n = len(token)
    return -sum(c / n * math.log2(c / n) for c in Counter(token).values()) if n else 0.0


def looks_random(token: str) -> bool:
    return (
        any(c.isdigit() for c in token)
        and any(c.isalpha() for c in token)
        and entropy(token) >= ENTROPY
    )


def strong_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text)]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return found


class Taken:
    """Spans by start, with the running maxima of their ends: has any of them a point in an interval?"""

    def __init__(self, spans: list[tuple[int, int, str]]):
        self.starts, self.ends = [], []
        for s, e, _ in sorted(spans):
            self.starts.append(s)
            self.ends.append(max(e, self.ends[-1]) if self.ends else e)

    def meets(self, low: int, high: int) -> bool:
        i = bisect.bisect_left(self.starts, high)
        return i > 0 and self.ends[i - 1] > low


def _near(spans: list[tuple[int, int, str]], others: list[tuple[int, int, str]], reach: int, blanks: list[int]) -> list:
    """Spans that have one of others within reach in their scope: an interval join by binary search."""
    taken = Taken(others)
    out = []
    for span in spans:
        at = bisect.bisect_right(blanks, span[0])
        low = max(span[0] - reach, blanks[at - 1] if at else 0)
        high = min(span[1] + reach, blanks[at] if at < len(blanks) else span[1] + reach)
        if taken.meets(low, high):
            out.append(span)
    return out


def find_secrets(text: str | None, reach: int = REACH) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, by start, then kind as listed."""
    if not text:
        return []
    base = strong_spans(text)
    endpoints = [(*m.span(), "weak_endpoint") for m in ENDPOINT.finditer(text)] if "://" in text else []
    ids = []
    if ":" in text or "=" in text:
        taken = Taken(base)
        ids = [(*m.span(), "weak_id") for m in WEAK_ID.finditer(text) if not taken.meets(*m.span())]
    weak = []
    if ids or endpoints or any(k == "access" for _, _, k in base):
        taken = Taken(base + ids + endpoints)
        cued = [(*m.span(), "weak_secret") for m in WEAK_SECRET_CUE.finditer(text) if not taken.meets(*m.span())]
        taken = Taken(base + ids + endpoints + cued)
        weak = cued + [
            (*m.span(), "weak_secret") for m in WEAK_SECRET.finditer(text) if not taken.meets(*m.span()) and looks_random(m[0])
        ]
    if ids or endpoints or weak:
        blanks = [m.start() for m in BLANK.finditer(text)]
        identifiers = [s for s in base if s[2] == "access"] + ids
        secrets = [s for s in base if s[2] != "access"] + weak
        base = base + _near(ids, secrets, reach, blanks) + _near(endpoints, secrets, reach, blanks)
        base += _near(weak, identifiers + endpoints, reach, blanks)
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(base, key=lambda s: (s[0], order[s[2]], s[1]))


SPANS = "array<struct<kind:string,start:bigint,end:bigint,match:string>>"


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH) -> DataFrame:
    """One row per row of df: the id and ``spans``, an array of (kind, start, end, match)."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            texts = b.column(1).to_pylist()
            yield {
                "doc_id": b.column(0),
                "spans": [
                    [{"kind": k, "start": s, "end": e, "match": t[s:e]} for s, e, k in find_secrets(t, reach)] for t in texts
                ],
            }

    return map_batches(df, run, f"doc_id bigint, spans {SPANS}")
