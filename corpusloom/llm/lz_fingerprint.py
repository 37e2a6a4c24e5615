"""Lempel-Ziv phrase fingerprints.

A text is parsed into the phrases of a growing dictionary (LZ78): the longest known phrase and one more symbol
make a new phrase. Symbols are words (runs without white space, cut into parts of at most 16 characters), so
that phrases of unlike texts seldom agree by chance. The set of phrase hashes is reduced to a signature of 128
bins: a hash chooses its bin, and each bin keeps the least of its hashes, 16 bits of it. The likeness of two signatures, the
share of equal bins among those that either fills, estimates the overlap of the phrase sets, and so how
much of one text's dictionary serves the other.

Defined results: a null text counts as empty; an empty text's signature is all `f`, two such are alike (1) and
one is unlike (0) any text with words. Repeated rows each give a row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, map_batches

BINS = 128
PART = 16
MASK = (1 << 64) - 1
#: Odd multiplier of the rolling phrase hash.
FACTOR = 0x9E3779B97F4A7C15
EMPTY = 0xFFFF

_hashes = Memo(xxhash.xxh64_intdigest)


def word_symbols(text: str) -> list[str]:
    words = text.split()
    if max(map(len, words), default=0) > PART:
        words = [w[i : i + PART] for w in words for i in range(0, len(w), PART)]
    return words


def parse(hashes: Iterable[int], phrases: set[int], at: int = 0) -> int:
    """Adds the phrases of the symbols; at: the phrase that was open. Returns the one that stays open, or 0."""
    add = phrases.add
    for h in hashes:
        at = (at * FACTOR + h) & MASK
        if at not in phrases:
            add(at)
            at = 0
    return at


def signature(phrases: set[int]) -> np.ndarray:
    out = np.full(BINS, EMPTY, np.uint16)
    if phrases:
        h = np.fromiter(phrases, np.uint64, len(phrases))
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(33)
        h.sort()  # the highest bits choose the bin, so each bin's least comes first
        bins, first = np.unique((h >> np.uint64(57)).astype(np.int64), return_index=True)
        out[bins] = np.minimum((h[first] >> np.uint64(20)) & np.uint64(0xFFFF), EMPTY - 1).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    filled = (a != EMPTY) | (b != EMPTY)
    n = int(filled.sum())
    return 1.0 if not n else int(((a == b) & filled).sum()) / n


def to_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(bytes.fromhex(text), ">u2").astype(np.uint16)


def fingerprint(text: str | None) -> np.ndarray:
    phrases: set[int] = set()
    parse(map(_hashes.__getitem__, word_symbols(text or "")), phrases)
    return signature(phrases)


def fingerprint_edit(text: str, edited: str) -> tuple[np.ndarray, np.ndarray]:
    """Both fingerprints; what the texts' symbols begin with alike is parsed once."""
    a, b = (list(map(_hashes.__getitem__, word_symbols(t))) for t in (text, edited))
    low, high = 0, min(len(a), len(b))
    while low < high:  # lists compare fast: the length of what they have in common, by bisection
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    phrases: set[int] = set()
    at = parse(a[:low], phrases)
    other = set(phrases)
    parse(a[low:], phrases, at)
    parse(b[low:], other, at)
    return signature(phrases), signature(other)


def lz_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id and fingerprint (512 hexadecimal digits)."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            yield {"doc_id": b.column(0), "fingerprint": [to_text(fingerprint(t)) for t in b.column(1).to_pylist()]}

    return map_batches(df, run, "doc_id bigint, fingerprint string")


#: Ranges of ids, at most: bounds and quantiles are held by the driver and by each task.
RANGES = 4096


def edit_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_range: int = 4096) -> DataFrame:
    """Each text beside its edit, in which the next document (by id) gives the second half, and beside that document.

    The documents are dealt into ranges of ids of about ``per_range`` documents, or, if there are many documents, into ``RANGES``
    larger ones; a range is streamed in order, so its size is no matter of memory. The bounds come from quantiles
    of the ids alone, so a range's size doesn't depend on how the ids are spread, and only the bounds (at most
    ``RANGES``, whatever the input) reach the driver. The first document of each range goes to the range before as well. A null id
    comes first. Of equal ids the order is that of the texts.
    """
    rows = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    ).withColumn("key", F.coalesce("doc_id", F.lit(-(2**63))))
    keys = df.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(-(2**63))).alias("key"))
    ranges = min(RANGES, max(1, keys.count() // per_range))
    cuts: list[int] = []
    if ranges > 1:
        shares = [i / ranges for i in range(1, ranges)]
        quantiles = keys.agg(F.percentile_approx("key", shares, 20 * RANGES).alias("q")).first().q
        cuts = sorted(set(quantiles))
    bounds = np.array(cuts, np.int64)
    deal = F.pandas_udf(lambda s: pd_series(np.searchsorted(bounds, s.to_numpy(), "right")), "int")
    least = {r["range"]: r.key for r in keys.select(deal("key").alias("range"), "key").groupBy("range").agg(F.min("key").alias("key")).collect()}
    order = sorted(least)
    # the document with this key is the next one of the last in that range
    before = {least[b]: order[i - 1] for i, b in enumerate(order)}
    firsts = np.array(sorted(before), np.int64)
    target = np.array([before[k] for k in firsts.tolist()], np.int64)

    def lend(s):
        k = s.to_numpy()
        at = np.minimum(np.searchsorted(firsts, k), max(0, len(firsts) - 1))
        hit = firsts[at] == k if len(firsts) else np.zeros(len(k), bool)
        return pd_series(np.where(hit, target[at], -1) if len(firsts) else np.full(len(k), -1))

    dealt = rows.select("doc_id", "text", "key", deal("key").alias("own"), F.pandas_udf(lend, "int")("key").alias("lent"))
    copies = F.when(F.col("lent") < 0, F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("own").alias("range"), F.lit(0).alias("guest")), F.struct(F.col("lent").alias("range"), F.lit(1).alias("guest")))
    )
    dealt = dealt.select("doc_id", "text", "key", F.explode(copies).alias("c")).select("c.range", "c.guest", "key", "doc_id", "text")
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("range")).sortWithinPartitions("range", "guest", "key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at = held = waiting = None  # range; the last document, which waits for the next; its row, for the next's signature
        for b in batches:
            out: list[list] = [[] for _ in EDIT]
            for here, guest, doc, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if here != at:
                    at, held, waiting = here, None, None
                if held is not None:
                    row, own = compare(*held, text)
                    if waiting is not None:
                        append(out, *waiting, own)
                    waiting = (row, own)
                    if guest:
                        append(out, row, own, fingerprint(text))
                        waiting = None
                held = None if guest else (doc, text)
            yield dict(zip(EDIT, out, strict=True))

    schema = (
        "doc_id bigint, n_chars bigint, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return map_batches(dealt, run, schema)


EDIT = ("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def compare(doc: int | None, text: str, following: str) -> tuple[tuple, np.ndarray]:
    """What is known of a document before the next one's signature is, and its own signature."""
    n = len(text)
    half = n // 2
    edited = text[: n - half] + following[:half]
    own, other = fingerprint_edit(text, edited)
    return (doc, n, edited, to_text(own), to_text(other), likeness(own, other)), own


def append(out: list[list], row: tuple, own: np.ndarray, following: np.ndarray) -> None:
    for column, value in zip(out, (*row, likeness(own, following)), strict=True):
        column.append(value)


def pd_series(values: np.ndarray):
    import pandas as pd

    return pd.Series(values.astype(np.int32))

