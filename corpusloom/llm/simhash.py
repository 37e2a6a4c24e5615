"""Near-duplicates by SimHash with deletion-variant signatures.

A fingerprint has 64 bits; two texts are linked if their fingerprints differ in at most three. A fingerprint is
cut into two segments of 32 bits: of three differing bits at most one lies in one of the segments. Each segment
is indexed 32 times, each time with another bit deleted, so that segments which differ by at most one bit share
a signature. Rows with equal signatures meet in an equality join and are verified on all 64 bits.

Equal fingerprints are merged first, so a group of copies is one row. Where rows meet, no pairs are emitted:
the rows of a signature are searched from one to the next (breadth first, taking out what is reached), and the
edges of a spanning forest of the links are returned. A signature with more than ``block`` fingerprints isn't
held by one task: its rows differ by at most one bit in that segment, so they are indexed anew by the halves of the other
one, and where that isn't enough by quarters. What then agrees leaves eleven bits free, so a group has at most 2,048 fingerprints.

Components come from alternating large-star and small-star steps, each round written to the shared folder, until nothing changes. Joins
on a node or fingerprint that many rows have broadcast the few hot keys (``common.join_unique``).

Defined results: a null text counts as empty; texts without words have fingerprint zero and are linked like any
others; of a null id the component is found, but it is never the least; repeated rows share their result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, join_unique, map_batches, materialize, may_hold

SEED = 42
#: Bits in which linked fingerprints differ, at most. The two segments serve up to three.
BITS = 3
#: Fingerprints of a signature that are compared in one task.
BLOCK = 4096


def fingerprint(text: str | None, words: int = 3) -> int:
    """Unsigned; bit i is set if it is in over half of the shingles' hashes."""
    tokens = (text or "").encode().lower().split()  # of bytes: A-Z only, and the six ASCII blanks
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, len(shingles))
    set_bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    majority = np.packbits(2 * set_bits > len(shingles), bitorder="little")
    return int(majority.view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, hashed: bool = False) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed 64-bit integer; if hashed, the text's hash h too."""
    more = [text_hash(text_col).alias("h")] if hashed else []
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            found = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64)
            yield {"doc_id": b.column(0), "fp": pa.array(found.view(np.int64))} | ({"h": b.column(2)} if hashed else {})

    return map_batches(df, run, "doc_id bigint, fp bigint" + (", h bigint" if hashed else ""))


#: Bits of the parts that are indexed at each level, and how many parts of the bits not yet agreed on there are.
LEVELS = (32, 16, 8)
#: Edges of a node (rows of 16 bytes) that are few enough for one task.
NODE_ROWS = 100_000


def signatures(fps: DataFrame, level: int = 0) -> DataFrame:
    """sig and fp: the keys under which each fingerprint is indexed at a level; rows that differ by at most BITS bits share one.

    Level 0: fps has fp. The 64 bits are two parts of 32; a key is a part without one of its bits. Further levels: fps has sig and
    fp, whose sig agrees in all but one bit of its part; the other part is cut in two, of which one differs by at most one bit.
    A key's ``path`` tells the parts chosen so far (from the highest level on, 0 for the lower one).
    """
    width = LEVELS[level]
    k = F.col("k")
    half = F.floor(k / width).cast("int")
    if level == 0:
        shift, path, before = half * width, half.cast("bigint"), F.lit(0).cast("bigint")
    else:
        # the part that is left: the sibling of the last one chosen, within the sibling of the one before, ...
        base = F.lit(0)
        for i in range(level):
            chosen = F.shiftright(F.col("path"), level - 1 - i).bitwiseAND(F.lit(1)).cast("int")
            base = base + (1 - chosen) * LEVELS[i]
        shift, path, before = base + half * width, F.col("path") * 2 + half, F.col("sig")
    bit = shift + k % width
    part = F.expr(f"shiftleft({(1 << width) - 1}L, shift)")
    kept = F.col("fp").bitwiseAND(part).bitwiseAND(F.expr("~shiftleft(1L, bit)"))
    rows = fps.select("*", F.explode(F.sequence(F.lit(0), F.lit(2 * width - 1))).alias("k"))
    rows = rows.select(before.alias("before"), path.alias("path"), bit.cast("int").alias("bit"), shift.cast("int").alias("shift"), "fp")
    key = F.xxhash64("before", "path", "bit", kept)
    return rows.select(key.alias("sig"), "path", "fp")


def forest(a: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges of a spanning forest of the links among distinct unsigned fingerprints."""
    left, right = [], []
    pool = a
    while len(pool) > 1:
        front, pool = pool[:1], pool[1:]
        while len(front) and len(pool):
            v, front = front[0], front[1:]
            near = np.bitwise_count(pool ^ v) <= bits
            if near.any():
                got = pool[near]
                left.append(np.full(len(got), v, np.uint64))
                right.append(got)
                front = np.concatenate([front, got])
                pool = pool[~near]
    return left, right


def links(fps: DataFrame, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) that join distinct fingerprints of fps just as all links would; a < b as signed integers."""
    edges, todo = None, fps
    for level in range(len(LEVELS)):
        found = materialize(_linked(signatures(todo, level), bits, block, level + 1 == len(LEVELS)), "links")
        here = found.where(F.col("sig").isNull()).select("a", "b")
        edges = here if edges is None else edges.union(here)
        todo = found.where(F.col("sig").isNotNull()).select("sig", "path", F.col("a").alias("fp"))
        if todo.isEmpty():
            break
    return edges.distinct()


def _linked(sigs: DataFrame, bits: int, block: int, last: bool) -> DataFrame:
    """Edges within signatures (sig is null), and the rows of signatures with more than ``block``, as they are; none at the last level."""
    sigs = sigs.repartition(F.col("sig")).sortWithinPartitions("sig", "path", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        kept = [np.zeros(0, np.int64)] * 3
        large: int | None = None

        def solve(sig: np.ndarray, fp: np.ndarray) -> dict:
            """Runs of one sig each, whole. What differs in path but has one sig by chance is verified like the rest."""
            x, y = [], []
            cuts = np.flatnonzero(np.diff(sig)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(sig)]
            two = starts[ends - starts == 2]
            a, b = fp[two].view(np.uint64), fp[two + 1].view(np.uint64)
            near = np.bitwise_count(a ^ b) <= bits
            x.append(a[near])
            y.append(b[near])
            for i in np.flatnonzero(ends - starts > 2):
                got = forest(fp[starts[i] : ends[i]].view(np.uint64), bits)
                x.extend(got[0])
                y.extend(got[1])
            a, b = np.concatenate(x).view(np.int64), np.concatenate(y).view(np.int64)
            return {"sig": pa.nulls(len(a), pa.int64()), "path": pa.nulls(len(a), pa.int64()), "a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))}

        def raw(rows: list[np.ndarray]) -> dict:
            return dict(zip(("sig", "path", "a", "b"), map(pa.array, (*rows, rows[2])), strict=True))

        for batch in batches:
            rows = [np.concatenate([k, c.to_numpy(zero_copy_only=False)]) for k, c in zip(kept, batch.columns, strict=True)]
            if large is not None:  # what still belongs to a signature that is too large to hold
                end = int(np.searchsorted(rows[0], large, "right"))
                if end:
                    yield raw([c[:end] for c in rows])
                rows = [c[end:] for c in rows]
                if len(rows[0]):
                    large = None
            sig = rows[0]
            if not len(sig):
                kept = rows
                continue
            cuts = np.flatnonzero(np.diff(sig)) + 1
            starts, ends = np.r_[0, cuts], np.r_[cuts, len(sig)]
            out = (ends - starts > block) & (not last)
            for s, e in zip(starts[out], ends[out], strict=True):
                yield raw([c[s:e] for c in rows])
            end = starts[-1]
            if out[-1]:
                large, end = int(sig[-1]), len(sig)
            small = np.repeat(~out, ends - starts)
            small[end:] = False
            if small.any():
                yield solve(sig[small], rows[2][small])
            kept = [c[end:] for c in rows]
        if len(kept[0]):
            yield solve(kept[0], kept[2])

    return map_batches(sigs, run, "sig bigint, path bigint, a bigint, b bigint")


def components(edges: DataFrame) -> DataFrame:
    """node and root, the least node of its component, for each node of the edges (a, b).

    Large-star: every larger neighbour of a node is joined to the node's least neighbour. Small-star: every
    smaller one, and the node. Both keep the components; the rounds end when no edge changes, which they must, as no
    edge's ends ever grow.
    """

    def state(e: DataFrame) -> tuple:
        """Count and two sums of hashes: equal for equal sets of edges."""
        h = [F.xxhash64("a", "b", F.lit(i)).cast("decimal(38,0)") for i in (1, 2)]
        return tuple(e.agg(F.count("*"), F.sum(h[0]), F.sum(h[1])).first())

    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    now = state(edges)
    while now[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
        large = join_unique(edges, least, "a", now[0], "n", NODE_ROWS).select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        if now[0] >= NODE_ROWS:  # else it is cheaper to make it twice than to write it
            large = materialize(large, "large")
        # now each edge leads from the smaller a to the larger b
        least = large.groupBy("b").agg(F.min("a").alias("m"), F.count("*").alias("n"))
        joined = join_unique(large, least, "b", now[0], "n", NODE_ROWS)
        small = joined.select(F.col("m").alias("a"), "b").union(joined.select(F.col("m").alias("a"), F.col("a").alias("b")))
        after = materialize(small.where("a <> b").distinct(), "edges")
        discard(edges, large)
        edges, before = after, now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS, block: int = BLOCK
) -> DataFrame:
    """One row per row of df: doc_id, fingerprint (hexadecimal) and component_id, the least id reachable."""
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one deleted bit find up to three differing bits")
    rows = materialize(fingerprints(df, id_col, text_col, words), "fingerprints")
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    roots = materialize(components(links(groups.select("fp"), bits, block)), "roots")
    nodes = roots.join(groups, roots.node == groups.fp)
    least = nodes.groupBy("root").agg(F.min("least").alias("component"), F.count("*").alias("nodes"))
    joined = join_unique(roots, least, "root", total, "nodes").select(F.col("node").alias("fp"), "component")
    of_fp = materialize(groups.join(joined, "fp", "left").select("fp", F.coalesce("component", "least").alias("component_id"), "n"), "components")
    discard(groups, roots)
    found = join_unique(rows, of_fp, "fp", total, "n")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def row_key(doc_id: Column, h: Column) -> Column:
    """A hash of a row's id and its text's hash."""
    return F.xxhash64(doc_id, h)


def keep_least(df: DataFrame, rows: DataFrame, roots: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of df with one of each component: that of the least id, a null id last; of equal ids the least fp and text hash.

    rows has doc_id, h (the text's hash) and fp of each row of df, roots node and root of the fps that are linked. Texts of rows
    that are alone in their component, or first in it and not repeated, aren't shuffled, but for the few that ``may_hold`` doesn't tell apart.
    """
    of_root = rows.join(roots, rows.fp == roots.node, "left").select(F.coalesce("root", "fp").alias("root"), "doc_id", "h", "fp")
    of_root = materialize(of_root.groupBy("root", "doc_id", "h", "fp").agg(F.count("*").alias("times")), "rows")
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp", "h")).alias("first")
    first = materialize(of_root.groupBy("root").agg(one, F.count("*").alias("n")).select("root", "first.doc_id", "first.h", "n"), "first")
    total = of_root.count()
    lasting = first.select("root", "n", F.col("doc_id").alias("_id"), F.col("h").alias("_kept"))
    met = join_unique(of_root, lasting, "root", total, "n")
    goes = met.where((F.col("times") > 1) | (F.col("h") != F.col("_kept")) | ~F.col("doc_id").eqNullSafe(F.col("_id")))
    goes = materialize(goes.select(row_key(F.col("doc_id"), F.col("h")).alias("key")), "goes")
    own_id = F.col(id_col).cast("bigint")
    # names that df doesn't have, so that all its columns stay
    mark = "_" * (1 + max(map(len, df.columns)))
    hashed = df.withColumn(mark + "h", text_hash(text_col))
    hashed = hashed.withColumn(mark + "goes", may_hold(goes, row_key(own_id, F.col(mark + "h"))))
    stay, told = hashed.where(~F.col(mark + "goes")), hashed.where(F.col(mark + "goes"))
    keep = first.select(F.col("doc_id").alias(mark + "id"), F.col("h").alias(mark + "kept"))
    kept = told.join(keep, own_id.eqNullSafe(F.col(mark + "id")) & (F.col(mark + "h") == F.col(mark + "kept")), "left_semi")
    return stay.drop(mark + "h", mark + "goes").unionByName(kept.dropDuplicates([id_col, mark + "h"]).drop(mark + "h", mark + "goes"))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = BITS) -> DataFrame:
    """The rows of df with one row of each component, whatever ids repeat or are null: see ``keep_least``.

    Rows with a null id stay only if their component has no id; then one of them does.
    """
    if not 0 <= bits <= 3:
        raise ValueError("two segments with one deleted bit find up to three differing bits")
    rows = materialize(fingerprints(df, id_col, text_col, words, hashed=True), "fingerprints")
    roots = components(links(rows.select("fp").distinct(), bits))
    return keep_least(df, rows, roots, id_col, text_col)
