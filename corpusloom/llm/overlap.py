"""Near-copies by SimHash: texts are linked if the Jaccard similarity of their sets of five-word shingles is high enough.

The fingerprint is that of ``simhash`` (the majority of the shingles' hash bits) over the set of distinct shingles, but long enough for
a similarity of 0.8, at which 15 % of the bits differ: 52 segments of 18 bits. Two texts are candidates if a segment
differs by at most one bit, found by deletion variants: of the segment's halves one is then equal, and the other is equal
without one of its bits. Rows are dealt by segment and equal half, and the variants of the other half meet in an equality join inside the task.
What meets is verified on 192 bits. A pair of similarity s has bits that differ with probability p = arccos(2 s / (1 + s)) / pi and is
missed with probability (1 - (1 - p)**18 - 18 p (1 - p)**17)**52: 3e-6 at 0.8, 3e-11 at 0.85. A pair that met is joined with both
whole fingerprints and stays if at most WHOLE of the 960 bits differ. Where a group is so dense that a spanning forest stands for its pairs, they stay without it.

Components of what stays are then searched on the whole sets of 64-bit shingle hashes, so no link is wrong. Equal
sets are merged first. Only texts that have a candidate are read again for their sets, once for all their candidates. As in
``simhash``, no pairs are emitted, but the edges of a spanning forest; a component with more than ``block`` sets is cut into
blocks, and each pair of blocks is a group of its own.

Majorities of few hashes are coarser than p, so sets of up to 64 shingles meet by prefixes instead, which miss none: of sets so similar,
the first fifth (and one) of the hashes has one in common, in whatever order, if it is the same for all. Rare hashes come first, so a passage
that many unlike texts share is in no prefix, and a hash of one set alone meets nothing. Where sets meet they are compared whole, within the task.

Defined results: a null text counts as empty; a text of fewer words than a shingle is one shingle; texts without words are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import discard, join_unique, map_batches, materialize, may_hold
from .simhash import SEED, components, keep_least, row_key, text_hash

WORDS, SIMILARITY = 5, 0.8
#: Segments of a fingerprint, and bits of a half of one.
SEGMENTS, HALF = 52, 9
#: 64-bit words of a fingerprint; those that are verified, and how many of their bits differ at most (at 0.8: 29, by 5 more or less).
LANES, CHECKED, RADIUS = 15, 3, 55
#: How many bits of a whole fingerprint differ at most (at 0.8: 143, by 11 more or less).
WHOLE = 200
#: Shingles of a set that is met by its prefix.
FEW = 64
#: Fingerprints of a signature of which all pairs are compared at once; of more, row by row.
RUN = 32
#: Rows that a task takes at once, with all of their keys.
CHUNK = 50_000
#: Pairs for each row that are held before they are replaced by as few as join the same.
HELD = 4
#: Sets of a component that are compared in one task, and hashes of them that are looked up at once.
BLOCK, FLAT = 512, 1 << 20


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the distinct shingles, in order."""
    tokens = (text or "").encode().lower().split()  # as in simhash
    if not tokens:
        return np.zeros(0, np.uint64)
    rows = [tokens] if len(tokens) < words else zip(*(tokens[i:] for i in range(words)), strict=False)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in rows), np.uint64))


def key_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64))


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """LANES words, the majorities of as many hashes made of each of the given ones."""
    counts = np.zeros(64 * LANES, np.int64)
    for at in range(0, len(hashes), 255):  # as many as a byte counts
        z = hashes[at : at + 255, None] + np.arange(1, LANES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        z ^= z >> np.uint64(31)
        counts += np.unpackbits(z.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def codes_of(lanes: np.ndarray) -> np.ndarray:
    """Of fingerprints (a row each): for each segment and half, its number, the half's bits and those of the other half, 9 bits each."""
    bits = np.unpackbits(lanes.view(np.uint8).reshape(len(lanes), -1), axis=1, bitorder="little")[:, : 2 * HALF * SEGMENTS]
    halves = (bits.reshape(len(lanes), SEGMENTS, 2, HALF) << np.arange(HALF, dtype=np.int32)).sum(3, dtype=np.int32)
    number = np.arange(2 * SEGMENTS, dtype=np.int32).reshape(SEGMENTS, 2)
    return ((number << 2 * HALF) | (halves << HALF) | halves[:, :, ::-1]).reshape(len(lanes), -1)


def sketches(df: DataFrame, id_col: str, text_col: str, words: int, similarity: float) -> DataFrame:
    """doc_id, h (the hash of the text), fp (that of its shingle set), lanes (its fingerprint) and least (a small set itself); each where it serves."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            sets = [shingle_set(t, words) for t in b.column(2).to_pylist()]
            # a small set's partners have at most FEW / similarity shingles
            yield {
                "doc_id": b.column(0), "h": b.column(1), "fp": [key_of(s) for s in sets],
                "lanes": [fingerprint(s).tobytes() if len(s) > FEW else None for s in sets],
                "least": [s.view(np.int64).tolist() if similarity * len(s) <= FEW + 1e-9 else [] for s in sets],
            }

    return map_batches(df, run, "doc_id bigint, h bigint, fp bigint, lanes binary, least array<bigint>")


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= RADIUS


def meet(code: np.ndarray, fp: np.ndarray, lanes: np.ndarray) -> np.ndarray:
    """Pairs of fp (a row each) that join what is near within the signatures of whole keys; code is in order."""
    return meetings(code, fp, lanes)[0]


def meetings(code: np.ndarray, fp: np.ndarray, lanes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ``meet``, and whether each stands for others that aren't given, so that it must stay."""
    nodes, node = np.unique(fp, return_inverse=True)
    held = np.zeros(0, np.int64)  # pairs as numbers, twice, and one more if they stand for others

    def numbers(x: np.ndarray, y: np.ndarray, bound: bool) -> np.ndarray:
        return 2 * (np.minimum(node[x], node[y]) * len(nodes) + np.maximum(node[x], node[y])) + bound

    for bit in range(HALF):
        out = [held]
        order = np.argsort(code & ~np.int32(1 << bit), kind="stable")
        sig = (code & ~np.int32(1 << bit))[order]
        cuts = np.flatnonzero(np.diff(sig)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(sig)]
        sizes = ends - starts
        few = sizes <= RUN
        left = np.where(np.repeat(few, sizes), np.repeat(ends, sizes) - np.arange(len(sig)), 0)  # rows of the run from each on
        at = np.flatnonzero(left > 1)
        for step in range(1, RUN):
            at = at[left[at] > step]
            if not len(at):
                break
            x, y = order[at], order[at + step]
            good = near(lanes[x], lanes[y])
            out.append(numbers(x[good], y[good], False))
        for s, e in zip(starts[~few], ends[~few], strict=True):
            pool = order[s:e]
            while len(pool) > 1:
                front, pool = [pool[0]], pool[1:]
                while front and len(pool):
                    v = front.pop()
                    hit = near(lanes[pool], lanes[v])
                    got, pool = pool[hit], pool[~hit]
                    out.append(numbers(np.full(len(got), v), got, True))
                    front.extend(got)
        held = np.unique(np.concatenate(out))
        if len(held) > HELD * len(code):
            joined = stars(np.column_stack(np.divmod(held >> 1, len(nodes))))
            held = 2 * (joined[:, 0] * len(nodes) + joined[:, 1]) + 1
    last = np.r_[held[1:] >> 1 != held[:-1] >> 1, True] if len(held) else held.astype(bool)  # of a pair given both ways, the one that must stay
    held = held[last]
    x, y = np.divmod(held >> 1, len(nodes)) if len(nodes) else (held, held)
    return np.column_stack([nodes[x], nodes[y]]), (held & 1).astype(bool)


def thin(pairs: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same with stars in place of components that have over HELD pairs for each node."""
    joined = stars(pairs)
    nodes = np.unique(pairs)
    root = nodes.copy()
    root[np.searchsorted(nodes, joined[:, 1])] = joined[:, 0]
    number, of_node = np.unique(root, return_inverse=True)
    of_pair = of_node[np.searchsorted(nodes, pairs[:, 0])]
    dense = np.bincount(of_pair, minlength=len(number)) > HELD * np.bincount(of_node, minlength=len(number))
    short = joined[dense[of_node[np.searchsorted(nodes, joined[:, 1])]]]
    keep = ~dense[of_pair]
    return np.concatenate([pairs[keep], short]), np.r_[bound[keep], np.ones(len(short), bool)]


def stars(pairs: np.ndarray) -> np.ndarray:
    """For each node of the pairs (a row each) that isn't the least of its component: the least one, and it."""
    nodes, at = np.unique(pairs, return_inverse=True)
    x, y = at.reshape(-1, 2).T
    least = np.arange(len(nodes))
    while len(x):
        low, high = np.minimum(least[x], least[y]), np.maximum(least[x], least[y])
        apart = low != high
        x, y, low, high = x[apart], y[apart], low[apart], high[apart]
        np.minimum.at(least, high, low)
        while (least[least] != least).any():
            least = least[least]
    other = least != np.arange(len(nodes))
    return np.column_stack([nodes[least[other]], nodes[other]])


def candidates(groups: DataFrame) -> DataFrame:
    """Edges (a, b) between the fp of groups (fp, lanes) that join all that may be similar; bound: the edge stands for others, see ``meetings``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                lanes = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint64).reshape(-1, LANES)
                fp, n = part.column(0).to_numpy(), 2 * SEGMENTS
                yield {"code": pa.array(codes_of(lanes).ravel()), "fp": pa.array(np.repeat(fp, n))} | {
                    f"c{i}": pa.array(np.repeat(lanes[:, i].view(np.int64), n)) for i in range(CHECKED)
                }

    schema = "code int, fp bigint, " + ", ".join(f"c{i} bigint" for i in range(CHECKED))
    rows = map_batches(groups.where("lanes is not null").select("fp", "lanes"), deal, schema)
    rows = rows.repartition(F.shiftright("code", HALF)).sortWithinPartitions("code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held, size = [], 0

        def take(columns: list[np.ndarray]) -> dict:
            # a few edges for each fingerprint at most, however many pairs there are
            pairs, bound = thin(*meetings(columns[0], columns[1], np.column_stack(columns[2:]).view(np.uint64)))
            return {"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "bound": pa.array(bound)}

        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            size += b.num_rows
            if size >= CHUNK:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                keys = columns[0] >> HALF
                cut = int(np.searchsorted(keys, keys[-1]))  # the last key may go on
                if cut:
                    yield take([c[:cut] for c in columns])
                held, size = [[c[cut:] for c in columns]], 0
        if held:
            yield take([np.concatenate(c) for c in zip(*held, strict=True)])

    return map_batches(rows, run, "a bigint, b bigint, bound boolean").groupBy("a", "b").agg(F.bool_or("bound").alias("bound"))


@F.arrow_udf(BooleanType())
def alike(a: pa.Array, b: pa.Array) -> pa.Array:
    """Whether whole fingerprints are near enough."""
    one, other = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(-1, LANES) for c in (a, b))
    return pa.array(np.bitwise_count(one ^ other).sum(1, dtype=np.int64) <= WHOLE)


def likely(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """The edges of ``candidates`` whose whole fingerprints are near, and those that stand for others."""
    lanes = groups.where("lanes is not null").select("fp", "lanes")
    for end in ("a", "b"):
        edges = edges.join(lanes.select(F.col("fp").alias(end), F.col("lanes").alias(f"lanes_{end}")), end)
    return edges.where(F.col("bound") | alike("lanes_a", "lanes_b")).select("a", "b")


def prefixes(groups: DataFrame, similarity: float) -> DataFrame:
    """key and fp: the hashes of the small sets' prefixes, rare ones first, that other small sets have too."""
    sets = groups.where(F.size("least") > 0).select("fp", F.size("least").alias("size"), F.explode("least").alias("key"))
    total = groups.agg(F.coalesce(F.sum(F.greatest(F.size("least"), F.lit(0))), F.lit(0))).first()[0]
    counts = sets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = join_unique(sets, counts.select("key", "n", F.col("n").alias("rows")), "key", total, "rows")
    # hashes of one set alone come first in it and meet nothing
    ranked = shared.groupBy("fp").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("n", "key"))).alias("all"))
    left = F.size("all") + 1 - F.ceil(F.col("size") * F.lit(similarity) - 1e-9)
    return ranked.where(left > 0).select("fp", F.explode(F.slice("all", F.lit(1), left.cast("int"))).alias("one")).select("one.key", "fp")


def short_links(groups: DataFrame, similarity: float, block: int) -> DataFrame:
    """Edges (a, b) that join the small sets of groups (fp, least) just as all links would."""
    keys = prefixes(groups, similarity)
    sizes = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = keys.count()
    keys = join_unique(keys, sizes.select("key", "n", F.col("n").alias("rows")), "key", total, "rows").select(F.col("key").alias("root"), "fp", blocks_of(block).alias("blocks"))
    sets = keys.join(groups.select("fp", "least"), "fp").select("fp", "root", "blocks", "least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            least = [np.array(x, np.int64).tobytes() for x in b.column(3).to_pylist()]
            yield {"fp": b.column(0), "root": b.column(1), "blocks": b.column(2), "hashes": least}

    return compared(map_batches(sets, run, "fp bigint, root bigint, blocks int, hashes binary"), similarity)


def blocks_of(block: int) -> Column:
    return F.when(F.col("n") > block, F.ceil(2 * F.col("n") / F.lit(block))).otherwise(1).cast("int")


def common(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many hashes each of the others shares with one; no set is empty."""
    flat = np.concatenate(others)
    hits = one[np.minimum(np.searchsorted(one, flat), len(one) - 1)] == flat
    return np.add.reduceat(hits, np.r_[0, np.cumsum([len(o) for o in others])[:-1]], dtype=np.int64)


def forest(keys: np.ndarray, sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct sets."""
    edges = []
    sizes = np.array([len(s) for s in sets])
    pool = np.arange(len(sets))
    while len(pool) > 1:
        front, pool = [pool[0]], pool[1:]
        while front and len(pool):
            v = front.pop()
            size = len(sets[v])
            # sets whose sizes differ by more can't be so similar
            fit = pool[np.minimum(sizes[pool], size) >= similarity * np.maximum(sizes[pool], size) - 1e-9]
            if not len(fit):
                continue
            before = np.cumsum(sizes[fit]) - sizes[fit]
            shared = np.concatenate([common(sets[v], [sets[i] for i in part]) for part in np.split(fit, np.flatnonzero(np.diff(before // FLAT)) + 1)])
            got = fit[shared >= similarity * (size + sizes[fit] - shared) - 1e-9]
            edges.extend((int(keys[v]), int(keys[i])) for i in got)
            front.extend(got)
            pool = pool[~np.isin(pool, got)]
    return edges


def compared(sets: DataFrame, similarity: float) -> DataFrame:
    """Edges (a, b) of spanning forests of the links within the roots of sets (fp, root, blocks, hashes)."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    dealt = sets.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")).select("root", "fp", "hashes", "own", other)
    dealt = dealt.select("root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "hashes")
    dealt = dealt.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def rows_of(keys: list, sets: list) -> dict:
            edges = forest(np.array(keys, np.int64), [np.frombuffer(s, np.uint64) for s in sets], similarity)
            return {"a": [min(e) for e in edges], "b": [max(e) for e in edges]}

        at, keys, held = None, [], []
        for b in batches:
            for *group, fp, hashes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if group != at:
                    if len(keys) > 1:
                        yield rows_of(keys, held)
                    at, keys, held = group, [], []
                if not keys or keys[-1] != fp:  # rows that repeat an id and its text have one set
                    keys.append(fp)
                    held.append(hashes)
        if len(keys) > 1:
            yield rows_of(keys, held)

    return map_batches(dealt, run, "a bigint, b bigint")


def links(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, words: int, similarity: float, block: int) -> tuple[DataFrame, list[DataFrame]]:
    """Edges (a, b) between the fp of rows, which are the sketches of df, that join them just as all links would; the tables they are read from."""
    groups = rows.groupBy("fp").agg(F.min(F.struct("doc_id", "h", "lanes", "least")).alias("one"))
    groups = materialize(groups.select("fp", "one.*"), "groups")
    roots = materialize(components(likely(candidates(groups), groups)), "met")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    met = roots.join(sizes.select("root", blocks_of(block).alias("blocks")), "root").withColumnRenamed("node", "fp")
    wanted = materialize(met.join(groups, "fp").select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "fp", "root", "blocks"), "wanted")
    texts = df.select(F.col(id_col).cast("bigint").alias("doc_id"), text_hash(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))
    # the join shuffles the texts that are read and few others
    texts = texts.where(may_hold(wanted.select(row_key(F.col("_id"), F.col("_h"))), row_key(F.col("doc_id"), F.col("h"))))
    texts = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("fp", "root", "blocks", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                sets = [shingle_set(t, words).tobytes() for t in part.column(3).to_pylist()]
                yield {"fp": part.column(0), "root": part.column(1), "blocks": part.column(2), "hashes": sets}

    sets = map_batches(texts, read, "fp bigint, root bigint, blocks int, hashes binary")
    return compared(sets, similarity).union(short_links(groups, similarity, block)).distinct(), [groups, roots, wanted]


def drop_near_copies(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY, block: int = BLOCK
) -> DataFrame:
    """The rows of df with one row of each component, as ``simhash.keep_least`` chooses."""
    if not SIMILARITY <= similarity <= 1:
        raise ValueError("the segments are made for a similarity of 0.8 and more")
    rows = materialize(sketches(df, id_col, text_col, words, similarity), "sketches")
    edges, tables = links(df, rows, id_col, text_col, words, similarity, block)
    roots = components(edges)
    discard(*tables)
    return keep_least(df, rows.select("doc_id", "h", "fp"), roots, id_col, text_col)
