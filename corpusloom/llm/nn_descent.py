"""Nearest neighbours by largest inner product: NN-descent builds a neighbour graph, a greedy search walks it.

Nodes are the distinct vectors; equal ones are one node, which lists its least ids, as many as a result can hold. A node's key tells where it is stored:
nodes are sorted by the signs of random projections, and each ``BLOCK`` consecutive ones are a block, so that neighbours tend to share blocks.

Graph. Its first edges are the best within runs of nodes sorted by the signs of projections, for several sets of projections. Then each round is a join of
neighbours of neighbours: a node sends its vector to some of the nodes it lists and that list it (new edges first, by ``sample`` each; a hub's are sampled
before they meet), and each node compares the vectors it gets with each other. Pairs that improve a list go to both ends. Rounds end when few lists change.
In the rounds vectors travel in half precision, scaled by their largest component; lists hold ``degree`` edges.

Search. All queries walk at once, in rounds: each expands the ``width`` best nodes it hasn't expanded, their listed nodes are asked for by block, and those that
beat the query's ``beam``-th are merged into its beam. A query ends when nothing in its beam is left to expand. A query whose vector is a node starts there, others at
``ENTRIES`` fixed nodes. Requests of a block that many queries ask are dealt to copies of the block. Scores here are inner products of the original vectors in double precision.

No task holds more than a run, a block, the vectors at one node, or one query's beam. The lists, samples and beams are what makes the method
approximate; no row is left out of nodes, graph or results. On unlike vectors recall falls slowly as rows grow; a wider beam raises it.

Defined results: rows without an id, and vectors that are null, empty, zero or that hold a null or a non-finite component, take no part, neither do vectors of another
dimension than most have (the smaller one, if several are as frequent); rows that repeat an id count once, with the least of its vectors; of equal scores the lesser id is
nearer; a query has fewer results if there are fewer candidates; an empty table gives no rows. Only the columns named are read, so any others may be there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, join_unique, map_batches, materialize
from .merkle import indexed

#: Nodes of a block, as bits of a key, and nodes of a run of the first edges.
BLOCK_BITS, RUN = 11, 1024
#: Sets of projections, signs in each, and edges of a node that each of them gives.
TREES, SIGNS, TREE_EDGES = 8, 24, 12
#: Edges of a node; of those that are new, and old, and of those that lead to it, how many take part in a round.
DEGREE, SAMPLE = 40, 16
#: Rounds end when lists have so few new edges, as a share of all, and at the latest after so many.
SETTLED, ROUNDS = 0.02, 12
#: Best nodes that a query keeps, and how many of them it expands in a round.
BEAM, WIDTH = 256, 96
#: Nodes where queries start that aren't nodes themselves.
ENTRIES = 32
#: Requests (a query's to a block) that one copy of a block answers.
ASKED = 20_000


@dataclass
class Index:
    """nodes: node, vec, ids (the least ``ids`` ones); graph: node, near; blocks: block, slots, data (packed vectors); and what the vectors are."""

    nodes: DataFrame
    graph: DataFrame
    blocks: DataFrame
    ids: int
    dimension: int
    double: bool


def vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id and vec of the rows that take part, one of each id."""
    vec = F.col(vec_col)
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    sound = vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vec, lambda x: x != 0)
    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), vec.alias("vec")).where(F.coalesce(sound, F.lit(False)))
    common = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").first()
    rows = rows.where(F.size("vec") == (common.d if common else 0))
    return rows.groupBy("id").agg(F.min("vec").alias("vec"))


def packed(column: pa.Array, dtype: str = "f8") -> np.ndarray:
    """A matrix of a column of equally long lists."""
    return column.values.slice(column.offsets[0].as_py(), column.offsets[-1].as_py() - column.offsets[0].as_py()).to_numpy(zero_copy_only=False).astype(dtype).reshape(len(column), -1)


def _grouped(batches: Iterator[pa.RecordBatch], key: str, most: int = 0) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that follow each other with one key; several small groups come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        k = b.column(key)
        if sum(x.num_rows for x in held) < most or k[0] == k[len(k) - 1]:
            continue
        last = int(np.flatnonzero(k.to_numpy() != k[len(k) - 1].as_py())[-1]) + 1
        yield pa.Table.from_batches([*held[:-1], b.slice(0, last)])
        held = [b.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def projections(seed: int, dimension: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dimension, SIGNS + 1))


def _signs(rows: DataFrame, columns: tuple[str, ...], mean: list[float], trees: int) -> DataFrame:
    """rows with columns and, for each of trees, tree, signs and along (a further projection)."""
    kept = rows.select(*columns)
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields)
    names, at, middle = kept.columns, kept.columns.index("vec"), np.array(mean)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if not b.num_rows:
                continue
            x = packed(b.column(at))
            x = x / np.abs(x).max(1, keepdims=True) - middle
            for t in range(trees):
                p = x @ projections(t, len(middle))
                signs = (p[:, :SIGNS] > 0) @ (1 << np.arange(SIGNS)[::-1])
                yield dict(zip(names, b.columns, strict=True)) | {"tree": np.full(len(x), t, np.int32), "signs": signs.astype(np.int64), "along": p[:, SIGNS]}

    return map_batches(kept, run, f"{types}, tree int, signs bigint, along double")


def _mean(rows: DataFrame, dimension: int) -> list[float]:
    """The mean of the vectors, each scaled by its largest component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total, count = np.zeros(dimension), 0
        for b in batches:
            if b.num_rows:
                x = packed(b.column(0))
                total, count = total + (x / np.abs(x).max(1, keepdims=True)).sum(0), count + len(x)
        yield {"at": np.arange(dimension), "total": total, "n": np.full(dimension, count)}

    found = map_batches(rows.select("vec"), run, "at bigint, total double, n bigint").groupBy("at").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return [r.total / max(1, r.n) for r in sorted(found.collect())]


def _best(edges: DataFrame, degree: int) -> DataFrame:
    """The graph of the best of edges (node, other, score, fresh); of one that comes twice, it is old if one of them is."""
    one = edges.repartition("node").groupBy("node", "other").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "other"))
    kept = one.withColumn("place", place).where(F.col("place") <= degree)
    lists = kept.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", "other", "score", "fresh"))).alias("l"))
    return lists.select("node", F.col("l.other").alias("near"), F.col("l.score").alias("score"), F.col("l.fresh").alias("fresh"))


def _top_pairs(a: np.ndarray, b: np.ndarray, s: np.ndarray, most: int) -> dict:
    """Edges a to b of score s without repeats, the most best of each a."""
    order = np.lexsort((b, -s, a))
    a, b, s = a[order], b[order], s[order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    a, b, s = a[new], b[new], s[new]
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, int)
    place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
    keep = place < most
    return {"node": a[keep], "other": b[keep], "score": s[keep]}


def first_edges(nodes: DataFrame, mean: list[float]) -> DataFrame:
    """node, other and score: the best within runs of the nodes sorted by signs of projections."""
    dealt = _signs(nodes, ("node", "vec"), mean, TREES).repartitionByRange("tree", "signs", "along").sortWithinPartitions("tree", "signs", "along")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        def solve(key: np.ndarray, x: np.ndarray) -> dict:
            s = x @ x.T
            np.fill_diagonal(s, -np.inf)
            m = min(TREE_EDGES, len(key) - 1)
            best = np.argpartition(-s, m - 1, axis=1)[:, :m] if m else np.zeros((len(key), 0), int)
            return {"node": np.repeat(key, m), "other": key[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()}

        key, x, tree = np.zeros(0, np.int64), None, None
        for b in batches:
            if not b.num_rows:
                continue
            tree = b.column(2).to_numpy()
            for t in np.unique(tree):  # a run may begin in one set and end in the next: its nodes are compared all the same
                at = np.flatnonzero(tree == t)
                part = b.slice(int(at[0]), len(at))
                key = np.r_[key, part.column(0).to_numpy()]
                x = packed(part.column(1)) if x is None else np.r_[x, packed(part.column(1))]
                while len(key) >= RUN:
                    yield solve(*_once(key[:RUN], x[:RUN]))
                    key, x = key[RUN:], x[RUN:]
        if len(key) > 1:
            yield solve(*_once(key, x))

    return map_batches(dealt, run, "node bigint, other bigint, score double")


def _once(key: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(key, return_index=True)
    return key, x[at]


def _sampled(graph: DataFrame, sample: int, turn: int) -> DataFrame:
    """Edges that take part in a round (node, other, fresh), and all lists as they go on (kept), their sampled edges old."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: list[list] = [[], [], []]
            old = []
            for node, near, fresh in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                rng = np.random.default_rng((node, turn))
                f = np.array(fresh)
                chosen = [rng.permutation(np.flatnonzero(f == kind))[:sample] for kind in (True, False)]
                for kind, at in zip((True, False), chosen, strict=True):
                    out[0].extend([node] * len(at))
                    out[1].extend(near[i] for i in at.tolist())
                    out[2].extend([kind] * len(at))
                f[chosen[0]] = False
                old.append(f.tolist())
            n, m = len(out[0]), b.num_rows
            yield {"node": out[0], "other": out[1], "fresh": out[2], "near": [None] * n, "score": [None] * n, "flags": [None] * n}
            yield {"node": b.column(0), "other": [None] * m, "fresh": [None] * m, "near": b.column(1), "score": b.column(2), "flags": old}

    return map_batches(graph, run, "node bigint, other bigint, fresh boolean, near array<bigint>, score array<double>, flags array<boolean>")


def _joined(members: DataFrame, degree: int) -> DataFrame:
    """Edges that improve a list, from the vectors that meet at each centre: members has centre, fresh, node, half, scale and worst."""
    dealt = members.repartition("centre").sortWithinPartitions("centre")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in _grouped(batches, "centre", 20_000):
            centre, fresh, node, scale, worst = (t.column(c).to_numpy() for c in ("centre", "fresh", "node", "scale", "worst"))
            x = np.frombuffer(b"".join(t.column("half").to_pylist()), np.float16).reshape(len(node), -1).astype(np.float32)
            starts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
            found: list[list[np.ndarray]] = [[], [], []]
            for lo, hi in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                key, at = np.unique(node[lo:hi], return_index=True)
                new = np.flatnonzero(np.isin(key, node[lo:hi][fresh[lo:hi]]))
                if not len(new) or len(key) < 2:
                    continue
                at = at + lo
                s = (x[at[new]] @ x[at].T) * scale[at[new]][:, None] * scale[at]
                bar = worst[at]
                for mine, yours in ((bar[new][:, None], False), (bar[None, :], True)):
                    i, j = np.nonzero(s > mine)
                    other = new[i] != j
                    i, j = i[other], j[other]
                    a, b = (key[j], key[new[i]]) if yours else (key[new[i]], key[j])
                    for to, got in zip(found, (a, b, s[i, j]), strict=True):
                        to.append(got)
            if found[0]:
                yield _top_pairs(*map(np.concatenate, found), degree)

    return map_batches(dealt, run, "node bigint, other bigint, score double")


def _coded(nodes: DataFrame) -> DataFrame:
    """node, its vector in half precision and the scale that restores it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            if b.num_rows:
                x = packed(b.column(1))
                scale = np.abs(x).max(1)
                half = (x / scale[:, None]).astype(np.float16)
                yield {"node": b.column(0), "half": [r.tobytes() for r in half], "scale": scale}

    return map_batches(nodes.select("node", "vec"), run, "node bigint, half binary, scale double")


def descend(graph: DataFrame, coded: DataFrame, degree: int, sample: int, turn: int) -> tuple[DataFrame, int]:
    """One round: the next graph, and how many of its edges are new."""
    step = materialize(_sampled(graph, sample, turn), "sampled")
    edges = step.where("other is not null").select("node", "other", "fresh")
    order = F.xxhash64("node", "other", F.lit(turn))
    place = F.row_number().over(Window.partitionBy("other", "fresh").orderBy(order, "node"))
    back = edges.withColumn("place", place).where(F.col("place") <= sample).select(F.col("other").alias("centre"), F.col("node").alias("member"), "fresh")
    ahead = edges.select(F.col("node").alias("centre"), F.col("other").alias("member"), "fresh")
    met = ahead.unionByName(back).groupBy("centre", "member").agg(F.max("fresh").alias("fresh"))
    lists = step.where("other is null").select("node", "near", "score", F.col("flags").alias("fresh"))
    full = F.when(F.size("score") >= degree, F.element_at("score", -1)).otherwise(F.lit(float("-inf")))
    sent = coded.join(lists.select("node", full.alias("worst")), "node")
    members = met.join(sent, met.member == sent.node).select("centre", "fresh", "node", "half", "scale", "worst")
    better = _joined(members, degree).withColumn("fresh", F.lit(True))
    listed = lists.select("node", F.explode(F.arrays_zip("near", "score", "fresh")).alias("e")).select("node", F.col("e.near").alias("other"), "e.score", "e.fresh")
    after = materialize(_best(listed.unionByName(better), degree), "graph")
    discard(step, graph)
    new = after.agg(F.coalesce(F.sum(F.size(F.filter("fresh", lambda x: x))), F.lit(0))).first()[0]
    return after, new


def build(
    df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", ids: int = 21, degree: int = DEGREE, sample: int = SAMPLE,
    rounds: int = ROUNDS, settled: float = SETTLED,
) -> Index:
    """ids: how many of the least ids of equal vectors a search may return."""
    rows = materialize(vectors(df, id_col, vec_col), "vectors")
    double = dict(rows.dtypes)["vec"] == "array<double>"
    first = rows.select(F.size("vec")).first()
    dimension = first[0] if first else 0
    place = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    least = rows.withColumn("place", place).where(F.col("place") <= ids)
    distinct = least.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    mean = _mean(rows, dimension)
    # keys without gaps, so that blocks are full however many tasks sorted them
    ordered, total, _ = indexed(_signs(distinct, ("vec", "ids"), mean, 1).withColumn("grp", F.lit("")), ("signs", "along", "vec"))
    nodes = materialize(ordered.select(F.col("idx").alias("node"), "vec", "ids"), "nodes")
    discard(ordered)
    edges = first_edges(nodes, mean).withColumn("fresh", F.lit(True))
    graph = materialize(_best(edges, degree), "graph")
    coded = materialize(_coded(nodes), "coded")
    for turn in range(rounds if total > 1 else 0):
        graph, new = descend(graph, coded, degree, sample, turn)
        if new <= settled * degree * total:
            break
    discard(coded, rows)
    return Index(nodes, graph.select("node", "near"), materialize(_blocks(nodes, double), "blocks"), ids, dimension, double)


def _blocks(nodes: DataFrame, double: bool) -> DataFrame:
    """block, slots (the lower bits of its nodes' keys) and data, their vectors one after the other."""
    kind = "f8" if double else "f4"
    dealt = nodes.select(F.shiftright("node", BLOCK_BITS).alias("block"), F.col("node").bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)).alias("slot"), "vec")
    dealt = dealt.repartition("block").sortWithinPartitions("block", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in _grouped(batches, "block"):
            t = t.combine_chunks().to_batches()[0]
            block, slot, x = t.column(0).to_numpy(), t.column(1).to_numpy().astype("<i4"), packed(t.column(2), kind)
            for k in np.unique(block):
                m = block == k
                yield {"block": [k], "slots": [slot[m].tobytes()], "data": [x[m].tobytes()]}

    return map_batches(dealt, run, "block bigint, slots binary, data binary")


def _answers(requests: DataFrame, index: Index) -> DataFrame:
    """q, near and score of the requested nodes that beat bar. requests: q, vec, bar, block and near."""
    asked = requests.groupBy("block").agg(F.count("*").alias("asked"))
    copies = F.ceil(F.col("asked") / ASKED).cast("int")
    blocks = index.blocks.join(asked.select("block", copies.alias("copies")), "block")
    blocks = blocks.select("block", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"), "slots", "data")
    dealt = requests.join(asked.select("block", copies.alias("copies")), "block")
    dealt = dealt.withColumn("copy", F.pmod(F.xxhash64("q"), F.col("copies")).cast("int")).drop("copies")
    none = lambda kind: F.lit(None).cast(kind)
    both = blocks.select("block", "copy", none("bigint").alias("q"), none("array<double>").alias("vec"), none("double").alias("bar"), none("array<bigint>").alias("near"), "slots", "data")
    both = both.unionByName(dealt.select("block", "copy", "q", F.col("vec").cast("array<double>").alias("vec"), "bar", "near", none("binary").alias("slots"), none("binary").alias("data")))
    both = both.repartition("block", "copy").sortWithinPartitions("block", "copy", F.col("q").asc_nulls_first())
    kind, dimension = "f8" if index.double else "f4", index.dimension

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        x, place = np.zeros((0, dimension)), np.zeros(0, int)
        for b in batches:
            out: dict[str, list] = {"q": [], "near": [], "score": []}
            asks = b.column(2).to_pylist()
            for i, q in enumerate(asks):
                if q is None:
                    x = np.frombuffer(b.column(7)[i].as_py(), kind).astype(np.float64).reshape(-1, dimension)
                    place = np.zeros(1 << BLOCK_BITS, int)
                    slots = np.frombuffer(b.column(6)[i].as_py(), "<i4")
                    place[slots] = np.arange(len(slots))
                    continue
                vec = b.column(3)[i].values.to_numpy()
                near = np.unique(b.column(5)[i].values.to_numpy())
                score = (x[place[near & ((1 << BLOCK_BITS) - 1)]] * vec).sum(1)
                good = score > b.column(4)[i].as_py()
                if good.any():
                    out["q"].append(q)
                    out["near"].append(near[good])
                    out["score"].append(score[good])
            yield out

    return map_batches(both, run, "q bigint, near array<bigint>, score array<double>")


STATE = "q bigint, vec array<double>, near array<bigint>, score array<double>, done array<boolean>, ahead array<bigint>"


def _merged(state: DataFrame, answers: DataFrame, beam: int, width: int) -> DataFrame:
    """The beams with the answers; ahead: the nodes to expand next, which are marked as done."""
    none = lambda kind: F.lit(None).cast(kind)
    rows = state.select("q", F.lit(0).alias("part"), "vec", "near", "score", "done")
    rows = rows.unionByName(answers.select("q", F.lit(1).alias("part"), none("array<double>").alias("vec"), "near", "score", none("array<boolean>").alias("done")))
    rows = rows.repartition("q").sortWithinPartitions("q", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for t in _grouped(batches, "q"):
            out: dict[str, list] = {c: [] for c in ("q", "vec", "near", "score", "done", "ahead")}
            q, vec, near, score, done = (t.column(c).to_pylist() for c in ("q", "vec", "near", "score", "done"))
            starts = [i for i in range(len(q)) if not i or q[i] != q[i - 1]]
            for lo, hi in zip(starts, [*starts[1:], len(q)], strict=True):
                n = np.concatenate([np.array(x, np.int64) for x in near[lo:hi]])
                s = np.concatenate([np.array(x, np.float64) for x in score[lo:hi]])
                d = np.zeros(len(n), bool)
                d[: len(done[lo])] = done[lo]
                _, at = np.unique(n, return_index=True)  # the first of each: what the beam has keeps its mark
                at = at[np.lexsort((n[at], -s[at]))][:beam]
                n, s, d = n[at], s[at], d[at]
                go = np.flatnonzero(~d)[:width]
                d[go] = True
                for c, v in zip(out, (q[lo], vec[lo], n, s, d, n[go]), strict=True):
                    out[c].append(v)
            yield out

    return map_batches(rows, run, STATE)


def search(index: Index, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", n: int = 20, beam: int = BEAM, width: int = WIDTH) -> DataFrame:
    """query_id, rank, vec_id and score: the n nearest found of each row of queries, without the row of its own id."""
    if n + 1 > index.ids:
        raise ValueError(f"the index returns {index.ids - 1} ids at most")
    asked = materialize(vectors(queries, id_col, vec_col).where(F.size("vec") == index.dimension), "queries")
    groups = asked.groupBy("vec").agg(F.min("id").alias("q"), F.count("*").alias("asking"))
    entries = index.nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node").collect()
    start = F.array(*[F.lit(r.node).cast("bigint") for r in entries]).cast("array<bigint>")
    own = index.nodes.select("vec", "node")
    groups = groups.join(own, "vec", "left").select("q", "vec", "asking", F.when(F.col("node").isNotNull(), F.array("node")).otherwise(start).alias("ahead"))
    groups = materialize(groups, "groups")
    empty = F.array()
    state = groups.select("q", F.col("vec").cast("array<double>").alias("vec"), empty.cast("array<bigint>").alias("near"), empty.cast("array<double>").alias("score"), empty.cast("array<boolean>").alias("done"), "ahead")
    state = materialize(state, "state")
    while not state.where(F.size("ahead") > 0).isEmpty():
        front = state.where(F.size("ahead") > 0)
        bar = F.when(F.size("score") >= beam, F.element_at("score", -1)).otherwise(F.lit(float("-inf")))
        steps = front.select("q", F.explode("ahead").alias("node"))
        # the nodes that a step leads to, and the node itself
        led = steps.join(index.graph, "node", "left").select("q", F.explode(F.concat(F.coalesce("near", F.array()), F.array("node"))).alias("other"))
        wanted = led.groupBy("q", F.shiftright("other", BLOCK_BITS).alias("block")).agg(F.collect_set("other").alias("near"))
        requests = materialize(wanted.join(front.select("q", "vec", bar.alias("bar")), "q"), "requests")
        after = materialize(_merged(state, _answers(requests, index), beam, width), "state")
        discard(state, requests)
        state = after
    # the best nodes, and those that tie with the last of them, for which the ids decide
    last = F.coalesce(F.get("score", F.lit(n)), F.lit(float("-inf")))
    best = state.select("q", F.explode(F.filter(F.arrays_zip("near", "score"), lambda b: b["score"] >= last)).alias("b")).select("q", F.col("b.near").alias("node"), "b.score")
    named = best.join(index.nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("id"))
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "id"))
    top = named.withColumn("place", place).where(F.col("place") <= n + 1)
    top = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("top"))
    top = materialize(top.join(groups.select("q", "asking"), "q"), "top")
    total = asked.count()
    of = materialize(asked.join(groups.select("vec", "q"), "vec").select(F.col("id").alias("query_id"), "q"), "asked")
    found = join_unique(of, top, "q", total, "asking")
    others = F.slice(F.filter("top", lambda t: t["id"] != F.col("query_id")), 1, n)
    found = found.select("query_id", F.posexplode(others).alias("at", "t"))
    return found.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("t.id").alias("vec_id"), "t.score")
