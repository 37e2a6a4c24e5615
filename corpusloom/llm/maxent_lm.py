"""A hashed maximum-entropy language model with a class-factored softmax.

log P(word | context) = log P(class | context) + log P(bucket | class, context) + log P(word | bucket).

The class (of 32, by the word's last two bytes; the end of a text has its own) and the word's bucket within the class (of 32, by
its hash) are each predicted by a softmax over features of the context that are hashed into a table: the word before (bigram),
the word before that (skip) and both (trigram), and a bias; the second softmax has the class in each of its features. The
words of a bucket, a 1,024th of the vocabulary, have their share of its training tokens, with one added to each count and one
place for unknown words.

Training is distributed: in each of two rounds every task of that round (the partitions take turns) starts from the
broadcast tables, runs AdaGrad steps over its training texts and emits its change; changes are averaged row by row, weighted
by the squared gradients behind them. Each training token updates all four of its features. The score (not the counts, nor
base_score) depends a little on how the rows are dealt into partitions. A table has 2**14 rows, and twice as many for each tenfold of
training text beyond a GB, up to 2**18: 4 MB of both tables at first, 64 MB at most.

Word counts are exact. Texts are encoded once, in the same pass that trains, in blocks of about 24 MB, each with a vocabulary of its
own; the vocabularies (a row for each word and block) are summed by word and return to their block, so no task or driver
ever holds the corpus's vocabulary. A word has one row for each block at most: at 100 TB four million, which the window spills.

Defined results: a null or empty text has the end token alone; a null id is in no remainder class, so it is learned from;
repeated rows are each counted and scored; with nothing to learn from, counts are zero and the tables are zero.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import map_batches, materialize

CLASSES = BUCKETS = 32
#: Bits of the number of rows of a table: at first, and at most.
ROW_BITS, MOST_BITS = 14, 18
#: Training bytes beyond which the tables grow.
SMALL = 1e9
#: Bytes of text in a block, about.
BLOCK = 24 << 20
ROUNDS = 2
#: Tokens of a learning step, and of a batch that is scored.
STEP, BATCH = 1024, 4096
RATE = 0.6
#: Tokens of a row up to which a step adds them one by one, for all rows at once.
FEW = 6
CHUNKS = 64
END = b""
#: Odd multipliers of the context hashes.
MIX = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F)]


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z and splits at the six ASCII blanks; the end token follows."""
    return [*(text or "").encode().lower().split(), END]


def word_class(word: bytes) -> int:
    return 1 + zlib.crc32(word[-2:]) % (CLASSES - 1) if word else 0


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> 3) % BUCKETS


def table_bits(text_bytes: float) -> int:
    """Bits of the number of rows for so much training text."""
    return min(MOST_BITS, ROW_BITS + max(0, int(np.ceil(np.log10(max(1.0, text_bytes / SMALL))))))


def contexts(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the word before each token and of the one before that; 1 where there is none in its text. starts: where texts begin."""
    before, skipped = np.ones_like(hashes), np.ones_like(hashes)
    before[1:] = hashes[:-1]
    skipped[2:] = hashes[:-2]
    before[starts] = skipped[starts] = 1
    second = starts + 1
    skipped[second[second < len(hashes)]] = 1
    return before, skipped


def feature_rows(hashes: np.ndarray, classes: np.ndarray, starts: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of both tables for each token: bigram (half of a table), skip and trigram (a quarter each), and the bias."""
    a, b = (x.astype(np.uint64) for x in contexts(hashes, starts))
    keys = a * MIX[0], b * MIX[1], (a * MIX[2] ^ b * MIX[3]) * MIX[0]
    spans = (0, bits - 1), (1 << (bits - 1), bits - 2), (3 << (bits - 2), bits - 2)
    own = (classes.astype(np.uint64) + np.uint64(1)) * MIX[4]
    kind = np.int32
    first, second = np.empty((4, len(hashes)), kind), np.empty((4, len(hashes)), kind)
    for i, (key, (base, width)) in enumerate(zip(keys, spans, strict=True)):
        shift = np.uint64(64 - width)
        first[i] = (key >> shift).astype(kind) + base
        second[i] = (((key ^ own) * MIX[0]) >> shift).astype(kind) + base
    first[3] = 1 << bits
    second[3] = (1 << bits) + classes
    return first, second


def blank(bits: int) -> list[np.ndarray]:
    return [np.zeros(((1 << bits) + 1, CLASSES), np.float32), np.zeros(((1 << bits) + CLASSES, BUCKETS), np.float32)]


def softmax(table: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = table.take(rows[0], 0)
    for r in rows[1:]:
        out += table.take(r, 0)
    np.minimum(out, 60, out=out)
    np.exp(out, out=out)
    out /= (out @ np.ones((out.shape[1], 1), np.float32)) + np.float32(1e-30)
    return out


def model_scores(tables: list[np.ndarray], hashes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 P(class and bucket | context) of each token."""
    bits = (len(tables[0]) - 1).bit_length() - 1
    rows, targets = feature_rows(hashes, classes, starts, bits), (classes, bucket_of(hashes))
    out = np.zeros(len(hashes))
    for table, own, target in zip(tables, rows, targets, strict=True):
        for at in range(0, len(hashes), BATCH):
            part = slice(at, at + BATCH)
            p = softmax(table, own[:, part])
            out[part] += np.log10(np.maximum(p[np.arange(len(p)), target[part]], 1e-30))
    return out


def residual(table: np.ndarray, rows: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gradient of each token's -ln P by the sum of its rows."""
    g = softmax(table, rows)
    g[np.arange(len(target)), target] -= 1
    return g


def by_row(g: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows, each once, and the sums of g there; rows: those of one kind of feature for each token, or of several kinds, end to end."""
    bits = (len(g) - 1).bit_length()
    keys = np.sort(rows.astype(np.int64).reshape(-1, len(g)) << bits | np.arange(len(g)), axis=None)
    tokens, ordered = keys & ((1 << bits) - 1), keys >> bits
    first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]])
    sizes = np.diff(np.r_[first, len(ordered)])
    sums = g.take(tokens[first], 0)
    at = np.flatnonzero((sizes > 1) & (sizes <= FEW))  # most rows are those of one token, which need no sum
    for k in range(1, FEW):
        sums[at] += g.take(tokens[first[at] + k], 0)
        at = at[sizes[at] > k + 1]
    many = sizes > FEW
    if many.any():
        ends = np.cumsum(sizes[many])
        sums[many] = np.add.reduceat(g.take(tokens[np.repeat(many, sizes)], 0), ends - sizes[many], axis=0)
    return ordered[first], sums


def gradient(table: np.ndarray, rows: np.ndarray, target: np.ndarray, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of one kind of feature, each once, and the gradient of the loss (the sum of -ln P) there."""
    return by_row(residual(table, rows, target), rows[kind])


def learn(table: np.ndarray, mass: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """One AdaGrad step on all features of the tokens; mass: the squared gradients of each row so far."""
    g = residual(table, rows, target)
    # the biases are few rows of many tokens, and apart from those of the other kinds
    bias, own = np.unique(rows[-1], return_inverse=True)
    among = np.zeros((len(bias), len(g)), np.float32)
    among[own, np.arange(len(g))] = 1
    for at, sums in (by_row(g, rows[:-1]), (bias, among @ g)):
        total = mass.take(at) + np.einsum("ij,ij->i", sums, sums)
        mass[at] = total
        sums *= (RATE / np.sqrt(total + 1))[:, None]
        table[at] = table.take(at, 0) - sums


class Trainer:
    """A task's copy of the tables, and what it has learned."""

    def __init__(self, tables: list[np.ndarray]):
        self.before, self.tables = tables, [t.copy() for t in tables]
        self.mass = [np.zeros(len(t), np.float32) for t in tables]
        self.bits, self.steps = (len(tables[0]) - 1).bit_length() - 1, 0

    def add(self, hashes: np.ndarray, classes: np.ndarray, starts: np.ndarray) -> None:
        rows, targets = feature_rows(hashes, classes, starts, self.bits), (classes, bucket_of(hashes))
        for at in range(0, len(hashes), STEP):
            part = slice(at, at + STEP)
            for table, mass, own, target in zip(self.tables, self.mass, rows, targets, strict=True):
                learn(table, mass, own[:, part], target[part])
            self.steps += 1

    def changes(self) -> Iterator[bytes]:
        """The change of each row times its mass, and its mass, in CHUNKS parts of rows of both tables."""
        whole = [np.column_stack([(t - b) * m[:, None], m]) for t, b, m in zip(self.tables, self.before, self.mass, strict=True)]
        for part in np.array_split(np.concatenate(whole).astype(np.float32), CHUNKS):
            yield part.tobytes()


def apply_changes(tables: list[np.ndarray], changes: DataFrame) -> list[np.ndarray]:
    """tables with the mean of the changes (number of the part, bytes), summed part by part."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                values = np.frombuffer(part, np.float32).astype(np.float64)
                sums[c] = sums[c] + values if c in sums else values
        for c, x in sums.items():
            x = x.reshape(-1, CLASSES + 1)
            yield {"chunk": [c], "part": [(x[:, :-1] / np.maximum(x[:, -1:], 1e-20)).astype(np.float32).tobytes()]}

    parts = {r.chunk: np.frombuffer(r.part, np.float32) for r in map_batches(changes.repartition(F.col("chunk")), add, "chunk int, part binary").collect()}
    if not parts:
        return tables
    change = np.concatenate([parts[c] for c in range(CHUNKS)]).reshape(-1, CLASSES)
    cut = len(tables[0])
    return [tables[0] + change[:cut], tables[1] + change[cut:]]


class Numbers(dict):
    """A number for each word that is asked for, from 0 on."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


ENCODED = "block bigint, kind int, number bigint, word binary, count bigint, doc_id bigint, held_out boolean, tokens binary"


def encode(df: DataFrame, tables: list[np.ndarray] | None = None, block: int = BLOCK) -> DataFrame:
    """df: doc_id, text, held_out. Rows of kind 1: a document with the numbers of its words in its block; of kind 0: a word of a
    block; of kind 2, if there are tables: what the task learned from the texts that aren't held out, by the number of the part."""
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        task, k, size = TaskContext.get().partitionId() << 20, 0, 0
        trainer = Trainer(shared.value) if shared.value else None
        numbers = Numbers()
        counts, codes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        learned: list[np.ndarray] = []

        def rows(kind: int, n: int) -> dict:
            return {
                "block": pa.array(np.full(n, task | k)), "kind": pa.array(np.full(n, kind, np.int32)),
                "number": pa.nulls(n, pa.int64()), "word": pa.nulls(n, pa.binary()), "count": pa.nulls(n, pa.int64()),
                "doc_id": pa.nulls(n, pa.int64()), "held_out": pa.nulls(n, pa.bool_()), "tokens": pa.nulls(n, pa.binary()),
            }

        def take_in() -> None:
            nonlocal counts, codes
            if len(codes) < len(numbers):
                new = list(numbers)[len(codes) :]
                codes = np.concatenate([codes, np.fromiter((zlib.crc32(w) << 5 | word_class(w) for w in new), np.int64, len(new))])
            if learned:
                ids = np.concatenate(learned)
                total = np.bincount(ids, minlength=len(numbers))
                total[: len(counts)] += counts
                counts = total
                if trainer:
                    starts = np.r_[0, np.cumsum([len(x) for x in learned])[:-1]]
                    code = codes[ids]
                    trainer.add(code >> 5, code & 31, starts)
                learned.clear()

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                tokens = []
                for text, held in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = words_of(text)
                    size += len(text or "")
                    ids = np.fromiter(map(numbers.__getitem__, words), np.int32, len(words))
                    tokens.append(ids.tobytes())
                    if not held:
                        learned.append(ids)
                take_in()
                yield rows(1, part.num_rows) | {"doc_id": part.column(0), "held_out": part.column(2), "tokens": tokens}
                if size >= block:
                    yield vocabulary_rows(numbers, counts, rows)
                    numbers, counts, codes, k, size = Numbers(), np.zeros(0, np.int64), np.zeros(0, np.int64), k + 1, 0
        if numbers:
            yield vocabulary_rows(numbers, counts, rows)
        if trainer and trainer.steps:
            for c, change in enumerate(trainer.changes()):
                yield rows(2, 1) | {"number": [c], "tokens": [change]}

    return map_batches(df, run, ENCODED)


def train_and_encode(df: DataFrame, rounds: int = ROUNDS, block: int = BLOCK) -> tuple[list[np.ndarray], list[DataFrame]]:
    """df: doc_id, text, held_out. The tables, and the encoded rows of each round."""
    learned = df.where(~F.col("held_out")).agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    tables, out = blank(table_bits(learned)), []
    for k in range(rounds):
        own = df.where(F.spark_partition_id() % rounds == k)
        out.append(materialize(encode(own, tables, block), "encoded"))
        tables = apply_changes(tables, out[-1].where("kind = 2").select(F.col("number").cast("int").alias("chunk"), "tokens"))
    return tables, out


def vocabulary_rows(numbers: dict[bytes, int], counts: np.ndarray, rows) -> dict:
    words = list(numbers)
    total = np.zeros(len(words), np.int64)
    total[: len(counts)] = counts
    return rows(0, len(words)) | {
        "number": pa.array(np.arange(len(words))), "word": pa.array(words, pa.binary()), "count": pa.array(total)
    }


@dataclass(frozen=True)
class Totals:
    """Training tokens and distinct training words of each bucket of each class."""

    tokens: np.ndarray
    words: np.ndarray


def score(
    df: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, block: int = BLOCK
) -> DataFrame:
    """Learn from the rows of df where held_out is false; one row per row of df.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-one unigram), plain_score (the shares of buckets and of words in
    them, without context) and score, all three log10.
    """
    df = df.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out")
    )
    tables, parts = train_and_encode(df, rounds, block)
    encoded = parts[0].withColumn("round", F.lit(0))
    for k, part in enumerate(parts[1:], 1):
        encoded = encoded.unionByName(part.withColumn("round", F.lit(k)))
    # partitions of several rounds have different blocks, as each takes part in one round only
    by_word = Window.partitionBy("word")
    vocabulary = encoded.where("kind = 0").select(
        "block", "number", F.sum("count").over(by_word).alias("count"), (F.min("block").over(by_word) == F.col("block")).alias("first"),
        F.crc32("word").alias("hash"), word_class_column("word").alias("class"),
    )
    vocabulary = materialize(vocabulary, "vocabulary")
    cell = (F.col("class") * BUCKETS + F.shiftright("hash", 3) % BUCKETS).cast("int").alias("cell")
    sums = vocabulary.where(F.col("first") & (F.col("count") > 0)).groupBy(cell).agg(F.sum("count").alias("n"), F.count("*").alias("v")).collect()
    totals = Totals(np.zeros(CLASSES * BUCKETS, np.int64), np.zeros(CLASSES * BUCKETS, np.int64))
    for r in sums:
        totals.tokens[r.cell], totals.words[r.cell] = r.n, r.v
    blocks = vocabulary.where("number = 0").count()

    both = vocabulary.select(
        "block", F.lit(0).alias("kind"), "number", "count", "hash", "class",
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("boolean").alias("held_out"), F.lit(None).cast("binary").alias("tokens"),
    ).unionByName(
        encoded.where("kind = 1").select(
            "block", "kind", "number", "count", F.lit(None).cast("bigint").alias("hash"), F.lit(None).cast("int").alias("class"),
            "doc_id", "held_out", "tokens",
        )
    )
    # a partition for each block, about, however large the input is
    both = both.repartition(max(1, blocks), F.col("block")).sortWithinPartitions("block", "kind", "number")
    shared = df.sparkSession.sparkContext.broadcast((tables, totals))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        tables, totals = shared.value
        n, v = int(totals.tokens.sum()), int(totals.words.sum())
        below = np.log10(totals.tokens + totals.words + 1)
        share = np.log10((totals.tokens + 1) / (n + len(totals.tokens)))
        at, parts = None, []
        counts = hashes = classes = np.zeros(0, np.int64)
        for b in batches:
            blocks, kinds = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(kinds) != 0)) + 1
            for s, e in zip(np.r_[0, cuts].tolist(), np.r_[cuts, b.num_rows].tolist(), strict=True):
                if s == e:
                    continue
                if kinds[s] == 0:
                    if blocks[s] != at:
                        at, parts = blocks[s], []
                    parts.append([b.column(i).slice(s, e - s).to_numpy(zero_copy_only=False) for i in (3, 4, 5)])
                    continue
                if parts:
                    counts, hashes, classes = (np.concatenate(c).astype(np.int64) for c in zip(*parts, strict=True))
                    parts = []
                for i in range(s, e, 64):
                    part = b.slice(i, min(64, e - i))
                    ids = [np.frombuffer(t, np.int32) for t in part.column(8).to_pylist()]
                    sizes = np.array([len(x) for x in ids])
                    starts = np.r_[0, np.cumsum(sizes)[:-1]]
                    ids = np.concatenate(ids)
                    c, cls, h = counts[ids], classes[ids], hashes[ids]
                    plain, cells = np.log10(c + 1), cls * BUCKETS + bucket_of(h)
                    inside = plain - below[cells]
                    model = model_scores(tables, h, cls, starts) + inside
                    yield {
                        "doc_id": part.column(6), "held_out": part.column(7), "n_tokens": pa.array(sizes.astype(np.int64)),
                        "n_known": pa.array(np.add.reduceat((c > 0).astype(np.int64), starts)),
                        "train_tokens": pa.array(np.full(len(sizes), n, np.int64)),
                        "base_score": pa.array(np.add.reduceat(plain, starts) - sizes * np.log10(n + v + 1)),
                        "plain_score": pa.array(np.add.reduceat(inside + share[cells], starts)),
                        "score": pa.array(np.add.reduceat(model, starts)),
                    }

    return map_batches(
        both, run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, plain_score double, score double"
    )


def word_class_column(word: str) -> Column:
    last = F.expr(f"substring({word}, -2)")
    return F.when(F.length(word) == 0, 0).otherwise((1 + F.crc32(last) % (CLASSES - 1)).cast("int")).cast("int")
