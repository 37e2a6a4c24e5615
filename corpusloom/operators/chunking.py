"""Token-budgeted chunks of a file's blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import ChunkOptions
from ..functions import paths


def assign(blocks: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """path, position and k, the number of the block's chunk (from 1), before the tail is balanced.

    A block above ``most`` is a chunk by itself. Another one starts a chunk if it is a heading, or if it doesn't fit and the
    chunk holds at least target * flex. Each file's blocks pass in order through one running state; a window
    can't say this, as the state starts anew where the data decide.
    """
    return _assigned(blocks, options).select("path", "position", "k")


def _assigned(blocks: DataFrame, options: ChunkOptions) -> DataFrame:
    """path, position, type, tokens and k."""
    floor = math.floor(options.target * options.flex)
    rows = blocks.select("path", F.col("position").cast("bigint").alias("position"), "type", F.col("tokens").cast("bigint").alias("tokens"))
    rows = rows.repartition(F.col("path")).sortWithinPartitions("path", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, k, size, open_ = None, 0, 0, False
        for b in batches:
            numbers = []
            for path, kind, tokens in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if path != at:
                    at, k, size, open_ = path, 0, 0, False
                if tokens > options.most:
                    k, size, open_ = k + 1, 0, False
                else:
                    if not open_ or kind == "heading" or (size + tokens > options.target and size >= floor):
                        k, size = k + 1, 0
                    size, open_ = size + tokens, True
                numbers.append(k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int64())], names=["path", "position", "type", "tokens", "k"])

    return rows.mapInArrow(run, "path string, position bigint, type string, tokens bigint, k bigint")


def balance_tail(numbered: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """numbered: path, position, type, tokens, k. A last chunk below ``least`` is joined with the one before, or both are cut anew.

    Not if it starts with a heading, or either is oversized. If both fit the target they become one; else the
    blocks of both are cut where the first part is nearest to half (the earliest such place).
    """
    file = Window.partitionBy("path")
    order = file.orderBy("position")
    chunk = Window.partitionBy("path", "k")
    d = numbered.withColumn("last", F.max("k").over(file))
    d = d.withColumn("size", F.sum("tokens").over(chunk)).withColumn("over", F.max("tokens").over(chunk) > options.most)
    d = d.withColumn("first", F.min_by("type", "position").over(chunk))
    tail, before = F.col("k") == F.col("last"), F.col("k") == F.col("last") - 1
    d = d.withColumn("tail_size", F.max(F.when(tail, F.col("size"))).over(file)).withColumn("prev_size", F.max(F.when(before, F.col("size"))).over(file))
    d = d.withColumn("blocked", F.bool_or((tail | before) & F.col("over") | tail & (F.col("first") == "heading")).over(file))
    due = (F.col("last") > 1) & (F.col("tail_size") < options.least) & ~F.col("blocked")
    pooled = due & (F.col("k") >= F.col("last") - 1)
    d = d.withColumn("pooled", pooled).withColumn("both", F.col("tail_size") + F.col("prev_size"))
    run = F.sum(F.when(F.col("pooled"), F.col("tokens"))).over(order)
    d = d.withColumn("run", run).withColumn("place", F.row_number().over(Window.partitionBy("path", "pooled").orderBy("position")))
    off = F.abs(F.col("run") - F.floor(F.col("both") / 2))
    cut = F.min_by("place", F.when(F.col("pooled"), F.struct(off.alias("off"), F.col("place")))).over(file)
    d = d.withColumn("cut", cut).withColumn("n", F.sum(F.col("pooled").cast("int")).over(file))
    merged = (F.col("both") <= options.target) | (F.col("cut") >= F.col("n"))
    k = F.when(~F.col("pooled"), F.col("k")).when(merged | (F.col("place") <= F.col("cut")), F.col("last") - 1).otherwise(F.col("last"))
    return d.select("path", "position", k.cast("bigint").alias("k"))


def number_blocks(blocks: DataFrame, options: ChunkOptions = ChunkOptions()) -> DataFrame:
    """blocks: path, position, type and tokens. path and numbers: that of each block's chunk, by the block's place in the path."""
    found = F.array_sort(F.collect_list(F.struct("position", "k"))).getField("k")
    return balance_tail(_assigned(blocks, options), options).groupBy("path").agg(found.alias("numbers"))


def chunk(blocks: DataFrame, options: ChunkOptions = ChunkOptions(), numbers: DataFrame | None = None) -> DataFrame:
    """blocks: path, position, type, content, tokens, heading (array). One row per chunk.

    id, type, source, heading, sequence, total, tokens, oversized, content and blocks.

    Texts are shuffled once, by path: numbers are found without them and come back as a list for each path, by the block's place.
    numbers: what number_blocks gives for the same blocks, where that is stored, so that its shuffles don't stay beside that of the texts.
    """
    base = blocks.select("path", "position", "type", "content", "tokens", "heading")
    # a stored list is many times as large as its file, by which Spark would judge whether to broadcast it
    numbers = number_blocks(base, options) if numbers is None else numbers.hint("merge")
    placed = base.withColumn("place", F.row_number().over(Window.partitionBy("path").orderBy("position")))
    final = placed.join(numbers, "path").withColumn("k", F.get("numbers", F.col("place") - 1)).drop("numbers", "place")
    block = F.struct("position", "type", "content", "tokens", "heading")
    c = final.groupBy("path", "k").agg(F.array_sort(F.collect_list(block)).alias("blocks"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("largest"))
    file = Window.partitionBy("path")
    c = c.select(
        paths.classify_source(F.col("path")).alias("type"), F.col("path").alias("source"),
        F.array_join(F.col("blocks")[0]["heading"], " > ").alias("heading"), F.col("k").alias("sequence"), F.count("*").over(file).alias("total"), "tokens",
        (F.col("largest") > options.most).alias("oversized"), F.array_join("blocks.content", "\n\n").alias("content"), "blocks",
    )
    digest = F.substring(F.sha2(F.col("content").cast("binary"), 256), 1, options.hash_length)
    return c.withColumn("id", paths.format_id(F.col("type"), digest, F.col("sequence")))


def statistics(chunks: DataFrame) -> DataFrame:
    """By type: chunks, tokens in all, least, most, mean (integers), oversized."""
    return chunks.groupBy("type").agg(
        F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.min("tokens").alias("least"), F.max("tokens").alias("most"),
        F.expr("sum(tokens) div count(*)").alias("mean"), F.count_if("oversized").alias("oversized"),
    )


def collisions(chunks: DataFrame) -> DataFrame:
    """Ids that stand for different contents."""
    hashes = chunks.groupBy("id").agg(F.countDistinct(F.sha2(F.col("content").cast("binary"), 256)).alias("contents"))
    return hashes.where("contents > 1")


def render_file(chunks: DataFrame) -> DataFrame:
    """The text of a chunk's file: a comment with its description, then the content."""
    mark = F.when(F.col("oversized"), "\noversized: true").otherwise("")
    head = F.format_string(
        "<!--\nid: %s\ntype: %s\nsource: %s\nheading: %s\nchunk: %d of %d\ntokens: %d%s\n-->\n\n",
        "id", "type", "source", "heading", "sequence", "total", "tokens", mark,
    )
    return chunks.select("id", "source", F.concat(head, "content", F.lit("\n")).alias("file"))
