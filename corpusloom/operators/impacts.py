"""A stored index for ranked search: postings by term with their weights, in blocks that know their best one.

What a posting adds to a score doesn't depend on the query but for a factor, so it is computed once, with the document's length and the corpus's
averages in it; a search joins neither. ``write`` lays the postings out as Parquet:

* ``blocks``: in folders by a hash of the term (``bucket``); within them in runs sorted by term, of some shards each: a task writes to all folders as it makes
  the rows, so its rows are never sorted as a whole nor spilled. A row is what a term has in a shard, which is up to ``2 ** SHARD_BITS`` documents of a corpus: the postings (places in the shard, ``at``, each less the one before, and ``code``) and ``best``, the
  largest weight. The folder ``NAMES`` has a row for each shard, with the names of its documents and their ``values`` by place: the different weights that a document's terms have.
  They are few, as they follow from few counts and lengths, so a posting's ``code``, its weight's place among them, is most often 0.
* ``terms``: in the same folders, each term's document frequency, its largest weight (``top``) and the ``factor`` (the idf) by which a search multiplies all its weights.
* ``corpora``: the names behind their numbers. A key is the shard and the place in it; keys have no order, so ties are settled by names.

A search reads the folders of its terms and shuffles the blocks of its terms to their shards, each once for all queries. A shard's task adds up the
scores of each query and returns the best, so what is shuffled after that is a few rows of each query and shard. Sets of queries that are too large to go with a task are joined instead.

Blocks that can't hold one of the k best aren't read on: the k-th score within the best blocks of a query's terms is a bound that the k best reach, and a
block whose best weight, with the largest weights of the query's other terms, stays below it holds no hit. No document among the k best has a posting in such a block, so the result is exact.
Queries of many terms, whose other terms outweigh any block, skip this step.

A frequent term is a row for each shard, so neither building nor searching puts one term in one task. A task makes shards of the documents that it reads, so building shuffles neither documents nor postings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import DEFAULTS, FieldWeight
from ..session import CODEC, bound_batches, side_by_side
from .index import DIGITS, corpus_stats, field_averages, field_document_frequency, idf

SCHEMAS = {
    "blocks": "c int, term string, shard bigint, best double, at array<smallint>, code array<int>, names array<string>, values array<array<double>>, bucket int",
    "terms": "c int, term string, df bigint, top double, factor double, bucket int",
    "corpora": "corpus string, docs bigint, c int, buckets int",
}
#: Folders of an index, and bits of a key that count within a shard (15 at most).
BUCKETS, SHARD_BITS = 32, 12
#: The folder of the documents' names.
NAMES = -1
#: Shards, about, that a task builds at once, if there are many corpora.
SHARDS_OF_A_TASK = 16
#: Rows that a task returns at once.
ROWS_AT_ONCE = 50_000
#: Queries of up to so many terms look for blocks to skip.
FEW_TERMS = 8
#: Terms of all queries, with their query, that are broadcast; more are shuffled.
BROADCAST_ROWS = 100_000
#: Rounding of sums must not make a bound too low.
SLACK = 1e-6


@dataclass(frozen=True)
class Impacts:
    blocks: DataFrame
    terms: DataFrame
    docs: DataFrame
    corpora: DataFrame
    buckets: int
    values: DataFrame


def weights(post: DataFrame, lengths: DataFrame, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b) -> DataFrame:
    """corpus, doc, term and w of BM25. post: corpus, doc, term, tf; lengths: corpus, doc, dl."""
    corpora = corpus_stats(lengths)
    df = post.groupBy("corpus", "term").agg(F.count("*").alias("df")).join(F.broadcast(corpora), "corpus")
    stats = df.select("corpus", "term", "avgdl", idf(F.col("n"), F.col("df")).alias("idf"))
    rows = post.join(lengths, ["corpus", "doc"]).join(stats, ["corpus", "term"])
    return rows.select("corpus", "doc", "term", (F.col("idf") * _saturated(k1, b)).alias("w"))


def _saturated(k1: float, b: float) -> Column:
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))


def _field_part(fields: dict[str, FieldWeight]) -> Column:
    """What a term's tf in a field adds to its wtf."""
    weight, slope = F.lit(0.0), F.lit(0.0)
    for name, f in fields.items():
        weight = F.when(F.col("field") == name, F.lit(f.weight)).otherwise(weight)
        slope = F.when(F.col("field") == name, F.lit(f.b)).otherwise(slope)
    return weight * F.when(F.col("avgdl") > 0, F.col("tf") / (1 - slope + slope * F.col("dl") / F.col("avgdl"))).otherwise(F.col("tf"))


def field_weights(post: DataFrame, lengths: DataFrame, fields: dict[str, FieldWeight] | None = None, k1: float = DEFAULTS.k1) -> DataFrame:
    """corpus, doc, term and w of BM25F. post: corpus, doc, field, term, tf; lengths: corpus, doc, field, dl."""
    n = lengths.groupBy("corpus").agg(F.countDistinct("doc").alias("n"))
    df = field_document_frequency(post).join(F.broadcast(n), "corpus").select("corpus", "term", idf(F.col("n"), F.col("df")).alias("idf"))
    tf = post.join(lengths, ["corpus", "doc", "field"]).join(F.broadcast(field_averages(lengths)), ["corpus", "field"])
    part = _field_part(fields or DEFAULTS.fields)
    wtf = tf.select("corpus", "doc", "term", part.alias("w")).groupBy("corpus", "doc", "term").agg(F.round(F.sum("w"), 12).alias("wtf"))
    return wtf.join(df, ["corpus", "term"]).select("corpus", "doc", "term", (F.col("idf") * F.col("wtf") * (k1 + 1) / (F.col("wtf") + k1)).alias("w"))


def bucket(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def _corpora(lengths: DataFrame, path: str, buckets: int) -> DataFrame:
    """lengths: corpus and dl of each document. corpus, docs, avgdl and c; stored but for avgdl, as many rows as corpora."""
    numbered = corpus_stats(lengths).withColumnRenamed("n", "docs").withColumn("c", F.row_number().over(Window.orderBy("corpus")).cast("int"))
    numbered.withColumn("buckets", F.lit(buckets)).coalesce(1).write.mode("overwrite").parquet(f"{path}/corpora")
    return lengths.sparkSession.read.parquet(f"{path}/corpora")


def _store(docs: DataFrame, path: str, buckets: int, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], one: bool, factor: Column) -> Impacts:
    """docs: c, doc, parts (x, norm, terms: term, tf), each document once; a part is a field. factor: of df and docs (those of the corpus).

    What a term is worth in a document: of the one part, weigh(tf, norm); of several, weigh of the sum of x * tf / norm, and 1.
    Documents are numbered and turned into blocks by the task that reads them; a shard is a run of a task's documents of one corpus.
    """
    spark, size, most = docs.sparkSession, 1 << SHARD_BITS, SHARDS_OF_A_TASK << SHARD_BITS
    schema = SCHEMAS["blocks"].removesuffix(", bucket int")
    types = to_arrow_schema(StructType.fromDDL(schema))

    def postings(b: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Row, term and weight of each posting, by row."""
        parts = b.column(2)
        of_part = np.repeat(np.arange(len(b)), pc.fill_null(pc.list_value_length(parts), 0).to_numpy(zero_copy_only=False))
        x, norm, terms = parts.flatten().flatten()
        sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
        row, x, norm = (np.repeat(v, sizes) for v in (of_part, x.to_numpy(zero_copy_only=False), norm.to_numpy(zero_copy_only=False)))
        term, tf = terms.flatten().flatten()
        tf = tf.to_numpy(zero_copy_only=False).astype(float)
        if one:
            return row, term, weigh(tf, norm)
        coded = term.dictionary_encode()
        width = max(1, len(coded.dictionary))
        each, place = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        total = np.round(np.bincount(place, x * (tf / norm), len(each)), 12)
        return each // width, coded.dictionary.take(pa.array(each % width)), weigh(total, np.ones(len(each)))

    def block(c: int, shard: int, pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        names = [x for n, *_ in pieces for x in n]
        begins = np.cumsum([0, *(len(n) for n, *_ in pieces)])
        at, w = np.concatenate([a + o for (_, a, *_), o in zip(pieces, begins, strict=False)]), np.concatenate([w for *_, w in pieces])
        by_value = np.lexsort((w, at))
        of, v = at[by_value], w[by_value]
        new = np.append(True, (np.diff(of) != 0) | (v[1:] != v[:-1]))[: len(of)]
        begin = np.searchsorted(of[new], np.arange(len(names) + 1))
        value = np.empty(len(at), np.int64)
        value[by_value] = np.cumsum(new) - 1 - begin[of]
        values = pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v[new], pa.float64())))
        head = [[c], [None], [shard], [None], [None], [None], [names]]
        yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(head, types, strict=False)), values.cast(types.field("values").type)], schema=types)
        coded = pa.chunked_array([t for _, _, t, _ in pieces], pa.string()).combine_chunks().dictionary_encode()
        if not len(coded):
            return
        code = coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
        n, offsets, gaps = len(first) - 1, pa.array(first, pa.int32()), np.diff(at[order], prepend=0)
        gaps[first[:-1]] = at[order][first[:-1]]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x, k)) for x, k in ((gaps, pa.int16()), (value[order], pa.int32()))]
        best = pa.array(np.maximum.reduceat(w[order], first[:-1]))
        columns = [pa.array(np.full(n, c), pa.int32()), coded.dictionary, pa.array(np.full(n, shard), pa.int64()), best, *lists, *(pa.nulls(n, f.type) for f in list(types)[6:])]
        yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, types, strict=True)], schema=types)

    def run_of(made: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_term = pa.Table.from_batches(made, schema=types).combine_chunks().sort_by([(k, "ascending") for k in ("term", "c", "shard")])
        made.clear()
        yield from by_term.to_batches(max_chunksize=ROWS_AT_ONCE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, rows, made = TaskContext.get().partitionId() << 32, {}, {}, []
        first = shard
        for b in batches:
            row, term, w = postings(b)
            corpora, names = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for c in np.unique(corpora):
                own = np.flatnonzero(corpora == c)
                while len(own):
                    here, own = np.split(own, [size - rows.get(c, 0)])
                    place = np.full(len(b), -1)
                    place[here] = np.arange(len(here))
                    mine = place[row] >= 0
                    held.setdefault(c, []).append(([names[i] for i in here], place[row[mine]], term.filter(pa.array(mine)), w[mine]))
                    rows[c] = rows.get(c, 0) + len(here)
                    if rows[c] == size:
                        made += block(int(c), shard, held.pop(c))
                        shard, rows[c] = shard + 1, 0
            if sum(rows.values()) >= most:
                for c in sorted(held):
                    made += block(int(c), shard, held.pop(c))
                    shard += 1
                rows.clear()
            if shard - first >= SHARDS_OF_A_TASK:
                yield from run_of(made)
                first = shard
        for c in sorted(held):
            made += block(int(c), shard, held.pop(c))
            shard += 1
        yield from run_of(made)

    bound_batches(spark)
    made = docs.select("c", "doc", "parts").mapInArrow(run, schema)
    made = made.withColumn("bucket", F.when(F.col("names").isNotNull(), NAMES).otherwise(bucket(F.col("term"), buckets)))
    with side_by_side(spark, buckets + 1):
        # the codec finds the frequent ones among gaps and codes; places in a dictionary hide them from it
        plain = {f"parquet.enable.dictionary#{c}.list.element": "false" for c in ("at", "code")}
        made.write.mode("overwrite").option("compression", CODEC).options(**plain).partitionBy("bucket").parquet(f"{path}/blocks")
    blocks = spark.read.schema(SCHEMAS["blocks"]).parquet(f"{path}/blocks").where(F.col("bucket") >= 0)
    # each folder's terms are gathered, counted and written by one task
    rows = blocks.select("bucket", "c", "term", F.size("at").alias("n"), "best").repartition(buckets, "bucket")
    terms = rows.groupBy("bucket", "c", "term").agg(F.sum("n").alias("df"), F.max("best").alias("top"))
    terms = terms.join(F.broadcast(spark.read.parquet(f"{path}/corpora").select("c", "docs")), "c").select("c", "term", "df", "top", factor.alias("factor"), "bucket")
    terms.sortWithinPartitions("bucket", "c", "term").write.mode("overwrite").option("compression", CODEC).partitionBy("bucket").parquet(f"{path}/terms")
    return read(spark, path)


def write(rows: DataFrame, path: str, buckets: int = BUCKETS) -> Impacts:
    """rows: corpus, doc, term, w; each term of a document once. Overwrites path."""
    terms = F.collect_list(F.struct("term", F.col("w").alias("tf")))
    docs = rows.where("term is not null").groupBy("corpus", "doc").agg(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("norm"), terms.alias("terms"))).alias("parts"))
    c = _corpora(rows.select("corpus", "doc", F.lit(1).alias("dl")).distinct(), path, buckets)
    return _store(docs.join(F.broadcast(c.select("corpus", "c")), "corpus"), path, buckets, lambda tf, norm: tf, True, F.lit(1.0))


def write_texts(docs: DataFrame, path: str, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b, buckets: int = BUCKETS) -> Impacts:
    """The index of BM25. docs: corpus, doc, dl, terms (term, tf), each document once.

    Lengths are read first, for their means; then each document once. The idf, for which all shards are counted, is its terms' factor.
    """
    c = _corpora(docs.select("corpus", "dl"), path, buckets)
    norm = 1 - b + b * F.col("dl") / F.col("avgdl")
    parts = F.array(F.struct(F.lit(1.0).alias("x"), norm.alias("norm"), "terms"))
    joined = docs.join(F.broadcast(c.select("corpus", "c", "avgdl")), "corpus").select("c", "doc", parts.alias("parts"))
    return _store(joined, path, buckets, lambda tf, norm: tf * (k1 + 1) / (tf + k1 * norm), True, idf(F.col("docs"), F.col("df")))


def write_fields(
    docs: DataFrame, path: str, fields: dict[str, FieldWeight] | None = None, k1: float = DEFAULTS.k1, buckets: int = BUCKETS, lengths: DataFrame | None = None
) -> Impacts:
    """The index of BM25F. docs: corpus, doc, fields (field, dl, terms: term, tf), each document once. lengths: corpus, field, dl, if there is a shorter way to them."""
    lengths = docs.select("corpus", F.inline("fields")) if lengths is None else lengths
    means = field_averages(lengths).groupBy("corpus").agg(F.map_from_entries(F.collect_list(F.struct("field", "avgdl"))).alias("means"))
    c = _corpora(docs.select("corpus", F.lit(1).alias("dl")), path, buckets)

    def part(f: Column) -> Column:
        weight, slope, mean = F.lit(0.0), F.lit(0.0), F.col("means")[f["field"]]
        for name, of in (fields or DEFAULTS.fields).items():
            weight = F.when(f["field"] == name, F.lit(of.weight)).otherwise(weight)
            slope = F.when(f["field"] == name, F.lit(of.b)).otherwise(slope)
        norm = F.when(mean > 0, 1 - slope + slope * f["dl"] / mean).otherwise(1.0)
        return F.struct(weight.alias("x"), norm.alias("norm"), f["terms"].alias("terms"))

    joined = docs.join(F.broadcast(c.select("corpus", "c")), "corpus").join(F.broadcast(means), "corpus")
    joined = joined.select("c", "doc", F.transform("fields", part).alias("parts"))
    return _store(joined, path, buckets, lambda tf, norm: tf * (k1 + 1) / (tf + k1 * norm), False, idf(F.col("docs"), F.col("df")))


def read(spark: SparkSession, path: str) -> Impacts:
    all_rows, terms, corpora = (spark.read.schema(schema).parquet(f"{path}/{t}") for t, schema in SCHEMAS.items())
    blocks, names = all_rows.where(F.col("bucket") >= 0).drop("names", "values"), all_rows.where(F.col("bucket") == NAMES)
    docs = names.select("shard", F.posexplode("names").alias("at", "doc")).select("doc", _key("at").alias("key"))
    first = corpora.select("buckets").first()
    return Impacts(blocks, terms, docs, corpora, first[0] if first else 1, names.select("c", "shard", "values"))


def _key(at: str) -> Column:
    return F.shiftleft("shard", SHARD_BITS) + F.col(at)


@dataclass(frozen=True)
class _Wanted:
    """rows: query, term and weight, one for each; local: the same in the driver, if they are few; buckets: the folders they read; few: whether a query is short."""

    rows: DataFrame
    local: list[tuple] | None
    buckets: list[int]
    few: bool

    def held(self, df: DataFrame) -> DataFrame:
        """df, which has a row for each of rows and corpus at most, as the side of a join that is broadcast if it is small."""
        return F.broadcast(df) if self.local is not None else df

    def blocks(self, index: Impacts) -> DataFrame:
        return index.blocks.where(F.col("bucket").isin(self.buckets))


def _wanted(index: Impacts, wanted: DataFrame) -> _Wanted:
    rows = wanted.groupBy("query", "term").agg(F.sum("weight").alias("weight")).where("weight > 0")
    got = rows.withColumn("bucket", bucket(F.col("term"), index.buckets)).limit(BROADCAST_ROWS + 1).collect()
    if len(got) > BROADCAST_ROWS:
        return _Wanted(rows, None, list(range(index.buckets)), True)
    local = [tuple(r[:3]) for r in got]
    terms = Counter(r[0] for r in local)
    return _Wanted(rows.sparkSession.createDataFrame(local, rows.schema), local, sorted({r["bucket"] for r in got}), min(terms.values(), default=0) <= FEW_TERMS)


def _dealt(index: Impacts, blocks: DataFrame) -> DataFrame:
    """c, term, shard, at, code and values: the blocks by shard, each shard's after the row of its values."""
    none = {c: F.lit(None).cast(t) for c, t in (("term", "string"), ("at", "array<smallint>"), ("code", "array<int>"), ("values", "array<array<double>>"))}
    values = index.values.select("c", none["term"].alias("term"), "shard", none["at"].alias("at"), none["code"].alias("code"), "values")
    rows = blocks.select("c", "term", "shard", "at", "code", none["values"].alias("values")).unionAll(values)
    return rows.repartition("c", "shard").sortWithinPartitions("c", "shard", "term")  # null comes first


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Of dealt blocks, some of a shard's at a time: c, shard, terms, where each term's postings begin (and the end), places and weights."""
    here, begin, values = None, np.zeros(0), np.zeros(0)
    for b in batches:
        c, shard = b.column(0).to_numpy(), b.column(2).to_numpy()
        cuts = [0, *(np.flatnonzero((np.diff(c) != 0) | (np.diff(shard) != 0)) + 1), len(b)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if lo == hi:
                continue
            if (c[lo], shard[lo]) != here:
                here, own = (c[lo], shard[lo]), b.column(5)[int(lo)].values
                begin, values = own.offsets.to_numpy(), own.values.to_numpy()
                lo += 1
            part = b.slice(lo, hi - lo)
            n = pc.list_value_length(part.column(3)).to_numpy(zero_copy_only=False)
            first = np.append(0, np.cumsum(n, dtype=np.int64))
            sums = np.append(0, np.cumsum(part.column(3).flatten().to_numpy(), dtype=np.int64))
            at = sums[1:] - np.repeat(sums[first[:-1]], n)
            yield int(here[0]), int(here[1]), part.column(1), first, at, values[begin[at] + part.column(4).flatten().to_numpy()]


def _opened(index: Impacts, blocks: DataFrame) -> DataFrame:
    """The blocks' places and weights, as they are: c, term, shard, at and w."""
    schema = "c int, term string, shard bigint, at array<smallint>, w array<double>"
    types = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c, shard, terms, first, at, w in _pieces(batches):
            lists = [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(v, k)) for v, k in ((at, pa.int16()), (w, pa.float64()))]
            columns = [pa.array(np.full(len(terms), c)), terms, pa.array(np.full(len(terms), shard)), *lists]
            yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(columns, types, strict=True)], schema=types)

    return _dealt(index, blocks).mapInArrow(run, schema)


def _scored(blocks: DataFrame) -> DataFrame:
    """blocks: query, c, shard, weight, at, w. The sum for each document."""
    rows = blocks.select("query", "c", "shard", "weight", F.inline(F.arrays_zip("at", "w")))
    return rows.groupBy("query", "c", _key("at").alias("key")).agg(F.sum(F.col("weight") * F.col("w")).alias("score"))


def weighted(index: Impacts, w: _Wanted) -> DataFrame:
    """query, c, term, weight (with the term's factor) and top of the terms that the index has."""
    rows = index.terms.where(F.col("bucket").isin(w.buckets)).join(w.held(w.rows), "term")
    return rows.select("query", "c", "term", (F.col("weight") * F.col("factor")).alias("weight"), "top")


def all_blocks(index: Impacts, w: _Wanted) -> DataFrame:
    """The blocks of the terms of each query: query, c, shard, term, weight, best, at and code."""
    return w.blocks(index).join(w.held(weighted(index, w)), ["c", "term"]).select("query", "c", "shard", "term", "weight", "best", "at", "code")


def bounds(index: Impacts, w: _Wanted, n: int) -> DataFrame:
    """query, c, term, weight and enough: a block whose best is less holds none of the query's n best."""
    tops = weighted(index, w)
    per = Window.partitionBy("query", "c")
    tops = tops.withColumn("all", F.sum(F.col("weight") * F.col("top")).over(per)).withColumn("terms", F.count("*").over(per))
    short = tops.where(F.col("terms") <= FEW_TERMS)
    first = w.blocks(index).join(w.held(short.select("c", "term", "top").distinct()), ["c", "term"]).where(F.col("best") == F.col("top"))
    first = _opened(index, first).join(w.held(short), ["c", "term"])
    place = F.row_number().over(per.orderBy(F.col("score").desc()))
    least = _scored(first).withColumn("place", place).where(F.col("place") == n).select("query", "c", F.col("score").alias("least"))
    # anything is enough where no n documents are known
    enough = F.coalesce((F.col("least") - F.col("all") - SLACK) / F.col("weight") + F.col("top"), F.lit(float("-inf")))
    return tops.join(w.held(least), ["query", "c"], "left").select("query", "c", "term", "weight", enough.alias("enough"))


def matched(index: Impacts, w: _Wanted, n: int) -> DataFrame:
    """The blocks that some query must read for its n best: c, shard, term, at and code."""
    own, shape = w.blocks(index), ("c", "shard", "term", "at", "code")
    if not w.few:
        return own.join(w.held(w.rows.select("term").distinct()), "term").select(*shape)
    least = bounds(index, w, n).groupBy("c", "term").agg(F.min("enough").alias("enough"))
    return own.join(w.held(least), ["c", "term"]).where(F.col("best") >= F.col("enough")).select(*shape)


def _best_of_shards(index: Impacts, blocks: DataFrame, wanted: DataFrame, n: int | None) -> DataFrame:
    """query, c, key and score: in each shard the n best of each query, and what ties with the last; without n all.

    wanted: query, c, term, weight; as few rows as go with a task.
    """
    of: dict = {}
    for query, c, term, weight in wanted.select("query", "c", "term", "weight").collect():
        of.setdefault(c, {}).setdefault(query, []).append((term, weight))
    query_type = wanted.schema["query"].dataType.simpleString()
    shared = blocks.sparkSession.sparkContext.broadcast(of)
    names = ("query", "c", "key", "score")

    def best(c: int, shard: int, postings: dict[str, tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple]:
        size = 1 << SHARD_BITS
        for query, terms in shared.value.get(c, {}).items():
            there = [(postings[t], x) for t, x in terms if t in postings]
            if not there:
                continue
            score = np.zeros(size)
            for (at, w), x in there:
                score[at] += x * w
            hit = np.flatnonzero(score)
            if n is not None and len(hit) > n:
                s = score[hit]
                hit = hit[s >= np.partition(s, len(s) - n)[len(s) - n] - SLACK]
            yield [query] * len(hit), np.full(len(hit), c), (shard << SHARD_BITS) + hit, score[hit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, postings = None, {}

        def batch(found: list[tuple]) -> pa.RecordBatch:
            columns = [[q for f in found for q in f[0]], *(np.concatenate([f[i] for f in found]) for i in (1, 2, 3))]
            return pa.RecordBatch.from_pydict(dict(zip(names, columns, strict=True)), schema=types)

        def result(each: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            found, rows = [], 0
            for f in each:
                found.append(f)
                rows += len(f[0])
                if rows >= ROWS_AT_ONCE:
                    yield batch(found)
                    found, rows = [], 0
            if found:
                yield batch(found)

        for c, shard, terms, first, at, w in _pieces(batches):
            if (c, shard) != here:
                if here is not None:
                    yield from result(best(*here, postings))
                here, postings = (c, shard), {}
            for term, lo, hi in zip(terms.to_pylist(), first.tolist(), first[1:].tolist(), strict=False):
                postings[term] = at[lo:hi], w[lo:hi]
        if here is not None:
            yield from result(best(*here, postings))

    schema = f"query {query_type}, c int, key bigint, score double"
    types = to_arrow_schema(StructType.fromDDL(schema))
    return _dealt(index, blocks).mapInArrow(run, schema)


def scores(index: Impacts, wanted: DataFrame) -> DataFrame:
    """query, corpus, key and score of all documents that score above 0. wanted: query, term, weight (above 0; of a term that comes twice, the sum)."""
    w = _wanted(index, wanted)
    if w.local is not None:
        own = w.blocks(index).join(w.held(w.rows.select("term").distinct()), "term").select("c", "shard", "term", "at", "code")
        found = _best_of_shards(index, own, weighted(index, w), None)
    else:
        found = _scored(_opened(index, w.blocks(index)).join(weighted(index, w), ["c", "term"]))
    found = found.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    return found.join(F.broadcast(index.corpora.select("c", "corpus")), "c").select("query", "corpus", "key", "score")


def search(index: Impacts, wanted: DataFrame, n: int) -> DataFrame:
    """query, corpus, doc, score and rank of the n best of each query and corpus, by (score desc, doc)."""
    w = _wanted(index, wanted)
    if w.local is not None:
        found = _best_of_shards(index, matched(index, w, n), weighted(index, w), n)
    else:
        found = _scored(_opened(index, matched(index, w, n)).join(weighted(index, w), ["c", "term"]))
    found = found.withColumn("score", F.round("score", DIGITS)).where("score > 0")
    by_score = Window.partitionBy("query", "c").orderBy(F.col("score").desc())
    # what ties with the n-th is ranked by its name
    tied = found.withColumn("rank", F.rank().over(by_score)).where(F.col("rank") <= n).drop("rank").join(index.docs, "key")
    place = F.row_number().over(Window.partitionBy("query", "c").orderBy(F.col("score").desc(), "doc"))
    best = tied.withColumn("rank", place.cast("bigint")).where(F.col("rank") <= n)
    return best.join(F.broadcast(index.corpora.select("c", "corpus")), "c").select("query", "corpus", "doc", "score", "rank")
