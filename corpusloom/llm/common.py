"""Helpers shared by the operators: Arrow mapping, shared-folder tables, table reading."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a worker's cache of words may hold, by estimate, before it is emptied; longer keys aren't kept.
CACHE_BYTES, CACHE_KEY = 160 << 20, 64

#: Arrow batches to and from Python hold at most so many rows and bytes, as a worker holds several copies of one.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


class Memo(dict):
    """make(key) for each key asked for, kept up to CACHE_BYTES by estimate; then all is forgotten and learned anew."""

    def __init__(self, make: Callable[[Any], Any], most: int = CACHE_BYTES):
        self.make, self.most, self.held = make, most, 0

    def __missing__(self, key):
        value = self.make(key)
        if len(key) <= CACHE_KEY:
            cost = 220 + len(key) + (len(value) if isinstance(value, bytes) else 0)  # the dictionary's slot, two objects and what they hold
            self.held += cost
            if self.held > self.most:
                self.clear()
                self.held = cost
            self[key] = value
        return value


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster shares. Where none is configured, a temporary one if all runs in one process, else an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
        if chosen.isDefined():
            return chosen.get()
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="corpusloom-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Tables that operators have written and nobody has discarded: path to session.
_scratch: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    _scratch[path] = spark
    return path


def discard(*tables: DataFrame | str) -> None:
    """Delete scratch tables that nothing will read again: what later rows follow from must have been written."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_scratch_path", None)
        if path in _scratch:
            _remove(_scratch.pop(path), path)


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Results of operators called inside are to be consumed inside; at the end, all tables written meanwhile are deleted."""
    before = set(_scratch)
    try:
        yield
    finally:
        discard(*(p for p in list(_scratch) if p not in before))


@atexit.register
def _at_exit() -> None:
    for path, spark in list(_scratch.items()):
        with contextlib.suppress(Exception):  # the session is gone; the folder belongs to the cluster's cleaning
            _remove(spark, path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts the lineage. ``discard`` or ``scratch`` delete it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


#: Rows of one key that are few enough for one task; keys with more are hot. HOT_KEYS bounds what is broadcast.
HOT_ROWS, HOT_KEYS = 1000, 1000


def join_unique(rows: DataFrame, unique: DataFrame, key: str, total: int, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined (inner) with unique, which has one row for each key and, in ``count``, how many of rows have it.

    total: an upper bound on the rows. Keys of at least max(hot_rows, total / HOT_KEYS) rows are at most HOT_KEYS, so they are
    broadcast, and their rows stay where they are; the others are shuffled. Each key is in just one part. Both tables are
    read several times.
    """
    least = max(hot_rows, -(-total // HOT_KEYS))
    if total < hot_rows:
        return rows.join(unique.drop(count), key)
    hot = F.broadcast(unique.where(F.col(count) >= least))
    parts = rows.join(hot.drop(count), key), rows.join(hot.select(key), key, "left_anti").join(unique.where(F.col(count) < least).drop(count), key)
    return parts[0].unionByName(parts[1])


#: Bits of a bitmap of keys: for each key, so that one of 16 others passes, and the powers of two at least and at most (16 MB).
KEY_BITS, LEAST_BITS, MOST_BITS = 16, 16, 27


def may_hold(keys: DataFrame, key: Column) -> Column:
    """True wherever key is among keys (one column, spread like a hash), and for few others: rows that a join need not shuffle are told
    without one. Keys beyond MOST_BITS / KEY_BITS let more others pass. keys is read twice."""
    spark, name = keys.sparkSession, keys.columns[0]
    bits = min(MOST_BITS, max(LEAST_BITS, (KEY_BITS * keys.count()).bit_length()))
    # a sixty-fourth of the bitmap is made in one task
    part, span = F.shiftrightunsigned(name, 58).cast("int").alias("part"), bits - 6

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        parts: dict[int, np.ndarray] = {}
        for b in batches:
            at, bit = b.column(0).to_numpy(), b.column(1).to_numpy()
            for p in np.unique(at).tolist():
                parts.setdefault(p, np.zeros(1 << span, np.uint8))[bit[at == p]] = 1
        for p, x in parts.items():
            yield {"part": [p], "bits": [np.packbits(x, bitorder="little").tobytes()]}

    bit = F.shiftrightunsigned(name, 64 - bits).bitwiseAND(F.lit((1 << span) - 1)).alias("bit")
    made = map_batches(keys.select(part, bit).repartition(F.col("part")), fill, "part int, bits binary").collect()
    whole = np.zeros((64, 1 << span - 3), np.uint8)
    for r in made:
        whole[r.part] = np.frombuffer(r.bits, np.uint8)
    shared = spark.sparkContext.broadcast(whole.ravel())

    @F.arrow_udf("boolean")
    def held(k: pa.Array) -> pa.Array:
        at = k.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array((shared.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return held(key)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to those above, if they are higher; they stay so, as plans read them when they run."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch]) -> DataFrame:
    """mapInArrow of a function that keeps the columns; it gets them by place, whatever their names."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                yield fn(b.slice(at, 256))

    return df.mapInArrow(run, df.schema)


def replace_column(batch: pa.RecordBatch, at: int, values: list) -> pa.RecordBatch:
    columns = list(batch.columns)
    columns[at] = pa.array(values, batch.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def map_batches(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[dict]], schema: str
) -> DataFrame:
    """mapInArrow where fn yields dicts of column values in the order of schema."""
    bound_batches(df.sparkSession)
    types = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in fn(batches):
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols.values(), types, strict=True)],
                schema=types,
            )

    return df.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def crc_mod(column: str, mod: int):
    """crc32 of a column's text form, modulo mod; a null gives -1, so it is in no class."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % mod, F.lit(-1))


def crc32_text(value) -> int:
    return zlib.crc32(str(value).encode())
