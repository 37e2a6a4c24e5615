"""Session helpers."""

from __future__ import annotations

import atexit
import contextlib
import gc
import re
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession


def build(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow."""
    b = SparkSession.builder.master(master).config("spark.sql.shuffle.partitions", partitions)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names. Where none is named, a temporary one if all runs in one process, else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(where or tempfile.mkdtemp(prefix="corpusloom-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Rows and bytes of an Arrow batch at most: a Python worker holds several copies of one.
BATCH_LIMITS = {"maxRecordsPerBatch": 1000, "maxBytesPerBatch": 4 << 20}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's limits of Arrow batches to these, if they are higher; plans read them when they run."""
    for key, most in BATCH_LIMITS.items():
        key = f"spark.sql.execution.arrow.{key}"
        now = int(re.sub(r"\D", "", spark.conf.get(key)) or 0)
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


@contextlib.contextmanager
def side_by_side(spark: SparkSession, folders: int) -> Iterator[None]:
    """Writes that begin in here keep files of up to so many folders open in a task, instead of sorting its rows by folder, which spills them."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, str(max(folders, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """df written to the folder for checkpoints."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _version(spark: SparkSession, path: str) -> tuple:
    """Names, lengths and times of the files of a table."""
    where, files = _file_system(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files.listStatus(where)))


#: Of stored tables.
CODEC = "zstd"


def _passed_on(spark: SparkSession, most: float = 10.0) -> None:
    """Returns when Py4J has told the JVM of all that Python no longer refers to, or after so many seconds."""
    queue, end = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ()), time.monotonic() + most
    while queue and time.monotonic() < end:
        time.sleep(0.05)
    time.sleep(0.05)  # for the one that isn't in the queue any more


def let_go(spark: SparkSession) -> None:
    """Collects the driver's garbage: the shuffle files of queries that are over are deleted then, not when the driver happens to run short of memory.

    The plan of a query that has just ended is held by the events that tell of its end, and by Python's references to it until a thread of
    Py4J has passed them on. Both are waited for.
    """
    with contextlib.suppress(Exception):  # more than ten seconds: they are let go with the next
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    for _ in range(2):  # the first one ends what the second one finds unused
        gc.collect()
        _passed_on(spark)
        spark.sparkContext._jvm.System.gc()


#: What has been made: application, name and sources, to the sources' version, the folder and the session.
_made: dict[tuple, tuple[tuple, str, SparkSession]] = {}


def _remove(spark: SparkSession, path: str) -> None:
    where, files = _file_system(spark, path)
    files.delete(where, True)


def stored(spark: SparkSession, name: str, sources: str, write: Callable[[str], object]) -> str:
    """The folder that write(folder) has filled, once in this application while the table ``sources`` has the same files; a later version replaces it."""
    key, version = (spark.sparkContext.applicationId, name, sources), _version(spark, sources)
    if key in _made:
        if _made[key][0] == version:
            return _made[key][1]
        _remove(spark, _made.pop(key)[1])
    folder = f"{shared_folder(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
    write(folder)
    let_go(spark)
    _made[key] = version, folder, spark
    return folder


def once(spark: SparkSession, key: tuple[str, str], make: Callable[[], DataFrame]) -> DataFrame:
    """What make gives, as Parquet that is written once while the documents in a folder are the same. key: a name and that folder."""
    return spark.read.parquet(stored(spark, key[0], f"{key[1]}/documents.parquet", lambda folder: make().write.option("compression", CODEC).parquet(folder)))


def forget() -> None:
    """Delete all that has been stored."""
    while _made:
        _, folder, spark = _made.popitem()[1]
        _remove(spark, folder)


@atexit.register
def _at_exit() -> None:
    with contextlib.suppress(Exception):  # the session is gone; the folder belongs to the cluster's cleaning
        forget()
