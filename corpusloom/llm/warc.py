"""WARC archives: writing with revisits, and reading by boundary-chain verification.

Writing: of records with equal payloads the one with the least page id is a response and the others, which
hold no payload but its digest and length, revisit it. Archives are written by Spark's text writer, so on any file system: a record's end, two line
breaks, is the separator of lines, and an archive has about ``records`` records.

Reading: archives are split like any text, at the magic of a record. A piece between two magics may be a record, or lie
inside a payload that holds the magic itself. Tasks measure each piece and read from its header where its
record would end: a candidate edge from the record's offset to its successor's. The lengths add up to
offsets within the file, and pointer jumping from the file's start (the reachable set is joined with the jumps of
1, 2, 4, ... records) keeps only records that a chain of lengths leads to. Only these small rows are brought
together, by file; payloads aren't. A payload's length and digest are computed where its piece is read; a payload
with a magic inside is put together from its pieces in a second pass, which runs only if there is one.

A file that doesn't begin with a record, or whose chain stops before its end, is an error, as what follows would be lost. A magic in an
address is escaped.

Defined results: a null html counts as empty; records with a null page id are always responses and nobody
revisits them; rows that repeat the least page id are all responses; an empty table gives no archive and an empty result.
"""

from __future__ import annotations

import hashlib
import re
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_unique, map_batches, materialize, scratch_path

#: What records begin with, and what ends them.
MAGIC = "WARC/1."
END = "\r\n\r\n"
RECORDS = 4096
#: Revisits that are broadcast, at most (about 10 MB), so that the payloads needn't be shuffled.
BROADCAST_ROWS = 100_000


def base32_of_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: each ten hexadecimal digits are eight of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, digest, and refers_to: for revisits the least page id with the payload, else null."""
    pages = pages.select("page_id", "url", "payload", base32_of_sha1(F.col("payload")).alias("digest"))
    keys = pages.where(F.length("payload") >= least_bytes).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    # only payloads that occur more than once, by page: the payloads themselves aren't shuffled, and those of many pages are broadcast
    later = join_unique(keys, firsts.where("n > 1"), "digest", pages.count(), "n").where(F.col("page_id") > F.col("first"))
    later = later.select(F.col("page_id").alias("later"), F.col("first").alias("refers_to"), F.col("digest").alias("of")).distinct()
    later = materialize(later, "revisits")
    if later.count() <= BROADCAST_ROWS:
        later = F.broadcast(later)  # else both sides are shuffled by page and digest
    joined = pages.join(later, (pages.page_id == later.later) & (pages.digest == later.of), "left")
    return joined.select("page_id", "url", "payload", "digest", "refers_to")


def record(page_id: Column, url: Column, payload: Column, digest: Column, refers_to: Column) -> Column:
    """A record without what ends it, as a string of the very bytes."""
    line = "\r\n"
    http = F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=utf-8{line}{line}")
    body = F.when(refers_to.isNull(), F.concat(http, payload)).otherwise(http)
    # a line break in an address would end the header, and a magic would cut it
    uri = F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\x00-\x20]+", "%20")
    uri = F.replace(uri, F.lit(MAGIC), F.lit(MAGIC.replace("/", "%2F")))

    def header(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit(line))

    known = F.coalesce(header("WARC-Page-ID", page_id.cast("string")), F.lit(""))
    revisit = F.concat(
        F.lit(f"WARC-Type: revisit{line}WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest{line}"),
        header("WARC-Refers-To", F.concat(F.lit("<urn:page:"), refers_to.cast("string"), F.lit(">"))),
        header("WARC-Payload-Length", F.octet_length(payload).cast("string")),
    )
    kind = F.when(refers_to.isNull(), F.lit(f"WARC-Type: response{line}")).otherwise(revisit)
    return F.concat(
        F.lit(f"WARC/1.0{line}"),
        kind,
        header("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))),
        known,
        header("WARC-Target-URI", uri),
        F.lit(f"WARC-Date: 2000-01-01T00:00:00Z{line}"),
        header("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        F.lit(f"Content-Type: application/http; msgtype=response{line}"),
        header("Content-Length", F.octet_length(body).cast("string")),
        F.lit(line),
        body,
    )


def write_archives(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", records: int = RECORDS,
    least_bytes: int = 0,
) -> None:
    """A record for each row of df, in archives under path."""
    pages = df.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("payload"),
    )
    marked = mark_revisits(pages, least_bytes)
    rows = marked.select(record(*(F.col(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))).alias("value"))
    rows.write.option("lineSep", END).option("maxRecordsPerFile", records).text(path)


HEADER_END = re.compile(rb"\r\n\r\n")


def headers_of(piece: bytes) -> tuple[int, dict[bytes, bytes]] | None:
    """Length of a record's header, from what follows the magic, and its fields; None if it isn't one."""
    end = HEADER_END.search(piece)
    if not end or not re.match(rb"[01]\r\n", piece):
        return None
    fields = {}
    for line in piece[3 : end.start()].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower()] = value.strip()
    if not re.fullmatch(rb"[0-9]{1,18}", fields.get(b"content-length", b"")):
        return None
    return end.end(), fields


def payload_of(block: bytes) -> bytes:
    """What follows the HTTP header of a record's block."""
    at = block.find(b"\r\n\r\n")
    return block[at + 4 :] if at >= 0 else block


def base32(payload: bytes) -> str:
    return b32encode(hashlib.sha1(payload).digest()).decode()


def _number(text: bytes) -> int | None:
    got = re.search(rb"-?[0-9]{1,19}", text)
    return int(got[0]) if got else None


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """Of all archives under path: file, block (where the split begins), value (the bytes behind a magic)."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


FACTS = (
    "file string, block bigint, number bigint, length bigint, ends bigint, page_id bigint, type string, refers_to bigint, payload_bytes bigint, digest string"
)


def candidates(split: DataFrame) -> DataFrame:
    """A small row for each piece: its number in its split, its length, where its record would end from its magic on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, number = None, 0
        names = [f.strip().split(" ")[0] for f in FACTS.split(",")]
        for b in batches:
            out: list[list] = [[] for _ in names]
            for file, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                number = number + 1 if (file, block) == at else 0
                at = (file, block)
                row = [file, block, number, len(value), None, None, None, None, None, None]
                if got := headers_of(value):
                    head, fields = got
                    length = int(fields[b"content-length"])
                    row[4] = len(MAGIC) + head + length + len(END)
                    row[5] = _number(fields.get(b"warc-page-id", b""))
                    row[6] = fields.get(b"warc-type", b"").decode("latin-1")
                    row[7] = _number(fields.get(b"warc-refers-to", b"")) if row[6] == "revisit" else None
                    if head + length + len(END) == len(value) and row[6] == "response":
                        payload = payload_of(value[head : head + length])
                        row[8], row[9] = len(payload), base32(payload)
                    elif row[6] == "revisit":
                        row[8] = _number(fields.get(b"warc-payload-length", b""))
                        row[9] = fields.get(b"warc-payload-digest", b"").decode("latin-1").removeprefix("sha1:")
                for column, x in zip(out, row, strict=True):
                    column.append(x)
            yield dict(zip(names, out, strict=True))

    return map_batches(split, run, FACTS)


def reachable(offsets: np.ndarray, successors: np.ndarray) -> np.ndarray:
    """Which records a chain from the first offset reaches, by pointer jumping. successors: offsets, -1 for none."""
    n = len(offsets)
    at = np.searchsorted(offsets, successors)
    jump = np.where((at < n) & (offsets[np.minimum(at, n - 1)] == successors), at, n)
    jump = np.r_[jump, n]  # n: nowhere
    found = np.zeros(n + 1, bool)
    found[0] = n > 0
    reach = 1
    while reach <= n:
        found[jump[np.flatnonzero(found)]] = True
        jump = jump[jump]
        reach *= 2
    return found[:n]


def chain(facts: pa.Table) -> pa.Table:
    """Of one file's candidates the records, with offset, and pieces: how many pieces each has."""
    facts = facts.sort_by([("block", "ascending"), ("number", "ascending")])
    length = facts.column("length").to_numpy()
    ends = np.where(np.asarray(facts.column("ends").is_null()), -1, facts.column("ends").fill_null(-1).to_numpy())
    # the first piece is what stands before the first magic
    offsets = np.cumsum(length)[:-1] + len(MAGIC) * np.arange(len(length) - 1)
    successors = np.where(ends[1:] < 0, -1, offsets + ends[1:])
    good = reachable(offsets, successors)
    rows = np.flatnonzero(good)
    whole = int(length.sum()) + len(MAGIC) * (len(length) - 1)
    if length[0] or (len(rows) and successors[rows[-1]] != whole) or not len(rows) and whole:
        raise ValueError(f"{facts.column('file')[0]}: the chain of records stops before the file's end")
    spans = np.diff(np.r_[rows, len(offsets)])
    out = facts.take(pa.array(rows + 1))
    return out.append_column("offset", pa.array(offsets[rows], pa.int64())).append_column("pieces", pa.array(spans, pa.int64()))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records under path: page_id, payload_bytes, payload_digest, record_type and refers_to."""
    facts = candidates(pieces(spark, path))
    records = facts.groupBy("file").applyInArrow(chain, f"{FACTS}, offset bigint, pieces bigint")
    records = materialize(records, "records")
    cut = records.where("type = 'response' and digest is null")
    if not cut.isEmpty():
        records = _mend(spark, path, records, cut)
    records = records.where("type in ('response', 'revisit')")
    if not records.where("payload_bytes is null").isEmpty():
        records = _lengths(records)
    return records.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


def _lengths(records: DataFrame) -> DataFrame:
    """For revisits of other writers, which don't say it: the length of the payload they refer to."""
    responses = records.where("type = 'response' and page_id is not null").groupBy(
        F.col("page_id").alias("response"), F.col("digest").alias("of")
    ).agg(F.max("payload_bytes").alias("of_response"))
    of = records.where("payload_bytes is null").groupBy(F.col("refers_to").alias("response"), F.col("digest").alias("of")).agg(F.count("*").alias("n"))
    known = of.join(responses, ["response", "of"]).select(F.struct("response", "of").alias("key"), "of_response", "n")
    rows = records.withColumn("key", F.when(F.col("payload_bytes").isNull(), F.struct(F.col("refers_to").alias("response"), F.col("digest").alias("of"))))
    short = rows.where("payload_bytes is null")
    found = join_unique(short, known, "key", short.count(), "n").withColumn("payload_bytes", F.col("of_response")).drop("of_response")
    lost = short.join(known.select("key"), "key", "left_anti")
    whole = rows.where("payload_bytes is not null")
    return whole.unionByName(found).unionByName(lost).drop("key")


def _mend(spark: SparkSession, path: str, records: DataFrame, cut: DataFrame) -> DataFrame:
    """Length and digest of payloads that hold a magic, from all of their pieces."""

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        at, number = None, 0
        for b in batches:
            numbers = []
            for file, block in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                number = number + 1 if (file, block) == at else 0
                at = (file, block)
                numbers.append(number)
            yield {"file": b.column(0), "block": b.column(1), "number": numbers, "value": b.column(2)}

    whole = map_batches(pieces(spark, path), numbered, "file string, block bigint, number bigint, value binary")
    # numbers of the pieces within the file, from their counts in the splits
    facts = candidates(pieces(spark, path)).select("file", "block", "number")
    counts = facts.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = counts.alias("a").join(counts.alias("b"), F.expr("a.file = b.file and b.block < a.block"), "left")
    before = before.groupBy(F.expr("a.file").alias("file"), F.expr("a.block").alias("block")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("base"))
    heads = cut.join(before, ["file", "block"]).select(
        "file", "offset", F.explode(F.sequence(F.col("base") + F.col("number"), F.col("base") + F.col("number") + F.col("pieces") - 1)).alias("place")
    )
    wanted = heads.join(before, "file").where("place >= base")
    last = wanted.groupBy("file", "offset", "place").agg(F.max("base").alias("base"))
    wanted = last.join(before, ["file", "base"]).select("file", "offset", "place", "block", (F.col("place") - F.col("base")).alias("number"))
    got = whole.join(wanted, ["file", "block", "number"]).select("file", "offset", "place", "value")

    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("place")
        value = MAGIC.encode().join(batch.column("value").to_pylist())
        head, fields = headers_of(value)
        payload = payload_of(value[head : head + int(fields[b"content-length"])])
        return pa.table({"file": [key[0].as_py()], "offset": [key[1].as_py()], "mended": [len(payload)], "of": [base32(payload)]})

    mended = got.groupBy("file", "offset").applyInArrow(run, "file string, offset bigint, mended bigint, of string")
    joined = records.join(mended, ["file", "offset"], "left")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "mended")).withColumn("digest", F.coalesce("digest", "of")).drop("mended", "of")


def round_trip(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write the rows of df to archives in the shared folder and read them back."""
    path = scratch_path(df.sparkSession, "warc")
    write_archives(df, path, id_col, url_col, html_col, least_bytes=least_bytes)
    return read_archives(df.sparkSession, path)
