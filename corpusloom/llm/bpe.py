"""Byte-level BPE: merges by a priority queue over a doubly linked list; decoding by joining vocabulary strings.

Encoding splits a text before merging, as the tokenizer file says: special tokens first, then the pattern's
pieces. A piece's bytes are the symbols of a doubly linked list; a heap holds the rank of each neighbouring
pair with its place. The least entry is taken; it is stale, and skipped, if the pair at that place is no
longer the one whose rank it bears.

Defined results: a null or empty text has no ids and decodes to the empty text; a null id is kept; repeated
rows each give a row. Row by row, whole texts, no shuffle. A worker caches words and pieces, up to a fixed number of bytes.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, Memo, map_batches

#: The split of byte-level BPE, with white space as Unicode has it.
PATTERN = regex.compile(
    r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
)
#: White space besides the blank and the line feed.
RARE_SPACE = re.compile("[\t\x0b-\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PLACE = 40


def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it is printable, else the next from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(spare))
        spare += b not in plain
    return out


def uneven(text: str) -> bool:
    """Does a blank stand beside other white space or at an end? If none does, each blank begins a piece."""
    return (
        "  " in text or "\n " in text or " \n" in text or text[0] == " " or text[-1] == " " or bool(RARE_SPACE.search(text))
    )


class ByteBPE:
    """A tokenizer read from a file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        chars = byte_chars()
        self.first = [vocab[c] for c in chars]
        self.rank = {vocab[a] << 32 | vocab[b]: r << PLACE for r, (a, b) in enumerate(merges)}
        self.merged = [vocab[a + b] for a, b in merges]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = special
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        of_char = {c: b for b, c in enumerate(chars)}
        strings = {i: bytes(of_char[c] for c in t) for t, i in vocab.items() if t not in special}
        strings |= {i: t.encode() for t, i in special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings) + 1)]
        self.pieces = Memo(lambda piece: np.array(self.merge(piece.encode()), "<u4").tobytes(), CACHE_BYTES // 2)
        self.words = Memo(lambda word: b"".join(map(self.pieces.__getitem__, PATTERN.findall(word))), CACHE_BYTES)

    def merge(self, data: bytes) -> list[int]:
        first, rank, merged = self.first, self.rank.get, self.merged
        symbols = [first[b] for b in data]
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r | i for i in range(n - 1) if (r := rank(symbols[i] << 32 | symbols[i + 1])) is not None]
        heapq.heapify(heap)
        place = (1 << PLACE) - 1
        while heap:
            entry = heapq.heappop(heap)
            i = entry & place
            j = after[i]
            if symbols[i] < 0 or j >= n or rank(symbols[i] << 32 | symbols[j]) != entry - i:
                continue  # stale
            new = merged[entry >> PLACE]
            symbols[i], symbols[j] = new, -1
            k, h = after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                if (r := rank(new << 32 | symbols[k])) is not None:
                    heapq.heappush(heap, r | i)
            if h >= 0 and (r := rank(symbols[h] << 32 | new)) is not None:
                heapq.heappush(heap, r | h)
        return [s for s in symbols if s >= 0]

    def _plain(self, text: str) -> bytes:
        if uneven(text):
            return b"".join(map(self.pieces.__getitem__, PATTERN.findall(text)))
        head, *rest = text.split(" ")
        return self.words[head] + b"".join(map(self.words.__getitem__, map(" ".__add__, rest)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if self.split_special is None or not any(s in text for s in self.special):
            return self._plain(text)
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            if i % 2:
                out.append(self.special[part].to_bytes(4, "little"))
            elif part:
                out.append(self._plain(part))
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """Read once in a worker."""
    if path not in _loaded:
        _loaded[path] = ByteBPE(path)
    return _loaded[path]


def bpe_encode(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """One row per row of df: the id and ``ids``, little-endian unsigned 32-bit integers as binary.

    decoded adds ``decoded``, the text that the ids give again.
    """
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [bpe.encode_bytes(t) for t in part.column(1).to_pylist()]
                out = {"doc_id": part.column(0), "ids": ids}
                if decoded:
                    out["decoded"] = [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids]
                yield out

    return map_batches(df, run, "doc_id bigint, ids binary" + ", decoded string" * decoded)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The inverse: the id and ``text``."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(ids_col), F.lit(b"")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bpe = tokenizer(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                yield {
                    "doc_id": part.column(0),
                    "text": [bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(1).to_pylist()],
                }

    return map_batches(df, run, "doc_id bigint, text string")
