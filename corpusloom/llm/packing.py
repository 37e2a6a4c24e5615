"""Packing of documents into sequences: first-fit decreasing with a tournament tree, in random groups.

A document's ids are cut into pieces as long as a sequence and one shorter rest. A piece as long as a sequence
fills one by itself, as it would in first-fit decreasing. The rests are dealt into groups by a hash of their
place in the input; within a group they go, longest first, each into the first sequence with room, which a
tournament tree of the remaining capacities finds in logarithmic time. Groups have about ``group_size`` rests,
whatever the input, so a task's memory is bounded and groups are packed independently.

A sequence whose fill isn't a power of two is padded to the sequence length; with thousands of rests in a group
all but the last sequences of a group are full or nearly so.

Defined results: a null or empty text is one piece with the end id alone; a null id is kept; repeated rows are
packed each by itself; of rests of equal length the one with the lower place goes first.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHE_BYTES, CACHE_KEY, map_batches, materialize

SEQUENCE = 2048
#: Rests in a group, about.
GROUP_SIZE = 8192
#: Punctuation that, after a letter or digit, always begins a piece of its own.
TAIL = "!#$%&()*,-./:;?@[]_{|}~\"+="

#: Letters that are composed already and whose lower case is one letter, whatever stands beside them; a word of them is one piece.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
of_letters = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def ends_plainly(core: str) -> bool:
    """Does it end in a letter or digit once it is composed and in lower case, as the library does first? A mark would join the punctuation."""
    if core[-1].isascii():
        return core[-1].isalnum()
    last = unicodedata.normalize("NFC", core).lower()[-1]
    return last < "\u2e80" and unicodedata.category(last)[0] in "LN"


class WordTokenizer:
    """Ids of the tokenizers library, with a cache of words: its split never crosses a blank or line feed."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.cache: dict[str, bytes] = {"": b""}
        self.held = 0
        self.model = self.tokenizer.model
        self.as_bytes, self.plain = self._letters()

    def _letters(self) -> tuple[dict[int, str], bool]:
        """What the library makes of each letter before it merges, and whether it makes a word of letters one piece of these."""

        def pieces(word: str) -> list[str]:
            normal, split = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
            word = normal.normalize_str(word) if normal else word
            return [p for p, _ in split.pre_tokenize_str(word)] if split else [word]

        table = {ord(c): "".join(pieces(c)) for c in LETTERS if not c.isascii()}
        return table, pieces(LETTERS + LETTERS.upper().replace("SS", "ß").replace("\u0178", "ÿ")) == [2 * LETTERS.translate(table)]

    def _ids(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _ids_of_letters(self, word: str) -> bytes:
        """The same of a word of LETTERS: the model's merges alone, a third of the library's time for such a word."""
        ids = [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.as_bytes))]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _keep(self, word: str, ids: bytes) -> bytes:
        """As ``Memo`` keeps values; written out here, as half of the time goes into words met for the first time."""
        if len(word) <= CACHE_KEY:
            self.held += 220 + len(word) + len(ids)
            if self.held > CACHE_BYTES:
                self.cache.clear()
                self.cache[""], self.held = b"", 0
            self.cache[word] = ids
        return ids

    def word(self, word: str) -> bytes:
        """By parts where the library's split does the same: before trailing punctuation, if a letter or digit precedes it."""
        found = self.cache.get(word)
        if found is not None:
            return found
        if self.plain and of_letters(word):
            lower = word.lower()
            return self._keep(word, self._ids_of_letters(word) if lower == word else self.word(lower))
        core = word.rstrip(TAIL)
        if core and core != word and "<|" not in word and ends_plainly(core):
            return self._keep(word, self.word(core) + self.word(word[len(core) :]))
        if word.isascii() and not word.islower() and "<|" not in word and word.isalpha():
            return self._keep(word, self.word(word.lower()))
        return self._keep(word, self._ids(word))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if "<|" in text and any(str(t) in text for t in self.special()):
            return self._ids(text)
        get, word = self.cache.get, self.word
        return b"".join([get(w) or word(w) for w in text.replace("\n", " ").split(" ")])

    def special(self) -> list[str]:
        return [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]


_loaded: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def forget() -> None:
    """Let go of the tokenizers that this process has read, with their words; they are read again when asked for."""
    _loaded.clear()


class Tournament:
    """The remaining capacity of bins as leaves; each inner node has the larger of its two."""

    def __init__(self, leaves: int, capacity: int):
        self.base = 1 << max(0, leaves - 1).bit_length()
        self.room = [capacity] * (2 * self.base)

    def place(self, size: int) -> int:
        """Take size from the first bin with room for it; its number."""
        room, node = self.room, 1
        while node < self.base:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        leaf = node - self.base
        while node > 1:
            node >>= 1
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left > right else right
        return leaf


def first_fit_decreasing(sizes, capacity: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """For each size, in the order given: its bin and its offset there."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    tree = Tournament(len(sizes), capacity)
    bins, offsets, fill = [0] * len(sizes), [0] * len(sizes), [0] * len(sizes)
    for i in order:
        b = tree.place(sizes[i])
        bins[i], offsets[i] = b, fill[b]
        fill[b] += sizes[i]
    return bins, offsets


def cut_pieces(
    df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, length: int = SEQUENCE
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32 and doc_tokens."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        words, end, width = word_tokenizer(path), np.array([end_id], "<u4").tobytes(), 4 * length
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = words.encode_bytes(text) + end
                for at in range(0, len(ids), width):
                    piece = ids[at : at + width]
                    for column, value in zip(out, (doc, at // 4, len(piece) // 4, zlib.crc32(piece), len(ids) // 4), strict=True):
                        column.append(value)
            yield dict(zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), out, strict=True))

    return map_batches(df, run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def pack(
    df: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 1,
    length: int = SEQUENCE,
    group_size: int = GROUP_SIZE,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset."""
    cut = cut_pieces(df, path, id_col, text_col, end_id, length)
    pieces = materialize(cut.withColumn("place", F.monotonically_increasing_id()), "pieces")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    rests = pieces.where(F.col("length") < length)
    groups = max(1, -(-rests.count() // group_size))
    rests = rests.withColumn("group", F.pmod(F.xxhash64("place"), F.lit(groups)))

    def run(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        batch = batch.sort_by("place")
        bins, offsets = first_fit_decreasing(batch.column("length").to_pylist(), length)
        base = key[0].as_py() << 24
        return pa.table(
            {c: batch.column(c) for c in columns}
            | {"sequence_id": pa.array([base | b for b in bins], pa.int64()), "offset": pa.array(offsets, pa.int64())}
        )

    packed = rests.groupBy("group").applyInArrow(
        run, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
    )
    alone = pieces.where(F.col("length") == length).select(
        *columns, (-1 - F.col("place")).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset")
    )
    return alone.unionByName(packed)
