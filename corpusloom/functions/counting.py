"""Token counters: a column function from texts to numbers of tokens, for the budgets of chunks."""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .text import estimated_tokens

#: The split of the older byte-level encodings, as their publisher states it. A fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@lru_cache(4)
def encoding(path: str, split: str = SPLIT):
    """A byte-level BPE from a file of ranks (base64 token and rank in each line), read once in a process."""
    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
    return tiktoken.Encoding(path, pat_str=split, mergeable_ranks=ranks, special_tokens={})


def counter(path: str | None = None, split: str = SPLIT) -> Callable[[Column], Column]:
    """Counts by the encoding in the file, whose vocabulary is so a parameter; without one, a token for each four bytes begun."""
    if path is None:
        return estimated_tokens

    @F.arrow_udf(LongType())
    def count(texts: pa.Array) -> pa.Array:
        codec = encoding(path, split)
        return pa.array([None if t is None else len(codec.encode_ordinary(t)) for t in texts.to_pylist()], pa.int64())

    return count
