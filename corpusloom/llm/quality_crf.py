"""Quality rules by line sequence labelling.

Each line of a text is an observation of a linear-chain conditional random field with two labels, boilerplate
(0) and content (1). Viterbi decoding marks the lines, and a document is kept if lines marked as content hold
at least ``share`` of its words. Fixed rules on word counts reject some documents beforehand.

The field is fitted on at most ``sample`` labelled documents of each class, those with the least hash of their id. Lines have no
labels of their own: they are latent, and what is fitted is the document. The expected share of words in content lines, by
the field's marginals, is to tell good documents from bad ones: the likelihood of the documents' labels under a logistic function of it
is ascended, so steps and weights are learned together. A labelled text of more than ``lines`` lines gives so many consecutive ones,
from a place that its id's hash chooses; their features are those of the whole text. Without labelled rows of both classes ``DEFAULT`` is used.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; a null id is kept;
repeated rows each give a row; rows with a null label aren't used. Row by row, whole texts; only the ids of the sample and
the features of its lines reach the driver, both bounded by ``sample`` and ``lines``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, map_rows

SYMBOLS = "#*$%&|<>"
#: Labelled documents of a class that the fit uses, at most, and lines of one of them.
SAMPLE = 600
SAMPLE_LINES = 512
SHARE = 0.5
#: How sharply a document's label follows from its share; and the fit's penalty on squared weights, of lines and of steps alike.
SHARPNESS, PENALTY = 20.0, 0.1
ROUNDS = 150
FEATURES = (
    "bias", "symbols>0", "symbols>.1", "symbols>.3", "upper>.3", "upper>.7", "digits>.2", "marks>.3", "marks>.7",
    "repeated line", "repeated words>.5", "one or two words", "long words", "short words", "few letters",
)
N = len(FEATURES)


@dataclass(frozen=True)
class Field:
    """Weights for content (those of boilerplate are 0); step[a][b]: from label a to b; first: of the first line."""

    weights: tuple[float, ...]
    step: tuple[tuple[float, float], tuple[float, float]]


#: What holds if there is nothing to fit on: symbols, capitals and repetition speak for boilerplate.
DEFAULT = Field(
    (2.0, -0.5, -2.0, -2.0, -1.5, -2.5, -1.0, -1.0, -1.0, -2.0, -2.0, -0.5, -1.0, -0.5, -1.5), ((0.5, -0.5), (-0.5, 0.5))
)


def word_codes(words: list[bytes]) -> np.ndarray:
    codes = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(codes.__getitem__, words), np.int64, len(words))


def repeated(codes: np.ndarray) -> np.ndarray:
    """Which words stand in a window of three that occurs twice or more."""
    n = len(codes)
    covered = np.zeros(n, bool)
    if n < 4:
        return covered
    span = int(codes.max()) + 1
    _, pairs = np.unique(codes[:-1] * span + codes[1:], return_inverse=True)
    _, back, count = np.unique(pairs[:-1] * span + codes[2:], return_inverse=True, return_counts=True)
    twice = count[back] > 1
    for i in range(3):
        covered[i : n - 2 + i] |= twice
    return covered


def line_features(line: str, words: int, again: bool, covered: float) -> int:
    """The features that hold, as bits."""
    n = max(1, len(line) - line.count(" "))
    symbols = sum(map(line.count, SYMBOLS)) / max(1, words)
    letters = sum(map(str.isalpha, line)) if not line.isascii() else len(line.translate(LETTERS_ONLY))
    upper = 0 if line.islower() else sum(map(str.isupper, line))
    digits = sum(map(line.count, "0123456789"))
    marks = sum(map(line.count, "!?|@^~=_")) / max(1, words)
    mean = n / max(1, words)
    bits = (
        True, symbols > 0, symbols > 0.1, symbols > 0.3, upper > 0.3 * n, upper > 0.7 * n, digits > 0.2 * n, marks > 0.3,
        marks > 0.7, again, covered > 0.5, words < 3, mean > 14, mean < 2.5, letters < 0.6 * n,
    )
    return sum(1 << i for i, b in enumerate(bits) if b)


LETTERS_ONLY = {i: None for i in range(128) if not chr(i).isalpha()}


def describe(text: str) -> tuple[tuple[int, int, int, int, int], list[int], list[int]]:
    """(words, word characters, symbols, repeated lines, repeated words); of each line with a word: features, words."""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    covered = [0, *np.cumsum(repeated(word_codes(words))).tolist()]
    features, counts, seen, dup, at = [], [], set(), 0, 0
    for line in text.split("\n"):
        k = len(line.encode().split())
        if not k:
            continue
        again = line in seen
        dup += again
        seen.add(line)
        features.append(line_features(line, k, again, (covered[at + k] - covered[at]) / k))
        counts.append(k)
        at += k
    white = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    return (n, len(text) - white, symbols, dup, covered[-1]), features, counts


_BITS = 1 << np.arange(N)


def scores(features: list[int], field: Field) -> np.ndarray:
    """The score for content of each line; that for boilerplate is 0."""
    held = (np.asarray(features, np.int64)[:, None] & _BITS) != 0
    return held @ np.asarray(field.weights)


def viterbi(content: list[float], step) -> list[int]:
    """The best labels."""
    (s00, s01), (s10, s11) = step
    a = b = 0.0
    back = []
    for i, c in enumerate(content):
        if i:
            x, y = a + s00, b + s10
            u, v = a + s01, b + s11
            back.append((y > x, v >= u))
            a, b = max(x, y), max(u, v) + c
        else:
            b = c
    label = int(b >= a)
    labels = [label]
    for pair in reversed(back):
        label = int(pair[label])
        labels.append(label)
    return labels[::-1]


def content_share(features: list[int], counts: list[int], field: Field) -> float:
    if not features:
        return 0.0
    labels = viterbi(scores(features, field).tolist(), field.step)
    return sum(k for k, y in zip(counts, labels, strict=True) if y) / sum(counts)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of 2 x 2 matrices (00, 01, 10, 11), each scaled to a largest entry of 1."""
    out = np.stack([a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]])
    return out / out.max(0)


def marginals(content: np.ndarray, step: np.ndarray, first: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """P(content) of each line of texts that follow one another, and P(a, b) of it and the line before (00, 01, 10, 11; 0 for first lines).

    content: the score of each line; first: lines that begin a text; longest: the most lines of a text. Products of the 2 x 2 matrices of
    lines are doubled in length until they reach over any text; what leads from one text to the next has rank one, so they don't mix.
    """
    ways = np.exp(step - step.max()).ravel()[:, None]
    line = np.exp(-np.logaddexp(0, np.stack([content, -content])))  # of the scores 0 and c the exponentials, scaled to a sum of 1
    ahead = np.where(first, 1.0, ways) * line[[0, 1, 0, 1]]
    last = np.r_[first[1:], True]
    behind = np.concatenate([ahead[:, 1:], np.ones((4, 1))], 1)
    behind[:, last] = 1.0
    d = 1
    while d <= longest:
        grown, back = ahead.copy(), behind.copy()
        grown[:, d:] = _product(ahead[:, :-d], ahead[:, d:])
        back[:, :-d] = _product(behind[:, :-d], behind[:, d:])
        ahead, behind, d = grown, back, 2 * d
    a, b = ahead[:2], behind[[0, 2]]
    p = a * b
    pairs = np.zeros((4, len(content)))
    x = a[:, :-1] / a[:, :-1].sum(0)
    pairs[:, 1:] = x[[0, 0, 1, 1]] * ways * (line * b)[[0, 1, 0, 1], 1:]
    pairs[:, 1:] /= pairs[:, 1:].sum(0)
    pairs[:, first] = 0
    return p[1] / p.sum(0), pairs


def shares(documents: list[tuple[list[int], list[int]]], field: Field) -> np.ndarray:
    """The expected share of words in content lines of each document (features and words of its lines)."""
    return _Lines(documents).expected(np.asarray(field.weights), np.asarray(field.step))[0]


class _Lines:
    """The lines of documents, one after another: no document takes more room than its lines."""

    def __init__(self, documents: list[tuple[list[int], list[int]]]):
        sizes = np.array([len(f) for f, _ in documents])
        self.held = (((np.concatenate([np.asarray(f, np.int64) for f, _ in documents]))[:, None] & _BITS) != 0).astype(np.float64)
        self.starts, self.longest, self.sizes = np.r_[0, np.cumsum(sizes)[:-1]], int(sizes.max()), sizes
        self.first = np.zeros(len(self.held), bool)
        self.first[self.starts] = True
        words = np.concatenate([np.asarray(k, np.float64) for _, k in documents])
        self.weight = words / np.repeat(np.add.reduceat(words, self.starts), sizes)

    def expected(self, weights: np.ndarray, step: np.ndarray, tilt: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each document the share; in all the features of content lines, and the steps."""
        p, pairs = marginals(self.held @ weights + tilt, step, self.first, self.longest)
        return np.add.reduceat(self.weight * p, self.starts), p @ self.held, pairs.sum(1).reshape(2, 2)

    def likelihood(self, weights: np.ndarray, step: np.ndarray, y: np.ndarray, share: float, penalty: float) -> float:
        z = SHARPNESS * (self.expected(weights, step)[0] - share) * np.where(y, 1, -1)
        return float(-np.logaddexp(0, -z).sum() - penalty / 2 * ((weights**2).sum() + (step**2).sum()))

    def gradient(self, weights: np.ndarray, step: np.ndarray, y: np.ndarray, share: float, penalty: float) -> tuple[np.ndarray, np.ndarray]:
        """Of ``likelihood``. The slope of a document's share is its covariance with the features: how their expectation moves
        if lines are tilted towards content by their weight in the share."""
        z = SHARPNESS * (self.expected(weights, step)[0] - share)
        tilt = np.repeat(SHARPNESS * (y - 1 / (1 + np.exp(-z))), self.sizes) * self.weight
        e = 1e-4 / max(1e-9, np.abs(tilt).max())
        (_, fu, su), (_, fd, sd) = self.expected(weights, step, e * tilt), self.expected(weights, step, -e * tilt)
        return (fu - fd) / (2 * e) - penalty * weights, (su - sd) / (2 * e) - penalty * step


def fit(
    documents: list[tuple[list[int], list[int], int]], rounds: int = ROUNDS, penalty: float = PENALTY, share: float = SHARE, chain: bool = True
) -> Field:
    """documents: features and words of the lines, and the document's label. chain: False leaves the steps at 0. AdaGrad ascent."""
    documents = [d for d in documents if d[0]]
    if len({y for *_, y in documents}) < 2:
        return DEFAULT
    lines, y = _Lines([d[:2] for d in documents]), np.array([d[2] for d in documents])
    weights, step = np.zeros(N), np.zeros((2, 2))
    sums_w, sums_s = np.full(N, 1e-8), np.full((2, 2), 1e-8)
    for _ in range(rounds):
        grad_w, grad_s = lines.gradient(weights, step, y, share, penalty)
        sums_w += grad_w**2
        sums_s += grad_s**2
        weights = weights + 0.5 * grad_w / np.sqrt(sums_w)
        if chain:
            step = step + 0.5 * grad_s / np.sqrt(sums_s)
    return Field(tuple(weights.tolist()), tuple(map(tuple, step.tolist())))


def fit_on(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, lines: int = SAMPLE_LINES,
) -> Field:
    """Fit on the labelled documents with the least hashes of their ids, ``sample`` of each class."""
    return fit(labelled_lines(df, labels, id_col, text_col, label_col, sample, lines))


def labelled_lines(
    df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    sample: int = SAMPLE, lines: int = SAMPLE_LINES,
) -> list[tuple[list[int], list[int], int]]:
    """What ``fit`` takes; by id, of rows that repeat one the least features."""
    named = labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
    named = named.where(F.col("id").isNotNull())
    ids = {
        row.id: label
        for label in (0, 1)
        for row in named.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample).collect()
    }
    if len(set(ids.values())) < 2:
        return []
    found = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).where(
        F.col("id").isin(list(ids)) & F.col("text").isNotNull()
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            out: list[list] = [[], []]
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, features, words = describe(t)
                at = i * 2654435761 % max(1, len(features) - lines + 1)
                for column, values in zip(out, (features, words), strict=True):
                    column.append(values[at : at + lines])
            yield {"id": b.column(0), "features": out[0], "words": out[1]}

    rows = map_batches(found, run, "id bigint, features array<int>, words array<int>").groupBy("id").agg(F.min(F.struct("features", "words")).alias("m"))
    return [(list(r.m.features), list(r.m.words), ids[r.id]) for r in sorted(rows.collect(), key=lambda r: r.id)]


def quality(
    df: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE, least_words: int = 50
) -> DataFrame:
    """One row per row of df: the id, the counts, ``base_failed``, ``content_share`` and ``kept``."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            got = [verdict(t, field, share, least_words) for t in b.column(1).to_pylist()]
            counts = list(zip(*(c for c, *_ in got), strict=True)) or [[]] * 5
            yield {"doc_id": b.column(0)} | dict(zip(names, map(list, counts), strict=True)) | {
                "base_failed": [f for _, f, _, _ in got], "content_share": [s for _, _, s, _ in got], "kept": [k for *_, k in got]
            }

    schema = "doc_id bigint, " + ", ".join(f"{n} bigint" for n in names) + ", base_failed boolean, content_share double, kept boolean"
    return map_batches(df, run, schema)


def verdict(text: str | None, field: Field, share: float = SHARE, least_words: int = 50) -> tuple:
    counts, features, words = describe(text or "")
    failed = counts[0] < least_words or 100 * counts[4] > 50 * counts[0]
    content = content_share(features, words, field)
    return counts, failed, content, not failed and content >= share


def keep_documents(df: DataFrame, field: Field, text_col: str = "text", share: float = SHARE, least_words: int = 50) -> DataFrame:
    """The rows of df that the rules keep, with all their columns."""
    at = df.columns.index(text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array([verdict(t, field, share, least_words)[3] for t in batch.column(at).to_pylist()], pa.bool_()))

    return map_rows(df, run)
