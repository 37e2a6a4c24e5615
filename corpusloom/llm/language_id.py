"""Language identification by cross-parsing entropy.

For each language the suffix automaton of some labelled text is built. A text is cut from left to right into
the longest phrases that occur in that text (a phrase ends where the automaton has no transition); the fewer
phrases a language needs, normalised by the logarithm of its automaton's text length and the text's length,
the likelier it is. The language with the least value wins; ties go to the first name.

Symbols are code points: letters and marks in lower case, and one symbol for a run of anything else. Alphabets of any size are told
apart: with up to ``DENSE`` symbols an automaton is a plain table by state and symbol, with more a hash table of the transitions
it has (two places for each, so two look-ups tell if there is one); both parse alike. Texts are cut into windows of ``WINDOW`` symbols that are parsed in lockstep, all windows of some texts at once, each as
if a phrase began with it. Then the state at each window's end is carried into the next one until both parses are in the
same state, mostly after some symbols, and the count of that stretch is put right; so the phrases are those of the whole text.

The fit uses at most ``docs`` documents of a language, those with the least hash of their id, and at most
``chars`` characters of them (fewer each if there are many languages); these bounds hold for any input. Each
document gives an equal share of them; what short ones leave goes to the longer. All languages are learned.

Defined results: `und` with score 0 for a null or empty text, one without a letter, or if nothing could be
learned; a null id is kept; repeated rows each give a row; rows with a null lang aren't learned from.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, map_rows, replace_column

#: Documents of a language that the fit uses, at most.
DOCS = 60
#: Characters of a language that the fit uses, at most, and of all languages together.
CHARS, ALL_CHARS = 60_000, 360_000
WINDOW = 256
#: Windows that are parsed at once.
WINDOWS = 4096
#: Symbols of a language whose automaton is a plain table, at most.
DENSE = 64
POINTS = 0x110000
#: Odd multipliers of the two hashes of a transition.
MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """The transitions of each state; state 0 is the start."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        new = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[new] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return follow


@dataclass(frozen=True)
class Dense:
    """By state + symbol: the next state, or, negative, ~ of it if a phrase ended before the symbol. States are multiples of the width."""

    letters: np.ndarray
    table: np.ndarray
    size: int

    def numbers(self, points: np.ndarray) -> np.ndarray:
        """The symbol of each code point: its place among the letters, or the one after them, which no phrase has."""
        at = np.minimum(np.searchsorted(self.letters, points), len(self.letters) - 1)
        return np.where(self.letters[at] == points, at, len(self.letters)).astype(np.int32)

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and whether a phrase ended before the symbol; an unknown symbol is a phrase by itself."""
        x = self.table.take(state + symbol)
        sign = x >> 31
        return x ^ sign, -sign


@dataclass(frozen=True)
class Hashed:
    """Transitions by cuckoo hashing: state * POINTS + code point stands in one of two places, with the next state."""

    keys: np.ndarray
    after: np.ndarray
    bits: int
    size: int

    def numbers(self, points: np.ndarray) -> np.ndarray:
        return points

    def places(self, key: np.ndarray, which: int) -> np.ndarray:
        return ((key.view(np.uint64) * MIX[which]) >> np.uint64(64 - self.bits)).view(np.int64)

    def follow(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next states, -1 where there is no transition."""
        key = state.astype(np.int64) * POINTS + symbol
        at = self.places(key, 0)
        out = np.where(self.keys[at] == key, self.after[at], -1)
        missed = np.flatnonzero(out < 0)
        key = key[missed]
        at = self.places(key, 1)
        out[missed] = np.where(self.keys[at] == key, self.after[at], -1)
        return out

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As in ``Dense``."""
        out = self.follow(state, symbol)
        ended = out < 0
        again = np.flatnonzero(ended)
        out[again] = np.maximum(self.follow(np.zeros(len(again), np.int32), symbol[again]), 0)
        return out, ended


def automaton(points: list[int]) -> Dense | Hashed:
    follow, known = suffix_automaton(points), sorted(set(points))
    return dense(follow, known, len(points)) if len(known) <= DENSE else hashed(follow, len(points))


def dense(follow: list[dict[int, int]], known: list[int], size: int) -> Dense:
    number, width = {c: i for i, c in enumerate(known)}, len(known) + 1
    moves = np.full((len(follow), width), -1, np.int32)
    for s, own in enumerate(follow):
        for c, t in own.items():
            moves[s, number[c]] = t
    start = np.where(moves[0] >= 0, moves[0], 0)
    return Dense(np.array(known or [-1], np.int64), np.where(moves >= 0, moves * width, ~(start * width)[None, :]).astype(np.int32).ravel(), size)


def hashed(follow: list[dict[int, int]], size: int) -> Hashed:
    key = np.array([s * POINTS + c for s, moves in enumerate(follow) for c in moves], np.int64)
    after = np.array([t for moves in follow for t in moves.values()], np.int32)
    bits = max(4, int(3 * len(key)).bit_length())
    while True:  # at most a third full, so the first size nearly always serves
        table = Hashed(np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32), bits, size)
        home, which = np.full(1 << bits, -1, np.int64), np.zeros(len(key), np.int64)
        waiting = np.arange(len(key))
        for _ in range(200):
            if not len(waiting):
                break
            at = np.where(which[waiting] == 0, table.places(key[waiting], 0), table.places(key[waiting], 1))
            before = home[at]
            home[at] = waiting  # of several that want one place the last gets it
            out = np.concatenate([waiting[home[at] != waiting], np.unique(before[before >= 0])])
            which[out] ^= 1
            waiting = out
        if not len(waiting):
            break
        bits += 1
    used = np.flatnonzero(home >= 0)
    table.keys[used], table.after[used] = key[home[used]], after[home[used]]
    return table


@dataclass(frozen=True)
class Model:
    langs: list[str]
    tables: list[Dense | Hashed]


@cache
def letters() -> np.ndarray:
    """Of each code point: is it a letter or a mark?"""
    out = np.zeros(POINTS, bool)
    for start in range(0, POINTS, 0x1000):
        out[start : start + 0x1000] = [unicodedata.category(chr(c))[0] in "LM" for c in range(start, start + 0x1000)]
    return out


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-cased text; a run of other characters than letters and marks is one 0."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    got = np.where(letters()[points], points, 0)
    keep = np.ones(len(got), bool)
    keep[1:] = (got[1:] > 0) | (got[:-1] > 0)
    return got[keep]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def largest_share(langs: int, chars: int, all_chars: int) -> int:
    """Characters of a language, at most."""
    return max(1, min(chars, all_chars // max(1, langs)))


def equal_shares(texts: list[str], most: int) -> str:
    """The beginnings of texts, joined by line breaks, of at most ``most`` characters; none is cut below an equal share."""
    left, share = most - max(0, len(texts) - 1), 0
    for done, n in enumerate(sorted(map(len, texts))):
        share = left // (len(texts) - done)
        left -= min(n, max(0, share))
    return "\n".join(t[: max(0, share)] for t in texts)[:most]


def fit(samples: dict[str, list[str]], chars: int = CHARS, all_chars: int = ALL_CHARS) -> Model:
    """samples: texts by language. Each language uses as much text as the others, at most."""
    langs = sorted(samples)
    most = largest_share(len(langs), chars, all_chars)
    texts = {k: equal_shares(samples[k], most) for k in langs}
    return Model(langs, [automaton(symbols(texts[k]).tolist()) for k in langs])


def fit_on(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs: int = DOCS,
    chars: int = CHARS, all_chars: int = ALL_CHARS,
) -> Model:
    """Fit on the rows of df; the caller has taken out those that must not be learned from."""
    df = df.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")
    )
    keys = df.select("id", "lang").where("id is not null and lang is not null and lang <> ''")
    # of each language some times more ids than wanted: those with hashes below a bound that follows from how many ids there are, about
    counts = keys.groupBy("lang").agg(F.approx_count_distinct("id").alias("ids"))
    bound = F.when(F.col("ids") > 20 * docs, (F.lit(8.0 * docs) / F.col("ids") - 0.5) * 2.0**64).otherwise(2.0**64)
    few = keys.join(F.broadcast(counts.select("lang", bound.alias("bound"))), "lang").where(F.xxhash64("id") < F.col("bound"))
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id")
    chosen = few.select("id", "lang").distinct().withColumn("n", F.row_number().over(by_hash)).where(F.col("n") <= docs).drop("n")
    chosen = chosen.groupBy("lang").agg(F.collect_list("id").alias("ids")).orderBy("lang").collect()
    wanted = {(i, row.lang) for row in chosen for i in row.ids}
    if not wanted:
        return Model([], [])
    most = largest_share(len(chosen), chars, all_chars)
    # the longest useful part of each; rows that repeat an id and language are one
    cut = df.where(F.col("id").isin(sorted({i for i, _ in wanted}))).select("id", "lang", F.substring("text", 1, most).alias("text"))
    rows = cut.where("text is not null").groupBy("id", "lang").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: r.id):
        if (row.id, row.lang) in wanted and has_letter(row.text):
            samples.setdefault(row.lang, []).append(row.text)
    return fit(samples, chars, all_chars)


def count_phrases(table: Dense | Hashed, columns: np.ndarray, rest: np.ndarray, first: np.ndarray, start: int) -> tuple[np.ndarray, int]:
    """Phrases that begin in each window, besides the one that its text begins with, and the state at the end of the last window.

    columns: symbols by place and window; rest: symbols of each window; first: windows that begin a text; start: the state before the
    first window, if it doesn't begin a text.
    """
    n, top = len(rest), int(rest.max(initial=0))
    state, ended = np.zeros(n, np.int32), np.zeros(n, np.int16)
    states, so_far = np.zeros((top + 1, n), np.int32), np.zeros((top + 1, n), np.int16)
    for t in range(top):  # what follows a window's end is never looked at
        state, more = table.step(state, columns[t])
        np.add(so_far[t], more, out=so_far[t + 1], casting="unsafe")
        states[t + 1] = state
    every = np.arange(n)
    final, total = states[rest, every].copy(), so_far[rest, every].astype(np.int64)
    due, known = np.flatnonzero(~first), np.full(n, -1, np.int32)
    for _ in range(3):  # windows whose state at the beginning wasn't known when they were parsed last
        at, state = due, np.where(due > 0, final[due - 1], start).astype(np.int32)
        known[due] = state
        extra = np.zeros(len(due), np.int64)
        was = final[due].copy()
        place = np.arange(len(due))
        apart = state != 0
        total[at[~apart]] = so_far[rest[at[~apart]], at[~apart]]
        final[at[~apart]] = states[rest[at[~apart]], at[~apart]]
        at, state, place = at[apart], state[apart], place[apart]
        for t in range(top):
            if not len(at):
                break
            over = rest[at] <= t  # the window has ended
            if over.any():
                final[at[over]], total[at[over]] = state[over], extra[place[over]]
                at, state, place = at[~over], state[~over], place[~over]
            state, ended = table.step(state, columns[t, at])
            extra[place] += ended
            met = state == states[t + 1, at]
            if met.any():
                w = at[met]
                total[w] = extra[place[met]] + so_far[rest[w], w] - so_far[t + 1, w]
                final[w] = states[rest[w], w]
                at, state, place = at[~met], state[~met], place[~met]
        final[at], total[at] = state, extra[place]
        moved = due[final[due] != was]
        later = moved[(moved + 1 < n)] + 1
        due = later[~first[later] & (known[later] != final[later - 1])]
    # what still isn't in step is mostly a text that repeats itself: window by window, each content and state once
    done: dict[tuple[bytes, int], tuple[int, int]] = {}
    for w in due.tolist():
        while w < n and not first[w] and known[w] != final[w - 1]:
            known[w] = final[w - 1]
            own = columns[: rest[w], w]
            key = own.tobytes(), int(known[w])
            if key not in done:
                state, count = known[w : w + 1], 0
                for t in range(len(own)):
                    state, ended = table.step(state, own[t : t + 1])
                    count += int(ended[0])
                done[key] = count, int(state[0])
            total[w], final[w] = done[key]
            w += 1
    return total, int(final[-1]) if n else start


def phrases(model: Model, texts: list[str]) -> np.ndarray:
    """Phrases that each language (column) needs for each text (row), and the symbols of each text, last."""
    got = [symbols(t) for t in texts]
    lengths = np.array([len(g) for g in got], np.int64)
    out = np.zeros((len(got), len(model.langs) + 1))
    out[:, -1] = lengths
    windows = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(got)), windows)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
    out[:, :-1] += lengths[:, None] > 0  # the phrase a text begins with
    start = [0] * len(model.tables)
    for low in range(0, len(owner), WINDOWS):
        own, k = owner[low : low + WINDOWS], number[low : low + WINDOWS]
        rest = np.minimum(WINDOW, lengths[own] - k * WINDOW)
        grid = np.zeros((len(own), WINDOW), np.int64)
        for i in np.unique(own):
            w = np.flatnonzero(own == i)
            piece = got[i][k[w[0]] * WINDOW : (k[w[-1]] + 1) * WINDOW]
            grid[w[0] : w[-1] + 1].ravel()[: len(piece)] = piece
        points = np.ascontiguousarray(grid.T)
        for j, table in enumerate(model.tables):
            total, start[j] = count_phrases(table, table.numbers(points), rest, k == 0, start[j])
            out[:, j] += np.bincount(own, total, len(got))
    return out


def rates(model: Model, texts: list[str]) -> np.ndarray:
    """Bits a symbol of each language for each text: phrases * log2(text behind the automaton) / symbols."""
    got = phrases(model, texts)
    return got[:, :-1] * np.log2([max(2, t.size) for t in model.tables]) / np.maximum(1, got[:, -1:])


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], list[float], list[float | None]]:
    """Languages, scores (the runner-up's share of the two least rates) and the least rates."""
    langs, score, least = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
    good = [i for i, t in enumerate(texts) if has_letter(t)] if model.langs else []
    for at in range(0, len(good), 256):
        part = good[at : at + 256]
        got = rates(model, [texts[i] for i in part])
        best = got.argmin(1)
        for i, row, b in zip(part, got, best.tolist(), strict=True):
            low = float(row[b])
            second = float(np.partition(row, 1)[1]) if len(row) > 1 else None
            langs[i], least[i] = model.langs[b], low
            score[i] = 1.0 if second is None else second / (low + second)
    return langs, score, least


def identify(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: doc_id, lang_pred, score and rate (bits a symbol)."""
    df = df.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            langs, score, least = classify(shared.value, b.column(1).to_pylist())
            yield {"doc_id": b.column(0), "lang_pred": langs, "score": score, "rate": least}

    return map_batches(df, run, "doc_id bigint, lang_pred string, score double, rate double")


def set_language(
    df: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", before: Callable[[], None] | None = None
) -> DataFrame:
    """The rows of df that have a language, with it in lang_col; the other columns stay, whatever their names.

    before: called in the workers ahead of each batch, to let go of what other operators' tasks have left in them.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    text, lang = df.columns.index(text_col), df.columns.index(lang_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if before is not None:
            before()
        langs = classify(shared.value, batch.column(text).to_pylist())[0]
        return replace_column(batch, lang, langs).filter(pa.array([k != "und" for k in langs], pa.bool_()))

    return map_rows(df, run)
