"""Column functions on texts: tokens, keys, markdown clean-up, hashes, windows of text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructType

from . import words
from .stem import index_term

TOKEN = r"([\w][\w\-\.]*[\w]|[\w]+)"
#: Characters that end a phrase.
DELIMITERS = ".!?,;:\n\t()[]\"'"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def raw_words(text: Column) -> Column:
    """Lower-cased, with stop words and without stemming."""
    return F.transform(raw_tokens(text), F.lower)


def word_array(items) -> Column:
    return F.array(*[F.lit(w) for w in items])


def is_stopword(lower: Column) -> Column:
    return lower.isin(words.STOPWORDS) & ~lower.isin(words.TECHNICAL)


@F.arrow_udf(ArrayType(StringType()))
def _index_terms(tokens: pa.Array) -> pa.Array:
    """Of lists of tokens the terms: each distinct token of a batch is stemmed once."""
    coded = tokens.flatten().dictionary_encode()
    terms = pa.array([index_term(t) for t in coded.dictionary.to_pylist()], pa.string()).take(coded.indices)
    sizes = pc.fill_null(pc.list_value_length(tokens), 0)
    offsets = pa.array(np.r_[0, np.cumsum(sizes.to_numpy(zero_copy_only=False))], pa.int32())
    return pa.ListArray.from_arrays(offsets, terms, mask=tokens.is_null())


def _kept(text: Column) -> Column:
    return F.filter(raw_tokens(text), lambda w: ~is_stopword(F.lower(w)))


def tokens(text: Column) -> Column:
    """Terms in order: lower-cased, without stop words, stemmed. The same at index time and at query time."""
    return _index_terms(_kept(text))


def token_count(text: Column) -> Column:
    """How many terms ``tokens`` gives, without their stems."""
    return F.size(_kept(text)).cast("bigint")


@F.arrow_udf(ArrayType(StructType().add("term", StringType()).add("tf", LongType())))
def term_counts(terms: pa.Array) -> pa.Array:
    """Of lists of terms each distinct one with its number; a list of null terms or a null one gives none."""
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy(zero_copy_only=False)
    coded = terms.flatten().dictionary_encode()
    known = coded.indices.is_valid().to_numpy(zero_copy_only=False)
    width = max(len(coded.dictionary), 1)
    at = np.repeat(np.arange(len(sizes)), sizes)[known] * width + coded.indices.drop_null().to_numpy(zero_copy_only=False)
    each, counts = np.unique(at, return_counts=True)
    offsets = np.searchsorted(each, np.arange(len(sizes) + 1) * width)
    pairs = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(each % width)).cast(pa.string()), pa.array(counts, pa.int64())], ["term", "tf"])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)


def has_mixed_case(word: Column) -> Column:
    return F.substring(word, 2, 1 << 30).rlike("[A-Z]")


def is_code_identifier(word: Column) -> Column:
    lower = F.lower(word)
    letter, digit = lower.rlike("[a-z]"), lower.rlike("[0-9]")
    capitals = (F.octet_length(word) >= 2) & letter & (word == F.upper(word))
    return lower.rlike("[._]") | (letter & digit) | capitals | has_mixed_case(word)


def rake_words(text: Column) -> Column:
    spaced = F.trim(F.regexp_replace(F.translate(F.lower(text), DELIMITERS, " " * len(DELIMITERS)), r"\s+", " "))
    return F.filter(F.split(spaced, " "), lambda w: w != "")


def normalize_key(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def humanize(name: Column) -> Column:
    parts = F.filter(F.split(F.translate(name, "-_", "  "), " "), lambda w: w != "")
    capital = lambda w: F.concat(F.translate(F.substring(w, 1, 1), *ASCII_UPPER), F.substring(w, 2, 1 << 30))
    return F.array_join(F.transform(parts, capital), " ")


#: The reference upper-cases the first byte, so only ASCII letters change.
ASCII_UPPER = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def title_from_path(path: Column) -> Column:
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, "/$", ""), r"\.md$", ""), "/README$", "")
    return humanize(F.element_at(F.split(cut, "/"), -1))


def strip_markdown(text: Column) -> Column:
    """Eight rewrites, in this order. Fixed values."""
    steps = (
        (r"(?s)```[^`]*```|~~~[^~]*~~~", " "), (r"`[^`]+`", " "), (r"\[([^\]]+)\]\([^)]+\)", "$1"),
        (r"\*\*([^*]+)\*\*|__([^_]+)__", "$1$2"), (r"<[^>]+>", " "), (r"(?m)^#{1,6}\s+", ""),
        (r"(?m)^[\t ]*[-*+][\t ]+|^[\t ]*\d+[.)]\s+", ""), (r"\s+", " "),
    )
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return F.trim(text)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text.cast("binary"), 256))


def short_hash(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, "^sha256:", ""), 1, 12)


def clamp_hash_length(n: Column) -> Column:
    return F.when(n <= 0, 16).otherwise(F.least(F.greatest(n, F.lit(8)), F.lit(64)))


def set_hash(ids: Column) -> Column:
    """Of a set of chunk ids: their order doesn't matter."""
    return F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.array_sort(ids), ",").cast("binary"), 256))


def tail_window(text: Column, size: int) -> Column:
    """The last size bytes, from after the next blank on. Bytes that aren't whole characters at its start go with it."""
    cut = F.substring(text.cast("binary"), F.octet_length(text) - size + 1, F.lit(size))
    # the blank is found in the bytes' hexadecimal form, so that a cut within a character does no harm
    hexes = F.regexp_replace(F.hex(cut), "(..)", "$1,")
    blank = F.locate("20,", hexes)
    after = F.substring(cut, F.floor((blank - 1) / 3).cast("int") + 2, F.lit(size))
    whole = F.octet_length(text) <= size
    return F.when(whole, text).otherwise(F.decode(F.when(blank > 0, after).otherwise(cut), "UTF-8"))


def last_sentence(text: Column) -> Column:
    """Between the last two of . ! ?; empty for code, headings, list items, table rows and short ones."""
    clean = F.trim(text)
    fences = F.size(F.split(clean, "```")) - 1
    last_line = F.trim(F.element_at(F.split(clean, "\n"), -1))
    # read from its end, where the pattern is anchored: from its beginning, each place would be tried
    found = F.trim(F.reverse(F.regexp_extract(F.reverse(clean), r"^[^.!?]*+([.!?][^.!?]*+)", 1)))
    found = F.regexp_replace(found, r"^\s+|\s+$", "")
    bad = (fences % 2 != 0) | last_line.startswith("```") | (F.octet_length(found) < 20) | found.rlike(r"^(#|- |\* |\|)")
    return F.when(bad, "").otherwise(found)


def looks_like_sentence(text: Column) -> Column:
    return (F.octet_length(text) > 30) & text.rlike(r"(?i)(?<!\w)(?:" + "|".join(words.SENTENCE_VERBS) + r")(?!\w)")


def plausible_abbreviation(short: Column, long: Column) -> Column:
    same = F.lower(F.substring(short, 1, 1)) == F.lower(F.substring(long, 1, 1))
    return (F.octet_length(short) < F.octet_length(long)) & (F.octet_length(short) >= 2) & same


def chunk_fields(content: Column) -> tuple[Column, Column]:
    """Code (inside fences) and body (the rest, from after the first comment end on)."""
    fence = r"(?s)```[^\n]*\n(.*?)```"
    code = F.array_join(F.regexp_extract_all(content, F.lit(fence), F.lit(1)), " ")
    rest = F.regexp_replace(content, fence, "")
    at = F.locate("-->", rest)
    return code, F.when(at > 0, F.substring(rest, at + 3, F.lit(1 << 30))).otherwise(rest)


def first_known(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit("unknown"))


def format_number(n: Column) -> Column:
    return F.format_number(n, 0)


def format_duration(seconds: Column) -> Column:
    minutes = F.floor(seconds / 60)
    return (
        F.when(seconds < 1, F.format_string("%.0fms", F.bround(seconds * 1000, 0)))
        .when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1)))
        .otherwise(F.concat(minutes.cast("string"), F.lit("m"), F.format_string("%.1fs", F.bround(seconds - minutes * 60, 1))))
    )


def format_ago(seconds: Column) -> Column:
    whole = lambda unit, mark: F.concat(F.floor(seconds / unit).cast("string"), F.lit(f"{mark} ago"))
    return F.when(seconds < 60, "just now").when(seconds < 3600, whole(60, "m")).when(seconds < 86400, whole(3600, "h")).otherwise(whole(86400, "d"))


def format_budget(used: Column, total: Column) -> Column:
    share = F.format_string("%.1f", F.bround(used / total * 100, 1))
    return F.when(total <= 0, F.concat(format_number(used), F.lit(" tokens"))).otherwise(
        F.concat(format_number(used), F.lit(" / "), format_number(total), F.lit(" tokens ("), share, F.lit("%)"))
    )


def estimated_tokens(text: Column) -> Column:
    """The provider `chars4`: a token for each four bytes begun."""
    return F.ceil(F.octet_length(text) / 4).cast("bigint")
