"""Fill-in-the-middle by escaped marker injection, in column functions only.

A delimiter is escaped in the text, so that it stands nowhere in it; regexp_replace puts one after each line; their count is the
number of lines; substring_index takes the lines before, between and after two of them; the parts lose their delimiters, get the
escaped characters back, and are assembled with the markers of their form. No row meets another, so nothing is shuffled.

The cuts and the form follow from a hash of the id and the seed alone, so a repeated run, or a repeated row, gives the same.

Defined results: a null text counts as empty, an empty text is plain; a text that holds a marker is plain, since its parts couldn't be
told apart again; with a null id the hash is that of the seed alone; rows that repeat stay, each with its own result; columns of other
names stay as they are, the added ones replace columns of the same names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: What ends a line once injected, and what escapes it and itself.
DELIMITER, ESCAPE = "\x01", "\x02"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(DELIMITER), F.lit(ESCAPE + "d"))


def unescape(text: Column) -> Column:
    """The inverse of escape, of a part that injected delimiters may still cut."""
    bare = F.replace(text, F.lit(DELIMITER), F.lit(""))
    return F.replace(F.replace(bare, F.lit(ESCAPE + "d"), F.lit(DELIMITER)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def inject(text: Column) -> Column:
    """The escaped text with a delimiter after each line, and after what follows the last line feed."""
    return F.regexp_replace(escape(text), r"([^\n]*+\n|[^\n]++)", "$1" + DELIMITER)


def _draws(doc_id: Column, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]


def transform(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, rate: int = 100, spm_rate: int = 50
) -> DataFrame:
    """df and n (lines), form, prefix, middle and suffix (null if plain) and output.

    rate: of a hundred documents that can be cut, how many are; spm_rate: of a hundred of those, how many begin with the suffix.
    """
    own = [c for c in df.columns if c not in ("n", "form", "prefix", "middle", "suffix", "output")]
    # helper columns take names that the table doesn't have
    free = "fim_"
    while any(c.lower().startswith(free) for c in df.columns):
        free += "_"
    named = {c: free + c for c in ("text", "marked", "n", "cut", "low", "high", "form")}
    text, marked, n, cut, low, high, form = (F.col(c) for c in named.values())
    h = _draws(F.col(id_col), seed)
    rows = df.withColumn(named["text"], F.coalesce(F.col(text_col).cast("string"), F.lit(""))).withColumn(named["marked"], inject(text))
    rows = rows.withColumn(named["n"], (F.length(marked) - F.length(F.replace(marked, F.lit(DELIMITER), F.lit("")))).cast("bigint"))
    holds = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    rows = rows.withColumn(named["cut"], ~((text == "") | holds | (h[2] % 100 >= rate)))
    first, second = h[0] % (n + 1), h[1] % (n + 1)
    rows = rows.withColumn(named["low"], F.least(first, second).cast("int")).withColumn(named["high"], F.greatest(first, second).cast("int"))
    rows = rows.withColumn(named["form"], F.when(~cut, "plain").when(h[3] % 100 < spm_rate, "spm").otherwise("psm"))

    ranked = lambda s, count: F.call_function("substring_index", s, F.lit(DELIMITER), count)
    parts = {
        "prefix": ranked(marked, low),
        "middle": ranked(ranked(marked, high), low - high),
        # what follows the last delimiter is empty and counts as a part
        "suffix": ranked(marked, high - n.cast("int") - 1),
    }
    rows = rows.select(*own, text, n, form, *[F.when(cut, unescape(p)).alias(c) for c, p in parts.items()])
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(form == "plain", text).when(form == "psm", psm).otherwise(spm)
    return rows.select(*own, n.alias("n"), form.alias("form"), "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that output and form were made from."""
    index = lambda s, marker, count: F.substring_index(s, marker, count)
    middle = index(output, MIDDLE, -1)
    psm = F.concat(F.substring(index(output, SUFFIX, 1), len(PREFIX) + 1, 2**31 - 1), middle, index(index(output, SUFFIX, -1), MIDDLE, 1))
    spm = F.concat(index(index(output, PREFIX, -1), MIDDLE, 1), middle, F.substring(index(output, PREFIX, 1), len(SUFFIX) + 1, 2**31 - 1))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)
