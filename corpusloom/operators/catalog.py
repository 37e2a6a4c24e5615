"""The manifest of chunks and documents: neighbours, spec links, references, bridges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text, words

SEPARATOR = " > "


def adjacency(chunks: DataFrame) -> DataFrame:
    """Adds previous and next: the neighbours' ids in the same source."""
    order = Window.partitionBy("source").orderBy("sequence")
    return chunks.withColumn("previous", F.lag("id").over(order)).withColumn("next", F.lead("id").over(order))


def heading_match(a: Column, b: Column) -> Column:
    """Bytes that two heading paths share: the shorter if it begins the other, else whole segments in common; -1 for none."""
    x, y = F.split(a, SEPARATOR), F.split(b, SEPARATOR)
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q))
    n = F.aggregate(same, F.lit(0), lambda acc, s: F.when((acc >= 0) & s, acc + 1).otherwise(F.when(acc >= 0, -acc - 1).otherwise(acc)), lambda acc: F.when(acc < 0, -acc - 1).otherwise(acc))
    shared = F.octet_length(F.array_join(F.slice(x, 1, n), SEPARATOR))
    whole = F.when(a.startswith(b), F.octet_length(b)).when(b.startswith(a), F.octet_length(a))
    return F.when((a == "") | (b == ""), -1).otherwise(F.coalesce(whole, F.when(shared > 0, shared), F.lit(-1))).cast("bigint")


def link_specs(chunks: DataFrame) -> DataFrame:
    """spec and object: each spec chunk's best match by heading in the file beside it; ties to the lesser sequence."""
    specs = chunks.where("type = 'spec'").select(F.col("id").alias("spec"), F.regexp_replace("source", r"\.spec\.md$", ".md").alias("source"), F.col("heading").alias("h"), F.col("source").alias("spec_source"), F.col("sequence").alias("spec_sequence"))
    objects = chunks.where("type = 'object'").select(F.col("id").alias("object"), "source", F.col("heading").alias("g"), "sequence")
    both = specs.join(objects, "source").withColumn("n", heading_match(F.col("h"), F.col("g"))).where("n >= 0")
    best = F.max_by(F.struct("object", "n"), F.struct(F.col("n"), -F.col("sequence")))
    return both.groupBy("spec", "spec_source", "spec_sequence").agg(best.alias("b")).select("spec", "spec_source", "spec_sequence", "b.object", F.col("b.n").alias("match"))


def reverse_links(links: DataFrame) -> DataFrame:
    """object and spec_chunk: of the specs that chose it the least id."""
    return links.groupBy("object").agg(F.min("spec").alias("spec_chunk"))


def metadata(chunks: DataFrame) -> DataFrame:
    """source, its chunks in order, and its tokens."""
    own = F.array_sort(F.collect_list(F.struct("sequence", "id")))
    return chunks.groupBy("source").agg(F.transform(own, lambda x: x["id"]).alias("chunks"), F.sum("tokens").alias("tokens"))


def counters(chunks: DataFrame) -> DataFrame:
    """Chunks and tokens by type, and in all (type `all`)."""
    rows = chunks.rollup("type").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"))
    return rows.select(F.coalesce("type", F.lit("all")).alias("type"), "chunks", "tokens")


def document_references(links: DataFrame, known: DataFrame) -> DataFrame:
    """links: src, dst. Those between different known documents, each once."""
    docs = known.select(F.col("source").alias("_d"))
    return links.where("src <> dst").distinct().join(docs, F.col("dst") == F.col("_d"), "left_semi")


def referenced_by(refs: DataFrame) -> DataFrame:
    return refs.groupBy(F.col("dst").alias("source")).agg(F.array_sort(F.collect_set("src")).alias("referenced_by"))


def heading_bridge(before: Column, after: Column) -> Column:
    """What is completed and what is entered between two heading paths; empty if they are equal."""
    x = F.when(before == "", F.array().cast("array<string>")).otherwise(F.split(before, SEPARATOR))
    y = F.when(after == "", F.array().cast("array<string>")).otherwise(F.split(after, SEPARATOR))
    n = F.aggregate(
        F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(0), lambda acc, s: F.when((acc >= 0) & s, acc + 1).otherwise(F.when(acc >= 0, -acc - 1).otherwise(acc)),
        lambda acc: F.when(acc < 0, -acc - 1).otherwise(acc),
    )
    leaving, entering = (F.array_join(F.slice(z, n + 1, F.greatest(F.size(z), F.lit(1))), SEPARATOR) for z in (x, y))
    return (
        F.when(before == after, "")
        .when(leaving == "", F.concat(F.lit("Entering: "), entering))
        .when(entering == "", F.concat(F.lit("Completed: "), leaving))
        .otherwise(F.concat(F.lit("Completed: "), leaving, F.lit(". Entering: "), entering))
    )


def key_phrases(texts: DataFrame, top: int = DEFAULTS.rake_phrases, longest: int = DEFAULTS.rake_words) -> DataFrame:
    """texts: id, words (array). The best phrases of each text by the sum of degree / frequency of their words: id, place, phrase, score.

    Stop words and words of one byte end a phrase; equal scores go by the first place. Whole texts are dealt by id; their words stay where they are.
    """
    w = texts.repartition("id").select("id", F.posexplode("words").alias("at", "word"))
    stop = F.col("word").isin(words.RAKE_STOPWORDS) | (F.octet_length("word") < 2)
    order = Window.partitionBy("id").orderBy("at")
    w = w.withColumn("stop", stop).withColumn("run", F.sum(F.col("stop").cast("int")).over(order)).where("not stop")
    w = w.withColumn("size", F.count("*").over(Window.partitionBy("id", "run")))
    same = Window.partitionBy("id", "word")
    w = w.withColumn("score", F.sum("size").over(same) / F.count("*").over(same))
    p = w.where(F.col("size") <= longest).groupBy("id", "run").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("phrase"),
        F.round(F.sum("score"), 9).alias("score"), F.min("at").alias("at"),
    )
    best = p.groupBy("id", "phrase").agg(F.max("score").alias("score"), F.min("at").alias("at"))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("score").desc(), "at")).cast("bigint")
    return best.withColumn("place", place).where(F.col("place") <= top).select("id", "place", "phrase", "score")


def lookup(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """ids: id. The chunks that have one of them; equal texts share an id, so an id may give several."""
    return chunks.join(ids.select("id").distinct(), "id", "left_semi")


def bridges(chunks: DataFrame, bridged: DataFrame | None = None, tail: int = DEFAULTS.bridge_tail) -> DataFrame:
    """chunks: doc, type, source, sequence, heading, content. doc and bridge, the way from a chunk to the next one of its source.

    Three layers, joined: what is completed and entered between their headings, the key phrases of the chunk's last ``tail`` bytes, and its
    last sentence. Spec chunks have none; nor have those that say nothing, or are in bridged (doc) already.
    """
    order = Window.partitionBy("source").orderBy("sequence")
    c = chunks.where("type <> 'spec'").withColumn("after", F.lead("heading").over(order)).where("after is not null")
    if bridged is not None:
        c = c.join(bridged.select("doc"), "doc", "left_anti")
    # the texts end here: what is said of them is all that is joined
    c = c.select(
        "doc", heading_bridge(F.col("heading"), F.col("after")).alias("way"), text.tail_window(F.col("content"), tail).alias("tail"), text.last_sentence(F.col("content")).alias("said")
    )
    found = key_phrases(c.select(F.col("doc").alias("id"), text.rake_words(F.col("tail")).alias("words")))
    own = F.array_sort(F.collect_list(F.struct("place", "phrase")))
    phrases = found.groupBy(F.col("id").alias("doc")).agg(F.array_join(F.transform(own, lambda x: x["phrase"]), ", ").alias("phrases"))
    layers = F.col("way"), F.concat(F.lit("Established: "), "phrases"), F.col("said")
    joined = F.concat_ws(". ", *[F.nullif(x, F.lit("")) for x in layers])
    return c.join(phrases, "doc", "left").select("doc", joined.alias("bridge")).where("bridge <> ''")
