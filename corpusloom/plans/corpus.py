"""Two pipelines: building a corpus from files, and answering queries on it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Config
from ..functions import paths, text
from ..operators import blocks as B
from ..operators import catalog, chunking, fuse, index, parse, taxonomy
from ..session import cut


@dataclass(frozen=True)
class Corpus:
    """Tables, by name; each can be written as Parquet and read back."""

    chunks: DataFrame
    manifest: DataFrame
    references: DataFrame
    terms: DataFrame
    aliases: DataFrame
    postings: DataFrame
    lengths: DataFrame


def build(
    files: DataFrame, config: Config = DEFAULTS, count: Callable[[Column], Column] = text.estimated_tokens, dictionary: DataFrame | None = None, tag: bool = False
) -> Corpus:
    """files: path, content. Parse, strip, count tokens, chunk, extract terms, index by field, link and bridge.

    count: the token counter of the chunks' budgets (see ``functions.counting``). dictionary: word and synonyms, for aliases. tag: also
    take noun phrases and names as terms (approximate). Each table is written to the checkpoint folder, as several others follow from it.
    """
    blocks = cut(B.strip(parse.parse_blocks(files)).withColumn("tokens", count(F.col("content"))))
    chunks = cut(chunking.chunk(blocks, config.chunk).withColumn("doc", F.concat("source", F.lit("#"), F.col("sequence").cast("string"))))
    flat = chunks.select(F.col("doc").alias("chunk"), "source", "sequence", F.posexplode("blocks").alias("block", "b")).select(
        "chunk", "source", "sequence", "block", "b.type", "b.content"
    )
    found = [f(flat) for f in (taxonomy.heading_terms, taxonomy.code_identifiers, taxonomy.bold_terms, taxonomy.list_headers, taxonomy.table_headers)]
    if tag:
        own = chunks.select(F.col("doc").alias("chunk"), "content")
        for names in (parse.noun_phrases(own), parse.named_entities(own)):  # after all blocks of their chunk
            found.append(names.select("chunk", F.lit((1 << 31) - 1).alias("block"), "place", "canonical", F.lit("pos_extraction").alias("source")))
    shape = ("chunk", "block", "place", "canonical", "source")
    candidates = reduce(DataFrame.unionByName, [f.select(*shape) for f in found])
    candidates = candidates.select(F.struct("chunk", "block", "place").alias("ordinal"), "canonical", "source", "chunk")
    terms = cut(taxonomy.deduplicate(candidates, config.least_term_frequency))
    pairs = taxonomy.apply_abbreviations(terms, taxonomy.abbreviations(flat))
    if dictionary is not None:
        pairs = pairs.unionByName(taxonomy.apply_dictionary(terms, dictionary))
    pairs = pairs.groupBy("key").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    links = cut(parse.parse_links(files).select(F.col("path").alias("src"), paths.resolve_link(F.col("path"), F.col("destination"), True).alias("dst")))
    hierarchy = taxonomy.heading_hierarchy(chunks.select(F.struct("source", "sequence").alias("ordinal"), F.split("heading", " > ").alias("heading")), terms)
    headed = terms.where("source = 'heading'").select("key", F.explode("chunks").alias("doc")).join(chunks.select("doc", "source"), "doc")
    near = taxonomy.cross_references(links, headed.select("key", "source").distinct(), hierarchy.select("key", "broader"))
    related = near.select(F.col("a").alias("key"), F.col("b").alias("other")).unionByName(near.select(F.col("b").alias("key"), F.col("a").alias("other")))
    related = related.groupBy("key").agg(F.array_sort(F.collect_set("other")).alias("related"))
    none = F.array().cast("array<string>")
    own = taxonomy.chunk_terms(terms)
    terms = terms.join(pairs, "key", "left").join(hierarchy, "key", "left").join(related, "key", "left").select(
        "key", "canonical", "source", "chunks", *[F.coalesce(c, none).alias(c) for c in ("aliases", "narrower", "related")]
    )
    terms = cut(terms)
    references = catalog.document_references(links, files.select(F.col("path").alias("source")))
    fields = cut(_fields(chunks, own))
    tables = (_manifest(chunks), references, terms, taxonomy.alias_index(terms), index.field_postings(fields), index.field_lengths(fields))
    return Corpus(chunks, *map(cut, tables))


def _fields(chunks: DataFrame, own: DataFrame) -> DataFrame:
    code, body = text.chunk_fields(F.col("content"))
    rows = chunks.join(own.withColumnRenamed("chunk", "doc"), "doc", "left")
    parts = F.array(*[
        F.struct(F.lit(name).alias("field"), text.tokens(value).alias("tokens"))
        for name, value in (("heading", F.col("heading")), ("body", body), ("code", code), ("terms", F.coalesce(F.array_join("terms", " "), F.lit(""))))
    ])
    return rows.select(paths.output_dir(F.col("type")).alias("corpus"), "doc", F.explode(parts).alias("p")).select("corpus", "doc", "p.*")


def _manifest(chunks: DataFrame) -> DataFrame:
    order = Window.partitionBy("source").orderBy("sequence")
    m = chunks.select("doc", "id", "type", "source", "heading", "sequence", "tokens", "content")
    m = m.withColumn("previous", F.lag("doc").over(order)).withColumn("next", F.lead("doc").over(order))
    links = catalog.link_specs(chunks.withColumn("id", F.col("doc")))
    m = m.join(links.select(F.col("spec").alias("doc"), F.col("object").alias("parent_object")), "doc", "left").join(catalog.bridges(chunks), "doc", "left")
    return m.join(catalog.reverse_links(links).withColumnRenamed("object", "doc"), "doc", "left")


def search(corpus: Corpus, queries: DataFrame, dictionary: DataFrame, config: Config = DEFAULTS, n: int | None = None) -> DataFrame:
    """queries: query, text. Expand, score by field in each corpus, fuse, re-rank, cut and look up: query, rank, doc, score, ..."""
    n = n or config.results
    terms = taxonomy.expand(queries, corpus.terms, corpus.aliases, dictionary, config.expansion_cap, config.tiers)
    scored = index.bm25f(terms.select("query", "term", "weight"), corpus.postings, corpus.lengths, config.fields, config.k1)
    fused = cut(fuse.weighted_rrf(index.top(scored, 3 * n), config))
    ranked = fuse.graph_rerank(fused, corpus.manifest, corpus.references, n, config).where(F.col("rank") <= n)
    return ranked.join(corpus.manifest, "doc")


def prompt(corpus: Corpus, hits: DataFrame, target: int, config: Config = DEFAULTS) -> DataFrame:
    """The text of the hits that fit the budget, by query."""
    budget = max(target, -(-int(target * config.prompt_multiplier * 1000) // 1000))
    chosen = fuse.select_budget(hits, budget)
    return fuse.assemble(chosen.select("query", "source", "sequence", "type", "content", "bridge"))
