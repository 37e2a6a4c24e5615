"""Terms of a corpus: candidates, deduplication, aliases, hierarchy, cross-references, and query expansion.

Candidates carry an ``ordinal`` (any sortable value) for what comes first.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS
from ..functions import text, words

LONGEST = 60
SHORTEST = 3
#: Patterns of identifiers. Fixed values.
CODE_PATTERNS = (
    r"(?m)^func\s+(?:\([^)]*\)\s+)?(\w+)",
    r"(?m)^type\s+(\w+)\s+",
    r"(?m)^(?:def|class)\s+(\w+)",
    r"(?m)^(?:export\s+)?(?:function|class)\s+(\w+)",
    r"(?m)^(?:pub\s+)?(?:fn|struct|enum|trait|impl)\s+(\w+)",
    r"(?m)^(?:public\s+|private\s+|protected\s+)?(?:static\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+(\w+)",
)
#: Patterns of list headers and abbreviations. Fixed values.
LIST_HEADER = r"(?m)^[-*+]\s+([^:\n]+?)(?::\s|(?:\s+--|(?:\s+—)))"
BOLD = r"(?m)^[ \t]*(?:(?:[-*+]|\d+[.)])[ \t]*)?(?:\*\*([^*\n]+)\*\*|__([^_\n]+)__)"
LONG = r"[A-Z][a-zA-Z0-9](?:[a-zA-Z0-9 -]{1,50}[a-zA-Z0-9])?"
SHORT = r"[A-Z][A-Z0-9]{1,9}"
EXPANSION_FIRST = rf"(?<!\w)({LONG})\s+\(({SHORT})\)"
SHORT_FIRST = rf"(?<!\w)({SHORT})\s+\(({LONG})\)"


def _first_of_each(found: DataFrame) -> DataFrame:
    """found: chunk, block, place, canonical. Of spellings that differ in case only, the first of a block."""
    order = Window.partitionBy("chunk", "block", F.lower("canonical")).orderBy("place")
    return found.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def _candidates(blocks: DataFrame, found: Column, source: str) -> DataFrame:
    rows = blocks.select("chunk", "block", F.posexplode(found).alias("place", "canonical")).withColumn("canonical", F.trim("canonical"))
    return rows.where(F.col("canonical") != "").withColumn("source", F.lit(source))


def heading_terms(blocks: DataFrame) -> DataFrame:
    """blocks: chunk, block, type, content, here and below."""
    return _candidates(blocks.where("type = 'heading'"), F.array("content"), "heading")


def code_identifiers(blocks: DataFrame) -> DataFrame:
    found = F.concat(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in CODE_PATTERNS])
    rows = _candidates(blocks.where("type = 'code_block'"), found, "code_identifier")
    return _first_of_each(rows.where(F.octet_length("canonical") >= SHORTEST))


def bold_terms(blocks: DataFrame) -> DataFrame:
    both = F.zip_with(
        F.regexp_extract_all("content", F.lit(BOLD), F.lit(1)), F.regexp_extract_all("content", F.lit(BOLD), F.lit(2)), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit("")))
    )
    return _first_of_each(_candidates(blocks, both, "bold_term").where(F.octet_length("canonical") <= LONGEST))


def list_headers(blocks: DataFrame) -> DataFrame:
    rows = _candidates(blocks, F.regexp_extract_all("content", F.lit(LIST_HEADER), F.lit(1)), "structured_position")
    return _first_of_each(rows.where((F.octet_length("canonical") <= LONGEST) & ~text.looks_like_sentence(F.col("canonical"))))


def table_headers(blocks: DataFrame) -> DataFrame:
    line = F.trim(F.substring_index("content", "\n", 1))
    cells = F.when(~line.rlike(r"^[\s|:-]+$"), F.split(line, r"\|"))
    rows = _candidates(blocks.where("type = 'table'"), cells, "structured_position")
    good = (F.octet_length("canonical") <= LONGEST) & ~F.lower("canonical").isin(words.GENERIC_HEADERS)
    return _first_of_each(rows.where(good))


def abbreviations(blocks: DataFrame) -> DataFrame:
    """short and long, each pair once (whatever its case), in the spelling that comes first."""
    first = F.zip_with(F.regexp_extract_all("content", F.lit(EXPANSION_FIRST), F.lit(2)), F.regexp_extract_all("content", F.lit(EXPANSION_FIRST), F.lit(1)), lambda s, w: F.struct(s.alias("short"), w.alias("long")))
    then = F.zip_with(F.regexp_extract_all("content", F.lit(SHORT_FIRST), F.lit(1)), F.regexp_extract_all("content", F.lit(SHORT_FIRST), F.lit(2)), lambda s, w: F.struct(s.alias("short"), w.alias("long")))
    rows = blocks.select("chunk", "block", F.posexplode(F.concat(first, then)).alias("place", "pair")).select("chunk", "block", "place", "pair.*")
    rows = rows.where(text.plausible_abbreviation(F.col("short"), F.col("long")))
    keyed = rows.groupBy(F.lower("short").alias("s"), F.lower("long").alias("l"))
    return keyed.agg(F.min_by(F.struct("short", "long"), F.struct("chunk", "block", "place")).alias("p")).select("p.*")


#: Where a definition stands: at a line's beginning, after a list marker or not, with a capital. Fixed value.
DEFINITION = r"(?m)^[ \t]*(?:(?:[-*+]|\d+[.)])[ \t]*)?[A-Z]"


def definition_position(content: Column) -> Column:
    return content.rlike(DEFINITION)


def structural(blocks: DataFrame) -> DataFrame:
    """The candidates that form and place give: chunk, block, place, canonical, source and ordinal (by chunk, block, kind and place)."""
    kinds = heading_terms, code_identifiers, bold_terms, list_headers, table_headers
    parts = [
        k(blocks).select("chunk", "block", "place", "canonical", "source", F.struct("chunk", "block", F.lit(i).alias("kind"), "place").alias("ordinal"))
        for i, k in enumerate(kinds)
    ]
    return functools.reduce(DataFrame.unionByName, parts)


def extract(blocks: DataFrame, least: int = DEFAULTS.least_term_frequency) -> DataFrame:
    """The terms of blocks: structural candidates, deduplicated."""
    return deduplicate(structural(blocks).select("ordinal", "canonical", "source", "chunk"), least)


def source_rank(source: Column) -> Column:
    out: Column = F.lit(7)
    for name, rank in words.SOURCE_RANKS.items():
        out = F.when(source == name, rank).otherwise(out)
    return out.cast("bigint")


def deduplicate(candidates: DataFrame, least: int = DEFAULTS.least_term_frequency) -> DataFrame:
    """candidates: ordinal, canonical, source, chunk. key, canonical, source and chunks (sorted) of terms in ``least`` chunks or more."""
    rows = candidates.withColumn("key", text.normalize_key(F.col("canonical"))).where("key <> ''")
    best = F.min_by(F.struct("canonical", "source"), F.struct(source_rank(F.col("source")), F.col("ordinal")))
    terms = rows.groupBy("key").agg(best.alias("best"), F.array_sort(F.collect_set("chunk")).alias("chunks"))
    return terms.where(F.size("chunks") >= least).select("key", "best.canonical", "best.source", "chunks")


def chunk_terms(terms: DataFrame) -> DataFrame:
    """chunk and its terms' keys, sorted."""
    return terms.select("key", F.explode("chunks").alias("chunk")).groupBy("chunk").agg(F.array_sort(F.collect_list("key")).alias("terms"))


def alias_index(terms: DataFrame) -> DataFrame:
    """terms: key, canonical, aliases. alias and the least key that has it, as its canonical form, an alias or itself."""
    own = F.concat(F.array("canonical", "key"), "aliases")
    return terms.select("key", F.explode(own).alias("alias")).groupBy(F.lower("alias").alias("alias")).agg(F.min("key").alias("key"))


def apply_abbreviations(terms: DataFrame, pairs: DataFrame) -> DataFrame:
    """key and alias: of the long form's term the short form, and the other way round."""
    a = pairs.select(text.normalize_key(F.col("long")).alias("key"), F.lower("short").alias("alias"))
    b = pairs.select(text.normalize_key(F.col("short")).alias("key"), F.lower("long").alias("alias"))
    return a.unionByName(b).distinct().join(terms.select("key"), "key", "left_semi")


def apply_dictionary(terms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """dictionary: word, synonyms. key and alias, by the term's key or else, if it differs, its canonical form's key."""
    a = terms.select("key", F.col("key").alias("word"))
    b = terms.select("key", text.normalize_key(F.col("canonical")).alias("word"))
    return a.unionByName(b).distinct().join(dictionary, "word").select("key", F.explode("synonyms").alias("alias")).distinct()


def heading_hierarchy(chunks: DataFrame, terms: DataFrame) -> DataFrame:
    """chunks: ordinal, heading (array). key, broader (its first parent) and narrower (sorted) of neighbours in heading paths."""
    keys = F.transform("heading", lambda h: text.normalize_key(h))
    pairs = F.zip_with(F.slice(keys, 1, F.greatest(F.size(keys) - 1, F.lit(0))), F.slice(keys, 2, F.size(keys)), lambda p, c: F.struct(p.alias("parent"), c.alias("child")))
    rows = chunks.where(F.size("heading") > 1).select("ordinal", F.posexplode(pairs).alias("place", "pair")).select("ordinal", "place", "pair.*")
    known = terms.select("key")
    rows = rows.where("parent <> child").join(known, F.col("parent") == F.col("key"), "left_semi").join(known, F.col("child") == F.col("key"), "left_semi")
    up = rows.groupBy("child").agg(F.min_by("parent", F.struct("ordinal", "place")).alias("broader")).withColumnRenamed("child", "key")
    down = rows.groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("narrower")).withColumnRenamed("parent", "key")
    return up.join(down, "key", "full_outer")


#: Keys of a class that go together.
KEYS_AT_ONCE = 512


def _key_blocks(classes: DataFrame) -> DataFrame:
    """classes: class, key. class, block and keys: up to some KEYS_AT_ONCE keys of a class, dealt by their hash."""
    sizes = classes.groupBy("class").agg(F.ceil(F.count("*") / KEYS_AT_ONCE).alias("blocks"))
    dealt = classes.join(sizes, "class").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")))
    return dealt.groupBy("class", "block").agg(F.collect_list("key").alias("keys"))


def cross_references(links: DataFrame, terms: DataFrame, broader: DataFrame) -> DataFrame:
    """links: src, dst. terms: key, source. Related pairs (a < b): a heading term of each end, unless one is the other's broader.

    A link gives as many pairs as its ends' terms multiply to, by definition; two links with the same terms at their ends give them once:
    sources are put in classes of equal sets of terms, and links between classes are made distinct, before terms are paired. Terms of a class are
    paired by blocks, which are dealt evenly, so that no task holds or pairs a whole class.
    """
    classes, edges = related_store(links, terms)
    ways = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    blocks = _key_blocks(classes)
    left, right = (blocks.select(F.col("class").alias(c), F.col("block").alias(f"{c}_block"), F.col("keys").alias(k)) for c, k in (("a", "xs"), ("b", "ys")))
    met = ways.join(left, "a").join(right, "b")
    n = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    pairs = met.repartition(n, "a", "a_block", "b", "b_block").select(F.explode("xs").alias("x"), "ys").select("x", F.explode("ys").alias("y"))
    pairs = pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    known = broader.where("broader is not null").select(F.least("key", "broader").alias("a"), F.greatest("key", "broader").alias("b")).distinct()
    return pairs.join(known, ["a", "b"], "left_anti")


def related_store(links: DataFrame, terms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """links: src, dst. terms: key, source. Related terms in factored form: classes (class, key) and edges (a, b) between classes.

    Sources with the same set of terms are one class, named by the set's digest. The rows are as many as the classes' terms and the
    distinct links between classes, however many pairs of terms they stand for.
    """
    sets = terms.select("key", "source").distinct().groupBy("source").agg(F.array_sort(F.collect_list("key")).alias("keys"))
    digest = F.sha2(F.to_json(F.struct("keys")).cast("binary"), 256)
    sets = sets.select("source", digest.alias("class"), "keys")
    classes = sets.groupBy("class").agg(F.first("keys").alias("keys")).select("class", F.explode("keys").alias("key"))
    own = sets.select("source", "class")
    edges = links.select("src", "dst").distinct().join(own.select(F.col("source").alias("src"), F.col("class").alias("a")), "src").join(
        own.select(F.col("source").alias("dst"), F.col("class").alias("b")), "dst"
    )
    return classes, edges.select("a", "b").distinct()


def related_of(keys: DataFrame, classes: DataFrame, edges: DataFrame, broader: DataFrame) -> DataFrame:
    """keys: key. key and related (sorted) of those keys that have related terms, from the factored form; only their classes are expanded.

    broader: key, broader. A term and its broader one aren't related.
    """
    ways = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    # keys that are in the same classes are of one kind and have the same list, which is made once
    sets = keys.select("key").distinct().join(classes, "key").groupBy("key").agg(F.sort_array(F.collect_set("class")).alias("classes"))
    kinds = sets.select("key", F.sha2(F.array_join("classes", ",").cast("binary"), 256).alias("class"), "classes")
    used = kinds.select("class", F.explode("classes").alias("a")).distinct().join(ways, "a").select("class", F.col("b").alias("_class")).distinct()
    lists = used.join(classes.withColumnRenamed("class", "_class"), "_class").groupBy("class").agg(F.sort_array(F.collect_set("key")).alias("others"))
    # it goes to each block of its keys, so that a large kind isn't one task's
    blocks = _key_blocks(kinds.select("class", "key")).join(lists.select("class"), "class", "left_semi")
    known = broader.where("broader is not null").select("key", F.col("broader").alias("other"))
    known = known.unionByName(known.select(F.col("other").alias("key"), F.col("key").alias("other"))).groupBy("key").agg(F.collect_set("other").alias("known"))
    own = blocks.select("class", "block", F.explode("keys").alias("key")).join(known, "key", "left")
    n = max(int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    each = own.repartition(n, "class", "block").join(blocks.select("class", "block").join(lists, "class").repartition(n, "class", "block"), ["class", "block"])
    related = F.array_except("others", F.concat(F.array("key"), F.coalesce("known", F.array().cast("array<string>"))))
    return each.select("key", related.alias("related")).where(F.size("related") > 0)


def expand(queries: DataFrame, terms: DataFrame, aliases: DataFrame, dictionary: DataFrame, cap: int = DEFAULTS.expansion_cap, tiers: dict[str, float] | None = None) -> DataFrame:
    """queries: query, text. terms: key, canonical, aliases, narrower, related. Weighted tokens: query, ordinal, term, weight, tier.

    First the query's own tokens; then for each raw word, in order, of the term whose alias it is: canonical form,
    aliases, narrower terms, related terms; if it is no alias, its synonyms. A token keeps the first tier that brings it; the
    cap doesn't cut the query's own.
    """
    tiers = tiers or DEFAULTS.tiers
    known = queries.where(F.size(text.tokens(F.col("text"))) > 0)
    original = known.select("query", F.posexplode(text.tokens(F.col("text"))).alias("at", "term")).select(
        "query", F.struct(F.lit(0).alias("w"), F.lit(0).alias("tier"), F.lit(0).alias("i"), F.col("at").alias("j")).alias("ord"), "term", F.lit("original").alias("tier")
    )
    raw = known.select("query", F.posexplode(text.raw_words(F.col("text"))).alias("w", "word"))
    found = raw.join(aliases, raw.word == aliases["alias"], "left").select("query", "w", "word", "key")
    hit = found.where("key is not null").join(terms, "key")
    names = terms.select(F.col("key").alias("other"), F.col("canonical").alias("name"))
    own = hit.select("query", "w", F.posexplode(F.concat(F.array("canonical"), "aliases")).alias("i", "name")).withColumn("t", F.lit(1))
    linked = [
        hit.select("query", "w", F.posexplode(c).alias("i", "other")).join(names, "other").select("query", "w", "i", "name", F.lit(n).alias("t"))
        for n, c in ((2, "narrower"), (3, "related"))
    ]
    missing = found.where("key is null").join(dictionary, "word").select("query", "w", F.posexplode("synonyms").alias("i", "name")).withColumn("t", F.lit(1))
    more = own.unionByName(linked[0]).unionByName(linked[1]).unionByName(missing)
    more = more.select("query", "w", "t", "i", F.posexplode(text.tokens(F.col("name"))).alias("j", "term"))
    tier = F.element_at(F.array(F.lit("alias"), F.lit("narrower"), F.lit("related")), F.col("t"))
    more = more.select("query", F.struct((F.col("w") + 1).alias("w"), F.col("t").alias("tier"), "i", "j").alias("ord"), "term", tier.alias("tier"))
    rows = original.unionByName(more).groupBy("query", "term").agg(F.min(F.struct("ord", "tier")).alias("m")).select("query", "term", "m.ord", "m.tier")
    rows = rows.withColumn("ordinal", F.row_number().over(Window.partitionBy("query").orderBy("ord")).cast("bigint"))
    weight: Column = F.lit(1.0)
    for name, w in tiers.items():
        weight = F.when(F.col("tier") == name, F.lit(float(w))).otherwise(weight)
    return rows.where((F.col("tier") == "original") | (F.col("ordinal") <= (cap if cap > 0 else 20))).select("query", "ordinal", "term", weight.alias("weight"), "tier")


def statistics(terms: DataFrame) -> DataFrame:
    """Terms by source, those with aliases, and their aliases."""
    return terms.groupBy("source").agg(
        F.count("*").alias("terms"), F.count_if(F.size("aliases") > 0).alias("with_aliases"), F.sum(F.size("aliases")).cast("bigint").alias("aliases"),
        F.round(F.avg(F.size("aliases")), 6).alias("mean_aliases"),
    )
