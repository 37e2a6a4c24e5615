"""Term extraction, deduplication, aliases, hierarchy, references and query expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, words
from ..operators import taxonomy as X
from ..registry import query
from ..sources.adapters import BLOCKS_SQL, CHUNKS_SQL, blocks, chunks, table
from .text_queries import KEPT_SQL, KEY_SQL, sql_list, stems_sql

#: Lines of prose dressed as markdown: code, bold terms, list headers and tables by their position.
_W1, _W2, _REST = "regexp_extract(content, '^(\\S+)', 1)", "regexp_extract(content, '^(\\S+(?: \\S+)?)', 1)", "regexp_replace(content, '[:*_|]', '')"
_K = "CASE WHEN position % 2 = 1 THEN 2 ELSE position // 2 % 4 END"
MARK_SQL = BLOCKS_SQL + f""", mk AS (SELECT path AS chunk, position AS block, CASE {_K} WHEN 0 THEN 'heading' WHEN 1 THEN 'code_block' WHEN 2 THEN 'list' ELSE 'table' END AS type,
    CASE {_K} WHEN 0 THEN content WHEN 1 THEN 'def ' || {_W1} || '(x):' || chr(10) || 'class ' || {_W1} || chr(10) || '  pub fn no' || chr(10) || 'export function ' || reverse({_W1}) || '()'
      WHEN 2 THEN '- **' || {_W2} || '** is' || chr(10) || '* ' || {_W1} || ': ' || content || chr(10) || 'so **not here**' || chr(10) || '1. __under__ x' || chr(10) || '+ ' || {_W2} || ' -- dash'
      ELSE replace({_W2}, ' ', ' | ') || ' | Name | ' || {_W1} || chr(10) || '--- | ---' END AS content FROM blk)"""


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    k = F.when(F.col("position") % 2 == 1, 2).otherwise(F.floor(F.col("position") / 2) % 4)
    one, two = F.regexp_extract("content", r"^(\S+)", 1), F.regexp_extract("content", r"^(\S+(?: \S+)?)", 1)
    code = F.concat(F.lit("def "), one, F.lit("(x):\nclass "), one, F.lit("\n  pub fn no\nexport function "), F.reverse(one), F.lit("()"))
    items = F.concat(F.lit("- **"), two, F.lit("** is\n* "), one, F.lit(": "), "content", F.lit("\nso **not here**\n1. __under__ x\n+ "), two, F.lit(" -- dash"))
    rows = F.concat(F.replace(two, F.lit(" "), F.lit(" | ")), F.lit(" | Name | "), one, F.lit("\n--- | ---"))
    kind = F.when(k == 0, "heading").when(k == 1, "code_block").when(k == 2, "list").otherwise("table")
    return b.select(F.col("path").alias("chunk"), F.col("position").alias("block"), kind.alias("type"), F.when(k == 0, F.col("content")).when(k == 1, code).when(k == 2, items).otherwise(rows).alias("content"))


def _first_sql(found: str, where: str = "true", place: bool = False) -> str:
    """Of each block's finds (list column f) the first of each spelling."""
    return f"""SELECT chunk, block, canonical{', place' if place else ''} FROM (SELECT chunk, block, canonical, place, row_number() OVER (PARTITION BY chunk, block, lower(canonical) ORDER BY place) AS n
      FROM (SELECT chunk, block, trim(unnest(f)) AS canonical, generate_subscripts(f, 1) AS place FROM ({found})) WHERE canonical <> '' AND {where}) WHERE n = 1"""


def _three(df: DataFrame) -> DataFrame:
    return df.select("chunk", "block", "canonical")


@query("X2_heading_terms", f"WITH {MARK_SQL} SELECT chunk, block, trim(content) AS canonical FROM mk WHERE type = 'heading'")
def heading_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(X.heading_terms(marked(spark, sf_dir)))


_CODE = "SELECT chunk, block, flatten([" + ", ".join(f"regexp_extract_all(content, '{p}', 1)" for p in X.CODE_PATTERNS) + "]) AS f FROM mk WHERE type = 'code_block'"


@query("X3_code_identifiers", f"WITH {MARK_SQL} {_first_sql(_CODE, 'strlen(canonical) >= 3')}")
def code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(X.code_identifiers(marked(spark, sf_dir)))


_BOLD = f"""SELECT chunk, block, list_transform(range(1, 1 + len(regexp_extract_all(content, '{X.BOLD}', 1))), lambda i: coalesce(regexp_extract_all(content, '{X.BOLD}', 1)[i::INT], '')
    || coalesce(regexp_extract_all(content, '{X.BOLD}', 2)[i::INT], '')) AS f FROM mk"""


@query("X4_bold_terms", f"WITH {MARK_SQL} {_first_sql(_BOLD, 'strlen(canonical) <= 60')}")
def bold_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(X.bold_terms(marked(spark, sf_dir)))


_LIST = f"SELECT chunk, block, regexp_extract_all(content, '{X.LIST_HEADER}', 1) AS f FROM mk"
_VERBS = "|".join(words.SENTENCE_VERBS)
_SHORT_ITEM = rf"strlen(canonical) <= 60 AND NOT (strlen(canonical) > 30 AND regexp_matches(canonical, '(?i)\b(?:{_VERBS})\b'))"


@query("X5_list_headers", f"WITH {MARK_SQL} " + _first_sql(_LIST, rf"strlen(canonical) <= 60 AND NOT (strlen(canonical) > 30 AND regexp_matches(canonical, '(?i)\b(?:{_VERBS})\b'))"))
def list_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(X.list_headers(marked(spark, sf_dir)))


_TABLE = r"SELECT chunk, block, CASE WHEN NOT regexp_matches(l, '^[\s|:-]+$') THEN string_split(l, '|') END AS f FROM (SELECT chunk, block, trim(string_split(content, chr(10))[1]) AS l FROM mk WHERE type = 'table')"


@query("X6_table_headers", f"WITH {MARK_SQL} {_first_sql(_TABLE, f'strlen(canonical) <= 60 AND NOT list_contains({sql_list(words.GENERIC_HEADERS)}, lower(canonical))')}")
def table_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _three(X.table_headers(marked(spark, sf_dir)))


#: Candidates of all five kinds, by kind; and the ranks of their sources.
_KINDS = (("code_identifier", _CODE, "strlen(canonical) >= 3"), ("bold_term", _BOLD, "strlen(canonical) <= 60"), ("structured_position", _LIST, _SHORT_ITEM),
          ("structured_position", _TABLE, f"strlen(canonical) <= 60 AND NOT list_contains({sql_list(words.GENERIC_HEADERS)}, lower(canonical))"))
STRUCTURAL_SQL = MARK_SQL + ", st AS (SELECT chunk, block, trim(content) AS canonical, 1 AS place, 0 AS kind, 'heading' AS source FROM mk WHERE type = 'heading' AND trim(content) <> ''" + "".join(
    f" UNION ALL SELECT chunk, block, canonical, place, {i}, '{name}' FROM ({_first_sql(found, where, place=True)})" for i, (name, found, where) in enumerate(_KINDS, 1)
) + ")"
RANK_SQL = "CASE source " + " ".join(f"WHEN '{name}' THEN {rank}" for name, rank in words.SOURCE_RANKS.items()) + " ELSE 7 END"


#: Abbreviations made of the first three words of a line, in either order.
ABBR_SQL = BLOCKS_SQL + r""", ws AS (SELECT path AS chunk, position AS block, list_filter(regexp_extract_all(content, '[A-Za-z][a-z]+'), lambda w: strlen(w) > 1)[1:3] AS w FROM blk),
    ab AS (SELECT chunk, block, upper(left(w[1], 1) || left(w[2], 1) || left(w[3], 1)) AS s, upper(left(w[1], 1)) || substr(w[1], 2) || ' ' || w[2] || ' ' || w[3] AS l FROM ws WHERE len(w) = 3)"""


def abbreviated(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.slice(F.filter(F.regexp_extract_all("content", F.lit("([A-Za-z][a-z]+)"), F.lit(1)), lambda x: F.octet_length(x) > 1), 1, 3)
    b = blocks(spark, sf_dir).select(F.col("path").alias("chunk"), F.col("position").alias("block"), w.alias("w")).where(F.size("w") == 3)
    at = lambda i: F.col("w")[i]
    short = F.upper(F.concat(*[F.substring(at(i), 1, 1) for i in range(3)]))
    long = F.concat(F.upper(F.substring(at(0), 1, 1)), F.substring(at(0), 2, 1 << 30), F.lit(" "), at(1), F.lit(" "), at(2))
    return b.select("chunk", "block", F.when(F.col("block") % 2 == 0, F.concat(F.lit("see "), long, F.lit(" ("), short, F.lit(") ok"))).otherwise(F.concat(short, F.lit(" ("), long, F.lit(")"))).alias("content"))


PAIRS_SQL = ABBR_SQL + ", pairs AS (SELECT arg_min((s, l), (chunk, block)) AS p FROM ab WHERE strlen(l) <= 54 GROUP BY lower(s), lower(l))"


@query("X7_abbreviations", f"WITH {PAIRS_SQL} SELECT struct_extract(p, 1) AS short, struct_extract(p, 2) AS long FROM pairs")
def abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.abbreviations(abbreviated(spark, sf_dir))


#: Candidates: headings of blocks, and their first words as bold terms.
CAND_SQL = CHUNKS_SQL + """, cand AS (SELECT (source, sequence, 0) AS ordinal, heading AS canonical, 'heading' AS source, id AS chunk FROM chk
    UNION ALL SELECT (source, sequence, 1), translate(string_split(heading, ' > ')[1], 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), 'bold_term', id FROM chk)"""
TERMS_SQL = CAND_SQL + f""", keyed AS (SELECT *, {KEY_SQL.format('canonical')} AS key FROM cand),
    terms AS (SELECT key, arg_min((canonical, source), (CASE source WHEN 'heading' THEN 0 ELSE 2 END, ordinal)) AS best, list_sort(list_distinct(list(chunk))) AS chunks
      FROM keyed WHERE key <> '' GROUP BY key HAVING len(list_distinct(list(chunk))) >= 2),
    tm AS (SELECT key, struct_extract(best, 1) AS canonical, struct_extract(best, 2) AS source, chunks FROM terms)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    one = lambda k, name, source: c.select(F.struct("source", "sequence", F.lit(k).alias("k")).alias("ordinal"), name.alias("canonical"), F.lit(source).alias("kind"), F.col("id").alias("chunk"))
    both = one(0, F.col("heading"), "heading").unionByName(one(1, F.translate(F.split("heading", " > ")[0], *text.ASCII_UPPER), "bold_term"))
    return both.withColumnRenamed("kind", "source")


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.deduplicate(candidates(spark, sf_dir))


@query("A5_deduplicate", f"WITH {TERMS_SQL} SELECT key, canonical, source, chunks FROM tm")
def deduplicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir)


@query("A7_chunk_terms", f"WITH {TERMS_SQL} SELECT chunk, list(key ORDER BY key) AS terms FROM (SELECT key, unnest(chunks) AS chunk FROM tm) GROUP BY chunk")
def chunk_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.chunk_terms(terms(spark, sf_dir))


KINDS = [*words.SOURCE_RANKS, "other"]


@query(
    "A6_source_ranks",
    f"""WITH {CHUNKS_SQL} SELECT heading, arg_min(kind, rank) AS source, min(rank)::BIGINT AS rank, count(*)::BIGINT AS n
        FROM (SELECT heading, tokens % 8 AS rank, {KINDS}[(tokens % 8 + 1)::INT] AS kind FROM chk) GROUP BY heading""",
)
def source_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of the kinds of source that name a heading; a chunk's number of tokens stands for the kind."""
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("tokens") % 8 + 1).cast("int"))
    rows = chunks(spark, sf_dir).select("heading", kind.alias("source")).withColumn("rank", X.source_rank(F.col("source")).cast("bigint"))
    return rows.groupBy("heading").agg(F.min_by("source", "rank").alias("source"), F.min("rank").alias("rank"), F.count("*").alias("n"))


#: Aliases: a term's key without hyphens, and its first three letters.
FULL_SQL = TERMS_SQL + ", full_ AS (SELECT *, list_distinct([replace(key, '-', ''), left(key, 3)]) AS aliases FROM tm)"


def full_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms(spark, sf_dir).withColumn("aliases", F.array_distinct(F.array(F.replace("key", F.lit("-"), F.lit("")), F.substring("key", 1, 3))))


@query("A8_alias_index", f"WITH {FULL_SQL} SELECT alias, min(key) AS key FROM (SELECT key, lower(unnest(list_concat([canonical, key], aliases))) AS alias FROM full_) GROUP BY alias")
def alias_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.alias_index(full_terms(spark, sf_dir))


@query(
    "A9_A10_term_statistics",
    f"WITH {FULL_SQL} SELECT source, count(*)::BIGINT AS terms, count(*) FILTER (len(aliases) > 0)::BIGINT AS with_aliases, sum(len(aliases))::BIGINT AS aliases, round(avg(len(aliases)), 6) AS mean_aliases FROM full_ GROUP BY source",
)
def term_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.statistics(full_terms(spark, sf_dir))


@query(
    "J14_apply_abbreviations",
    f"""WITH {PAIRS_SQL}, pp AS (SELECT struct_extract(p, 1) AS s, struct_extract(p, 2) AS l FROM pairs), known AS (SELECT DISTINCT lower(substr(s, 1, 3)) AS key FROM pp)
        SELECT DISTINCT lower(s) AS key, lower(l) AS alias FROM pp WHERE lower(s) IN (SELECT key FROM known)""",
)
def apply_abbreviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = X.abbreviations(abbreviated(spark, sf_dir))
    return X.apply_abbreviations(pairs.select(F.lower("short").alias("key")).distinct(), pairs)


#: A dictionary of own words, as a table: (word, synonyms).
DICTIONARY = [("the", ["article"]), ("that", ["which"]), ("an", ["one"]), ("der", ["artikel", "the"]), ("en-er", ["ener"]), ("of", ["from"])]
DICT_SQL = "dict AS (SELECT * FROM (VALUES " + ", ".join(f"('{w}', {sql_list(s)})" for w, s in DICTIONARY) + ") d(word, synonyms))"


def dictionary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DICTIONARY, "word string, synonyms array<string>")


@query("J15_apply_dictionary", f"WITH {TERMS_SQL}, {DICT_SQL} SELECT DISTINCT key, unnest(synonyms) AS alias FROM tm JOIN dict ON word = key OR word = {KEY_SQL.format('canonical')}")
def apply_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.apply_dictionary(terms(spark, sf_dir), dictionary(spark))


#: Heading paths of a chunk: its heading's words, lower-cased.
HIER_SQL = CHUNKS_SQL + f""", hp AS (SELECT source, sequence, list_transform(string_split(heading, ' > '), lambda h: {KEY_SQL.format('h')}) AS k FROM chk),
    ks AS (SELECT DISTINCT unnest(k) AS key FROM hp), pc AS (SELECT source, sequence, k[1] AS parent, k[2] AS child FROM hp WHERE len(k) = 2 AND k[1] <> k[2] AND k[1] <> '' AND k[2] <> '')"""


@query(
    "X10_heading_hierarchy",
    f"""WITH {HIER_SQL}, up AS (SELECT child AS key, arg_min(parent, (source, sequence)) AS broader FROM pc GROUP BY child), dn AS (SELECT parent AS key, list_sort(list_distinct(list(child))) AS narrower FROM pc GROUP BY parent)
        SELECT coalesce(up.key, dn.key) AS key, broader, narrower FROM up FULL JOIN dn ON up.key = dn.key""",
)
def heading_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir).select(F.struct("source", "sequence").alias("ordinal"), F.split("heading", " > ").alias("heading"))
    known = c.select(F.explode(F.transform("heading", lambda h: text.normalize_key(h))).alias("key")).where("key <> ''").distinct()
    return X.heading_hierarchy(c, known)


@query(
    "J16_cross_references",
    """WITH t AS (SELECT s_suppkey % 40 AS src, 'k' || s_suppkey AS key FROM supplier), l AS (SELECT DISTINCT n_nationkey AS src, n_regionkey + 5 AS dst FROM nation),
       b AS (SELECT 'k' || s_suppkey AS key, 'k' || (s_suppkey // 2) AS broader FROM supplier WHERE s_suppkey % 3 = 0)
       SELECT DISTINCT least(x.key, y.key) AS a, greatest(x.key, y.key) AS b FROM l JOIN t x ON x.src = l.src JOIN t y ON y.src = l.dst WHERE x.key <> y.key
         AND NOT EXISTS (SELECT 1 FROM b WHERE (b.key = x.key AND broader = y.key) OR (b.key = y.key AND broader = x.key))""",
)
def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, links, broader = linked_terms(spark, sf_dir)
    return X.cross_references(links, t, broader)


def linked_terms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nations stand for linked sources, suppliers for their terms."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey")
    k = lambda c: F.concat(F.lit("k"), c.cast("string"))
    t = s.select((F.col("s_suppkey") % 40).alias("source"), k(F.col("s_suppkey")).alias("key"))
    links = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("src"), (F.col("n_regionkey") + 5).cast("bigint").alias("dst"))
    broader = s.where("s_suppkey % 3 = 0").select(k(F.col("s_suppkey")).alias("key"), k(F.floor(F.col("s_suppkey") / 2)).alias("broader"))
    return t, links, broader


@query(
    "J16_related_of",
    """WITH t AS (SELECT s_suppkey % 40 AS src, 'k' || s_suppkey AS key FROM supplier), l AS (SELECT DISTINCT n_nationkey AS src, n_regionkey + 5 AS dst FROM nation),
       b AS (SELECT 'k' || s_suppkey AS key, 'k' || (s_suppkey // 2) AS broader FROM supplier WHERE s_suppkey % 3 = 0),
       p AS (SELECT x.key, y.key AS other FROM l JOIN t x ON x.src = l.src JOIN t y ON y.src = l.dst UNION SELECT y.key, x.key FROM l JOIN t x ON x.src = l.src JOIN t y ON y.src = l.dst)
       SELECT key, list(other ORDER BY other) AS related FROM p WHERE key <> other
         AND NOT EXISTS (SELECT 1 FROM b WHERE (b.key = p.key AND broader = p.other) OR (b.key = p.other AND broader = p.key)) GROUP BY key""",
)
def related_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Related terms of every key, from the factored form."""
    t, links, broader = linked_terms(spark, sf_dir)
    return X.related_of(t, *X.related_store(links, t), broader)


#: Terms for expansion: of each heading word its key; narrower and related ones are the next keys.
EXP_SQL = FULL_SQL + f""", et AS (SELECT key, canonical, aliases, lead(key) OVER o AS nx, lag(key) OVER o AS pv FROM (SELECT *, left(key, 1) AS g FROM full_) WINDOW o AS (PARTITION BY g ORDER BY key)),
    ai AS (SELECT alias, min(key) AS key FROM (SELECT key, lower(unnest(list_concat([canonical, key], aliases))) AS alias FROM full_) GROUP BY alias), {DICT_SQL},
    qk AS (SELECT item_id AS query, text FROM benchmark WHERE len({KEPT_SQL}) > 0),
    og AS (SELECT query, unnest({KEPT_SQL}) AS token, generate_subscripts({KEPT_SQL}, 1) - 1 AS j FROM qk),
    rw AS (SELECT query, lower(unnest(regexp_extract_all(text, '[\\w][\\w\\-\\.]*[\\w]|[\\w]+'))) AS word, generate_subscripts(regexp_extract_all(text, '[\\w][\\w\\-\\.]*[\\w]|[\\w]+'), 1) AS w FROM qk),
    fo AS (SELECT query, w, word, key FROM rw LEFT JOIN ai ON ai.alias = rw.word),
    nm AS (SELECT query, w, 1 AS t, unnest(list_concat([canonical], aliases)) AS text, generate_subscripts(list_concat([canonical], aliases), 1) - 1 AS i FROM fo JOIN et USING (key)
      UNION ALL SELECT query, w, 2, o.canonical, 0 FROM fo JOIN et USING (key) JOIN et o ON o.key = et.nx UNION ALL SELECT query, w, 3, o.canonical, 0 FROM fo JOIN et USING (key) JOIN et o ON o.key = et.pv
      UNION ALL SELECT query, w, 1, unnest(synonyms), generate_subscripts(synonyms, 1) - 1 FROM fo JOIN dict USING (word) WHERE key IS NULL),
    ex AS (SELECT query, w, t, i, unnest({KEPT_SQL}) AS token, generate_subscripts({KEPT_SQL}, 1) - 1 AS j FROM nm),
    tv AS (SELECT token FROM og UNION ALL SELECT token FROM ex), {stems_sql('tv')},
    al AS (SELECT query, term, (0, 0, 0, j::INT) AS ord, 'original' AS tier FROM og JOIN stems USING (token)
      UNION ALL SELECT query, term, (w::INT, t, i::INT, j::INT), ['alias', 'narrower', 'related'][t] FROM ex JOIN stems USING (token)),
    mn AS (SELECT query, term, min(ord) AS ord, arg_min(tier, ord) AS tier FROM al GROUP BY ALL), xq AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY ord) AS ordinal FROM mn)"""


def expanded(spark: SparkSession, sf_dir: str, cap: int) -> DataFrame:
    from pyspark.sql import Window

    full = full_terms(spark, sf_dir)
    order = Window.partitionBy(F.substring("key", 1, 1)).orderBy("key")
    some = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    t = full.select("key", "canonical", "aliases", some(F.lead("key").over(order)).alias("narrower"), some(F.lag("key").over(order)).alias("related"))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), "text")
    return X.expand(q, t, X.alias_index(full), dictionary(spark), cap)


@query("R6_expand_weighted", f"WITH {EXP_SQL} SELECT query, ordinal, term, CASE tier WHEN 'narrower' THEN 0.7 WHEN 'related' THEN 0.4 ELSE 1.0 END::DOUBLE AS weight, tier FROM xq WHERE tier = 'original' OR ordinal <= 20")
def expand_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return expanded(spark, sf_dir, 20)


@query("R5_expand", f"WITH {EXP_SQL} SELECT query, string_agg(term, ' ' ORDER BY ordinal) AS expanded FROM xq WHERE tier <> 'related' GROUP BY query")
def expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a cap and without related terms."""
    e = expanded(spark, sf_dir, 1 << 30).where("tier <> 'related'")
    own = F.array_sort(F.collect_list(F.struct("ordinal", "term")))
    return e.groupBy("query").agg(F.array_join(F.transform(own, lambda x: x["term"]), " ").alias("expanded"))


@query("U1_U4_candidates", f"WITH {CAND_SQL} SELECT source, count(*)::BIGINT AS n, count(DISTINCT canonical)::BIGINT AS names FROM cand GROUP BY source")
def union_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("canonical").alias("names"))
