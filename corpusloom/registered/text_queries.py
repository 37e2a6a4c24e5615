"""Tokens, keys, paths, hashes and display forms over the corpus tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text, words
from ..functions.stem import AFTER_1A, SPECIAL, STEP2, STEP3, STEP4
from ..operators import packages
from ..registry import query
from ..sources.adapters import BLOCKS_SQL, CHUNKS_SQL, SOURCES_SQL, blocks, chunks, sources, table


def sql_list(items) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in items) + "]"


RAW_SQL = r"regexp_extract_all(text, '[\w][\w\-\.]*[\w]|[\w]+')"
STOP_SQL = f"list_contains({sql_list(words.STOPWORDS)}, lower({{0}})) AND NOT list_contains({sql_list(words.TECHNICAL)}, lower({{0}}))"
#: Raw tokens without stop words, as they are written; ``stems_sql`` makes terms of them.
KEPT_SQL = f"list_filter({RAW_SQL}, lambda w: NOT ({STOP_SQL.format('w')}))"
CODE_SQL = r"""(regexp_matches(lower(w), '[._]') OR (regexp_matches(lower(w), '[a-z]') AND regexp_matches(lower(w), '[0-9]'))
    OR (strlen(w) >= 2 AND regexp_matches(lower(w), '[a-z]') AND w = upper(w)) OR regexp_matches(substr(w, 2), '[A-Z]'))"""


def _cut(column: str, endings, rest: str = "") -> str:
    """A CASE over endings (ending, replacement, condition), the first that fits deciding; {n} in a condition is what is left of it."""
    whens = [
        f"WHEN {column} LIKE '%{e}' THEN CASE WHEN {c.format(n=f'(length({column}) - {len(e)})')} THEN left({column}, length({column}) - {len(e)}) || '{to}' ELSE {column} END"
        for e, to, c in endings
    ]
    return f"CASE {' '.join(whens)} {rest} ELSE {column} END"


def stems_sql(tokens: str) -> str:
    """Common table expressions up to ``stems`` (token, term): Porter2 step by step over the parts of the tokens in the relation ``tokens`` (token).

    Independent of the Python stemmer: regular expressions and CASE over whole columns; only lists of the published algorithm are shared.
    """
    v, r1, r2 = "[aeiouy]", "{n} >= r1", "{n} >= r2"
    short = lambda c: f"(regexp_matches({c}, '[^aeiouy][aeiouy][^aeiouywxY]$') OR regexp_matches({c}, '^[aeiouy][^aeiouy]$'))"
    ing = [(e, "", f"regexp_matches(left(b, {{n}}), '{v}')") for e in ("ingly", "edly", "ing", "ed")]
    step2 = [(e, to, r1 + {"ogi": " AND d LIKE '%logi'", "li": " AND regexp_matches(d, '[cdeghkmnrt]li$')"}.get(e, "")) for e, to in STEP2]
    step3 = [(e, to, r2 if e == "ative" else r1) for e, to in STEP3]
    step4 = [(e, "", r2 + (" AND regexp_matches(g, '[st]ion$')" if e == "ion" else "")) for e in STEP4]
    cases = ", ".join(f"('{w}', '{t}')" for w, t in SPECIAL.items() if w not in words.UNSTEMMED)
    return f"""sv AS (SELECT DISTINCT token AS w FROM {tokens}), sp AS (SELECT DISTINCT unnest(string_split(lower(w), '-')) AS p FROM sv),
    s0 AS (SELECT p, regexp_replace(regexp_replace(p, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS x FROM sp
      WHERE length(p) > 2 AND NOT list_contains({sql_list(words.UNSTEMMED)}, p) AND p NOT IN (SELECT * FROM (VALUES {', '.join(f"('{w}')" for w in SPECIAL)}))),
    s1 AS (SELECT *, CASE WHEN regexp_matches(x, '^(gener|arsen)') THEN 5 WHEN x LIKE 'commun%' THEN 6
      WHEN regexp_matches(x, '{v}[^aeiouy]') THEN length(regexp_extract(x, '^.*?{v}[^aeiouy]')) ELSE length(x) END AS r1 FROM s0),
    s2 AS (SELECT *, CASE WHEN regexp_matches(substr(x, r1 + 1), '{v}[^aeiouy]') THEN r1 + length(regexp_extract(substr(x, r1 + 1), '^.*?{v}[^aeiouy]')) ELSE length(x) END AS r2 FROM s1),
    s3 AS (SELECT *, CASE WHEN x LIKE '%sses' THEN left(x, -2) WHEN x LIKE '%ied' OR x LIKE '%ies' THEN left(x, CASE WHEN length(x) > 4 THEN -2 ELSE -1 END)
      WHEN x LIKE '%s' AND x NOT LIKE '%us' AND x NOT LIKE '%ss' AND regexp_matches(left(x, -1), '{v}.') THEN left(x, -1) ELSE x END AS b FROM s2),
    s4 AS (SELECT *, list_contains({sql_list(sorted(AFTER_1A))}, b) AS done, CASE WHEN b LIKE '%eed' OR b LIKE '%eedly' THEN {_cut('b', [('eedly', 'ee', r1), ('eed', 'ee', r1)])}
      ELSE {_cut('b', ing)} END AS c0 FROM s3),
    s5 AS (SELECT *, CASE WHEN c0 = b OR b LIKE '%eed' OR b LIKE '%eedly' THEN c0 WHEN regexp_matches(c0, '(at|bl|iz)$') THEN c0 || 'e' WHEN regexp_matches(c0, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(c0, -1)
      WHEN length(c0) <= r1 AND {short('c0')} THEN c0 || 'e' ELSE c0 END AS c FROM s4),
    s6 AS (SELECT *, CASE WHEN length(c) > 2 AND regexp_matches(c, '[^aeiouy][yY]$') THEN left(c, -1) || 'i' ELSE c END AS d FROM s5),
    s7 AS (SELECT *, {_cut('d', step2)} AS e FROM s6), s8 AS (SELECT *, {_cut('e', step3)} AS g FROM s7), s9 AS (SELECT *, {_cut('g', step4)} AS h FROM s8),
    st AS (SELECT p, lower(CASE WHEN done THEN b WHEN h LIKE '%e' AND (length(h) - 1 >= r2 OR (length(h) - 1 >= r1 AND NOT {short('left(h, -1)')})) THEN left(h, -1)
      WHEN h LIKE '%ll' AND length(h) - 1 >= r2 THEN left(h, -1) ELSE h END) AS s FROM s9 UNION ALL SELECT * FROM (VALUES {cases})),
    sq AS (SELECT w, unnest(string_split(lower(w), '-')) AS p, generate_subscripts(string_split(lower(w), '-'), 1) AS i FROM sv),
    stems AS (SELECT w AS token, CASE WHEN {CODE_SQL} OR list_contains({sql_list(words.TECHNICAL)}, lower(w)) THEN lower(w)
      ELSE string_agg(coalesce(s, p), '-' ORDER BY i) END AS term FROM sq LEFT JOIN st USING (p) GROUP BY w)"""


SQUEEZE = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def sha(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


@query(
    "T1_tokenize",
    f"""WITH k AS (SELECT doc_id, unnest({KEPT_SQL}) AS token, generate_subscripts({KEPT_SQL}, 1) AS i FROM documents), {stems_sql('k')},
        t AS (SELECT doc_id, count(*) AS n, string_agg(term, ' ' ORDER BY i) AS t FROM k JOIN stems USING (token) GROUP BY doc_id)
        SELECT doc_id, coalesce(n, 0)::BIGINT AS n, sha256(coalesce(t, '')) AS digest FROM documents LEFT JOIN t USING (doc_id) WHERE text IS NOT NULL""",
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("bigint").alias("n"), sha(F.array_join("t", " ")).alias("digest"))


@query(
    "T2_stopwords",
    f"""SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest(list_transform({RAW_SQL}, lambda w: lower(w))) AS w FROM documents)
        WHERE list_contains({sql_list(words.STOPWORDS)}, w) AND NOT list_contains({sql_list(words.TECHNICAL)}, w) GROUP BY w""",
)
def stopwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(text.raw_words(F.col("text"))).alias("word"))
    return w.where(text.is_stopword(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("T3_code_identifier", f"SELECT w AS word, count(*)::BIGINT AS n FROM (SELECT unnest({RAW_SQL}) AS w FROM documents) WHERE {CODE_SQL} GROUP BY w")
def code_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("word"))
    return w.where(text.is_code_identifier(F.col("word"))).groupBy("word").agg(F.count("*").alias("n"))


@query("T4_mixed_case", f"SELECT doc_id, len(list_filter({RAW_SQL}, lambda w: regexp_matches(substr(w, 2), '[A-Z]')))::BIGINT AS n FROM documents")
def mixed_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.filter(text.raw_tokens(F.col("text")), text.has_mixed_case)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("bigint").alias("n"))


@query("T6_raw_words", f"SELECT item_id, array_to_string(list_transform({RAW_SQL}, lambda w: lower(w)), ' ') AS words FROM benchmark")
def raw_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.raw_words(F.col("text")), " ").alias("words"))


RAKE_SQL = r"list_filter(string_split(trim(regexp_replace(translate(lower({}), '.!?,;:' || chr(10) || chr(9) || '()[]\"''', repeat(' ', 14)), '\s+', ' ', 'g')), ' '), lambda w: w <> '')".replace('\\"', '"')


@query("T7_rake_words", f"SELECT item_id, array_to_string({RAKE_SQL.format('text')}, '|') AS words FROM benchmark")
def rake_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(text.rake_words(F.col("text")), "|").alias("words"))


@query(
    "T8_tail_window",
    """WITH t AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '_', 'g') AS a FROM documents)
       SELECT doc_id, CASE WHEN strlen(a) <= 600 THEN a WHEN strpos(right(a, 600), ' ') = 0 THEN right(a, 600)
              ELSE substr(right(a, 600), strpos(right(a, 600), ' ') + 1) END AS tail FROM t""",
)
def tail_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.regexp_replace("text", r"[^\x00-\x7F]", "_")
    return table(spark, sf_dir, "documents").select("doc_id", text.tail_window(plain, 600).alias("tail"))


@query(
    "T9_last_sentence",
    r"""WITH t AS (SELECT doc_id, trim(text) AS c FROM documents),
        s AS (SELECT doc_id, c, regexp_replace(regexp_extract(c, '(?s)([^.!?]*[.!?])[^.!?]*$', 1), '^\s+|\s+$', '', 'g') AS f FROM t)
        SELECT doc_id, CASE WHEN (len(string_split(c, '```')) - 1) % 2 <> 0 OR starts_with(trim(string_split(c, chr(10))[-1]), '```')
               OR strlen(f) < 20 OR regexp_matches(f, '^(#|- |\* |\|)') THEN '' ELSE f END AS sentence FROM s""",
)
def last_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.last_sentence(F.col("text")).alias("sentence"))


@query("T10_short_hash", "SELECT doc_id, substr(sha256(text), 1, 12) AS short FROM documents")
def short_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.short_hash(text.content_hash(F.col("text"))).alias("short"))


@query("T11_query_hash", "SELECT item_id, 'sha256:' || sha256(text) AS hash FROM benchmark")
def query_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", text.content_hash(F.col("text")).alias("hash"))


@query(
    "T12_chunk_set_hash",
    f"WITH {CHUNKS_SQL} SELECT source, 'sha256:' || sha256(string_agg(id, ',' ORDER BY id)) AS hash FROM chk GROUP BY source",
)
def chunk_set_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("source").agg(text.set_hash(F.collect_list("id")).alias("hash"))


@query(
    "T13_compile_hash",
    f"""WITH {SOURCES_SQL}, h AS (SELECT (doc_id // 64)::BIGINT AS part, path || '=' || sha256(text) AS line FROM src)
        SELECT part, sha256(string_agg(line, chr(10) ORDER BY line)) AS hash FROM h GROUP BY part""",
)
def compile_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest over the sorted (path, hash) rows, in parts of 64 documents that a digest of digests can join."""
    line = F.concat("path", F.lit("="), sha(F.col("text")))
    rows = sources(spark, sf_dir).select(F.floor(F.col("doc_id") / 64).alias("part"), line.alias("line"))
    return rows.groupBy("part").agg(sha(F.array_join(F.array_sort(F.collect_list("line")), "\n")).alias("hash"))


@query(
    "T14_display",
    """SELECT o_orderkey, format('{:,}', o_orderkey * 1237) AS number,
         CASE WHEN s < 1 THEN printf('%.0fms', s * 1000) WHEN s < 60 THEN printf('%.1fs', s)
              ELSE (floor(s / 60)::BIGINT)::VARCHAR || 'm' || printf('%.1fs', s - floor(s / 60) * 60) END AS duration,
         CASE WHEN a < 60 THEN 'just now' WHEN a < 3600 THEN (a // 60) || 'm ago' WHEN a < 86400 THEN (a // 3600) || 'h ago' ELSE (a // 86400) || 'd ago' END AS ago,
         format('{:,}', a) || ' / 30,011 tokens (' || printf('%.1f', a / 30011 * 100) || '%)' AS budget
       FROM (SELECT o_orderkey, (o_orderkey % 1000) / 8 AS s, (o_orderkey * 977) % 500000 AS a FROM orders)""",
)
def display(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") % 1000) / 8).alias("s"), ((F.col("o_orderkey") * 977) % 500000).alias("a"))
    return o.select(
        "o_orderkey", text.format_number(F.col("o_orderkey") * 1237).alias("number"), text.format_duration(F.col("s")).alias("duration"),
        text.format_ago(F.col("a")).alias("ago"), text.format_budget(F.col("a"), F.lit(30011)).alias("budget"),
    )


@query("T15_coalesce", "SELECT event_id, coalesce(nullif(props, ''), nullif(event_type, ''), 'unknown') AS caller FROM events")
def caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", text.first_known(F.col("props"), F.col("event_type")).alias("caller"))


@query(
    "T16_plausible_abbreviation",
    """SELECT p_partkey, strlen(a) < strlen(b) AND strlen(a) >= 2 AND lower(left(a, 1)) = lower(left(b, 1)) AS ok
       FROM (SELECT p_partkey, upper(substr(p_brand, 1, (p_partkey % 4)::INT)) AS a, p_name AS b FROM part)""",
)
def plausible(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.upper(F.expr("substr(p_brand, 1, cast(p_partkey % 4 as int))"))
    return table(spark, sf_dir, "part").select("p_partkey", text.plausible_abbreviation(short, F.col("p_name")).alias("ok"))


@query(
    "T17_looks_like_sentence",
    f"""WITH {BLOCKS_SQL} SELECT path, position, strlen(content) > 30 AND regexp_matches(content, '(?i)\\b(?:{"|".join(words.SENTENCE_VERBS)})\\b') AS sentence FROM blk""",
)
def sentence_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).select("path", "position", text.looks_like_sentence(F.col("content")).alias("sentence"))


@query("T18_generic_header", f"SELECT w AS word, list_contains({sql_list(words.GENERIC_HEADERS)}, lower(w)) AS generic FROM (SELECT DISTINCT unnest({RAW_SQL}) AS w FROM benchmark)")
def generic_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").select(F.explode(text.raw_tokens(F.col("text"))).alias("word")).distinct()
    return w.select("word", F.lower("word").isin(words.GENERIC_HEADERS).alias("generic"))


@query(
    "T20_tags",
    """SELECT p_partkey, CASE WHEN starts_with(t, 'v') THEN t ELSE 'v' || t END AS tag, regexp_replace(t, '^v', '') AS version,
              regexp_replace('>=' || t, '^>=', '') AS bare
       FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END || p_size || '.' || (p_partkey % 9) || '.0' AS t FROM part)""",
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.when(F.col("p_partkey") % 2 == 0, "v").otherwise(""), F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(".0"))
    return table(spark, sf_dir, "part").select("p_partkey", t.alias("t")).select(
        "p_partkey", paths.tag_of(F.col("t")).alias("tag"), paths.version_of(F.col("t")).alias("version"),
        paths.constraint_version(F.concat(F.lit(">="), "t")).alias("bare"),
    )


@query(
    "S15_hash",
    f"""WITH {SOURCES_SQL}, h AS (SELECT (doc_id // 100)::BIGINT AS dir, sha256(text) AS h FROM src)
        SELECT dir, count(*)::BIGINT AS files, 'sha256:' || sha256(string_agg(h, '' ORDER BY h)) AS hash FROM h GROUP BY dir""",
)
def directory_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of directories of a hundred files: SHA-256 over the sorted hashes of their files."""
    rows = sources(spark, sf_dir).select(F.floor(F.col("doc_id") / 100).alias("dir"), sha(F.col("text")).alias("h"))
    joined = F.concat_ws("", F.array_sort(F.collect_list("h")))
    return rows.groupBy("dir").agg(F.count("*").alias("files"), F.concat(F.lit("sha256:"), sha(joined)).alias("hash"))


@query("P12_classify_source", f"WITH {SOURCES_SQL} SELECT path, CASE WHEN path LIKE '%.spec.md' THEN 'spec' WHEN path LIKE 'system/%' THEN 'system' ELSE 'object' END AS kind FROM src")
def classify_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources(spark, sf_dir).select("path", paths.classify_source(F.col("path")).alias("kind"))


@query(
    "P13_classify_document",
    """SELECT p_partkey, CASE split_part(f, '/', 1) WHEN 'foundation' THEN 'foundation' WHEN 'topics' THEN 'topic' WHEN 'plans' THEN 'plan'
              WHEN 'prompts' THEN 'prompt' WHEN 'system' THEN 'system' WHEN 'packages' THEN 'package' ELSE 'topic' END AS kind
       FROM (SELECT p_partkey, ['foundation', 'topics', 'plans', 'prompts', 'system', 'packages', 'other'][1 + (p_partkey % 7)::INT] || '/x.md' AS f FROM part)""",
)
def classify_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirs = text.word_array(["foundation", "topics", "plans", "prompts", "system", "packages", "other"])
    f = F.concat(F.element_at(dirs, (F.col("p_partkey") % 7 + 1).cast("int")), F.lit("/x.md"))
    return table(spark, sf_dir, "part").select("p_partkey", paths.classify_document(f).alias("kind"))


@query(
    "P14_output_dir",
    f"""WITH {CHUNKS_SQL} SELECT id, source, CASE type WHEN 'spec' THEN 'specs' WHEN 'system' THEN 'system' ELSE 'objects' END AS dir,
        split_part(split_part(id, ':', 2), '.', 1) || '.' || sequence || '.md' AS file FROM chk""",
)
def output_dir(spark: SparkSession, sf_dir: str) -> DataFrame:
    file = F.concat(F.substring_index(F.col("id"), ":", -1), F.lit(".md"))
    return chunks(spark, sf_dir).select("id", "source", paths.output_dir(F.col("type")).alias("dir"), file.alias("file"))


@query(
    "P15_content_hash",
    "SELECT doc_id, substr(sha256(text), 1, CASE WHEN n <= 0 THEN 16 ELSE least(greatest(n, 8), 64) END) AS hash FROM (SELECT doc_id, text, (doc_id % 90 - 5)::INT AS n FROM documents)",
)
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", sha(F.col("text")).alias("h"), (F.col("doc_id") % 90 - 5).cast("int").alias("n"))
    return d.select("doc_id", F.substring("h", F.lit(1), text.clamp_hash_length(F.col("n"))).alias("hash"))


@query("P16_format_id", f"WITH {CHUNKS_SQL} SELECT source, sequence, id FROM chk")
def format_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("source", "sequence", "id")


@query("P17_heading_join", f"WITH {CHUNKS_SQL} SELECT source, sequence, heading, len(string_split(heading, ' > '))::BIGINT AS depth, sha256(content) AS content FROM chk")
def heading_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("source", "sequence", "heading", F.size(F.split("heading", " > ")).cast("bigint").alias("depth"), sha(F.col("content")).alias("content"))


@query(
    "P19_parse_ref",
    """SELECT p_partkey, CASE WHEN k = 0 THEN 'local' WHEN k = 1 THEN 'package' ELSE 'package_path' END AS kind,
              CASE WHEN k = 0 THEN '' ELSE 'pkg' || p_partkey END AS package, CASE WHEN k = 0 THEN 'topics/p' || p_partkey WHEN k = 1 THEN '' ELSE 'a/b' || p_size END AS path
       FROM (SELECT p_partkey, p_size, p_partkey % 3 AS k FROM part)""",
)
def parse_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, key = F.col("p_partkey") % 3, F.col("p_partkey").cast("string")
    package = F.concat(F.lit("pkg"), key, F.lit("@author"))
    ref = F.when(k == 0, F.concat(F.lit("topics/p"), key)).when(k == 1, package).otherwise(F.concat(package, F.lit("/a/b"), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", paths.parse_ref(ref).alias("r")).select("p_partkey", "r.*")


@query(
    "P20_humanize",
    """SELECT p_partkey, array_to_string(list_transform(list_filter(string_split(translate(p_name, '-_', '  '), ' '), lambda w: w <> ''),
              lambda w: translate(left(w, 1), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') || substr(w, 2)), ' ') AS title FROM part""",
)
def humanize(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("foundation/"), F.translate("p_name", " ", "-"), F.lit("/README.md"))
    return table(spark, sf_dir, "part").select("p_partkey", text.title_from_path(path).alias("title"))


@query(
    "P22_dep_keys",
    """SELECT p_partkey, 'pkg' || p_partkey % 50 AS name, CASE WHEN k IN (0, 1) THEN 'author' || p_size ELSE '' END AS author,
              CASE WHEN k IN (0, 2) THEN '1.' || p_size || '.0' ELSE '' END AS version, k = 0 AS complete
       FROM (SELECT p_partkey, p_size, p_partkey % 4 AS k FROM part)""",
)
def dep_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    author = F.concat(F.lit("@author"), F.col("p_size").cast("string"))
    version = F.concat(F.lit(":1."), F.col("p_size").cast("string"), F.lit(".0"))
    key = F.concat(F.lit(" pkg"), (F.col("p_partkey") % 50).cast("string"), F.when(k.isin(0, 1), author).otherwise(""), F.when(k.isin(0, 2), version).otherwise(""))
    parsed = table(spark, sf_dir, "part").select("p_partkey", paths.parse_partial_key(key).alias("p"), paths.parse_dep_key(F.trim(key)).alias("full"))
    return parsed.select("p_partkey", "p.*", F.col("full").isNotNull().alias("complete"))


#: The links of a page, as a list that someone typed: blanks around commas, an empty entry, a comma at the end. Some names hold commas.
IDS_SQL = "SELECT page_id, ' ' || array_to_string(regexp_extract_all(html, 'href=\"/([^\"]*)\"', 1), ' , ') || ',, ' AS raw FROM pages WHERE html IS NOT NULL"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").where("html is not null")
    return p.select("page_id", "url", F.regexp_extract_all("html", F.lit('href="/([^"]*)"'), F.lit(1)).alias("names"))


@query("P23_parse_ids", f"SELECT page_id, list_filter(list_transform(string_split(raw, ','), lambda x: trim(x)), lambda x: x <> '') AS ids FROM ({IDS_SQL})")
def parse_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" "), F.array_join("names", " , "), F.lit(",, "))
    return page_links(spark, sf_dir).select("page_id", paths.parse_ids(raw).alias("ids"))


#: Each link of a page in one of six forms, from a file named by the page's address.
LINKS_SQL = """lk AS (SELECT page_id, regexp_extract(url, '://[^/]*/([^?#]*)', 1) || '.md' AS source, unnest(names) AS name, generate_subscripts(names, 1) AS k
    FROM (SELECT page_id, url, regexp_extract_all(html, 'href="/([^"]*)"', 1) AS names FROM pages WHERE html IS NOT NULL)),
  lt AS (SELECT page_id, k::BIGINT AS k, source, CASE k % 6 WHEN 0 THEN '../' || name || '.md' WHEN 1 THEN './x/./' || name || '.md#part' WHEN 2 THEN '#' || name WHEN 3 THEN 'https://h/' || name
    WHEN 4 THEN '../../../' || name || '//y.md' ELSE name || '/../z.md' END AS target FROM lk),
  lp AS (SELECT *, split_part(target, '#', 1) AS plain, string_split(source, '/') AS ss FROM lt)"""
#: A path step by step: what is kept so far, and the next segment.
STEPS_SQL = """array_to_string(list_reduce(list_prepend(ss[1:len(ss) - 1], list_transform(string_split(plain, '/'), lambda x: [x])),
    lambda a, x: CASE WHEN x[1] IN ('', '.') THEN a WHEN x[1] <> '..' THEN a || x WHEN len(a) = 0 {above} THEN {kept} ELSE a[1:len(a) - 1] END), '/')"""


@query(
    "P24_P25_resolve_link",
    f"""WITH {LINKS_SQL} SELECT page_id, k, CASE WHEN target LIKE '%://%' OR plain = '' THEN '' ELSE {STEPS_SQL.format(above='', kept='a')} END AS dropped,
        CASE WHEN target LIKE '%://%' OR plain = '' THEN '' ELSE {STEPS_SQL.format(above="OR a[len(a)] = '..'", kept='a || x')} END AS kept FROM lp""",
)
def resolve_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.concat(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1), F.lit(".md"))
    rows = page_links(spark, sf_dir).select("page_id", source.alias("source"), F.posexplode("names").alias("at", "name"))
    k, name = (F.col("at") + 1).cast("bigint"), F.col("name")
    forms = [("../", ".md"), ("./x/./", ".md#part"), ("#", ""), ("https://h/", ""), ("../../../", "//y.md"), ("", "/../z.md")]
    target = F.lit(None).cast("string")
    for i, (before, after) in enumerate(forms):
        target = F.when(k % 6 == i, F.concat(F.lit(before), name, F.lit(after))).otherwise(target)
    s, t = F.col("source"), F.col("target")
    rows = rows.select("page_id", k.alias("k"), "source", target.alias("target"))
    return rows.select("page_id", "k", paths.resolve_link(s, t).alias("dropped"), paths.resolve_link(s, t, True).alias("kept"))


@query(
    "P26_P27_versions",
    """SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'latest' WHEN p_partkey % 5 = 1 THEN '>=1.0.0' ELSE '>=' || v END AS range,
              CASE WHEN p_partkey % 5 > 1 THEN (p_size + 1) || '.0.0' END AS major, CASE WHEN p_partkey % 5 > 1 THEN p_size || '.' || (p_partkey % 9 + 1) || '.0' END AS minor,
              CASE WHEN p_partkey % 5 > 1 THEN p_size || '.' || p_partkey % 9 || '.4' END AS patch
       FROM (SELECT p_partkey, p_size, p_size || '.' || p_partkey % 9 || '.3' AS v FROM part)""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    v = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 9).cast("string"), F.lit(".3"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "latest").when(k == 1, ">=1.0.0").otherwise(v).alias("v"))
    return rows.select("p_partkey", paths.to_range(F.col("v")).alias("range"), *[paths.bump(F.col("v"), p).alias(p) for p in ("major", "minor", "patch")])


KEY_SQL = "regexp_replace(regexp_replace(lower(trim({})), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query("P28_normalize_key", f"WITH {BLOCKS_SQL} SELECT path, position, {KEY_SQL.format('content')} AS key FROM blk WHERE type = 'heading'")
def normalize_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).where("type = 'heading'").select("path", "position", text.normalize_key(F.col("content")).alias("key"))


@query(
    "P29_installable",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 2 END::BIGINT AS priority,
              row_number() OVER (PARTITION BY s_nationkey ORDER BY CASE WHEN s_suppkey % 3 = 0 THEN 0 WHEN s_suppkey % 3 = 1 THEN 1 ELSE 2 END, s_suppkey) AS place FROM supplier""",
)
def installable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search results of a registry (here: a nation): with a release first, then with a tag, then the others."""
    k = F.col("s_suppkey") % 3
    found = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (k == 0).alias("released"), (k == 1).alias("tagged"))
    return packages.installable(found, "s_nationkey", "s_suppkey").drop("s_nationkey")


@query(
    "P30_strip_markdown",
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m,
          '(?s)```[^`]*```|~~~[^~]*~~~', ' ', 'g'), '`[^`]+`', ' ', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g'), '\*\*([^*]+)\*\*|__([^_]+)__', '\1\2', 'g'),
          '<[^>]+>', ' ', 'g'), '(?m)^#{1,6}\s+', '', 'g'), '(?m)^[\t ]*[-*+][\t ]+|^[\t ]*\d+[.)]\s+', '', 'g'), '\s+', ' ', 'g')) AS plain
        FROM (SELECT page_id, '# Title' || chr(10) || '- **bold** `code` [link](' || url || ')' || chr(10) || html AS m FROM pages)""",
)
def strip_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.concat(F.lit("# Title\n- **bold** `code` [link]("), "url", F.lit(")\n"), "html")
    return table(spark, sf_dir, "pages").select("page_id", text.strip_markdown(m).alias("plain"))


@query(
    "P31_chunk_fields",
    r"""WITH p AS (SELECT page_id, html || chr(10) || '```py' || chr(10) || url || chr(10) || '```' || chr(10) || 'end' AS c FROM pages),
        f AS (SELECT page_id, array_to_string(regexp_extract_all(c, '(?s)```[^\n]*\n(.*?)```', 1), ' ') AS code, regexp_replace(c, '(?s)```[^\n]*\n(.*?)```', '', 'g') AS rest FROM p)
        SELECT page_id, code, sha256(CASE WHEN strpos(rest, '-->') > 0 THEN substr(rest, strpos(rest, '-->') + 3) ELSE rest END) AS body FROM f""",
)
def chunk_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat("html", F.lit("\n```py\n"), "url", F.lit("\n```\nend"))
    code, body = text.chunk_fields(c)
    return table(spark, sf_dir, "pages").select("page_id", code.alias("code"), sha(body).alias("body"))
