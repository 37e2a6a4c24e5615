"""Manifest, references, bridges and key phrases."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, words
from ..operators import catalog
from ..registry import query
from ..sources.adapters import CHUNKS_SQL, chunks, table
from .text_queries import RAKE_SQL, sql_list

#: The same chunks under fewer headings, with specs beside objects: a document and the next multiple of five share a path.
PAIRED_SQL = CHUNKS_SQL + """, prd AS (SELECT 'd/' || (regexp_extract(source, '(\\d+)\\.', 1)::BIGINT // 5) || CASE WHEN type = 'spec' THEN '.spec.md' ELSE '.md' END AS source,
    CASE WHEN type = 'spec' THEN 'spec' ELSE 'object' END AS type, lower(heading) AS heading, sequence, source || '#' || sequence AS id FROM chk)"""
_SHARED = """len(list_filter(range(1, 1 + least(len(string_split({0}, ' > ')), len(string_split({1}, ' > ')))::INT),
    lambda i: string_split({0}, ' > ')[1:i::INT] = string_split({1}, ' > ')[1:i::INT]))"""
MATCH_SQL = f"""CASE WHEN h = '' OR g = '' THEN -1 WHEN starts_with(h, g) THEN strlen(g) WHEN starts_with(g, h) THEN strlen(h)
    WHEN strlen(array_to_string(string_split(h, ' > ')[1:{_SHARED.format('h', 'g')}], ' > ')) > 0 THEN strlen(array_to_string(string_split(h, ' > ')[1:{_SHARED.format('h', 'g')}], ' > ')) ELSE -1 END"""
LINKS_SQL = PAIRED_SQL + f""", sp AS (SELECT id AS spec, regexp_replace(source, '\\.spec\\.md$', '.md') AS source, heading AS h FROM prd WHERE type = 'spec'),
    ob AS (SELECT id AS object, source, heading AS g, sequence FROM prd WHERE type = 'object'),
    mt AS (SELECT spec, object, sequence, {MATCH_SQL} AS n FROM sp JOIN ob USING (source)),
    lk AS (SELECT spec, arg_max((object, n), (n, -sequence, object)) AS b FROM mt WHERE n >= 0 GROUP BY spec)"""


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunks(spark, sf_dir)
    spec = F.col("type") == "spec"
    number = F.floor(F.regexp_extract("source", r"(\d+)\.", 1).cast("bigint") / 5).cast("string")
    return c.select(
        F.concat(F.lit("d/"), number, F.when(spec, ".spec.md").otherwise(".md")).alias("source"), F.when(spec, "spec").otherwise("object").alias("type"),
        F.lower("heading").alias("heading"), "sequence", F.concat("source", F.lit("#"), F.col("sequence").cast("string")).alias("id"),
    )


@query("J5_adjacency", f"WITH {CHUNKS_SQL} SELECT source, sequence, lag(id) OVER s AS previous, lead(id) OVER s AS next FROM chk WINDOW s AS (PARTITION BY source ORDER BY sequence)")
def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.adjacency(chunks(spark, sf_dir)).select("source", "sequence", "previous", "next")


@query("J3_link_specs", f"WITH {LINKS_SQL} SELECT spec, b.n::BIGINT AS match FROM (SELECT spec, max(n) AS m FROM mt WHERE n >= 0 GROUP BY spec) JOIN lk USING (spec)".replace("b.n::BIGINT", "m::BIGINT"))
def link_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.link_specs(paired(spark, sf_dir)).select("spec", "match")


@query("J4_heading_match", f"WITH {LINKS_SQL} SELECT spec, object, n::BIGINT AS n FROM mt")
def heading_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paired(spark, sf_dir)
    spec = p.where("type = 'spec'").select(F.col("id").alias("spec"), F.regexp_replace("source", r"\.spec\.md$", ".md").alias("source"), F.col("heading").alias("h"))
    both = spec.join(p.where("type = 'object'").select(F.col("id").alias("object"), "source", F.col("heading").alias("g")), "source")
    return both.select("spec", "object", catalog.heading_match(F.col("h"), F.col("g")).alias("n"))


@query("A12_counters", f"WITH {CHUNKS_SQL} SELECT coalesce(type, 'all') AS type, count(*)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens FROM chk GROUP BY ROLLUP (type)")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.counters(chunks(spark, sf_dir))


@query("A13_metadata", f"WITH {CHUNKS_SQL} SELECT source, list(id ORDER BY sequence) AS chunks, sum(tokens)::BIGINT AS tokens FROM chk GROUP BY source")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.metadata(chunks(spark, sf_dir))


#: Links: each document names the one of the number 3 * n + 1 and, every fourth, itself; targets beyond the table aren't known.
REFS_SQL = """lnk AS (SELECT doc_id::VARCHAR AS src, (doc_id * 3 + 1)::VARCHAR AS dst FROM documents UNION ALL SELECT doc_id::VARCHAR, doc_id::VARCHAR FROM documents WHERE doc_id % 4 = 0
    UNION ALL SELECT doc_id::VARCHAR, (doc_id // 7)::VARCHAR FROM documents), rf AS (SELECT DISTINCT src, dst FROM lnk WHERE src <> dst AND dst IN (SELECT doc_id::VARCHAR FROM documents))"""


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    own = F.col("doc_id").cast("string")
    ends = F.array((F.col("doc_id") * 3 + 1).cast("string"), F.when(F.col("doc_id") % 4 == 0, own), F.floor(F.col("doc_id") / 7).cast("string"))
    links = d.select(own.alias("src"), F.explode(ends).alias("dst")).where("dst is not null")
    return catalog.document_references(links, d.select(own.alias("source")))


@query("J6_document_references", f"WITH {REFS_SQL} SELECT src, dst FROM rf")
def document_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir)


@query("J7_referenced_by", f"WITH {REFS_SQL} SELECT dst AS source, list(src ORDER BY src) AS referenced_by FROM rf GROUP BY dst")
def referenced_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.referenced_by(references(spark, sf_dir))


@query("A14_reference_counters", f"WITH {REFS_SQL} SELECT count(*)::BIGINT AS links, count(DISTINCT src)::BIGINT AS documents FROM rf")
def reference_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references(spark, sf_dir).agg(F.count("*").alias("links"), F.countDistinct("src").alias("documents"))


@query(
    "W6_heading_bridge",
    f"""WITH {CHUNKS_SQL}, p AS (SELECT source, sequence, heading AS h, lead(heading) OVER (PARTITION BY source ORDER BY sequence) AS g FROM chk WHERE type <> 'spec'),
        n AS (SELECT *, {_SHARED.format('h', 'g')} AS n FROM p WHERE g IS NOT NULL),
        l AS (SELECT *, array_to_string(string_split(h, ' > ')[n + 1:], ' > ') AS x, array_to_string(string_split(g, ' > ')[n + 1:], ' > ') AS y FROM n)
        SELECT source, sequence, CASE WHEN h = g THEN '' WHEN x = '' THEN 'Entering: ' || y WHEN y = '' THEN 'Completed: ' || x ELSE 'Completed: ' || x || '. Entering: ' || y END AS bridge FROM l""",
)
def heading_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    after = F.lead("heading").over(Window.partitionBy("source").orderBy("sequence"))
    p = chunks(spark, sf_dir).where("type <> 'spec'").withColumn("after", after).where("after is not null")
    return p.select("source", "sequence", catalog.heading_bridge(F.col("heading"), F.col("after")).alias("bridge"))


RAKE_PHRASES_SQL = f"""w0 AS (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS at_ FROM txt),
    w1 AS (SELECT *, list_contains({sql_list(words.RAKE_STOPWORDS)}, word) OR strlen(word) < 2 AS stop FROM w0),
    w2 AS (SELECT *, sum(stop::INT) OVER (PARTITION BY id ORDER BY at_) AS run FROM w1),
    w3 AS (SELECT *, count(*) OVER (PARTITION BY id, run) AS size FROM w2 WHERE NOT stop), sc AS (SELECT id, word, sum(size) / count(*) AS score FROM w3 GROUP BY ALL),
    ph AS (SELECT id, run, string_agg(word, ' ' ORDER BY at_) AS phrase, round(sum(score), 9) AS score, min(at_) AS at_ FROM w3 JOIN sc USING (id, word) WHERE size <= 5 GROUP BY ALL),
    bp AS (SELECT id, phrase, max(score) AS score, min(at_) AS at_ FROM ph GROUP BY ALL), pl AS (SELECT id, phrase, score, row_number() OVER (PARTITION BY id ORDER BY score DESC, at_) AS place FROM bp)"""


@query("R11_key_phrases", f"WITH txt AS (SELECT item_id AS id, {RAKE_SQL.format('text')} AS w FROM benchmark), {RAKE_PHRASES_SQL} SELECT id, place, phrase, score FROM pl WHERE place <= 4")
def key_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.rake_words(F.col("text")).alias("words"))
    return catalog.key_phrases(t)


@query("A15_word_scores", f"WITH txt AS (SELECT item_id AS id, {RAKE_SQL.format('text')} AS w FROM benchmark), {RAKE_PHRASES_SQL} SELECT id, count(*)::BIGINT AS n, max(score) AS best FROM bp GROUP BY id")
def word_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), text.rake_words(F.col("text")).alias("words"))
    return catalog.key_phrases(t, top=1 << 30).groupBy("id").agg(F.count("*").alias("n"), F.max("score").alias("best"))


#: Text in ASCII, so that both engines lower-case alike.
_TAIL = "CASE WHEN strlen(a) <= 600 THEN a WHEN strpos(right(a, 600), ' ') = 0 THEN right(a, 600) ELSE substr(right(a, 600), strpos(right(a, 600), ' ') + 1) END"


@query(
    "W5_bridges",
    f"""WITH {CHUNKS_SQL}, nx AS (SELECT source || '#' || sequence AS id, regexp_replace(content, '[^\\x00-\\x7F]', '_', 'g') AS a, heading AS h,
          lead(heading) OVER (PARTITION BY source ORDER BY sequence) AS g FROM chk WHERE type <> 'spec'),
        n0 AS (SELECT *, {_SHARED.format('h', 'g')} AS n FROM nx WHERE g IS NOT NULL),
        n1 AS (SELECT *, array_to_string(string_split(h, ' > ')[n + 1:], ' > ') AS x, array_to_string(string_split(g, ' > ')[n + 1:], ' > ') AS y FROM n0),
        n2 AS (SELECT id, trim(a) AS c, CASE WHEN h = g THEN NULL WHEN x = '' THEN 'Entering: ' || y WHEN y = '' THEN 'Completed: ' || x ELSE 'Completed: ' || x || '. Entering: ' || y END AS one FROM n1),
        n3 AS (SELECT *, regexp_replace(regexp_extract(c, '(?s)([^.!?]*[.!?])[^.!?]*$', 1), '^\\s+|\\s+$', '', 'g') AS f FROM n2),
        n4 AS (SELECT id, one, CASE WHEN (len(string_split(c, '```')) - 1) % 2 <> 0 OR starts_with(trim(string_split(c, chr(10))[-1]), '```')
          OR strlen(f) < 20 OR regexp_matches(f, '^(#|- |\\* |\\|)') THEN NULL ELSE f END AS three FROM n3),
        txt AS (SELECT id, {RAKE_SQL.format(f'({_TAIL})')} AS w FROM n0), {RAKE_PHRASES_SQL},
        n5 AS (SELECT id, 'Established: ' || string_agg(phrase, ', ' ORDER BY place) AS two FROM pl WHERE place <= 4 GROUP BY id)
        SELECT id AS doc, concat_ws('. ', one, two, three) AS bridge FROM n4 LEFT JOIN n5 USING (id) WHERE concat_ws('. ', one, two, three) <> ''""",
)
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit("#"), F.col("sequence").cast("string"))
    plain = F.regexp_replace("content", r"[^\x00-\x7F]", "_")
    return catalog.bridges(chunks(spark, sf_dir).withColumn("doc", key).withColumn("content", plain))
