"""Index tables, BM25, BM25F, fusion, re-ranking and what follows a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import fuse, impacts, index
from ..registry import query
from ..session import cut, let_go, once, stored
from ..sources.adapters import table
from .chunk_queries import BUILT_SQL, built
from .text_queries import KEPT_SQL, stems_sql

CORPUS_SQL = "CASE type WHEN 'spec' THEN 'specs' WHEN 'system' THEN 'system' ELSE 'objects' END"
#: The whole text of each benchmark item is a query.
QUERY_SQL = f"qt0 AS (SELECT item_id AS query, unnest({KEPT_SQL}) AS token FROM benchmark)"
DOCS_SQL = BUILT_SQL + f""", rt AS (SELECT {CORPUS_SQL} AS corpus, source || '#' || sequence AS doc, {KEPT_SQL.replace('text', 'content')} AS tokens FROM chk), {QUERY_SQL},
  ru AS (SELECT corpus, doc, unnest(tokens) AS token FROM rt), tv AS (SELECT token FROM ru UNION ALL SELECT token FROM qt0), {stems_sql('tv')},
  post AS (SELECT corpus, doc, term, count(*)::BIGINT AS tf FROM ru JOIN stems USING (token) GROUP BY ALL),
  len AS (SELECT corpus, doc, len(tokens)::BIGINT AS dl FROM rt),
  cs AS (SELECT corpus, count(*) AS n, avg(dl) AS avgdl FROM len GROUP BY corpus)"""
QT_SQL = "qt AS (SELECT query, term FROM qt0 JOIN stems USING (token))"
IDF_SQL = "ln(1 + (n - df + 0.5) / (df + 0.5))"
BM25_SQL = DOCS_SQL + f""", {QT_SQL}, ts AS (SELECT corpus, term, {IDF_SQL} AS idf, avgdl FROM (SELECT corpus, term, count(*) AS df FROM post GROUP BY ALL) JOIN cs USING (corpus)),
  hit AS (SELECT query, corpus, doc, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avgdl))), 9) AS score
          FROM qt JOIN post USING (term) JOIN ts USING (corpus, term) JOIN len USING (corpus, doc) GROUP BY ALL HAVING score > 0),
  rk AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, doc) AS rank FROM hit)"""


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit("#"), F.col("sequence").cast("string"))
    terms = text.term_counts(text.tokens(F.col("content")))
    return built(spark, sf_dir).select(paths.output_dir(F.col("type")).alias("corpus"), key.alias("doc"), F.col("terms").alias("dl"), terms.alias("terms"))


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("docs", sf_dir), lambda: counted(spark, sf_dir))


def index_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths: views of the stored documents, whose terms are counted."""
    d = docs(spark, sf_dir)
    return d.select("corpus", "doc", F.inline("terms")), d.select("corpus", "doc", "dl")


def query_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query"), text.tokens(F.col("text")).alias("terms")).select("query", F.posexplode("terms").alias("ordinal", "term"))


def term_index(spark: SparkSession, sf_dir: str) -> impacts.Impacts:
    """The stored index that searches read."""
    let_go(spark)  # of what earlier searches shuffled
    folder = stored(spark, "index", f"{sf_dir}/documents.parquet", lambda to: impacts.write_texts(counted(spark, sf_dir), to))
    return impacts.read(spark, folder)


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_terms(spark, sf_dir).select("query", "term", F.lit(1.0).alias("weight"))


def hits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """The n best of each query and corpus."""
    return impacts.search(term_index(spark, sf_dir), wanted(spark, sf_dir), n)


@query("A1_postings", f"WITH {DOCS_SQL} SELECT * FROM post")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index_of(spark, sf_dir)[0]


@query("A2_term_stats", f"WITH {DOCS_SQL} SELECT corpus, term, df, round({IDF_SQL}, 9) AS idf FROM (SELECT corpus, term, count(*)::BIGINT AS df FROM post GROUP BY ALL) JOIN cs USING (corpus)")
def term_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    post, lengths = index_of(spark, sf_dir)
    return index.term_stats(post, index.corpus_stats(lengths))


@query("A4_index_stats", f"WITH {DOCS_SQL} SELECT corpus, count(DISTINCT term)::BIGINT AS terms, any_value(n)::BIGINT AS docs, round(any_value(avgdl), 6) AS avgdl FROM post JOIN cs USING (corpus) GROUP BY corpus")
def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.index_stats(*index_of(spark, sf_dir))


@query("R1_bm25_topk", f"WITH {BM25_SQL} SELECT query, corpus, doc, score, rank FROM rk WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(spark, sf_dir, 10)


@query("R3_bm25_all", f"WITH {BM25_SQL} SELECT query, corpus, count(*)::BIGINT AS hits, max(score) AS best FROM hit GROUP BY ALL")
def bm25_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.scores(term_index(spark, sf_dir), wanted(spark, sf_dir)).groupBy("query", "corpus").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


#: Fields of a chunk: its heading, its body, and as terms the keys of its heading's parts; code stays empty.
FIELDS_SQL = BUILT_SQL + ", fd AS (" + " UNION ALL ".join(
    f"SELECT {CORPUS_SQL} AS corpus, source || '#' || sequence AS doc, '{f}' AS field, {KEPT_SQL.replace('text', c)} AS tokens FROM chk"
    for f, c in (("heading", "heading"), ("body", "content"), ("terms", "lower(heading)"), ("code", "''"))
) + f"""), {QUERY_SQL}, fu0 AS (SELECT corpus, doc, field, unnest(tokens) AS token FROM fd), tv AS (SELECT token FROM fu0 UNION ALL SELECT token FROM qt0), {stems_sql('tv')},
  fp AS (SELECT corpus, doc, field, term, count(*)::BIGINT AS tf FROM fu0 JOIN stems USING (token) GROUP BY ALL),
  fl AS (SELECT corpus, doc, field, len(tokens)::BIGINT AS dl FROM fd), fa AS (SELECT corpus, field, avg(dl) AS avgdl FROM fl GROUP BY ALL),
  fn AS (SELECT corpus, count(DISTINCT doc) AS n FROM fl GROUP BY corpus), fdf AS (SELECT corpus, term, count(DISTINCT doc)::BIGINT AS df FROM fp GROUP BY ALL)"""


def field_texts() -> dict[str, tuple[Column, Column]]:
    """Of a chunk, by field: the text and how many terms it has."""
    texts = {"heading": F.col("heading"), "body": F.col("content"), "terms": F.lower("heading"), "code": F.lit("")}
    return {f: (t, F.col("terms") if f == "body" else text.token_count(t)) for f, t in texts.items()}


def counted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit("#"), F.col("sequence").cast("string"))
    counts = [F.struct(F.lit(f).alias("field"), n.alias("dl"), text.term_counts(text.tokens(t)).alias("terms")) for f, (t, n) in field_texts().items()]
    return built(spark, sf_dir).select(paths.output_dir(F.col("type")).alias("corpus"), key.alias("doc"), F.array(*counts).alias("fields"))


def field_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """corpus, field and dl of each chunk: no term is stemmed or counted for them."""
    lengths = F.array(*[F.struct(F.lit(f).alias("field"), n.alias("dl")) for f, (_, n) in field_texts().items()])
    return built(spark, sf_dir).select(paths.output_dir(F.col("type")).alias("corpus"), F.inline(lengths))


def field_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return once(spark, ("field docs", sf_dir), lambda: counted_fields(spark, sf_dir))


@query("A3_field_stats", f"WITH {FIELDS_SQL} SELECT corpus, term, df, round({IDF_SQL}, 9) AS idf FROM fdf JOIN fn USING (corpus)")
def field_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = field_docs(spark, sf_dir)
    n = d.groupBy("corpus").agg(F.count("*").alias("n"))
    terms = F.array_distinct(F.flatten(F.transform("fields", lambda f: f["terms"]["term"])))
    df = d.select("corpus", F.explode(terms).alias("term")).groupBy("corpus", "term").agg(F.count("*").alias("df")).join(F.broadcast(n), "corpus")
    return df.select("corpus", "term", "df", F.round(index.idf(F.col("n"), F.col("df")), 9).alias("idf"))


@query("A3_field_averages", f"WITH {FIELDS_SQL} SELECT corpus, field, round(avgdl, 9) AS avgdl FROM fa")
def field_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = index.field_averages(field_lengths(spark, sf_dir))
    return d.select("corpus", "field", F.round("avgdl", 9).alias("avgdl"))


WQT_SQL = "wqt AS (SELECT DISTINCT query, term FROM qt0 JOIN stems USING (token)), wq AS (SELECT query, term, CASE WHEN strlen(term) % 2 = 0 THEN 1.0 ELSE 0.7 END::DOUBLE AS weight FROM wqt)"
BM25F_SQL = FIELDS_SQL + f""", {WQT_SQL}, pt AS (SELECT corpus, doc, term, round(sum(w * CASE WHEN avgdl > 0 THEN tf / (1 - b + b * dl / avgdl) ELSE tf END), 12) AS wtf
    FROM fp JOIN fl USING (corpus, doc, field) JOIN fa USING (corpus, field)
    JOIN (VALUES ('heading', 3.0::DOUBLE, 0.3::DOUBLE), ('terms', 2.0, 0.0), ('body', 1.0, 0.75), ('code', 0.6, 0.5)) v(field, w, b) USING (field)
    WHERE term IN (SELECT term FROM wq) GROUP BY ALL),
  fs AS (SELECT query, corpus, doc, round(sum(weight * {IDF_SQL} * wtf * 2.2 / (wtf + 1.2)), 9) AS score
         FROM pt JOIN fdf USING (corpus, term) JOIN fn USING (corpus) JOIN wq USING (term) GROUP BY ALL HAVING score > 0),
  fr AS (SELECT *, row_number() OVER (PARTITION BY query, corpus ORDER BY score DESC, doc) AS rank FROM fs)"""


def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = query_terms(spark, sf_dir).select("query", "term").distinct()
    return t.withColumn("weight", F.when(F.octet_length("term") % 2 == 0, 1.0).otherwise(0.7))


def field_term_index(spark: SparkSession, sf_dir: str) -> impacts.Impacts:
    let_go(spark)
    make = lambda to: impacts.write_fields(counted_fields(spark, sf_dir), to, lengths=field_lengths(spark, sf_dir))
    return impacts.read(spark, stored(spark, "field index", f"{sf_dir}/documents.parquet", make))


def field_hits(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    return impacts.search(field_term_index(spark, sf_dir), weighted_terms(spark, sf_dir), n)


@query("R2_bm25f_topk", f"WITH {BM25F_SQL} SELECT query, corpus, doc, score, rank FROM fr WHERE rank <= 10")
def bm25f_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return field_hits(spark, sf_dir, 10)


@query("R4_bm25f_all", f"WITH {BM25F_SQL} SELECT query, corpus, count(*)::BIGINT AS hits, max(score) AS best FROM fs GROUP BY ALL")
def bm25f_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impacts.scores(field_term_index(spark, sf_dir), weighted_terms(spark, sf_dir)).groupBy("query", "corpus").agg(F.count("*").alias("hits"), F.max("score").alias("best"))


RRF_SQL = BM25F_SQL + """, rr AS (SELECT query, doc, round(sum(w / (60 + rank)), 9) AS score
    FROM fr JOIN (VALUES ('objects', 1.0::DOUBLE), ('specs', 0.7), ('system', 0.3)) v(corpus, w) USING (corpus) WHERE rank <= 90 GROUP BY ALL),
  fu AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM rr)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.weighted_rrf(field_hits(spark, sf_dir, 90))


@query("R7_rrf", f"WITH {RRF_SQL} SELECT query, doc, score, rank FROM fu")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query", "doc", "score", "rank")


#: A spec's parent is the chunk of the same sequence in the source with the next lower number that isn't a spec.
MANIFEST_SQL = """, mf AS (SELECT source || '#' || sequence AS doc, source, type, content, tokens, sequence,
    lag(source || '#' || sequence) OVER s AS previous, lead(source || '#' || sequence) OVER s AS next FROM chk WINDOW s AS (PARTITION BY source ORDER BY sequence)),
  refs AS (SELECT source AS src, lead(source) OVER (PARTITION BY split_part(source, '/', -2) ORDER BY source) AS dst FROM (SELECT DISTINCT source FROM chk)),
  pr AS (SELECT s.doc AS spec, o.doc AS parent FROM mf s JOIN refs r ON r.src = s.source JOIN mf o ON o.source = r.dst AND o.sequence = s.sequence WHERE s.type = 'spec' AND o.type = 'object'),
  man AS (SELECT mf.*, p.parent AS parent_object, q.spec AS spec_chunk FROM mf LEFT JOIN pr p ON p.spec = mf.doc LEFT JOIN (SELECT parent, min(spec) AS spec FROM pr GROUP BY parent) q ON q.parent = mf.doc)"""


def manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Manifest rows, without texts, and references: each source refers to the next one of its folder."""
    return once(spark, ("manifest", sf_dir), lambda: _manifest(spark, sf_dir)), once(spark, ("references", sf_dir), lambda: _references(spark, sf_dir).where("dst is not null"))


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    sources = built(spark, sf_dir).select("source").distinct().withColumn("folder", F.element_at(F.split("source", "/"), -2))
    return sources.select(F.col("source").alias("src"), F.lead("source").over(Window.partitionBy("folder").orderBy("source")).alias("dst"))


def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat("source", F.lit("#"), F.col("sequence").cast("string"))
    order = Window.partitionBy("source").orderBy("sequence")
    c = built(spark, sf_dir).select("source", "type", "tokens", "sequence", key.alias("doc"))
    mf = c.withColumn("previous", F.lag("doc").over(order)).withColumn("next", F.lead("doc").over(order))
    refs = _references(spark, sf_dir)
    spec = mf.where("type = 'spec'").select(F.col("doc").alias("spec"), F.col("source").alias("src"), "sequence").join(refs, "src")
    objects = mf.where("type = 'object'").select(F.col("doc").alias("parent"), F.col("source").alias("dst"), "sequence")
    pairs = spec.join(objects, ["dst", "sequence"]).select("spec", "parent")
    mf = mf.join(pairs.select(F.col("spec").alias("doc"), F.col("parent").alias("parent_object")), "doc", "left")
    back = pairs.groupBy("parent").agg(F.min("spec").alias("spec_chunk")).withColumnRenamed("parent", "doc")
    return mf.join(back, "doc", "left")


RERANK_SQL = RRF_SQL + MANIFEST_SQL + """, win AS (SELECT query, doc FROM fu WHERE rank <= ceil(10 * 2.15)), ws AS (SELECT DISTINCT query, source FROM win JOIN mf USING (doc)),
  bo AS (SELECT fu.query, fu.doc, fu.score, 1 + CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.query = fu.query AND w.doc = man.previous) THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.query = fu.query AND w.doc = man.next) THEN 0.15::DOUBLE ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.query = fu.query AND w.doc = man.spec_chunk) THEN 0.20::DOUBLE ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM win w WHERE w.query = fu.query AND w.doc = man.parent_object) THEN 0.20::DOUBLE ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM ws JOIN refs r ON r.dst = ws.source WHERE ws.query = fu.query AND r.src = man.source) THEN 0.10::DOUBLE ELSE 0 END
      + CASE WHEN EXISTS (SELECT 1 FROM ws JOIN refs r ON r.src = ws.source WHERE ws.query = fu.query AND r.dst = man.source) THEN 0.10::DOUBLE ELSE 0 END AS factor
    FROM fu LEFT JOIN man USING (doc)),
  rb AS (SELECT query, doc, round(score * round(factor, 2), 11) AS score FROM bo),
  re AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM rb)"""


def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut(fused(spark, sf_dir))
    let_go(spark)  # the search's blocks aren't read again
    m, refs = manifest(spark, sf_dir)
    # a query's hits are 90 of each corpus at most
    own = m.join(F.broadcast(found.select("doc").distinct()), "doc", "left_semi")
    return fuse.graph_rerank(found, own, refs, top=10)


@query("R8_graph_rerank", f"WITH {RERANK_SQL} SELECT query, doc, score, rank FROM re")
def graph_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reranked(spark, sf_dir)


@query("R10_unified", f"WITH {RERANK_SQL} SELECT query, rank, doc, score, source, type, tokens FROM re JOIN mf USING (doc) WHERE rank <= 10")
def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores by field, fuses, re-ranks, cuts, and looks up what the manifest says."""
    m, _ = manifest(spark, sf_dir)
    return reranked(spark, sf_dir).where("rank <= 10").join(m, "doc").select("query", "rank", "doc", "score", "source", "type", "tokens")


@query("J2_enrich", f"WITH {BM25_SQL}{MANIFEST_SQL} SELECT query, rk.doc, rank, source, type, tokens FROM rk JOIN mf USING (doc) WHERE rank <= 5")
def enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = manifest(spark, sf_dir)
    return hits(spark, sf_dir, 5).join(m, "doc").select("query", "doc", "rank", "source", "type", "tokens")


REL_SQL = RERANK_SQL + """, hits AS (SELECT query, doc, rank FROM re WHERE rank <= 10),
  nb AS (SELECT query, rank, 0 AS side, previous AS doc FROM hits JOIN man USING (doc) UNION ALL SELECT query, rank, 1, next FROM hits JOIN man USING (doc)),
  nw AS (SELECT query, doc, min((rank, side)) AS pos FROM nb WHERE doc IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hits h WHERE h.query = nb.query AND h.doc = nb.doc) GROUP BY ALL)"""


@query("L4_related", f"WITH {REL_SQL} SELECT * FROM (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY pos) AS place FROM nw) WHERE place <= 5")
def related(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = manifest(spark, sf_dir)
    hits = reranked(spark, sf_dir).where("rank <= 10")
    return fuse.related(hits, m, hits)


@query("W7_budget", f"""WITH {RERANK_SQL} SELECT query, doc, rank, tokens, used FROM (SELECT query, doc, rank, tokens, (sum(tokens) OVER (PARTITION BY query ORDER BY rank))::BIGINT AS used
      FROM re JOIN mf USING (doc) WHERE rank <= 10) WHERE rank = 1 OR used <= 1200""")
def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.select_budget(unified(spark, sf_dir), 1200).select("query", "doc", "rank", "tokens", "used")


@query(
    "W10_assemble",
    f"""WITH {RERANK_SQL}, g AS (SELECT query, source, sequence, type, content, CASE type WHEN 'system' THEN 1 WHEN 'spec' THEN 2 ELSE 0 END AS kind,
          CASE WHEN sequence % 2 = 1 THEN 'after ' || mf.doc END AS bridge FROM re JOIN mf USING (doc) WHERE rank <= 10),
        l AS (SELECT *, lag(kind) OVER o AS k0, lag(source) OVER o AS s0, lag(sequence) OVER o AS q0, lag(bridge) OVER o AS b0, row_number() OVER o AS place
              FROM g WINDOW o AS (PARTITION BY query ORDER BY kind, source, sequence))
        SELECT query, sha256(string_agg(CASE WHEN k0 IS NULL OR k0 <> kind THEN chr(10) || '# ' || ['Instructions', 'System', 'Reasoning'][kind + 1] || chr(10) WHEN s0 <> source THEN chr(10) || '---' || chr(10)
          WHEN q0 + 1 <> sequence AND b0 IS NOT NULL THEN chr(10) || '---' || chr(10) || '> **Context bridge**: ' || b0 || chr(10) || '---' || chr(10) ELSE '' END
          || chr(10) || content, '' ORDER BY place)) AS digest, count(*)::BIGINT AS chunks FROM l GROUP BY query""",
)
def assemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, _ = manifest(spark, sf_dir)
    rows = reranked(spark, sf_dir).where("rank <= 10").join(m, "doc")
    # the texts of ten rows of each query
    rows = built(spark, sf_dir).select("source", "sequence", "content").join(F.broadcast(rows), ["source", "sequence"])
    rows = rows.withColumn("bridge", F.when(F.col("sequence") % 2 == 1, F.concat(F.lit("after "), "doc")))
    out = fuse.assemble(rows.select("query", "source", "sequence", "type", "content", "bridge"))
    return out.select("query", F.sha2(F.col("document").cast("binary"), 256).alias("digest"), "chunks")


@query("A25_sources", f"WITH {RERANK_SQL}, fs0 AS (SELECT query, source, min(rank) AS first FROM re JOIN mf USING (doc) WHERE rank <= 10 GROUP BY ALL) SELECT query, source, row_number() OVER (PARTITION BY query ORDER BY first) AS place FROM fs0")
def distinct_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.distinct_sources(unified(spark, sf_dir))


@query("W8_flatten", f"WITH {BM25_SQL} SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY score DESC, list_position(['objects', 'specs', 'system'], corpus), rank) AS place FROM rk WHERE rank <= 10")
def flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lists of all corpora as one, by score; ties in the order of the lists."""
    return fuse.flatten(hits(spark, sf_dir, 10))


@query("L10_effective_budget", "SELECT o_orderkey, greatest(t, ceil(t * 4.0::DOUBLE * (1 + d)))::BIGINT AS budget FROM (SELECT o_orderkey, o_orderkey % 700 AS t, ((o_orderkey % 9) - 8) / 8 AS d FROM orders)")
def effective_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    target, delta = F.col("o_orderkey") % 700, ((F.col("o_orderkey") % 9) - 8) / 8
    return table(spark, sf_dir, "orders").select("o_orderkey", fuse.effective_budget(target, delta=delta).alias("budget"))

