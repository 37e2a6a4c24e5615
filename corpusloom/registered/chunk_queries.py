"""Blocks and chunks: heading paths, strip, titles, chunking, statistics, rendering."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ChunkOptions
from ..functions import counting, text
from ..operators import blocks as B
from ..operators import chunking as C
from ..registry import query
from ..session import once
from ..sources.adapters import BLOCKS_SQL, CHUNKS_SQL, KIND_SQL, blocks, chunks

#: Small enough that lines of prose take every branch.
OPTIONS = ChunkOptions(target=120, least=60, most=200, flex=0.8)

#: Heading paths over a relation b: a level's last heading counts if no heading of a lower level follows it.
PATHS_SQL = (
    "w AS (SELECT *, "
    + ", ".join(
        f"coalesce(max(CASE WHEN type = 'heading' AND level = {k} THEN position END) OVER o, -1) AS p{k}, "
        f"arg_max(content, CASE WHEN type = 'heading' AND level = {k} THEN position END) OVER o AS h{k}"
        for k in range(1, 7)
    )
    + " FROM b WINDOW o AS (PARTITION BY path ORDER BY position ROWS UNBOUNDED PRECEDING)), "
    + "p AS (SELECT * EXCLUDE (p1, p2, p3, p4, p5, p6, h1, h2, h3, h4, h5, h6), list_filter(["
    + ", ".join(
        "CASE WHEN " + " AND ".join([f"p{j} > greatest(-1{''.join(f', p{i}' for i in range(1, j))})" for j in range(1, k + 1)]) + f" THEN h{k} END"
        for k in range(1, 7)
    )
    + "], lambda x: x IS NOT NULL) AS heading FROM w)"
)

#: Blocks with some thematic breaks and comments among them; files with paths of certain lengths have no headings.
MIXED_SQL = BLOCKS_SQL + """, bl AS (SELECT * REPLACE (CASE WHEN strlen(path) % 9 = 0 THEN 'paragraph' ELSE type END AS type, CASE WHEN strlen(path) % 9 = 0 THEN 0 ELSE level END AS level) FROM blk),
  mix AS (SELECT path, position, CASE WHEN position % 11 = 7 THEN 'thematic_break' WHEN position % 13 = 5 THEN 'html' ELSE type END AS type,
    CASE WHEN position % 11 <> 7 AND position % 13 <> 5 AND level > 0 THEN level + 1 ELSE 0 END AS level,
    CASE WHEN position % 11 <> 7 AND position % 13 = 5 THEN CASE WHEN position % 2 = 0 THEN '<!-- ' ELSE '<b>' END || content ELSE content END AS content, tokens FROM bl)"""


def mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = F.octet_length("path") % 9 == 0
    b = blocks(spark, sf_dir).withColumns({"type": F.when(plain, "paragraph").otherwise(F.col("type")), "level": F.when(plain, 0).otherwise(F.col("level"))})
    rule, html = F.col("position") % 11 == 7, F.col("position") % 13 == 5
    mark = F.when(F.col("position") % 2 == 0, "<!-- ").otherwise("<b>")
    return b.select(
        "path", "position", F.when(rule, "thematic_break").when(html, "html").otherwise(F.col("type")).alias("type"),
        F.when(~rule & ~html & (F.col("level") > 0), F.col("level") + 1).otherwise(0).alias("level"),
        F.when(~rule & html, F.concat(mark, "content")).otherwise(F.col("content")).alias("content"), "tokens",
    )


@query("P7_heading_paths", f"WITH {BLOCKS_SQL}, b AS (SELECT * FROM blk), {PATHS_SQL} SELECT path, position, array_to_string(heading, ' > ') AS heading FROM p")
def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.heading_paths(blocks(spark, sf_dir)).select("path", "position", F.array_join("heading", " > ").alias("heading"))


@query("P8_min_level", f"WITH {MIXED_SQL} SELECT path, coalesce(min(CASE WHEN type = 'heading' THEN level END), 0)::BIGINT AS min_level FROM mix GROUP BY path")
def min_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.min_level(mixed(spark, sf_dir))


@query(
    "P9_strip",
    f"""WITH {MIXED_SQL}, k AS (SELECT * FROM mix WHERE type <> 'thematic_break' AND NOT (type = 'html' AND starts_with(ltrim(content), '<!--'))),
        b AS (SELECT path, (row_number() OVER (PARTITION BY path ORDER BY position) - 1)::BIGINT AS position, type, content,
              CASE WHEN type = 'heading' THEN level - min(CASE WHEN type = 'heading' THEN level END) OVER (PARTITION BY path) + 1 ELSE level END AS level FROM k),
        {PATHS_SQL} SELECT path, position, type, level::BIGINT AS level, array_to_string(heading, ' > ') AS heading FROM p""",
)
def strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = B.strip(mixed(spark, sf_dir))
    return s.select("path", "position", "type", F.col("level").cast("bigint").alias("level"), F.array_join("heading", " > ").alias("heading"))


@query("P10_warnings", f"WITH {MIXED_SQL} SELECT path, 'file has no headings' AS warning FROM mix GROUP BY path HAVING NOT bool_or(type = 'heading')")
def warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.warnings(mixed(spark, sf_dir))


@query("P11_token_counts", f"WITH {BLOCKS_SQL} SELECT path, sum(tokens)::BIGINT AS tokens, count(*)::BIGINT AS blocks FROM blk GROUP BY path")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(spark, sf_dir).groupBy("path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"))


@query("P11_bpe_counts")
def bpe_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each file's blocks by a byte-level BPE; DuckDB has none to compare with."""
    import public_tokenizers

    count = counting.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    counted = blocks(spark, sf_dir).select("path", count(F.col("content")).alias("tokens"))
    return counted.groupBy("path").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"))


@query(
    "P18_titles",
    f"""WITH {BLOCKS_SQL} SELECT path, coalesce(arg_min(content, position) FILTER (type = 'heading' AND level = 1),
        regexp_replace(string_split(path, '/')[-1], '\\.md$', '')) AS title FROM blk GROUP BY path""",
)
def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.titles(blocks(spark, sf_dir))


@query(
    "P21_render",
    f"""WITH {BLOCKS_SQL}, l AS (SELECT *, min(CASE WHEN type = 'heading' THEN level END) OVER (PARTITION BY path) AS least FROM blk)
        SELECT path, sha256(string_agg(CASE WHEN type = 'heading' THEN repeat('#', least(greatest(level - least + 3, 1), 6)::INT) || ' ' || content ELSE content END,
               chr(10) || chr(10) ORDER BY position)) AS digest FROM l GROUP BY path""",
)
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.render(blocks(spark, sf_dir)).select("path", F.sha2(F.col("markdown").cast("binary"), 256).alias("digest"))


O = OPTIONS
FOLD_SQL = f"""RECURSIVE {BLOCKS_SQL}, n AS (SELECT path, position, type, content, tokens AS t, type = 'heading' AS h, row_number() OVER (PARTITION BY path ORDER BY position) AS n FROM blk),
  f AS (SELECT path, n, position, 1::BIGINT AS k, CASE WHEN t > {O.most} THEN 0 ELSE t END AS cur, t <= {O.most} AS open FROM n WHERE n = 1
    UNION ALL
    SELECT n.path, n.n, n.position,
      CASE WHEN t > {O.most} OR NOT open OR h OR (cur + t > {O.target} AND cur >= {int(O.target * O.flex)}) THEN k + 1 ELSE k END,
      CASE WHEN t > {O.most} THEN 0 WHEN NOT open OR h OR (cur + t > {O.target} AND cur >= {int(O.target * O.flex)}) THEN t ELSE cur + t END, t <= {O.most}
    FROM f JOIN n ON n.path = f.path AND n.n = f.n + 1)"""

TAIL_SQL = FOLD_SQL + f""", a AS (SELECT n.path, n.position, n.type, n.content, n.t AS tokens, f.k, max(f.k) OVER (PARTITION BY n.path) AS last FROM n JOIN f USING (path, n)),
  ck AS (SELECT path, k, any_value(last) AS last, sum(tokens) AS size, max(tokens) > {O.most} AS over, arg_min(type, position) AS first FROM a GROUP BY path, k),
  due AS (SELECT x.path, x.last, x.size + y.size AS total FROM ck x JOIN ck y ON x.path = y.path AND y.k = x.last - 1
          WHERE x.k = x.last AND x.size < {O.least} AND NOT x.over AND x.first <> 'heading' AND NOT y.over),
  pool AS (SELECT a.path, a.position, due.total, sum(a.tokens) OVER (PARTITION BY a.path ORDER BY a.position) AS run,
           row_number() OVER (PARTITION BY a.path ORDER BY a.position) AS place, count(*) OVER (PARTITION BY a.path) AS m
           FROM a JOIN due USING (path) WHERE a.k >= due.last - 1),
  cut AS (SELECT path, arg_min(place, (abs(run - total // 2), place)) AS cut FROM pool GROUP BY path),
  fin AS (SELECT a.path, a.position, a.type, a.content, a.tokens,
          (CASE WHEN p.place IS NULL THEN a.k WHEN p.total <= {O.target} OR cut.cut >= p.m OR p.place <= cut.cut THEN a.last - 1 ELSE a.last END)::BIGINT AS k
          FROM a LEFT JOIN pool p USING (path, position) LEFT JOIN cut ON cut.path = a.path)"""


@query("W1_chunk_fold", f"WITH {FOLD_SQL} SELECT path, position, k FROM f")
def chunk_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.assign(blocks(spark, sf_dir), OPTIONS)


@query("W2_balance_tail", f"WITH {TAIL_SQL} SELECT path, position, k FROM fin")
def balance_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    return C.balance_tail(b.join(C.assign(b, OPTIONS), ["path", "position"]), OPTIONS)


CHUNKED_SQL = TAIL_SQL + f""", cc AS (SELECT path, k AS sequence, count(*) OVER (PARTITION BY path) AS total, sum(tokens)::BIGINT AS tokens, max(tokens) > {O.most} AS oversized,
  string_agg(content, chr(10) || chr(10) ORDER BY position) AS content, {KIND_SQL} AS type FROM fin GROUP BY path, k)"""


def chunked(spark: SparkSession, sf_dir: str, dealt: bool = True) -> DataFrame:
    numbers = once(spark, ("numbers", sf_dir), lambda: C.number_blocks(blocks(spark, sf_dir), OPTIONS))
    return C.chunk(B.heading_paths(blocks(spark, sf_dir, dealt)), OPTIONS, numbers)


#: The chunker's chunks with the heading path of their first block, as the index and the searches see them.
BUILT_SQL = CHUNKED_SQL + f""", b AS (SELECT * FROM blk), {PATHS_SQL}, fb AS (SELECT path, k AS sequence, min(position) AS position FROM fin GROUP BY ALL),
  chk AS (SELECT cc.path AS source, cc.sequence, cc.tokens, cc.type, cc.content, array_to_string(p.heading, ' > ') AS heading
    FROM cc JOIN fb ON fb.path = cc.path AND fb.sequence = cc.sequence JOIN p ON p.path = cc.path AND p.position = fb.position)"""


def built(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker's chunks with the number of their terms (``terms``), made once in a session."""
    return once(spark, ("chunks", sf_dir), lambda: chunked(spark, sf_dir).drop("blocks").withColumn("terms", text.token_count(F.col("content"))))


@query(
    "W3_chunks",
    f"""WITH {CHUNKED_SQL} SELECT path AS source, sequence, total, tokens, oversized, CASE type WHEN 'spec' THEN 'spec:' WHEN 'system' THEN 'sys:' ELSE 'obj:' END
        || substr(sha256(content), 1, 16) || '.' || sequence AS id FROM cc""",
)
def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunked(spark, sf_dir).select("source", "sequence", "total", "tokens", "oversized", "id")


@query(
    "A11_chunk_statistics",
    f"""WITH {CHUNKED_SQL} SELECT type, count(*)::BIGINT AS chunks, sum(tokens)::BIGINT AS tokens, min(tokens)::BIGINT AS least, max(tokens)::BIGINT AS most,
        (sum(tokens) // count(*))::BIGINT AS mean, count(*) FILTER (oversized)::BIGINT AS oversized FROM cc GROUP BY type""",
)
def chunk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.statistics(chunked(spark, sf_dir, dealt=False))  # texts aren't read past their blocks


@query("A23_collisions", f"WITH {CHUNKS_SQL} SELECT substr(id, 1, 6) AS id, count(DISTINCT sha256(content))::BIGINT AS contents FROM chk GROUP BY ALL HAVING count(DISTINCT sha256(content)) > 1")
def collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of ids cut to six characters, as whole ones don't collide."""
    return C.collisions(chunks(spark, sf_dir).withColumn("id", F.substring("id", 1, 6)))


@query(
    "K2_render_file",
    f"""WITH {CHUNKS_SQL}, t AS (SELECT *, count(*) OVER (PARTITION BY source) AS total FROM chk)
        SELECT id, source, sha256('<!--' || chr(10) || 'id: ' || id || chr(10) || 'type: ' || type || chr(10) || 'source: ' || source || chr(10) || 'heading: ' || heading || chr(10)
          || 'chunk: ' || sequence || ' of ' || total || chr(10) || 'tokens: ' || tokens || chr(10) || '-->' || chr(10) || chr(10) || content || chr(10)) AS file FROM t""",
)
def render_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    c = chunks(spark, sf_dir).withColumn("total", F.count("*").over(Window.partitionBy("source"))).withColumn("oversized", F.lit(False))
    return C.render_file(c).select("id", "source", F.sha2(F.col("file").cast("binary"), 256).alias("file"))
