"""The stored index against scores computed plainly, and what a search reads of it."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corpusloom import session
from corpusloom.functions import text
from corpusloom.operators import blocks, catalog, chunking, impacts, index, parse
from corpusloom.registered import chunk_queries, score_queries
from corpusloom.sources import adapters


@pytest.fixture(scope="module")
def corpus(spark):
    """Documents in which one term is everywhere, in unlike numbers, and others are rare."""
    rng = random.Random(4)
    rows = []
    for i in range(900):
        words = ["common"] * rng.choice([1, 1, 1, 1, 2, 3, 8]) + [f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randrange(2, 40))]
        rows.append((["objects", "specs"][i % 3 == 0], f"d{i % 450:03}" if i % 3 else f"s{i}", words))
    docs = spark.createDataFrame(rows, "corpus string, doc string, tokens array<string>").groupBy("corpus", "doc").agg(F.flatten(F.collect_list("tokens")).alias("tokens"))
    docs = docs.withColumn("tokens", F.when(F.col("doc") == "d007", F.array().cast("array<string>")).otherwise(F.col("tokens")))
    return session.cut(index.postings(docs)), session.cut(index.doc_lengths(docs))


@pytest.fixture(scope="module")
def made(corpus, tmp_path_factory):
    """In shards of 16 documents."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(impacts, "SHARD_BITS", 4)
        yield impacts.write(impacts.weights(*corpus), str(tmp_path_factory.mktemp("index")), buckets=16)


def queries(spark):
    rng = random.Random(5)
    short = [(q, t) for q in range(40) for t in {f"w{rng.randrange(300)}", "common", f"w{rng.randrange(20)}"}]
    long = [(q, f"w{t}") for q in range(40, 44) for t in range(q, q + 30)]
    twice = [(50, "common"), (50, "common"), (50, "w1"), (51, "absent"), (52, "w1")]
    return spark.createDataFrame(short + long + twice, "query long, term string")


def rows(df):
    return sorted(map(tuple, df.select("query", "corpus", "doc", "score", "rank").collect()))


@pytest.mark.parametrize("n", [1, 5, 1000])
def test_top_equals_all_scores(spark, corpus, made, n):
    q = queries(spark)
    want = rows(index.top(index.bm25(q, *corpus), n))
    assert rows(impacts.search(made, q.withColumn("weight", F.lit(1.0)), n)) == want


def test_large_sets_of_queries_are_shuffled(spark, corpus, made, monkeypatch):
    monkeypatch.setattr(impacts, "BROADCAST_ROWS", 10)
    q = queries(spark)
    found = impacts.search(made, q.withColumn("weight", F.lit(1.0)), 5)
    assert rows(found) == rows(index.top(index.bm25(q, *corpus), 5))
    all_scores = impacts.scores(made, q.withColumn("weight", F.lit(1.0)))
    assert all_scores.count() == index.bm25(q, *corpus).count()


def test_fields(spark, tmp_path):
    rng = random.Random(6)
    parts = [("objects", f"d{i}", f, [f"w{rng.randrange(15)}" for _ in range(rng.randrange(0, 9))]) for i in range(120) for f in ("heading", "body", "terms", "code")]
    docs = spark.createDataFrame(parts, "corpus string, doc string, field string, tokens array<string>")
    post, lengths = index.field_postings(docs), index.field_lengths(docs)
    q = spark.createDataFrame([(q, f"w{t}", w) for q in range(8) for t, w in ((q, 1.0), (q + 1, 0.7), (q + 5, 0.3))], "query long, term string, weight double")
    made = impacts.write(impacts.field_weights(post, lengths), str(tmp_path / "index"), buckets=4)
    assert rows(impacts.search(made, q, 4)) == rows(index.top(index.bm25f(q, post, lengths), 4))


def test_blocks_that_cannot_hold_a_hit_are_not_read_on(spark, made):
    q = spark.createDataFrame([(2, "common")], "query long, term string").withColumn("weight", F.lit(1.0))
    w = impacts._wanted(made, q)
    assert impacts.matched(made, w, 1).count() < 0.5 * impacts.all_blocks(made, w).count()
    assert impacts.matched(made, w, 10_000).count() == impacts.all_blocks(made, w).count()


def test_a_search_reads_the_folders_of_its_terms(spark, made):
    q = spark.createDataFrame([(1, "common", 1.0), (1, "w3", 1.0)], "query long, term string, weight double")
    folders = {r[0] for r in q.select(impacts.bucket(F.col("term"), 16)).collect()}
    found = impacts.all_blocks(made, impacts._wanted(made, q))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    own = made.blocks.where(F.col("bucket").isin(sorted(folders)))
    read = {r[0] for r in own.select(F.col("_metadata.file_path")).distinct().collect()}
    assert {int(p.split("bucket=")[1].split("/")[0]) for p in read} == folders
    sizes = made.blocks.select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_size").alias("s")).distinct().collect()
    assert sum(r.s for r in sizes if r.p in read) < 0.5 * sum(r.s for r in sizes)


def test_an_empty_index_and_no_queries(spark, corpus, made, tmp_path):
    none = spark.createDataFrame([], "corpus string, doc string, term string, w double")
    empty = impacts.write(none, str(tmp_path / "empty"))
    q = spark.createDataFrame([(1, "common", 1.0)], "query long, term string, weight double")
    assert impacts.search(empty, q, 5).collect() == []
    assert impacts.search(made, q.limit(0), 5).collect() == []


def test_tables_are_stored_anew_when_their_sources_change(spark, tmp_path):
    source = str(tmp_path / "documents.parquet")
    spark.range(3).write.parquet(source)
    calls = []

    def make():
        calls.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("id"))

    get = lambda: sorted(r.id for r in session.once(spark, ("doubled", str(tmp_path)), make).collect())
    assert get() == get() == [0, 2, 4] and len(calls) == 1
    spark.range(5).write.mode("overwrite").parquet(source)
    assert get() == [0, 2, 4, 6, 8] and len(calls) == 2


def test_documents_are_indexed_where_their_shards_are(spark, tmp_path, monkeypatch):
    """Whole documents are shuffled, postings aren't; both forms of the index give the scores computed plainly."""
    monkeypatch.setattr(impacts, "SHARD_BITS", 3)
    monkeypatch.setattr(impacts, "SHARDS_OF_A_TASK", 2)
    monkeypatch.setattr(impacts, "ROWS_AT_ONCE", 5)
    rng = random.Random(7)
    parts = [(["objects", "specs"][i % 4 == 0], f"d{i}", f, [f"w{rng.randrange(15)}" for _ in range(rng.randrange(0, 9))]) for i in range(120) for f in ("heading", "body")]
    docs = session.cut(spark.createDataFrame(parts, "corpus string, doc string, field string, tokens array<string>"))
    q = spark.createDataFrame([(q, f"w{t}", w) for q in range(8) for t, w in ((q, 1.0), (q + 1, 0.7), (q + 5, 0.3))], "query long, term string, weight double")
    counted = docs.select("corpus", "doc", "field", F.size("tokens").cast("bigint").alias("dl"), text.term_counts("tokens").alias("terms"))
    fields = counted.groupBy("corpus", "doc").agg(F.collect_list(F.struct("field", "dl", "terms")).alias("fields"))
    made = impacts.write_fields(fields, str(tmp_path / "fields"), buckets=4)
    assert rows(impacts.search(made, q, 4)) == rows(index.top(index.bm25f(q, index.field_postings(docs), index.field_lengths(docs)), 4))
    body = docs.where("field = 'body'")
    made = impacts.write_texts(counted.where("field = 'body'"), str(tmp_path / "texts"), buckets=4)
    plain = index.bm25(q.drop("weight"), index.postings(body), index.doc_lengths(body))
    same = q.withColumn("weight", F.lit(1.0))
    assert rows(impacts.search(made, same, 3)) == rows(index.top(plain, 3))
    best = lambda df: sorted(map(tuple, df.groupBy("query", "corpus").agg(F.count("*"), F.max("score")).collect()))
    assert best(impacts.scores(made, same)) == best(plain)
    assert "Exchange" not in index.postings(body)._jdf.queryExecution().executedPlan().toString()


def test_counts_of_terms(spark):
    lists = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["a"]), (5, [None, "c", "c"])]
    got = spark.createDataFrame(lists, "id long, tokens array<string>").coalesce(1).select("id", F.inline(text.term_counts("tokens"))).collect()
    assert sorted(map(tuple, got)) == [(1, "a", 1), (1, "b", 2), (4, "a", 1), (5, "c", 2)]


def test_texts_of_chunks_are_shuffled_by_path_alone(spark):
    b = spark.range(9).selectExpr("'p' as path", "id as position", "'paragraph' as type", "'x' as content", "100L as tokens", "array('h') as heading")
    made = chunking.chunk(session.cut(b))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Exchange hashpartitioning\(path#\d+, (position|k)#", plan)
    assert [r.sequence for r in made.orderBy("sequence").collect()] == [1, 2, 3]


def test_last_sentence_reads_a_text_once(spark):
    """A text without a full stop was tried from each of its places."""
    texts = ["One here. And this is the last sentence of it.", "Is it? " + "word " * 9 + "! tail", "No end at all, not one", "x" * 400_000, "a. " + "long words " * 40_000, "A first line of text.\n\nThe second one stands here.\n"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    start = time.monotonic()
    got = [r.s for r in df.select("id", text.last_sentence(F.col("text")).alias("s")).orderBy("id").collect()]
    assert time.monotonic() - start < 20
    assert got == ["And this is the last sentence of it.", ("word " * 9 + "!"), "", "", "", "The second one stands here."]


def test_words_of_phrases_stay_where_their_text_is(spark):
    words = session.cut(spark.createDataFrame([("a", "red green the red blue".split()), ("b", ["one"])], "id string, words array<string>"))
    plan = catalog.key_phrases(words)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(id") == plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")
    chunks = session.cut(words.selectExpr("id as chunk", "'The big station.' as content"))
    plan = parse.noun_phrases(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")


def test_batches_of_python_workers_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    adapters.table(spark, "/root/testdata/sf0.001", "region")
    assert spark.conf.get(key) == "1000"
    spark.conf.set(key, before)


def shuffle_files(spark):
    files = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    paths = [files.apply(i).getPath() for i in range(files.size())]
    return {p: os.path.getsize(p) for p in paths if "shuffle_" in p and os.path.exists(p)}


def test_shuffle_files_of_a_stored_table_are_let_go(spark, tmp_path):
    """They stayed on the disk beside the table until the driver happened to collect its garbage."""
    source = str(tmp_path / "documents.parquet")
    spark.range(3000).write.parquet(source)
    before = shuffle_files(spark)
    made = session.once(spark, ("dealt", str(tmp_path)), lambda: spark.read.parquet(source).repartition(3, "id"))
    assert made.count() == 3000
    own = spark.read.parquet(source)
    session.stored(spark, "dealt again", source, lambda to: own.repartition(3, "id").write.parquet(to))
    start = time.monotonic()
    while left := sum(n for p, n in shuffle_files(spark).items() if p not in before):
        assert time.monotonic() - start < 20, left
        time.sleep(0.2)


def test_an_index_is_built_without_a_shuffle_of_documents(spark, tmp_path):
    """Documents were shuffled twice with their terms, once for their keys and once for their shards."""
    rng = random.Random(8)
    terms = [f"term{i}" for i in range(600)]
    docs = spark.createDataFrame([(["objects", "specs"][i % 2], f"d{i}", rng.sample(terms, 300)) for i in range(400)], "corpus string, doc string, tokens array<string>")
    docs.select("corpus", "doc", F.size("tokens").cast("bigint").alias("dl"), text.term_counts("tokens").alias("terms")).coalesce(2).write.parquet(str(tmp_path / "docs"))
    before = shuffle_files(spark)
    made = impacts.write_texts(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "index"), buckets=4)
    assert made.blocks.agg(F.sum(F.size("at"))).first()[0] == 120_000 and made.docs.count() == 400
    assert sum(n for p, n in shuffle_files(spark).items() if p not in before) < 100_000


def test_blocks_are_written_without_a_sort(spark, tmp_path):
    """Each task sorted its blocks by folder and term, and spilled twice an index's size at 1 GB."""
    docs = spark.createDataFrame([("objects", f"d{i}", 2, [(f"a{i % 50}", 1), ("b", 1)]) for i in range(300)], "corpus string, doc string, dl long, terms array<struct<term:string,tf:long>>")
    store = spark._jsparkSession.sharedState().statusStore()
    before, key = store.executionsCount(), "spark.sql.maxConcurrentOutputFileWriters"
    kept = spark.conf.get(key)
    made = impacts.write_texts(docs, str(tmp_path / "index"), buckets=8)
    assert spark.conf.get(key) == kept and made.terms.count() == 51
    runs = store.executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(before, runs.size())]
    own = [p for p in plans if "MapInArrow" in p and "InsertIntoHadoopFsRelationCommand" in p]
    assert own and not any("Sort" in p for p in own)
    parts = [os.path.join(d, f) for d, _, names in os.walk(tmp_path / "index/blocks") for f in names if f.endswith(".parquet")]
    assert len(parts) <= 9 * docs.rdd.getNumPartitions()


def test_what_a_search_has_shuffled_is_let_go(spark):
    """It stayed beside the next query's until the driver happened to collect its garbage."""
    before = shuffle_files(spark)
    found = score_queries.reranked(spark, "/root/testdata/sf0.001")
    start = time.monotonic()
    while left := sum(n for p, n in shuffle_files(spark).items() if p not in before):
        assert time.monotonic() - start < 20, left
        time.sleep(0.2)
    assert found.where("rank = 1").count() and sum(n for p, n in shuffle_files(spark).items() if p not in before)
    del found
    score_queries.term_index(spark, "/root/testdata/sf0.001")
    before, start = shuffle_files(spark), time.monotonic()
    score_queries.hits(spark, "/root/testdata/sf0.001", 5).count()
    score_queries.field_term_index(spark, "/root/testdata/sf0.001")
    while left := sum(n for p, n in shuffle_files(spark).items() if p not in before):
        assert time.monotonic() - start < 20, left
        time.sleep(0.2)


def test_references_of_python_are_passed_on_before_garbage_is_collected(spark, tmp_path):
    """Py4J's thread had most often not come round to them, so what they held stayed."""
    queue = spark.sparkContext._gateway._gateway_client.finalizer_deque
    left = []
    for _ in range(5):
        frames = [spark.range(3).repartition(2) for _ in range(200)]
        del frames
        session.let_go(spark)
        left.append(len(queue))
    assert left == [0] * 5


def test_what_a_search_has_shuffled_is_let_go_if_the_manifest_is_there(spark):
    """Only the making of a manifest, a while later, had let it go."""
    score_queries.manifest(spark, "/root/testdata/sf0.001")
    score_queries.field_term_index(spark, "/root/testdata/sf0.001")
    before = shuffle_files(spark)
    found = score_queries.reranked(spark, "/root/testdata/sf0.001")
    start = time.monotonic()
    while left := sum(n for p, n in shuffle_files(spark).items() if p not in before):
        assert time.monotonic() - start < 20, left
        time.sleep(0.2)
    assert found.where("rank = 1").count()


def test_weights_are_stored_once_for_each_document(spark, tmp_path):
    """Each posting had its weight as a double and its place as it is: 3.6 bytes of a file."""
    rng = random.Random(9)
    terms = [f"term{i}" for i in range(600)]
    docs = [("objects", f"d{i}", [t for t in rng.sample(terms, rng.randrange(200, 400)) for _ in range(rng.choice([1, 1, 1, 1, 2, 3]))]) for i in range(1500)]
    docs = session.cut(spark.createDataFrame(docs, "corpus string, doc string, tokens array<string>").coalesce(2))
    post, lengths = index.postings(docs), index.doc_lengths(docs)
    made = impacts.write_texts(docs.select("corpus", "doc", F.size("tokens").cast("bigint").alias("dl"), text.term_counts("tokens").alias("terms")), str(tmp_path / "index"), buckets=4)
    names = {r.key: r.doc for r in made.docs.collect()}
    opened = impacts._opened(made, made.blocks).select("c", "shard", "term", F.inline(F.arrays_zip("at", "w"))).select("term", impacts._key("at").alias("key"), "w").collect()
    factor = {r.term: r.factor for r in made.terms.collect()}
    got = {(names[r.key], r.term): round(r.w * factor[r.term], 9) for r in opened}
    assert got == {(r.doc, r.term): round(r.w, 9) for r in impacts.weights(post, lengths).collect()} and len(got) == len(opened)
    size = sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path / "index/blocks") for f in fs if f.endswith(".parquet"))
    assert size < 2.2 * len(opened), size / len(opened)


def test_chunks_take_stored_numbers(spark):
    """The blocks' sizes were shuffled twice beside the texts, and stayed on the disk until the chunks were written."""
    plan = chunk_queries.chunked(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "BroadcastExchange" not in plan
    files = adapters.blocks(spark, "/root/testdata/sf0.001")
    plain = chunking.chunk(blocks.heading_paths(files), chunk_queries.OPTIONS).drop("blocks")
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, chunk_queries.chunked(spark, "/root/testdata/sf0.001").drop("blocks").collect()))


def test_ties_go_to_the_lesser_name_wherever_documents_are(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(impacts, "SHARD_BITS", 3)
    docs = spark.createDataFrame([("objects", f"d{i:02}", 2, [("a", 1), ("b", 1)]) for i in reversed(range(60))], "corpus string, doc string, dl long, terms array<struct<term:string,tf:long>>")
    made = impacts.write_texts(docs.repartition(5), str(tmp_path / "index"), buckets=2)
    q = spark.createDataFrame([(1, "a", 1.0)], "query long, term string, weight double")
    assert [r[2:3] + r[4:] for r in rows(impacts.search(made, q, 4))] == [(f"d{i:02}", i + 1) for i in range(4)]
    monkeypatch.setattr(impacts, "BROADCAST_ROWS", 0)
    assert [r[2:3] + r[4:] for r in rows(impacts.search(made, q, 4))] == [(f"d{i:02}", i + 1) for i in range(4)]


def test_mean_lengths_need_no_stems(spark):
    """All terms of all fields were stemmed and counted for the mean number of them."""
    plan = score_queries.field_averages(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "field-docs" not in plan
    df = spark.createDataFrame([("The running dogs of http-server v2.0",), ("",), ("the of",)], "t string")
    assert all(r[0] == len(r[1]) for r in df.select(text.token_count(F.col("t")), text.tokens(F.col("t"))).collect())


def test_whole_texts_are_dealt_before_they_are_cut(spark):
    plan = blocks.heading_paths(adapters.blocks(spark, "/root/testdata/sf0.001", dealt=True))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Generate") < plan.index("Exchange ")
