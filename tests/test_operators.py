"""Small operators on edge cases, the factored form of related terms, and lookups by id."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import catalog, fuse, incremental, logs, packages, taxonomy
from corpusloom.sources import files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=repr)


def test_places_order_all_rows(spark):
    rng = random.Random(5)
    values = [None, None, 0, 0, -3, 1 << 40] + [rng.choice([rng.randrange(50), rng.randrange(10**9)]) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "id int, v bigint").repartition(7)
    want = sorted(range(len(values)), key=lambda i: (values[i] is None, -(values[i] or 0), i))
    got = {r.id: r.place for r in logs.places(df, "v", "id").collect()}
    assert got == {i: n for n, i in enumerate(want, 1)}
    assert logs.places(df.limit(0), "v", "id").count() == 0


def test_plan_steps(spark):
    steps = spark.createDataFrame(
        [(1, 1, "completed", None), (1, 2, "pending", 1), (1, 3, "in_progress", 2), (1, 4, "pending", 9), (2, 1, "completed", 2), (2, 2, "pending", None), (3, 1, None, None)],
        "plan int, step int, status string, blocker int",
    )
    assert rows(logs.blocked_steps(steps)) == [(1, 3)]
    assert rows(logs.progress(steps)) == [(1, 1, 1, 2), (2, 1, 0, 1), (3, 0, 0, 0)]


def test_session_totals_and_sizes(spark):
    e = spark.createDataFrame([("a", 2, 5), ("a", 1, 5), ("a", 3, 1), ("b", 1, 0)], "session string, place int, tokens bigint")
    assert rows(logs.session_totals(e, 10)) == [("a", 11, 110.0, True, 1), ("b", 0, 0.0, False, 1)]
    f = spark.createDataFrame([("x", "é"), ("x", None), ("y", None)], "folder string, content string")
    assert rows(logs.sizes(f, "folder")) == [("x", 2), ("y", None)]


def test_flatten_and_types(spark):
    r = spark.createDataFrame([("q", "system", "c", 1.0, 1), ("q", "objects", "b", 1.0, 2), ("q", "objects", "a", 1.0, 1), ("q", "own", "e", 1.0, 1), ("q", "specs", "d", 2.0, 1)], "query string, corpus string, doc string, score double, rank int")
    assert [x[1] for x in sorted(rows(fuse.flatten(r)), key=lambda x: x[2])] == ["d", "a", "b", "c", "e"]
    c = spark.createDataFrame([("s", 1, "spec"), ("s", 2, "object"), ("r", 1, "system")], "source string, sequence int, type string")
    assert [x[:2] for x in sorted(rows(fuse.by_type(c, F.lit(1))), key=lambda x: x[2])] == [("s", 2), ("r", 1), ("s", 1)]
    assert spark.range(1).select(fuse.result_count(F.lit(None), F.lit(None)), fuse.result_count(F.lit(None), F.lit(4)), fuse.result_count(F.lit(2), F.lit(4))).first()[:] == (30, 4, 2)


def test_union_of_fresh_and_kept(spark):
    kept = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "source string, sequence int")
    fresh = spark.createDataFrame([("a", 1), ("c", 1)], "source string, sequence int")
    assert rows(incremental.union_chunks(fresh, kept)) == [("a", 1, True), ("b", 1, False), ("c", 1, True)]
    assert rows(incremental.union_chunks(fresh.limit(0), kept), "source", "fresh") == [("a", False), ("a", False), ("b", False)]


def test_installable(spark):
    found = spark.createDataFrame([(1, "n", False, False), (1, "t", False, True), (1, "z", True, True), (1, "o", None, None)], "search int, name string, released boolean, tagged boolean")
    assert [x[1] for x in sorted(rows(packages.installable(found, "search", "name")), key=lambda x: x[3])] == ["z", "t", "n", "o"]


def test_definition_position(spark):
    texts = ["Term is", "lower", "- Item", "12) Item", "a\n  Deep", "-Item", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(taxonomy.definition_position(F.col("t"))).collect()] == [True, False, True, True, True, True, False, None]


def test_structural_keeps_all_kinds(spark):
    b = spark.createDataFrame(
        [("c1", 0, "heading", "Cache Layer"), ("c1", 1, "code_block", "def cache_layer(x):\nclass Store"), ("c2", 0, "list", "- **Cache Layer** is"), ("c2", 1, "table", "Store | Name\n--- | ---"), ("c3", 0, "heading", "")],
        "chunk string, block int, type string, content string",
    )
    got = {(r.canonical, r.source) for r in taxonomy.structural(b).collect()}
    assert got >= {("Cache Layer", "heading"), ("cache_layer", "code_identifier"), ("Store", "code_identifier"), ("Cache Layer", "bold_term"), ("Store", "structured_position")}
    terms = {r.key: (r.canonical, r.source) for r in taxonomy.extract(b, 2).collect()}
    assert terms["cache-layer"] == ("Cache Layer", "heading") and "store" in terms


@pytest.fixture
def linked(spark):
    """60 sources of four sets of 200 terms, each linked to all sources of the next set."""
    terms = spark.range(60).select(F.col("id").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("n"))
    terms = terms.select("source", F.concat(F.lit("k"), (F.col("source") % 4 * 150 + F.col("n")).cast("string")).alias("key"))
    links = spark.range(60).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(59))).alias("dst")).where("(src + 1) % 4 = dst % 4")
    broader = spark.createDataFrame([("k0", "k160"), ("k5", None)], "key string, broader string")
    return links, terms, broader


def test_related_terms_are_stored_by_class(spark, linked):
    links, terms, broader = linked
    classes, edges = taxonomy.related_store(links, terms)
    assert (classes.count(), edges.count()) == (4 * 200, 4)  # 900 links between sources of 200 terms stand for far more pairs
    pairs = taxonomy.cross_references(links, terms, broader)
    assert pairs.count() > 50_000
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    asked = spark.createDataFrame([("k0",), ("k5",), ("k170",), ("k170",), ("nowhere",)], "key string")
    want = both.join(asked.distinct(), both.a == asked.key, "left_semi").groupBy("a").agg(F.array_sort(F.collect_list("b")))
    assert rows(taxonomy.related_of(asked, classes, edges, broader)) == rows(want)


def scanned_files(df):
    plan = df._jdf.queryExecution().executedPlan()
    plan.execute().count()
    return plan.collectLeaves().head().metrics().get("numFiles").get().value()


def test_lookup_by_id_reads_few_files(spark, tmp_path):
    c = spark.range(5000).select(F.concat(F.lit("obj:"), F.col("id").cast("string")).alias("id"), F.col("id").alias("content"))
    c = c.unionByName(c.where("content = 7").withColumn("content", F.lit(-7).cast("bigint"))).unionByName(c.where("content = 0").withColumn("id", F.lit(None).cast("string")))
    path = str(tmp_path / "chunks")
    files.write_by_id(c, path)
    got = files.read_by_id(spark, path, ["obj:7", "obj:11", "obj:11", "obj:x"])
    assert rows(got, "id", "content") == [("obj:11", 11), ("obj:7", -7), ("obj:7", 7)]
    assert "PartitionFilters: [" in got._jdf.queryExecution().toString() and "PushedFilters: [" in got._jdf.queryExecution().toString()
    assert scanned_files(got) <= 3 < 200 <= scanned_files(spark.read.parquet(path))
    assert files.read_by_id(spark, path, []).count() == 0
    wanted = spark.createDataFrame([("obj:7",), ("obj:7",), (None,)], "id string")
    assert rows(catalog.lookup(c, wanted), "content") == [(-7,), (7,)]


def test_large_classes_are_paired_by_blocks(spark, monkeypatch):
    """No row holds a whole class's terms; terms of several classes and broader ones come out as in plain Python."""
    one = spark.range(2000).selectExpr("'c' as class", "concat('k', id) as key")
    sizes = [len(r["keys"]) for r in taxonomy._key_blocks(one).collect()]
    assert sum(sizes) == 2000 and len(sizes) > 1 and max(sizes) <= 2 * taxonomy.KEYS_AT_ONCE
    monkeypatch.setattr(taxonomy, "KEYS_AT_ONCE", 2)
    own = {0: ["a", "b", "c", "d", "e"], 1: ["c", "f", "g"], 2: ["a", "h"], 3: ["z"]}
    links, up = [(0, 1), (1, 0), (2, 2), (1, 2), (4, 0)], {("f", "a"), ("h", "a")}
    pairs = {tuple(sorted((x, y))) for s, d in links for x in own.get(s, []) for y in own.get(d, []) if x != y} - {tuple(sorted(p)) for p in up}
    frames = spark.createDataFrame(links, "src long, dst long"), spark.createDataFrame([(k, s) for s, ks in own.items() for k in ks], "key string, source long")
    broader = spark.createDataFrame([*up, ("z", None)], "key string, broader string")
    assert {(r.a, r.b) for r in taxonomy.cross_references(*frames, broader).collect()} == pairs
    want = {k: sorted({y for p in pairs if k in p for y in p if y != k}) for k in {k for p in pairs for k in p}}
    got = taxonomy.related_of(frames[1].select("key"), *taxonomy.related_store(*frames), broader).collect()
    assert {r.key: r.related for r in got} == want and len(got) == len(want)


def test_tags_are_read_once_for_all_levels(spark, monkeypatch):
    calls, plain = [], packages.valid_tags
    monkeypatch.setattr(packages, "valid_tags", lambda t: calls.append(1) or plain(t))
    tags = spark.createDataFrame([(f"p{i}", v) for i in range(5) for v in ("v1.0.0", "v1.2.0", "1.2.0")], "ref string, tag string")
    needs = spark.createDataFrame([(f"p{i}", "1.2.0", f"p{i + 1}", ">=1.0.0") for i in range(4)] * 2, "ref string, version string, dep_ref string, constraint string")
    found, met = packages.resolve(spark.createDataFrame([("p0", "latest")], "ref string, constraint string"), needs, tags)
    assert sorted(map(tuple, found.collect())) == [(f"p{i}", "1.2.0", "transitive" if i else "direct") for i in range(5)]
    assert met.count() == 5 and len(calls) == 1
