"""Scenarios of the operators on small literal tables, and a few queries against DuckDB."""

import json
import math
import random

import duckdb
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusloom.config import ChunkOptions
from corpusloom.functions import counting
from corpusloom.functions import text as words_of
from corpusloom.functions.markdown import parse
from corpusloom.functions.stem import stem
from corpusloom.operators import blocks as B
from corpusloom.operators import catalog, chunking, fuse, incremental, index, taxonomy
from corpusloom.operators import packages as P
from corpusloom.operators.parse import stemmed_tokens
from corpusloom.plans import corpus as plan
from corpusloom.sources import files
from corpusloom.streaming import logs as streams

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def fold(tokens, heads, o):
    """The chunk number of each block, by the rules in words."""
    out, k, size, open_ = [], 0, 0, False
    for t, h in zip(tokens, heads):
        if t > o.most:
            k, size, open_ = k + 1, 0, False
        elif not open_ or h or (size + t > o.target and size >= math.floor(o.target * o.flex)):
            k, size, open_ = k + 1, t, True
        else:
            size += t
        out.append(k)
    return out


CASES = [
    ([200, 300], "pp", [1, 1]), ([370, 100], "pp", [1, 2]), ([100, 1500, 100], "ppp", [1, 2, 3]), ([10, 400, 10, 400], "hphp", [1, 1, 2, 2]),
    ([400, 50], "pp", [1, 1]), ([200, 200, 10, 140], "pphp", [1, 1, 2, 2]), ([1500, 50], "pp", [1, 2]), ([800], "p", [1]), ([801, 10], "pp", [1, 2]),
]


def frame(spark, cases):
    rows = [(f"f{n}", i, "heading" if c == "h" else "paragraph", f"b{i}", t, ["x"]) for n, (ts, cs, _) in enumerate(cases) for i, (t, c) in enumerate(zip(ts, cs))]
    return spark.createDataFrame(rows, "path string, position bigint, type string, content string, tokens bigint, heading array<string>")


def test_chunk_rules(spark):
    got = {(r.path, r.position): r.k for r in chunking.assign(frame(spark, CASES)).collect()}
    for n, (tokens, _, want) in enumerate(CASES):
        assert [got[f"f{n}", i] for i in range(len(tokens))] == want


def test_chunks_keep_blocks_in_order(spark):
    rng = random.Random(2)
    cases = [([rng.randint(1, 900) for _ in range(n)], "".join(rng.choice("hppp") for _ in range(n)), None) for n in range(1, 25)]
    blocks = frame(spark, cases)
    got = {(r.path, r.position): r.k for r in chunking.assign(blocks).collect()}
    for n, (tokens, kinds, _) in enumerate(cases):
        assert [got[f"f{n}", i] for i in range(len(tokens))] == fold(tokens, [c == "h" for c in kinds], ChunkOptions())
    chunks = chunking.chunk(blocks).collect()
    for n, (tokens, _, _) in enumerate(cases):
        own = sorted((c for c in chunks if c.source == f"f{n}"), key=lambda c: c.sequence)
        assert [b.position for c in own for b in c.blocks] == list(range(len(tokens)))
        assert [c.sequence for c in own] == list(range(1, len(own) + 1)) and sum(c.tokens for c in own) == sum(tokens)


def test_tail_is_cut_anew_or_joined(spark):
    d = frame(spark, [([370, 100], "pp", None), ([300, 100, 60, 90], "pppp", None), ([100, 50], "pp", None)])
    numbered = d.withColumn("k", F.when(F.col("path") == "f1", F.when(F.col("position") < 2, 1).otherwise(2)).otherwise(F.col("position") + 1).cast("bigint"))
    got = {(r.path, r.position): r.k for r in chunking.balance_tail(numbered).collect()}
    assert [got["f0", i] for i in range(2)] == [1, 2]
    assert [got["f1", i] for i in range(4)] == [1, 2, 2, 2]  # 300 is nearest to half of 550
    assert [got["f2", i] for i in range(2)] == [1, 1]  # both fit the target


def test_heading_paths_stop_at_a_gap(spark):
    rows = [("p", 0, "heading", 1, "A"), ("p", 1, "heading", 3, "C"), ("p", 2, "heading", 2, "B"), ("p", 3, "heading", 3, "D"), ("p", 4, "heading", 2, "E"), ("p", 5, "x", 0, "t")]
    got = B.heading_paths(spark.createDataFrame(rows, "path string, position bigint, type string, level bigint, content string")).orderBy("position").collect()
    assert [r.heading for r in got] == [["A"], ["A"], ["A", "B"], ["A", "B", "D"], ["A", "E"], ["A", "E"]]


def test_heading_match(spark):
    pairs = [("A > B", "A > B", 5), ("A > B > C", "A > B", 5), ("A > Bx", "A > B", 5), ("A > X > Y", "A > X > Z", 5), ("A", "B", -1), ("", "A", -1)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r.n for r in df.select(catalog.heading_match(F.col("a"), F.col("b")).alias("n")).collect()] == [p[2] for p in pairs]


def test_bm25_prefers_rare_terms_and_short_documents(spark):
    docs = spark.createDataFrame([("o", "d1", ["a", "b"]), ("o", "d2", ["a", "a", "c", "c"]), ("o", "d3", ["a"]), ("o", "d4", [])], "corpus string, doc string, tokens array<string>")
    post, lengths = index.postings(docs), index.doc_lengths(docs)
    stats = {r.term: r.idf for r in index.term_stats(post, index.corpus_stats(lengths)).collect()}
    assert stats["a"] == round(math.log(1 + 1.5 / 3.5), 9) and stats["b"] == round(math.log(1 + 3.5 / 1.5), 9)
    q = spark.createDataFrame([(1, "b"), (1, "a"), (2, "a"), (3, "zz")], "query int, term string")
    got = index.top(index.bm25(q, post, lengths), 10).collect()
    assert [r.doc for r in sorted(got, key=lambda r: r["rank"]) if r["query"] == 1][0] == "d1" and not [r for r in got if r["query"] == 3]
    assert {r.doc for r in got if r["query"] == 2} == {"d1", "d2", "d3"}


def test_fusion_and_rerank(spark):
    ranked = spark.createDataFrame([(1, "objects", "x", 1), (1, "objects", "y", 2), (1, "specs", "s", 1), (1, "system", "z", 1)], "query int, corpus string, doc string, rank bigint")
    fused = fuse.weighted_rrf(ranked)
    got = {r.doc: r for r in fused.collect()}
    assert got["x"].score == round(1 / 61, 9) and got["s"].score == round(0.7 / 61, 9) and got["x"].sources == {"objects": 1}
    manifest = spark.createDataFrame(
        [("x", "a", None, "y", "s", None), ("y", "a", "x", None, None, None), ("s", "a.spec", None, None, None, "x"), ("z", "b", None, None, None, None)],
        "doc string, source string, previous string, next string, spec_chunk string, parent_object string",
    )
    refs = spark.createDataFrame([("a", "b")], "src string, dst string")
    boosted = {r.doc: r.score for r in fuse.graph_rerank(fused, manifest, refs, 2).collect()}
    assert boosted["x"] == round(got["x"].score * 1.45, 11) and boosted["y"] == round(got["y"].score * 1.25, 11)
    assert boosted["s"] == round(got["s"].score * 1.2, 11) and boosted["z"] == round(got["z"].score * 1.1, 11)


def test_budget_takes_the_first_always(spark):
    rows = spark.createDataFrame([(1, 1, 500), (1, 2, 10), (2, 1, 40), (2, 2, 40), (2, 3, 40), (2, 4, 1)], "query int, rank int, tokens int")
    assert sorted((r["query"], r["rank"]) for r in fuse.select_budget(rows, 100).collect()) == [(1, 1), (2, 1), (2, 2)]


def test_expansion_tiers(spark):
    terms = spark.createDataFrame(
        [("jwt", "JWT", ["token auth"], ["claim"], ["oauth"]), ("claim", "Claim set", [], [], []), ("oauth", "OAuth", [], [], [])],
        "key string, canonical string, aliases array<string>, narrower array<string>, related array<string>",
    )
    words = spark.createDataFrame([("login", ["signin"])], "word string, synonyms array<string>")
    q = spark.createDataFrame([(1, "the jwt login"), (2, "the")], "query int, text string")
    got = [(r.term, r.weight, r.tier) for r in taxonomy.expand(q, terms, taxonomy.alias_index(terms), words).orderBy("query", "ordinal").collect()]
    assert got == [
        ("jwt", 1.0, "original"), ("login", 1.0, "original"), ("token", 1.0, "alias"), ("auth", 1.0, "alias"), ("claim", 0.7, "narrower"), ("set", 0.7, "narrower"),
        ("oauth", 0.4, "related"), ("signin", 1.0, "alias"),
    ]
    assert taxonomy.expand(q, terms, taxonomy.alias_index(terms), words, cap=3).count() == 3


def test_versions_and_conflicts(spark):
    tags = spark.createDataFrame([("a", "v1.0.0"), ("a", "1.10.0"), ("a", "v1.9.0"), ("a", "v2.0.0-rc.1"), ("a", "x"), ("b", "v1.0.0"), ("b", "v3.0.0")], "ref string, tag string")
    want = spark.createDataFrame([("a", "latest"), ("a", ">=1.9.5"), ("a", "1.9.0"), ("a", "5.0.0"), ("b", ">=1.0.0")], "ref string, constraint string")
    got = {(r.ref, r.constraint): r.version for r in P.resolve_versions(want, tags).collect()}
    assert got == {("a", "latest"): "2.0.0-rc.1", ("a", ">=1.9.5"): "2.0.0-rc.1", ("a", "1.9.0"): "1.9.0", ("b", ">=1.0.0"): "3.0.0"}
    deps = spark.createDataFrame([("a", "1.9.0", "b", "2.0.0"), ("a", "1.9.0", "c", ">=1.0.0")], "ref string, version string, dep_ref string, constraint string")
    direct = spark.createDataFrame([("a", "1.9.0"), ("b", "1.0.0")], "ref string, constraint string")
    packages, met = P.resolve(direct, deps, tags)
    assert {(r.ref, r.version, r.source) for r in packages.collect()} == {("a", "1.9.0", "direct"), ("b", "1.0.0", "direct")}
    assert [r.ref for r in P.conflicts(met).collect()] == ["b"]


def test_first_build_is_all_new(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, hash string")
    assert {r.status for r in incremental.classify(now, now.limit(0)).collect()} == {"new"}


PAIRS = {
    "running": "run", "caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "hoping": "hope", "happy": "happi", "relational": "relat",
    "generally": "general", "consistency": "consist", "knightly": "knight", "skies": "sky", "by": "by", "cry": "cri", "national": "nation", "controlling": "control",
}


@pytest.mark.parametrize("word", PAIRS)
def test_stemmer(word):
    assert stem(word) == PAIRS[word]


@settings(max_examples=200, deadline=None)
@given(st.text("abcdeilnorstuyz'-", max_size=14))
def test_stems_are_no_longer(word):
    assert len(stem(word)) <= len(word) + 1


def test_stemmed_tokens(spark):
    docs = spark.createDataFrame([(1, "Running the CreateUser error-handling tests"), (2, "the of")], "doc int, text string")
    assert [(r.doc, r.tokens) for r in stemmed_tokens(docs).collect()] == [(1, ["run", "createuser", "error-handl", "test"])]


TERMS = {
    "Running tests": ["run", "test"], "CreateUser": ["createuser"], "http.Handler": ["http.handler"], "error-handling": ["error-handl"], "HTTP sessions": ["http", "session"],
    "await false": ["await", "false"], "because very above": ["because", "very", "above"], "sha256 files": ["sha256", "file"], "_x -c- b": ["_x", "c", "b"], "": [], "the of": [],
}


def test_index_and_query_terms_are_alike(spark):
    df = spark.createDataFrame([(t,) for t in TERMS] + [(None,)], "text string")
    got = {r.text: r.t for r in df.select("text", words_of.tokens(F.col("text")).alias("t")).collect()}
    assert got == {**TERMS, None: None}
    docs = spark.createDataFrame([("o", "d1", "The sessions are running")], "corpus string, doc string, text string").select("corpus", "doc", words_of.tokens(F.col("text")).alias("tokens"))
    q = spark.createDataFrame([(1, "a running session")], "query int, text string").select("query", F.explode(words_of.tokens(F.col("text"))).alias("term"))
    assert index.bm25(q, index.postings(docs), index.doc_lengths(docs)).count() == 1


def test_token_counter_equals_another_library(spark):
    from tokenizers import Tokenizer

    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()] + ["", " it's  tabs\t\n\n x1y <|endoftext|>", None]
    count = counting.counter(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select("text", count(F.col("text")).alias("n")).collect()
    other = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    other.encode_special_tokens = True
    assert {r.text: r.n for r in rows} == {t: None if t is None else len(other.encode(t, add_special_tokens=False).ids) for t in texts}
    assert counting.counter() is words_of.estimated_tokens


def test_bridges(spark):
    last = "Sessions are signed with rotating keys."
    rows = [
        ("a#1", "object", "a", 1, "A > B", "Opening words. " * 60 + "Rotating keys expire. " + last), ("a#2", "object", "a", 2, "A > C", "short"), ("a#3", "object", "a", 3, "A > C", "the of and"),
        ("a#4", "object", "a", 4, "A > C", "x"), ("s#1", "spec", "s", 1, "A", "spec text"), ("s#2", "spec", "s", 2, "B", "more"), ("b#1", "system", "b", 1, "A", "alone"),
    ]
    chunks = spark.createDataFrame(rows, "doc string, type string, source string, sequence int, heading string, content string")
    got = {r.doc: r.bridge for r in catalog.bridges(chunks).collect()}
    assert set(got) == {"a#1", "a#2"} and got["a#2"] == "Established: short"
    assert got["a#1"].startswith("Completed: B. Entering: C. Established: ") and got["a#1"].endswith(f". {last}") and "rotating keys" in got["a#1"]
    assert {r.doc for r in catalog.bridges(chunks, chunks.where("doc = 'a#1'").select("doc")).collect()} == {"a#2"}


def test_late_hashes_don_t_replace_newer_ones(spark, tmp_path):
    run = streams.merge_hashes(str(tmp_path / "h"))
    rows = lambda *r: spark.createDataFrame(list(r), "path string, hash string, ts bigint")
    run(rows(("a", "2", 9), ("b", "1", 1)), 0)
    run(rows(("a", "1", 3), ("b", "2", 4)), 1)
    run(rows(("c", "1", 1)), 2)
    assert {r.path: r.hash for r in spark.read.parquet(str(tmp_path / "h" / "2")).collect()} == {"a": "2", "b": "2", "c": "1"}
    assert not (tmp_path / "h" / "0").exists()


@settings(max_examples=150, deadline=None)
@given(st.text("ab #-*`>|_[](){}<!\n1.=~\\&", max_size=80))
def test_parser_takes_anything(text):
    for b in parse(text).blocks:
        assert b.type in {"heading", "paragraph", "list", "table", "blockquote", "html", "code_block", "thematic_break"}


def test_parser_blocks():
    d = parse("# Hi **there**\n\nSome *em* `co  de` [link](a.md#z) ![alt](i.png)\nsoft  \nhard <b>x</b>\n\n0. x\n1. y\n   - z\n\n| A | B |\n|---|---|\n| 1 | `2` |\n\n[r]: b.md\n\nsee [r] and [no]\n")
    assert [(b.type, b.content) for b in d.blocks] == [
        ("heading", "Hi there"), ("paragraph", "Some em `co  de` link alt soft\nhard <b>x</b>"), ("list", "1. x\n2. y\n   - z"), ("table", "A | B\n1 | `2`"), ("paragraph", "see r and [no]"),
    ]
    assert [t for t, _ in d.links] == ["a.md#z", "b.md"]


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("docs")
    texts = {
        "foundation/overview.md": "# Overview\n\nTokens and sessions. See [auth](../topics/auth.md).\n", "topics/auth.md": "# Auth\n\n## Tokens\n\nJSON Web Token (JWT) sessions are signed.\n\n```go\nfunc SignToken() {}\n```\n",
        "topics/auth.spec.md": "# Auth\n\n## Tokens\n\nSigned, since sessions are stateless.\n", "system/rules.MD": "# Rules\n\nWrite about tokens plainly.\n", ".hidden/x.md": "# No\n", "notes.txt": "no",
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def test_walk_build_search(spark, tree):
    found = files.walk(spark, tree)
    assert sorted(r.path for r in found.collect()) == ["foundation/overview.md", "system/rules.MD", "topics/auth.md", "topics/auth.spec.md"]
    corpus = plan.build(found)
    kinds = {r.source: r.type for r in corpus.manifest.collect()}
    assert kinds == {"foundation/overview.md": "object", "system/rules.MD": "system", "topics/auth.md": "object", "topics/auth.spec.md": "spec"}
    assert [(r.src, r.dst) for r in corpus.references.collect()] == [("foundation/overview.md", "topics/auth.md")]
    q = spark.createDataFrame([(1, "tokens sessions")], "query int, text string")
    none = spark.createDataFrame([], "word string, synonyms array<string>")
    hits = plan.search(corpus, q, none).cache()
    assert {r.source for r in hits.collect()} == set(kinds)
    related = {r.key: r.related for r in corpus.terms.collect()}
    assert related["tokens"] == [] or isinstance(related["tokens"], list)
    text = plan.prompt(corpus, hits, 100).first().document
    assert text.index("# Instructions") < text.index("# System") < text.index("# Reasoning")


def test_tables_and_logs(spark, tmp_path):
    chunks = spark.createDataFrame([("obj:1", "object", "a"), ("spec:2", "spec", "b")], "id string, type string, content string")
    files.write_table(chunks, str(tmp_path / "c"), "type")
    files.replace_partitions(chunks.where("type = 'spec'").withColumn("content", F.lit("c")), str(tmp_path / "c"), "type")
    back = files.read_table(spark, str(tmp_path / "c"))
    assert {r.id: r.content for r in back.collect()} == {"obj:1": "a", "spec:2": "c"}
    assert files.chunk_content(back, "spec:2").first().content == "c"
    log = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3")], "ts bigint, query_hash string")
    files.append_log(log, str(tmp_path / "l"))
    (tmp_path / "l" / "bad.json").write_text("{nope\n")
    assert [r.ts for r in files.read_log(spark, str(tmp_path / "l"), n=2).collect()] == [3, 2]
    rendered = chunking.render_file(chunks.selectExpr("*", "'s' as source", "'h' as heading", "1 as sequence", "1 as total", "3 as tokens", "true as oversized"))
    assert rendered.select(files.strip_comment(F.col("file")).alias("t")).first().t == "a\n" and "oversized: true" in rendered.first().file
    (tmp_path / "p.json").write_text(json.dumps({"name": "x", "steps": [{"id": 1, "status": "completed"}]}))
    assert files.find_plan(files.load_plans(spark, str(tmp_path / "p.json")), "x").first().steps[0].id == 1
    shown = spark.createDataFrame([("ab1", 1, "old"), ("ab2", 2, "new")], "hash string, ts bigint, content string")
    assert files.show_document(shown, "ab").first().content == "new" and files.show_document(shown, "zz").isEmpty()


def test_streamed_usage_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    rows = events.select("ts", F.concat(F.lit("u"), (F.col("user_id") % 5).cast("string")).alias("caller"), F.floor("value").cast("bigint").alias("tokens"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = streams.windowed_usage(stream, "1 day", "400 days").writeStream.outputMode("complete").format("memory").queryName("usage").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("usage").collect())) == sorted(map(tuple, streams.windowed_usage(rows, "1 day").collect()))
    hashes = spark.createDataFrame([("a", "1", 1), ("a", "2", 2), ("b", "1", 1)], "path string, hash string, ts bigint")
    run = streams.merge_hashes(str(tmp_path / "h"))
    run(hashes, 0)
    run(spark.createDataFrame([("b", "9", 5)], hashes.schema), 1)
    assert {r.path: r.hash for r in spark.read.parquet(str(tmp_path / "h" / "1")).collect()} == {"a": "2", "b": "9"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    return [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.mark.parametrize("name", ["T1_tokenize", "T9_last_sentence", "P9_strip", "W2_balance_tail", "A5_deduplicate", "R1_bm25_topk", "R8_graph_rerank", "R6_expand_weighted", "J19_drift", "R11_key_phrases", "A17_usage_by_caller", "G2_resolve_version"])
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    found = duck.sql(entry.oracle_sql()[name])
    at = [found.columns.index(c) for c in df.columns]
    want = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert sorted(repr([plain(x) for x in r]) for r in df.collect()) == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_find_plan_single_or_named(spark):
    plans = spark.createDataFrame([("x", 1), ("y", 2)], "name string, n int")
    assert [tuple(r) for r in files.find_plan(plans, "y").collect()] == [("y", 2)]
    assert files.find_plan(plans.where("n = 1")).first().name == "x"
    for rows, name in ((plans, None), (plans, "z"), (plans.where("n = 3"), None), (plans.where("n = 3"), "x")):
        with pytest.raises(LookupError):
            files.find_plan(rows, name)
