"""Near copies of five-word similarity 0.8, against all pairs by brute force."""

import random
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import overlap
from corpusloom.llm.common import materialize, may_hold, scratch, table


def brute_kept(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in range(i):
            if 10 * len(s & sets[j]) >= 8 * len(s | sets[j]):
                root[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (x, _) in enumerate(rows):
        groups[find(i)].append(x)
    return Counter(min((x for x in g if x is not None), default=None) for g in groups.values())


@pytest.mark.parametrize("block", [512, 6])
def test_kept_rows_equal_brute_force(spark, block):
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    rows = [(None, None), (0, ""), (1, "a"), (2, "A "), (3, "a b"), (None, "unlike any other text of them all")]
    for i in range(40):  # near copies of one text, some of which only a third one links
        w = list(base)
        for at in rng.sample(range(300), rng.randrange(12)):
            w[at] = "new" + str(rng.random())
        rows.append((10 + i, " ".join(w)))
    rows += [(100 + i, " ".join(f"w{rng.randrange(3000)}" for _ in range(60))) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = overlap.drop_near_copies(df, block=block).collect()
    assert Counter(r.doc_id for r in kept) == brute_kept(rows)
    assert overlap.drop_near_copies(df.limit(0)).count() == 0


def test_stage_drops_near_copies(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, "").collect())
    assert got == brute_kept(rows)
    assert 145 not in got and 177 not in got  # of similarity 0.83 to earlier ones, by more than three bits of a fingerprint


def naive_fingerprint(hashes):
    """The majorities of 960 hash bits, shingle by shingle."""
    top, counts = 2**64, [0] * 960
    for h in hashes:
        for lane in range(15):
            z = (h + (lane + 1) * 0x9E3779B97F4A7C15) % top
            z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 % top
            z = (z ^ z >> 27) * 0x94D049BB133111EB % top
            z ^= z >> 31
            for i in range(64):
                counts[64 * lane + i] += z >> i & 1
    return [2 * c > len(hashes) for c in counts]


def bits_of(lanes):
    return np.unpackbits(lanes.view(np.uint8), bitorder="little").astype(bool)


def test_fingerprint_is_the_majority_of_the_shingles():
    rng = np.random.default_rng(1)
    for n in (1, 4, 255, 300):
        hashes = rng.integers(0, 2**64, n, np.uint64)
        assert bits_of(overlap.fingerprint(hashes)).tolist() == naive_fingerprint(hashes.tolist())


def test_fingerprints_of_similarity_08_meet():
    """A segment differs by at most a bit, and those that are verified by at most RADIUS, in each pair of just that similarity."""
    rng = np.random.default_rng(2)
    for n in [65, 72, 90, 300, 900] * 40:
        new = n // 9
        hashes = rng.integers(0, 2**64, n + new, np.uint64)
        a, b = overlap.fingerprint(hashes[:n]), overlap.fingerprint(hashes[new:])
        segments = (bits_of(a) ^ bits_of(b))[:936].reshape(52, 18).sum(1)
        assert segments.min() <= 1 and overlap.near(a[:3], b[:3])


def components_of(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in pairs:
        root[find(i)] = find(j)
    return [min(j for j in range(n) if find(j) == find(i)) for i in range(n)]


@pytest.mark.parametrize("run", [32, 2])
def test_deletion_variants_equal_all_pairs(run, monkeypatch):
    monkeypatch.setattr(overlap, "RUN", run)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2, (6, 960)).astype(bool)
    bits = np.array([b ^ (rng.random(960) < rng.choice([0.02, 0.15, 0.3])) for b in base for _ in range(20)])
    lanes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    n = len(bits)
    code, fp = overlap.codes_of(lanes).ravel(), np.repeat(np.arange(n), 104)
    order = np.argsort(code, kind="stable")
    got = overlap.meet(code[order], fp[order], np.repeat(lanes[:, :3], 104, axis=0)[order])
    want = [
        (i, j) for i in range(n) for j in range(i)
        if (bits[i] ^ bits[j])[:936].reshape(52, 18).sum(1).min() <= 1 and (bits[i] ^ bits[j])[:192].sum() <= 55
    ]
    assert {tuple(sorted(w)) for w in want} >= set(map(tuple, got.tolist()))
    assert components_of(n, got.tolist()) == components_of(n, want)
    assert 6 < len(set(components_of(n, want))) < n


def test_short_texts_equal_brute_force(spark):
    """Sets about the size up to which prefixes serve, and partners on its other side."""
    rng = random.Random(6)
    rows = []
    for size in (5, 9, 30, 60, 64, 66, 68, 70, 80, 84):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        for k in range(0, 1 + size // 4, 2):
            rows += [(len(rows), " ".join(base + [f"n{rng.random()}" for _ in range(k)])), (len(rows) + 1, " ".join(base[k // 2 :]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert Counter(r.doc_id for r in overlap.drop_near_copies(df).collect()) == brute_kept(rows)


def test_lower_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        overlap.drop_near_copies(spark.createDataFrame([(1, "a")], "doc_id long, text string"), similarity=0.7)


def test_near_copies_make_few_edges(spark):
    """Groups of a signature that is compared pair by pair give as many edges as fingerprints, not as many as pairs."""
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2, 960).astype(bool)
    lanes = [np.packbits(base ^ (rng.random(960) < 0.004), bitorder="little").tobytes() for _ in range(30)]
    groups = spark.createDataFrame([(i, bytearray(x), []) for i, x in enumerate(lanes)], "fp long, lanes binary, least array<bigint>")
    edges = overlap.candidates(groups.coalesce(1)).collect()
    assert components_of(30, [(r.a, r.b) for r in edges]) == [0] * 30
    assert len(edges) <= 4 * 30


def test_stars_join_what_the_pairs_join():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 150, 400):
        pairs = rng.integers(0, 200, (n, 2))
        got = overlap.stars(pairs).tolist()
        assert components_of(200, got) == components_of(200, pairs.tolist())
        assert all(components_of(200, got)[b] == a < b for a, b in got)


def test_texts_that_stay_are_not_shuffled(spark):
    """Bytes of shuffles against those of texts, where no table is small enough to broadcast."""
    rng = random.Random(7)
    rows = [(i, "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=40_000))) for i in range(100)]
    rows += [(100, rows[3][1]), (3, rows[3][1]), (None, rows[4][1]), (101, rows[5][1] + " more"), (None, "alone of no id")]
    before, key = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        with scratch():
            df = materialize(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "texts")
            first = written(spark)
            kept = overlap.drop_near_copies(df).collect()
            moved = written(spark) - first
    finally:
        spark.conf.set(key, before)
    assert Counter(r.doc_id for r in kept) == brute_kept(rows)
    assert moved < 0.5 * sum(len(t) for _, t in rows)


def written(spark):
    """Bytes that the session's shuffles have written."""
    bus, store = spark.sparkContext._jsc.sc().listenerBus(), spark.sparkContext._jsc.sc().statusStore()
    bus.waitUntilEmpty(30_000)
    return sum(store.executorList(True).apply(i).totalShuffleWrite() for i in range(store.executorList(True).size()))


def test_bitmap_holds_every_key(spark):
    keys = spark.range(20_000).select(F.xxhash64("id").alias("key"))
    others = spark.range(20_000, 60_000).select(F.xxhash64("id").alias("key"))
    assert keys.where(may_hold(keys, F.col("key"))).count() == 20_000
    assert others.where(may_hold(keys, F.col("key"))).count() < 40_000 / 8
    assert others.where(may_hold(keys.limit(0), F.col("key"))).count() == 0


def peak_mb(run):
    tracemalloc.start()
    try:
        return run(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_meet_holds_no_more_than_a_few_pairs_a_row():
    """Runs that are compared pair by pair, in all of their signatures."""
    rng = np.random.default_rng(6)
    bits = np.repeat(rng.integers(0, 2, (300, 960)).astype(bool), 30, axis=0) ^ (rng.random((9000, 960)) < 0.002)
    lanes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    code, fp = overlap.codes_of(lanes).ravel(), np.repeat(np.arange(9000), 104)
    order = np.argsort(code, kind="stable")[:20_000]
    got, peak = peak_mb(lambda: overlap.meet(code[order], fp[order], np.repeat(lanes[:, :3], 104, axis=0)[order]))
    assert peak < 60  # 128 with all pairs
    assert len(got) <= 4 * 20_000
    assert (got // 30)[:, 0].tolist() == (got // 30)[:, 1].tolist()
    assert len(overlap.stars(got)) > 0.5 * len(np.unique(fp[order]))


def test_long_sets_are_compared_by_parts(monkeypatch):
    rng = np.random.default_rng(7)
    base, sets = rng.integers(0, 2**64, 10_000, np.uint64), []
    for i in range(300):
        s = base.copy()
        at = rng.choice(10_000, 900 + i, replace=False)  # about 0.8, some more and some less
        s[at] = rng.integers(0, 2**64, len(at), np.uint64)
        sets.append(np.unique(s))
    got, peak = peak_mb(lambda: overlap.forest(np.arange(300), sets, 0.8))
    assert peak < 45  # 75 with all at once
    monkeypatch.setattr(overlap, "FLAT", 1 << 40)
    assert overlap.forest(np.arange(300), sets, 0.8) == got


def test_edges_are_written_once(spark, monkeypatch):
    """By the rounds of components; each file that an executor writes has its cost."""
    names = []
    monkeypatch.setattr(overlap, "materialize", lambda df, name: names.append(name) or materialize(df, name))
    text = "a b c d e f g h i j k l m n o p q r s t"
    kept = overlap.drop_near_copies(spark.createDataFrame([(1, text), (2, text + " u"), (3, "v")], "doc_id long, text string"))
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert names == ["sketches", "groups", "met", "wanted"]


@pytest.mark.parametrize("n", [2000, 8000])
def test_a_common_passage_makes_no_rows(spark, n):
    """Unlike short texts that share five words, and some that share a sentence: few hashes meet, whatever the number of texts."""
    rng = random.Random(8)
    rows = [(i, "one passage that all share " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(50))) for i in range(n)]
    rows += [(n + i, rows[i][1].replace("one", "1")) for i in range(10)]
    with scratch():
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        groups = materialize(overlap.sketches(df, "doc_id", "text", 5, 0.8), "groups")
        keys = overlap.prefixes(groups, 0.8)
        assert keys.select("fp").distinct().count() == 20 and keys.count() <= 20 * 13
        if n == 2000:
            assert sorted(r.doc_id for r in overlap.drop_near_copies(df).collect()) == list(range(n))


def test_short_links_equal_all_pairs(spark):
    """Texts made of few passages, so that whole prefixes are frequent, in blocks of 4 and at once."""
    rng = random.Random(9)
    parts = [[f"p{k}w{i}" for i in range(rng.randrange(6, 30))] for k in range(8)]
    rows = [(i, " ".join(sum(rng.sample(parts, rng.randrange(1, 4)), [])[: rng.randrange(20, 80)])) for i in range(150)]
    with scratch():
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        groups = materialize(overlap.sketches(df, "doc_id", "text", 5, 0.8).dropDuplicates(["fp"]), "groups")
        sets = {r.fp: set(r.least) for r in groups.collect() if r.least}
        fps = sorted(sets)
        want = [(i, j) for i, a in enumerate(fps) for j, b in enumerate(fps[:i]) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
        for block in (512, 4):
            got = [(fps.index(r.a), fps.index(r.b)) for r in overlap.short_links(groups, 0.8, block).collect()]
            assert set(got) <= {(min(p), max(p)) for p in want}
            assert components_of(len(fps), got) == components_of(len(fps), want)
        assert len(want) > 20


def test_dense_components_become_stars():
    rng = np.random.default_rng(8)
    dense = np.array([(i, j) for i in range(30) for j in range(i + 1, 30)])
    sparse = np.array([(100 + i, 101 + i) for i in range(20)])
    pairs, bound = overlap.thin(np.concatenate([dense, sparse]), np.r_[np.zeros(len(dense), bool), np.arange(20) == 3])
    assert sorted(map(tuple, pairs[pairs[:, 0] >= 100].tolist())) == sorted(map(tuple, sparse.tolist()))
    assert bound.sum() == 29 + 1 and components_of(30, pairs[pairs[:, 0] < 30].tolist()) == [0] * 30
    assert [len(x) for x in overlap.thin(np.zeros((0, 2), np.int64), np.zeros(0, bool))] == [0, 0]
    for n in [65, 90, 300] * 40:  # whole fingerprints of pairs of similarity 0.8
        hashes = rng.integers(0, 2**64, n + n // 9, np.uint64)
        a, b = overlap.fingerprint(hashes[:n]), overlap.fingerprint(hashes[n // 9 :])
        assert np.bitwise_count(a ^ b).sum() <= overlap.WHOLE


def test_columns_of_any_name_stay(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, 10), (2, "a b c d e f", 1, 2, 3, 4), (3, "z", 4, 5, 6, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _h long, _goes int, _id long, _kept long")
    assert sorted(map(tuple, overlap.drop_near_copies(df).collect())) == [rows[0], rows[2]]
