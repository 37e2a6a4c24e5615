"""NN-descent and greedy search against brute force: recall, exact scores, ties, copies and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import nn_descent, queries
from corpusloom.llm.common import table

NAN, INF = float("nan"), float("inf")


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], f"vec_id long, embedding array<{kind}>, node int, q string, score int")


def brute(rows, asked, n=20):
    """For each asked id, (id, score) of the n of largest inner product, ties to the lesser id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in asked:
        s = (x * x[ids == q][0]).sum(1)
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:n]
        out[q] = [(int(ids[k]), float(s[k])) for k in order]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return np.mean([len({i for i, _ in got[q]} & {i for i, _ in w}) / len(w) for q, w in want.items()])


def test_query_on_a_given_table(spark):
    sf = "/root/testdata/sf0.001"
    out = queries.op13_nn_descent(spark, sf)
    assert dict(out.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    rows = [(r.vec_id, r.embedding) for r in table(spark, sf, "embeddings").collect()]
    want = brute(rows, [i for i, _ in rows if i % 20 == 0])
    got = found(out)
    assert got.keys() == want.keys() and all(len(w) == 20 for w in got.values())
    score = {q: dict(brute(rows, [q], len(rows))[q]) for q in want}
    assert all(abs(s - score[q][i]) < 1e-12 for q, hits in got.items() for i, s in hits)
    assert recall(got, want) >= 0.99


@pytest.mark.parametrize("shape", ["unlike", "groups and lengths"])
def test_recall_beyond_one_run(spark, shape):
    """Unlike vectors, the hardest; and groups of near copies whose lengths differ a hundredfold, so that few vectors are near to all."""
    rng = np.random.default_rng(3)
    n, d = (4000, 32) if shape == "unlike" else (3000, 16)
    x = rng.standard_normal((n, d))
    if shape != "unlike":
        x = x[rng.integers(0, 40, n)] + 0.05 * rng.standard_normal((n, d))
        x *= np.exp(rng.uniform(0, np.log(100), n))[:, None]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(x)]
    df = frame(spark, rows)
    got = found(nn_descent.search(nn_descent.build(df), df.where("vec_id % 20 = 0")))
    want = brute(rows, range(0, n, 20))
    assert recall(got, want) >= 0.95
    for hits in got.values():
        assert hits == sorted(hits, key=lambda h: (-h[1], h[0])) and len(hits) == 20


def test_copies_and_ties(spark):
    """A third of all rows are one vector; others come twice or tie. All of it is exact, as each beam holds all nodes."""
    rng = np.random.default_rng(5)
    some = rng.integers(-2, 3, (60, 4)).astype(float)
    some[~some.any(1)] = 1
    rows = [(i, some[0].tolist() if i % 3 == 0 else some[rng.integers(60)].tolist()) for i in range(300)]
    df = frame(spark, rows, "double")
    got = found(nn_descent.search(nn_descent.build(df), df.where("vec_id % 20 = 0")))
    assert got == brute(rows, range(0, 300, 20))


def test_queries_that_are_no_rows(spark):
    rng = np.random.default_rng(7)
    x, y = rng.standard_normal((800, 8)), rng.standard_normal((30, 8))
    index = nn_descent.build(frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "double"), ids=6)
    asked = [(i + 5000, v.tolist()) for i, v in enumerate(y)]
    got = found(nn_descent.search(index, frame(spark, [*asked, (9000, asked[0][1])], "double"), n=5))
    for i, v in enumerate(y):
        s = x @ v
        assert len(set(np.argsort(-s)[:5]) & {j for j, _ in got[i + 5000]}) >= 4
    assert got[9000] == got[5000]
    with pytest.raises(ValueError):
        nn_descent.search(index, frame(spark, asked, "double"), n=6)


def test_odd_rows(spark):
    odd = [(None, [1.0, 2.0]), (20, None), (40, []), (60, [0.0, 0.0]), (80, [NAN, 1.0]), (100, [INF, 1.0]), (120, [None, 1.0]), (140, [1.0, 2.0, 3.0])]
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [-1.0, 0.0]), (160, [0.0, 1.0])]
    df = frame(spark, odd + rows + [(0, [1.0, 0.0]), (0, [5.0, 0.0])])
    got = found(nn_descent.search(nn_descent.build(df), df.where("vec_id % 20 = 0")))
    assert got == brute(rows, [0, 160])
    for few in ([], [(0, [1.0, 0.0])], odd):
        df = frame(spark, few)
        assert nn_descent.search(nn_descent.build(df), df.where("vec_id % 20 = 0")).collect() == []


def test_hot_blocks_are_dealt_to_copies(spark, monkeypatch):
    rows = [(i, [float(i % 7 + 1), float(i % 11 - 5), 1.0]) for i in range(200)]
    df = frame(spark, rows)
    monkeypatch.setattr(nn_descent, "ASKED", 2)
    got = found(nn_descent.search(nn_descent.build(df), df.where("vec_id % 20 = 0")))
    assert got == brute(rows, range(0, 200, 20))


def test_a_hub_is_sampled_before_it_meets(spark):
    graph = spark.range(1, 2001).select(
        F.col("id").alias("node"), F.array(F.lit(0).cast("bigint")).alias("near"), F.array(F.lit(1.0)).alias("score"), F.array(F.lit(True)).alias("fresh")
    )
    coded = spark.range(0, 2001).select(F.col("id").alias("node"), F.unhex(F.lit("003C003C")).alias("half"), F.lit(1.0).alias("scale"))
    after, new = nn_descent.descend(nn_descent.materialize(graph, "graph"), coded, 40, 16, 0)
    assert after.where(F.size("near") > 40).isEmpty() and new < 16 * 17 * 2
