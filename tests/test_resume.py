"""Plans that are resumed: without a step, unchanged, changed, missing, without dependencies or chunks, several lists of chunks."""

import pytest

from corpusloom.plans.resume import resume
from corpusloom.sources import files

CHUNKS = "id string, source string, sequence int, type string, content string, bridge string"


@pytest.fixture
def world(spark):
    hashes = spark.createDataFrame([("docs/auth.md", "h1"), ("docs/base/README.md", "h2")], "path string, hash string")
    chunks = spark.createDataFrame(
        [("obj:a.1", "docs/auth.md", 1, "object", "one", None), ("obj:a.2", "docs/auth.md", 2, "object", "two", None), ("spec:b.1", "docs/b.spec.md", 1, "spec", "why", None),
         ("obj:a.1", "docs/copy.md", 1, "object", "copy", None)],
        CHUNKS,
    )
    return hashes, chunks


def plans(spark, *rows):
    full = [(name, "in_progress", current, deps, [(i, "t", "pending", q, c, []) for i, q, c in steps]) for name, current, deps, steps in rows]
    return spark.createDataFrame(full, files.PLAN)


def test_all_states_in_one_job(spark, world):
    same, step = [("docs/auth", "h1"), ("docs/base", "h2")], [(1, ["ask"], ["obj:a.1, obj:a.2", " , ", "spec:b.1,obj:a.2,obj:a.2,obj:x.1"])]
    p = plans(
        spark, ("none", 0, same, step), ("beyond", 5, same, step), ("same", 1, same, step), ("drift", 1, [("docs/auth", "old"), ("docs/base", "h2"), ("docs/nothing", "h")], step),
        ("other", 1, [("docs/auth", "h1")], [(1, [], [])]), ("free", 1, [], [(1, [], ["obj:x.1"])]), ("null", 1, None, [(1, None, None)]),
    )
    got = {r["name"]: r for r in resume(p, *world).collect()}
    assert len(got) == 7
    assert [(got[n].state, got[n].changed, got[n].replays) for n in ("none", "beyond")] == [("status", None, None)] * 2
    r = got["same"]
    assert (r.state, r.changed, r.missing, r.drifted, r.queries) == ("replay", 0, 0, None, None)
    assert [(x.call, x.document, x.chunks, x.absent) for x in r.replays] == [
        (0, "\n# Instructions\n\none\ntwo", 2, []), (2, "\n# Instructions\n\ntwo\n# Reasoning\n\nwhy", 2, ["obj:x.1"])
    ]
    r = got["drift"]
    assert (r.state, r.changed, r.missing, r.queries, r.replays) == ("drift", 1, 1, ["ask"], None)
    assert [(d.path, d.expected, d.hash) for d in r.drifted] == [("docs/auth", "old", "h1"), ("docs/nothing", "h", None)]
    assert (got["other"].state, got["other"].replays) == ("replay", None)
    assert [(x.document, x.absent) for x in got["free"].replays] == [(None, ["obj:x.1"])]
    assert (got["null"].state, got["null"].replays) == ("replay", None)


def test_no_plans_hashes_or_chunks(spark, world):
    hashes, chunks = world
    p = plans(spark, ("same", 1, [("docs/auth", "h1")], [(1, ["ask"], ["obj:a.1"])]))
    assert resume(p.limit(0), hashes, chunks).count() == 0
    assert resume(p, hashes.limit(0), chunks).first().state == "drift"
    assert resume(p, hashes, chunks.limit(0)).first().replays[0].absent == ["obj:a.1"]
