"""The stored corpus after updates against one built anew, and what an update leaves alone."""

import os

import pytest

from corpusloom.plans import incremental as inc

SCHEMA = "path string, content string"


def text(i, more=""):
    return f"# Title {i}\n\nSome words{i % 7} of file{i} about topic{i % 5}. {more}\n\n## Part\n\n" + f"Sentence number{i % 11} here. " * (3 + i % 4)


def files(spark, rows):
    return spark.createDataFrame(sorted(rows.items()), SCHEMA)


def tables(spark, store):
    return {t: sorted(map(tuple, inc.load(spark, store, t).collect())) for t in inc.TABLES}


def stamps(store, table):
    return {
        os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(f"{store}/{table}") for f in names if f.startswith("part-")
    }


@pytest.fixture(scope="module")
def first(spark, tmp_path_factory):
    rows = {f"{'system/' if i % 9 == 0 else ''}topics/f{i}{'.spec' if i % 5 == 0 else ''}.md": text(i) for i in range(60)}
    store = str(tmp_path_factory.mktemp("store"))
    assert inc.update(files(spark, rows), store) == {"new": 60, "modified": 0, "deleted": 0, "unchanged": 0}
    return rows, store


def test_an_update_gives_what_a_build_gives(spark, first, tmp_path, monkeypatch):
    rows, store = dict(first[0]), first[1]
    before = {t: stamps(store, t) for t in ("chunks", "postings", "lengths")}
    names = sorted(rows)
    del rows[names[3]]
    rows[names[7]] = text(7, "Changed with uncommonword.")
    rows["topics/fresh.md"] = text(99, "Entirely new.")
    moved = {names[3], names[7], "topics/fresh.md"}
    real, calls = inc._move_in, []

    def breaks(spark_, store_, staged, table, parts):
        calls.append(table)
        if len(calls) == 3:
            raise RuntimeError("lost")
        real(spark_, store_, staged, table, parts)

    monkeypatch.setattr(inc, "_move_in", breaks)
    with pytest.raises(RuntimeError):
        inc.update(files(spark, rows), store)
    monkeypatch.setattr(inc, "_move_in", real)
    # the next call finishes what was begun, and finds nothing else to do
    assert inc.update(files(spark, rows), store) == {"new": 0, "modified": 0, "deleted": 0, "unchanged": 60}
    anew = str(tmp_path / "anew")
    inc.update(files(spark, rows), anew)
    assert tables(spark, store) == tables(spark, anew)
    assert set(os.listdir(store)) == set(inc.TABLES)

    touched = {r[0] for r in spark.createDataFrame([(m,) for m in moved], "path string").select(inc.part_of(inc.F.col("path"))).collect()}
    for t, old in before.items():
        new = stamps(store, t)
        same = {f for f in old if int(f.split("part=")[1].split("/")[0]) not in touched}
        assert same and all(new.get(f) == old[f] for f in same)
        assert {int(f.split("part=")[1].split("/")[0]) for f in set(new) - set(old)} <= touched


def test_emptied_repeated_and_null(spark, tmp_path):
    store = str(tmp_path / "s")
    two = spark.createDataFrame([("a.md", "# A\n\nwords here"), ("b.md", None)], SCHEMA)
    assert inc.update(two, store)["new"] == 2
    assert inc.update(two, store) == {"new": 0, "modified": 0, "deleted": 0, "unchanged": 2}
    with pytest.raises(ValueError):
        inc.update(two.union(two), store)
    assert inc.update(two.limit(0), store)["deleted"] == 2
    assert all(not rows for rows in tables(spark, store).values())
    assert not inc.recover(spark, store)
