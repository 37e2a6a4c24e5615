"""Archives whose headers or lengths could cut the chain of records."""

from collections import Counter

import pytest

from corpusloom.llm import warc


def test_addresses_with_a_magic(spark):
    urls = ["http://a", "http://b/WARC/1.0", "WARC/1.", "http://c?WARC/1.0\r\n\r\nWARC/1.1", "http://d", None]
    rows = [(i, u, f"page {i}") for i, u in enumerate(urls)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = Counter((r.page_id, r.payload_bytes, r.record_type) for r in warc.round_trip(df).collect())
    assert got == Counter((i, len(h), "response") for i, _, h in rows)


def test_a_chain_that_stops_is_an_error(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i}") for i in range(4)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "good"))
    assert warc.read_archives(spark, str(tmp_path / "good")).count() == 4
    (part,) = (tmp_path / "good").glob("part-*")
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / part.name).write_bytes(part.read_bytes().replace(b"page 1", b"page one"))
    with pytest.raises(Exception, match="stops before the file's end"):
        warc.read_archives(spark, str(tmp_path / "bad")).count()


def test_a_file_must_begin_with_a_record(spark, tmp_path):
    (tmp_path / "x.warc").write_bytes(b"junk WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n")
    with pytest.raises(Exception, match="stops before the file's end"):
        warc.read_archives(spark, str(tmp_path)).count()


def test_revisits_of_other_writers_get_their_length_from_the_response(spark, tmp_path):
    rows = [(i, "u", "same payload" if i % 2 else f"page {i}") for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    want = sorted(map(tuple, warc.round_trip(df).collect()))
    warc.write_archives(df, str(tmp_path / "a"))
    (part,) = (tmp_path / "a").glob("part-*")
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "x.warc").write_bytes(part.read_bytes().replace(b"WARC-Payload-Length: 12\r\n", b""))
    assert sorted(map(tuple, warc.read_archives(spark, str(tmp_path / "b")).collect())) == want and len(want) == 8
