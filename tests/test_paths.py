"""Links and lists of ids with stated results."""

from pyspark.sql import functions as F

from corpusloom.functions import paths

LINKS = [
    ("docs/a/b.md", "../c.md", "docs/c.md", "docs/c.md"), ("docs/a/b.md", "./x/./y.md#part", "docs/a/x/y.md", "docs/a/x/y.md"),
    ("b.md", "../../z.md", "z.md", "../../z.md"), ("a/b.md", "#only", "", ""), ("a/b.md", "https://h/x.md", "", ""), ("a/b.md", "c//d.md", "a/c/d.md", "a/c/d.md"),
    ("a/b.md", "../../../q.md", "q.md", "../../q.md"),
]


def test_links(spark):
    df = spark.createDataFrame([x[:2] for x in LINKS], "s string, t string")
    s, t = F.col("s"), F.col("t")
    assert [tuple(r) for r in df.select(s, t, paths.resolve_link(s, t), paths.resolve_link(s, t, True)).collect()] == LINKS


def test_ids(spark):
    df = spark.createDataFrame([(" a, b c,,d ,",), (" , ",), ("",), (None,)], "raw string")
    assert [r[0] for r in df.select(paths.parse_ids(F.col("raw"))).collect()] == [["a", "b c", "d"], [], [], None]
