"""Fill-in-the-middle against a plain version, and its exact round trip."""

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle as fim
from corpusloom.llm import queries

ODD = [
    None, "", "\n", "\n\n", "one line", "a\nb\nc", "a\nb\nc\n", "\x01\n\x02e\x02d\n\x01\x02", "\x02", "has <P> in\nit", "<S\n>", "x<M>", "<", "é\U0001f600\n\n中\n", "\r\n \n\x85",
    "long line " * 30_000, "short\n" * 60_000, "$1\n\\1\n", "\x00\n\x00",
]


def brute(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    d = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    a, b, _, k = (int(d[i : i + 8], 16) for i in range(0, 32, 8))
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    form = "spm" if k % 100 < 50 else "psm"
    return n, form, p, m, s, f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def check(spark, rows):
    df = spark.createDataFrame([(i, t, "kept", "mine", 5) for i, t in rows], "doc_id long, text string, form string, fim_n string, n int")
    made = fim.transform(df).select("*", fim.restore(F.col("output"), F.col("form")).alias("back")).collect()
    assert [r.fim_n for r in made] == ["mine"] * len(rows)
    assert [(r.n, r.form, r.prefix, r.middle, r.suffix, r.output) for r in made] == [brute(i, t) for i, t in rows]
    assert [r.back for r in made] == [t or "" for _, t in rows]


def test_odd_rows(spark):
    rows = [(i, t) for t in ODD for i in (None, 0, 1, -5, 12, 999, 1000, 1001, 1002)]
    check(spark, rows + rows[:5])
    check(spark, [])


pieces = st.lists(st.sampled_from(["\n", "\x01", "\x02", "\x02e", "d", "<P", ">", "<S>", "word ", "é", "\U0001f600", "\r", "\x00"]), max_size=14).map("".join)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(-10, 10**9), pieces), min_size=1, max_size=60))
def test_random(spark, rows):
    check(spark, rows)


def test_rates(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    got = {r.form: r["count"] for r in fim.transform(df, rate=70, spm_rate=25).groupBy("form").count().collect()}
    assert 540 < got["plain"] < 660 and 300 < got["spm"] < 400 and 1000 < got["psm"] < 1100


def test_query_is_native_and_moves_nothing(spark):
    plan = queries.op12_fill_in_middle(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
