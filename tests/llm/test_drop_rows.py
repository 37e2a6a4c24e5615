"""Which row of a component of near-duplicates stays, if ids are null or repeat."""

from collections import Counter

from corpusloom.llm import simhash


def test_rows_of_null_and_repeated_ids_stay(spark):
    a, b, c, d = ("".join(f"{w}{i} " for i in range(40)) for w in "abcd")
    rows = [(None, a), (None, b), (None, b), (1, c), (None, c), (2, d), (2, "other " + a[::-1]), (2, d), (3, d)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = Counter(map(tuple, simhash.drop_near_duplicates(df).collect()))
    assert kept == Counter([(None, a), (None, b), (1, c), (2, d), (2, "other " + a[::-1])])
