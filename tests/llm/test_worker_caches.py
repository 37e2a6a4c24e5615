"""A stage's tasks let go of what an earlier stage's tasks keep in the same workers."""

from pyspark.sql import functions as F

from corpusloom.llm import language_id, packing
from corpusloom.llm.queries import WORD_BPE


def test_forget_leaves_nothing_and_is_read_again():
    first = packing.word_tokenizer(WORD_BPE)
    ids = first.encode_bytes("Some plain words, twice.")
    packing.forget()
    assert not packing._loaded
    again = packing.word_tokenizer(WORD_BPE)
    assert again is not first and again.encode_bytes("Some plain words, twice.") == ids


def test_languages_are_the_same_whatever_is_let_go(spark):
    model = language_id.fit({"en": ["the cat sat on the mat and the dog ran"], "de": ["die katze sitzt auf der matte und der hund rennt"]})
    docs = spark.createDataFrame([(1, "the dog and the cat", "xx"), (2, "der hund und die katze", None), (3, None, "en"), (4, "123", "de")], "doc_id bigint, text string, lang string")

    def loud():
        raise RuntimeError("called")

    plain = [tuple(r) for r in language_id.set_language(docs, model).orderBy("doc_id").collect()]
    assert [tuple(r) for r in language_id.set_language(docs, model, before=packing.forget).orderBy("doc_id").collect()] == plain
    assert [(r[0], r[2]) for r in plain] == [(1, "en"), (2, "de")]
    try:
        language_id.set_language(docs.where(F.col("doc_id") == 1), model, before=loud).collect()
    except Exception as e:
        assert "called" in str(e)
    else:
        raise AssertionError("before isn't called in the tasks")
