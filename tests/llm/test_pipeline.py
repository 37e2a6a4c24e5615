"""The pipeline's stages against what the operators decide, row by row."""

import corpus_pipeline
from corpusloom.llm import language_id, pii, quality_crf, queries
from corpusloom.llm.common import crc_mod, table

from .test_operators import check_packing
from .test_overlap import brute_kept

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    model = language_id.fit_on(docs.where(crc_mod("doc_id", 5) != 0))
    rows = docs.collect()
    langs = language_id.classify(model, [r.text for r in rows])[0]
    rows = [(r.doc_id, r.text, k) for r, k in zip(rows, langs) if k != "und"]
    kept_df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = quality_crf.fit_on(kept_df, table(spark, SF, "labels"))
    rows = [r for r in rows if quality_crf.verdict(r[1], field)[3]]
    kept = brute_kept([r[:2] for r in rows])
    rows = [r for r in rows if r[0] in kept]
    texts = {i: pii.redact(t, pii.find_pii(t)) for i, t, _ in rows}
    got = corpus_pipeline.run(spark, SF).collect()
    check_packing(got, texts)


def test_stage_columns_and_odd_rows(spark):
    rows = [(1, None, None, None, None), (None, "some words " * 40, "en", "s", 3), (2, "", "en", "s", 0), (3, "mail a@b.cd " * 30, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for empty in (False, True):
        df = docs.limit(0) if empty else docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, df, SF)
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, df, SF).collect()


def test_repeated_rows_and_very_long_texts(spark):
    """A text of a megabyte is handled whole by each stage, and rows that repeat are handled alike."""
    words = " ".join(f"word{i % 977} of{i % 13}" for i in range(20_000))
    rows = [(1, words), (2, "mail a@b.cd and more prose. " * 30), (2, "mail a@b.cd and more prose. " * 30), (3, "12 34 5"), (4, "the of and\n" * 30_000)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    langs = [r.doc_id for r in corpus_pipeline.identify_language(spark, docs, SF).collect()]
    assert sorted(langs) == [1, 2, 2, 4]
    field = quality_crf.fit_on(docs, table(spark, SF, "labels"))
    want = sorted(i for i, t in rows if quality_crf.verdict(t, field)[3])
    assert sorted(r.doc_id for r in corpus_pipeline.keep_quality(spark, docs, SF).collect()) == want
    assert sorted(r.doc_id for r in corpus_pipeline.drop_copies(spark, docs, SF).collect()) == [1, 2, 3, 4]
    redacted = {(r.doc_id, r.text, r.n_chars) for r in corpus_pipeline.redact_personal_data(spark, docs, SF).collect()}
    assert redacted == {(i, p := pii.redact(t, pii.find_pii(t)), len(p)) for i, t in rows}
    packed = corpus_pipeline.pack_sequences(spark, docs.where("doc_id <> 2"), SF).collect()
    check_packing(packed, {i: t for i, t in rows if i != 2})
    twice = corpus_pipeline.pack_sequences(spark, docs.where("doc_id = 2"), SF).collect()
    assert len(twice) == 2 and len({(r.sequence_id, r.offset) for r in twice}) == 2


def test_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality", "simhash", "pii", "packing"]
