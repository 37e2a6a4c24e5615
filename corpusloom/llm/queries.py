"""The registered queries of the operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, fill_in_middle, language_id, lz_fingerprint, maxent_lm, merkle, nn_descent, packing, pii, quality_crf, secret_scan, simhash, warc
from .common import crc_mod, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of(spans: Column, *kinds: str) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(*kinds))


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf_dir, "documents"))
    spans = F.col("spans")
    return found.select(
        "doc_id",
        *[F.size(_of(spans, k)).cast("bigint").alias(f"n_{k}") for k in secret_scan.STRONG],
        F.sha2(_joined(_of(spans, *secret_scan.STRONG)).cast("binary"), 256).alias("base_sha256"),
        _joined(spans).alias("spans"),
    )


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.bpe_encode(table(spark, sf_dir, "documents"), BYTE_BPE, decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), WORD_BPE)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_crf.quality(documents, quality_crf.fit_on(documents, table(spark, sf_dir, "labels")))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"), crc_mod("doc_id", 7) == 2)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_lz_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lz_fingerprint.edit_likeness(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", crc_mod("doc_id", 5) == 0)
    model = language_id.fit_on(documents.where(~F.col("held_out")))
    found = language_id.identify(documents, model)
    return found.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rate")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.scan_pii(table(spark, sf_dir, "documents")).drop("redacted")
    spans = F.col("spans")
    base = F.concat(*[_of(spans, k) for k in pii.KINDS[:4]])
    return found.select(
        "doc_id",
        *[F.size(_of(spans, k)).cast("bigint").alias(f"n_{k}") for k in pii.KINDS[:4]],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.concat(*[_of(spans, k) for k in pii.KINDS])).alias("spans"),
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    found = merkle.prove(table(spark, sf_dir, "documents"), ("doc_id", "source", "lang", "n_chars", "text"), "doc_id", "lang", {"text": tampered})
    return found.select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", merkle.digest(F.array_join(merkle.siblings(F.col("steps")), "")).alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("bigint").alias("prefix_chars"), F.length("middle").cast("bigint").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(fill_in_middle.restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


def op13_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = table(spark, sf_dir, "embeddings")
    return nn_descent.search(nn_descent.build(embeddings), embeddings.where(F.col("vec_id") % 20 == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_bpe, op3_packing, op4_quality, op5_simhash, op6_maxent_lm, op7_warc, op8_lz_fingerprint,
        op9_language_id, op10_pii, op11_merkle_manifest, op12_fill_in_middle,
        op13_nn_descent,
    )
}

#: Base32 in SQL: each ten hexadecimal digits of the SHA-1 are forty bits, eight digits of five bits.
_BASE32 = """array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
    1 + ((('0x' || substr(h, (1 + 10 * (k // 8))::INT, 10))::BIGINT >> (35 - 5 * (k % 8))::INT) & 31)::INT]), '')"""

#: CRC-32 by its bits, over the bytes of an ASCII text s.
_CRC32 = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(s) + 1), lambda k: ascii(substr(s, k::INT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"""
#: Levels that suffice for eight to this power rows.
_LEVELS = 9


def _merkle_sql() -> str:
    """The trees level by level: a group's single node is carried on as it is, several are hashed by eights; all levels of a path are joined row by row."""
    columns = ("doc_id", "source", "lang", "n_chars", "text")
    one = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(one(text if c == 'text' else c) for c in columns)})"
    low = f"translate(text, '{merkle.UPPER}', '{merkle.LOWER}')"
    sql = [
        f"""c AS (SELECT doc_id, lang, text, source, n_chars, doc_id::VARCHAR AS s FROM documents),
        d AS (SELECT doc_id, coalesce('=' || lang, '') AS g, {leaf('text')} AS leaf, CASE WHEN {_CRC32} % 3 = 0 THEN {leaf(low)} ELSE {leaf('text')} END AS entry FROM c),
        a0 AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM d), a_0 AS (SELECT g, i, leaf AS d FROM a0)"""
    ]
    tree = """{t}r_{l} AS (SELECT g, i // 8 AS i, list(d ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {t}_{l}) GROUP BY ALL),
        {t}_{m} AS (SELECT g, i, CASE WHEN n = 1 THEN run[1] ELSE sha256(array_to_string(run, '')) END AS d FROM {t}r_{l})"""
    sql += [tree.format(t="a", l=k, m=k + 1) for k in range(_LEVELS)]
    sql += [f"b0 AS (SELECT g AS of, d, row_number() OVER (ORDER BY g) - 1 AS i FROM a_{_LEVELS}), b_0 AS (SELECT '' AS g, i, d FROM b0)"]
    sql += [tree.format(t="b", l=k, m=k + 1) for k in range(_LEVELS)]
    sql += [f"""p_0 AS (SELECT a0.doc_id, a0.leaf, a0.g, a0.i AS i, b0.i AS j, b0.d AS subroot, b_{_LEVELS}.d AS root, entry AS got, '' AS others
        FROM a0 JOIN b0 ON b0.of = a0.g, b_{_LEVELS})"""]
    for at, (t, k) in enumerate([("a", k) for k in range(_LEVELS)] + [("b", k) for k in range(_LEVELS)]):
        place, g = ("i", "p.g") if t == "a" else ("j", "''")
        here = f"({place.replace(place, 'p.' + place)} // {8**k})"
        before, after = f"run[1:({here} % 8)::INT]", f"run[({here} % 8)::INT + 2:]"
        sql.append(f"""p_{at + 1} AS (SELECT p.* REPLACE (
            CASE WHEN n = 1 THEN got ELSE sha256(array_to_string({before}, '') || got || array_to_string({after}, '')) END AS got,
            CASE WHEN n = 1 THEN others ELSE others || array_to_string({before} || {after}, '') END AS others)
            FROM p_{at} p JOIN {t}r_{k} r ON r.g = {g} AND r.i = {here} // 8)""")
    return "WITH " + ", ".join(sql) + f" SELECT doc_id, leaf, subroot, root, sha256(others) AS proof_sha256, got AS folded_root, got = root AS verified FROM p_{2 * _LEVELS}"


_FIM_SQL = """
    WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || doc_id) AS h FROM documents),
    u AS (SELECT doc_id, text, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS units, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS d FROM t),
    v AS (SELECT *, len(units)::BIGINT AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR d[3] % 100 >= 100 THEN 'plain'
        WHEN d[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
    w AS (SELECT *, least(d[1] % (n + 1), d[2] % (n + 1)) AS lo, greatest(d[1] % (n + 1), d[2] % (n + 1)) AS hi FROM v),
    x AS (SELECT *, array_to_string(units[1:lo], '') AS pre, array_to_string(units[lo + 1:hi], '') AS mid, array_to_string(units[hi + 1:], '') AS suf FROM w)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
        sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
        sha256(text) AS restored_sha256 FROM x"""

ORACLES: dict[str, str] = {
    "op11_merkle_manifest": _merkle_sql(),
    "op12_fill_in_middle": _FIM_SQL,
    "op7_warc": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
        SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
               CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id > first THEN first END AS refers_to
        FROM p JOIN f USING (h)
    """,
}
