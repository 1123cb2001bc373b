"""The registered queries of the training-data operators, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import class_lm, decontam, host_rules, lang_filter, mixture, ngram_join, pii, quality_knn, simhash, token_align, token_resync, vector_codes, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(_read(spark, sf_dir, "documents"))


def op2_pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan_pii(_read(spark, sf_dir, "documents"))


def op3_warc_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op4_winnow_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.score_texts(_read(spark, sf_dir, "documents"))


def op6_quality_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_knn.score_quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op7_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.quality_rules(_read(spark, sf_dir, "documents"))


def op8_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_filter.identify(_read(spark, sf_dir, "documents"))


def op9_token_resync(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_resync.count_tokens(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.mix_sources(_read(spark, sf_dir, "documents"))


def op11_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(_read(spark, sf_dir, "documents"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_align.align_tokenizers(_read(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), str(public_tokenizers.path("piece_bpe_32k.model")))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(_read(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ngram_jaccard_join, op2_pii_anchors, op3_warc_chain, op4_winnow_decontaminate, op5_class_lm, op6_quality_neighbours, op7_host_rules, op8_language_filters, op9_token_resync, op10_mix_sources, op11_simhash_ball, op12_token_alignment, op13_vector_codes)
}

NEAR_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, p, p + least(5, len(w)) - 1) g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id a, b.doc_id b, count(*) c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM x JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id c FROM d UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) n_shingles, m.c component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) c FROM r GROUP BY doc_id) m USING (doc_id)
"""

WARC_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') h, sha1(coalesce(html, '')) x, max(page_id) OVER (PARTITION BY coalesce(html, '')) keep FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(1 + ((CAST('0x' || substr(x, CAST(1 + 5 * (j // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (j % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') payload_digest,
       CASE WHEN keep = page_id THEN 'response' ELSE 'revisit' END record_type, CASE WHEN keep <> page_id THEN keep END refers_to
FROM p
"""

CODES_SQL = r"""
WITH e AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) v FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, CAST(i AS INTEGER) part, v[4 * i + 1] x0, v[4 * i + 2] x1, v[4 * i + 3] x2, v[4 * i + 4] x3 FROM e, range(16) t(i)),
f AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 k FROM (SELECT vec_id FROM e ORDER BY vec_id LIMIT 64)),
c0 AS MATERIALIZED (SELECT part, k, x0, x1, x2, x3 FROM p JOIN f USING (vec_id)),
{round}
SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY part) code, CAST(sum(d) AS BIGINT) error, CAST(sum(sum(d)) OVER (PARTITION BY any_value(label)) AS BIGINT) label_error,
       (SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY part, k)) FROM c2) codebooks_sha256
FROM a3 JOIN e USING (vec_id) GROUP BY vec_id
"""
_ASSIGN = """a{i} AS MATERIALIZED (SELECT vec_id, part, m.k, m.d, x0, x1, x2, x3 FROM (SELECT p.vec_id, p.part, any_value(p.x0) x0, any_value(p.x1) x1, any_value(p.x2) x2, any_value(p.x3) x3,
    min({'d': (p.x0 - c.x0) ** 2 + (p.x1 - c.x1) ** 2 + (p.x2 - c.x2) ** 2 + (p.x3 - c.x3) ** 2, 'k': c.k}) m FROM p JOIN c{j} c USING (part) GROUP BY p.vec_id, p.part))"""
_UPDATE = """c{i} AS MATERIALIZED (SELECT c.part, c.k, coalesce(g.x0, c.x0) x0, coalesce(g.x1, c.x1) x1, coalesce(g.x2, c.x2) x2, coalesce(g.x3, c.x3) x3 FROM c{j} c LEFT JOIN
    (SELECT part, k, {sums} FROM a{i} GROUP BY part, k) g ON g.part = c.part AND g.k = c.k)"""
_SUMS = ", ".join(f"CAST(floor(sum(x{d}) / count(*)) AS BIGINT) x{d}" for d in range(4))
_ROUND = ", ".join(step.replace("{i}", str(i)).replace("{j}", str(i - 1)).replace("{sums}", _SUMS) for i in (1, 2, 3) for step in ([_ASSIGN, _UPDATE] if i < 3 else [_ASSIGN]))

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_jaccard_join": NEAR_SQL,
    "op3_warc_chain": WARC_SQL,
    "op4_winnow_decontaminate": decontam.CONTAMINATION_SQL.replace("{docs}", "documents"),
    "op7_host_rules": host_rules.QUALITY_SQL,
    "op10_mix_sources": mixture.MIXTURE_SQL.replace("{docs}", "documents"),
    "op13_vector_codes": CODES_SQL.replace("{round}", _ROUND),
}
