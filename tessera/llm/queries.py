"""The queries of the numbered operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.bpe import bpe_digests
from tessera.llm.common import load
from tessera.llm.decontaminate import contamination
from tessera.llm.filter_audit import filter_audit
from tessera.llm.importance import resample
from tessera.llm.language_id import identify
from tessera.llm.pieces import piece_digests
from tessera.llm.secrets import scan_secrets
from tessera.llm.sharding import assign_shards
from tessera.llm.simhash import simhash_components
from tessera.llm.target_resampling import target_resample
from tessera.llm.token_counts import count_tokens
from tessera.llm.topk import exact_top_k
from tessera.llm.toxicity import toxicity


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(load(spark, sf_dir, "documents"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(load(spark, sf_dir, "embeddings"), k=5, query_every=50)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return count_tokens(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, end_id=50256)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(load(spark, sf_dir, "documents"), shards=24)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_digests(load(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(load(spark, sf_dir, "documents"), shingle=3, threshold=2)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(load(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op11_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(load(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_importance": op3_importance,
    "op4_simhash": op4_simhash,
    "op5_decontamination": op5_decontamination,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_token_counts": op7_token_counts,
    "op8_sharding": op8_sharding,
    "op9_secrets": op9_secrets,
    "op10_toxicity": op10_toxicity,
    "op11_target_resampling": op11_target_resampling,
    "op12_sentencepiece": op12_sentencepiece,
    "op13_filter_audit": op13_filter_audit,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), 10) AS k, array_to_string(w[i.i : i.i + least(len(w), 10) - 1], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i) i WHERE len(w) > 0
), ks AS (SELECT DISTINCT k FROM win),
spots AS (
  SELECT doc_id, p.i, k, array_to_string(w[p.i : p.i + k - 1], ' ') AS s
  FROM (SELECT * FROM d, ks) t, LATERAL (SELECT unnest(range(1, len(t.w) - t.k + 2)) AS i) p
), hit AS (SELECT o.doc_id, o.i, o.k, win.item FROM spots o JOIN win ON win.k = o.k AND win.s = o.s),
n AS (SELECT doc_id, count(DISTINCT x.x) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + k)) AS x) x GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN items ON items.doc_id = d.doc_id""",
    "op6_exact_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
    "op11_target_resampling": f"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i::BIGINT, i::BIGINT, 0 FROM range(256) r(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8
), crc AS (SELECT list(c ORDER BY i) AS tab FROM steps WHERE k = 8),
w AS (SELECT true AS raw, row_number() OVER () AS row, doc_id, {_WORDS} AS w FROM documents UNION ALL SELECT false, 0, 0, {_WORDS} FROM benchmark),
f AS (
  SELECT raw, row, array_to_string(w[i.i : i.i + n - 1], ' ') AS f
  FROM (SELECT * FROM w, (VALUES (1), (2), (3)) s(n)) t, LATERAL (SELECT unnest(range(1, len(t.w) - t.n + 2)) AS i) i
), names AS (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM f)),
bytes AS (
  SELECT f, list_transform(range(0, len(h) // 2), lambda i: 16 * (strpos('0123456789ABCDEF', h[2 * i + 1]) - 1) + strpos('0123456789ABCDEF', h[2 * i + 2]) - 1) AS b
  FROM names
), b AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM bytes, crc
), fb AS (SELECT raw, row, bucket FROM f JOIN b USING (f)),
n AS (SELECT bucket, count(*) FILTER (raw) AS s, count(*) FILTER (NOT raw) AS t FROM fb GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM n) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM n) + 10000)::DOUBLE)))::BIGINT AS g FROM n
), weights AS (SELECT row, count(*) AS n_features, sum(g)::BIGINT AS weight FROM fb JOIN gain USING (bucket) WHERE raw GROUP BY row),
scored AS (
  SELECT row, doc_id, len(w) AS words, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5)::DOUBLE / 4294967296::DOUBLE))))::BIGINT AS score
  FROM w LEFT JOIN weights USING (row) WHERE raw
), ranked AS (SELECT row, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 5 * n // 100 THEN r END::BIGINT AS rank FROM scored LEFT JOIN ranked USING (row)""",
    "op13_filter_audit": r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), fails AS (
  SELECT part, quality = 1 AS good, toxic = 1 AS bad,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > 10 * length(t))::INT
      + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * (doc_id > min(doc_id) OVER (PARTITION BY t))::INT AS m
  FROM d LEFT JOIN labels USING (doc_id)
), n AS (SELECT part, m, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (bad) AS bad FROM fails GROUP BY part, m),
letters AS (SELECT chr((65 + i)::INT) AS x, i FROM range(5) r(i)),
orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS o FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT o, s.s::INT AS step, 1 << (ascii(o[s.s]) - 65) AS f, list_sum(list_transform(range(1, s.s), lambda i: 1 << (ascii(o[i]) - 65)))::INT AS before
  FROM orders, range(1, 6) s(s)
), counted AS (
  SELECT part, o, step, f,
    sum(n) FILTER (m & (coalesce(before, 0) | f) = 0) AS kept,
    sum(n) FILTER (m & f > 0 AND m & coalesce(before, 0) = 0) AS removed,
    sum(n) FILTER (m & f > 0 AND m & coalesce(before, 0) > 0) AS redundant,
    sum(n) FILTER (m = f) AS unique_fails,
    sum(good) FILTER (m & f > 0 AND m & coalesce(before, 0) = 0) AS good_lost,
    sum(bad) FILTER (m & f > 0 AND m & coalesce(before, 0) = 0) AS toxic_lost
  FROM steps, n GROUP BY part, o, step, f
)
SELECT part, o AS filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost,
  coalesce(sum(removed) OVER (PARTITION BY part, f), 0)::BIGINT AS shapley
FROM counted""",
}
