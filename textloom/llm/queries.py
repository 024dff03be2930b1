"""The queries of the training-data operators, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from textloom.llm import decontaminate, license_scan, line_dedup, packing, quality_model, quality_rules, secret_scan, sharding, simhash, warc
from textloom.llm.common import table

SHARDS = [f"shard-{i:04d}" for i in range(256)]


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.check(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, fn in globals().items() if name.startswith("op") and name[2].isdigit()}


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_HITS = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS t FROM documents),
i AS (SELECT item_id, {_WORDS} AS t FROM benchmark),
w AS (SELECT DISTINCT item_id, least(13, len(t)) AS k, array_to_string(t[p:p + least(13, len(t)) - 1], ' ') AS span FROM i, unnest(range(1, greatest(len(t) - 12, 1) + 1)) AS u(p) WHERE len(t) > 0),
s AS (SELECT doc_id, k, p, array_to_string(t[p:p + k - 1], ' ') AS span FROM d, (SELECT DISTINCT k FROM w), unnest(range(1, len(t) - k + 2)) AS u(p)),
h AS (SELECT doc_id, p, s.k, item_id FROM s JOIN w USING (span)),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM h, unnest(range(p, p + k)) AS u(q) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(x, ',' ORDER BY x)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM h) GROUP BY doc_id)
SELECT doc_id, len(t) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(t), false) AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)"""
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(x, {5 * i + 1}, 5))::INTEGER >> {shift}) % 32 + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
_WARC = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
f AS (SELECT x, min(page_id) AS first FROM p GROUP BY x)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f USING (x)"""


def _placement() -> str:
    """Placement by the table that `sharding.build_table` fills; how it is filled is tested against full preference lists."""
    slots = ", ".join(map(str, sharding.build_table(SHARDS).tolist()))
    return f"""
WITH t AS (SELECT [{slots}] AS slots), d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {sharding.HASH_DIGITS}))::BIGINT % {sharding.TABLE_SIZE})::INTEGER AS slot FROM documents)
SELECT doc_id, slot, slots[slot + 1]::INTEGER AS shard FROM d, t"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontamination": _HITS, "op7_sharding": _placement(), "op10_warc": _WARC}
