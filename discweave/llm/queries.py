"""The thin queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from discweave.llm import bitplane, bpe, editembed, exact, language, licences, minhash, mixing, toxicity, warc
from discweave.llm.common import scratch, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    entries = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder, entries)


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_stream(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4)


def op6_edit_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return editembed.edited_likeness(table(spark, sf_dir, "documents"), near=0.8)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op8_bitplane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "ids")
    entries = bitplane.write_ids(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return bitplane.read_ids(spark, folder, entries)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_licences": op2_licences,
    "op3_mixing": op3_mixing,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_minhash": op5_minhash,
    "op6_edit_embedding": op6_edit_embedding,
    "op7_language": op7_language,
    "op8_bitplane_ids": op8_bitplane_ids,
    "op9_toxicity": op9_toxicity,
    "op10_bpe_codec": op10_bpe_codec,
}

#: Where DuckDB can express the result.
ORACLES: dict[str, str] = {
    "op1_warc": """
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN revisit THEN first END AS refers_to, url
        FROM (SELECT *, payload_bytes >= 100 AND page_id <> first AS revisit
              FROM (SELECT page_id, url, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                           sha256(coalesce(html, '')) AS payload_digest,
                           min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first
                    FROM pages))
    """,
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                          regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS body FROM documents),
             g AS (SELECT *, first_value(doc_id) OVER (PARTITION BY body ORDER BY n DESC, doc_id) AS keep_id,
                          count(*) OVER (PARTITION BY body) AS group_size FROM d)
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept,
               sha256(body) AS text_sha256
        FROM g
    """,
}
