"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.llm import audio, bpe, crf, iblt, jaccard, langid, licenses, line_dedup, packing, warc
from vecpress.llm.sampling import held_out
from vecpress.session import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), shared AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND s.first <> k.doc_id) AS gone
  FROM keyed k LEFT JOIN shared s ON s.key = k.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), WORD_BPE)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = crf.score(docs.select("doc_id", "text"), crf.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_table(spark, sf_dir, "documents"), jaccard.Settings(words=3, num=90, den=100))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return iblt.compare_with_next(_table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"), licenses.document_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = materialize(warc.write_archives(_table(spark, sf_dir, "pages")), "warc", "uncompressed")
    return warc.read_archives(archives, payload=False).drop("url")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(audio.store(_table(spark, sf_dir, "documents")), "media")
    return audio.analyse(media)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), WORD_BPE, digests=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_packing": op1_packing, "op2_line_dedup": op2_line_dedup, "op3_quality": op3_quality, "op4_jaccard": op4_jaccard, "op5_fingerprints": op5_fingerprints, "op6_licenses": op6_licenses, "op7_warc": op7_warc, "op8_language_id": op8_language_id, "op9_media": op9_media, "op10_bpe": op10_bpe}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": OP2_SQL, "op6_licenses": licenses.oracle_sql()}
