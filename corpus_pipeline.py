"""A training corpus from raw documents: five stages, each a Parquet table for the next one.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
All but the last return the columns of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.llm import crf, jaccard, langid, line_dedup, packing
from vecpress.llm.blocks import unused
from vecpress.session import materialize

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
#: A five-word shingle set is a near copy from a similarity of 0.8 on.
NEAR = jaccard.Settings(words=5, num=80, den=100)
#: Ids of documents to drop that may be sent to all tasks.
SENT_ROWS = 500_000


def _shielded(docs: DataFrame, *results: str) -> tuple[DataFrame, list]:
    """``docs`` with other names for columns that are called like a stage's results, and the columns under their own names."""
    names = list(docs.columns)
    for i, c in enumerate(docs.columns):
        if c.lower() in results:
            names[i] = unused(f"_own_{c}", [*names, *results])
    return docs.toDF(*names), [F.col(f"`{now}`").alias(c) for now, c in zip(names, docs.columns)]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model doesn't reject, with all columns whatever their names.

    Null texts and texts without a letter go. Repeated rows are judged alike and all stay or go,
    very long texts are read whole, and an empty table gives no row.
    """
    docs, own = _shielded(docs, "lang_pred", "score", "rejected")
    return langid.identify(docs, langid.learn(docs)).filter(~F.col("rejected")).select(*own)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more, by labels outside the held-out fold, with all columns whatever their names.

    A score of just 0.5 stays, and so does every document where there are no labels to learn from.
    Null and empty texts are scored as one empty line; repeated rows all stay or go; very long texts
    are read whole; an empty table gives no row.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = crf.learn(docs, labels)
    docs, own = _shielded(docs, "score", "predicted")
    return crf.score(docs, model).filter("predicted = 1").select(*own)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in the first of them; every document and column stays.

    Where there is an ``n_chars``, it follows the text. Null and empty texts become empty, repeated
    rows lose the same lines, very long texts are read whole, and an empty table gives no row.
    """
    docs, own = _shielded(docs, "n_lines", "n_dropped")
    kept = line_dedup.drop_repeated_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*own)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, with all columns whatever their names.

    Rows that repeat a doc_id are one document, of which the row whose text's hash is smallest stays
    (any of rows with equal texts). Rows without a doc_id belong to no group; of those with equal
    texts one stays. Texts without words are in no group, very long ones are read whole, and an
    empty table gives no row.
    """
    found = materialize(jaccard.near_duplicates(docs, NEAR), "groups")
    gone = materialize(found.filter("component_id <> doc_id").select("doc_id").distinct(), "gone")
    if gone.count() <= SENT_ROWS:
        gone = F.broadcast(gone)
    left = docs.join(gone, "doc_id", "left_anti")
    # most tables repeat no id, so rows with one are set aside before texts are grouped
    ids = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")).alias("id")).groupBy("id").count()
    several = materialize(ids.filter("count > 1").select("id"), "repeated")
    if several.limit(1).count():
        key, text = unused("_key", docs.columns), unused("_hash", docs.columns)
        keyed = left.withColumn(key, F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).withColumn(text, F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256))
        again = F.broadcast(several) if several.count() <= SENT_ROWS else several
        again = again.withColumnRenamed("id", key)
        twice = keyed.join(again, key, "left_semi")
        of = F.when(F.col("doc_id").isNull(), F.col(text))
        first = twice.groupBy(key, of.alias("_of")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), text).alias("row")).select("row.*")
        left = keyed.join(again, key, "left_anti").drop(key, text).unionByName(first)
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of at most 4096 tokens.

    Null and empty texts give one piece of the end mark alone; repeated rows are packed as often as
    they occur; documents of more than 4096 tokens are cut; other columns end here; an empty table
    gives no row.
    """
    return packing.pack_documents(docs, WORD_BPE)


STAGES = [("language", language), ("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packed)]

#: Trained models and the packing have no SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
