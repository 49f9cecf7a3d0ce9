import hashlib

import numpy as np
import pytest
from cases import empty_documents, odd_documents
from tokenizers import Tokenizer

from vecpress.llm import bpe
from vecpress.llm.queries import WORD_BPE, op10_bpe


def expected(text):
    t = Tokenizer.from_file(WORD_BPE)
    ids = t.encode(text or "", add_special_tokens=False).ids
    return ids, t.decode(ids, skip_special_tokens=False)


def test_query_against_library(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids, back = expected(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())


@pytest.mark.parametrize("shards", [1, 5])
def test_odd_rows(spark, shards):
    docs = odd_documents(spark)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in bpe.encode(docs, WORD_BPE, shards).collect()), key=key)
    assert got == sorted(((r.doc_id, *expected(r.text)) for r in docs.collect()), key=key)


def test_small_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i % 7} the the, {i}.") for i in range(50)], "doc_id long, text string").repartition(3, "doc_id")
    got = {r.doc_id: list(r.ids) for r in bpe.encode(docs, WORD_BPE, 3).collect()}
    assert got == {i: expected(f"word{i % 7} the the, {i}.")[0] for i in range(50)}


def test_equal_and_missing_ids_in_separate_blocks(spark):
    """Blocks of one row each whose ids, offsets and word codes are alike, but not their words."""
    rows = [(None, "foo bar"), (None, "zoo qux"), (5, "one two"), (5, "three four"), (5, "one two")]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, len(rows)), "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.decoded, list(r.ids)) for r in bpe.encode(docs, WORD_BPE, 3).collect()))
    assert got == sorted((i or 0, *reversed(expected(t))) for i, t in rows)


def test_empty_table(spark):
    assert bpe.encode(empty_documents(spark), WORD_BPE).collect() == []


def test_vocabulary_that_keeps_white_space_is_refused():
    import public_tokenizers

    with pytest.raises(ValueError):
        bpe.tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
