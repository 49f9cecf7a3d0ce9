import pyarrow as pa
import pytest
from cases import DOCS, odd_documents
from test_jaccard import brute as brute_groups
from test_line_dedup import brute as brute_lines
from test_packing import check_packed, expected_pieces

import corpus_pipeline
from vecpress.llm import crf, langid
from vecpress.session import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def test_run_against_plain_python(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = rows_of(docs)
    _, _, rejected = langid.predict_texts(langid.learn(docs), pa.array([t for _, t in rows]))
    rows = [r for r, x in zip(rows, rejected) if not x]
    kept = docs.join(spark.createDataFrame([(i,) for i, _ in rows], "doc_id long"), "doc_id", "left_semi")
    scores = crf.score_texts(crf.learn(kept, labels), pa.array([t for _, t in rows]))
    rows = [r for r, s in zip(rows, scores) if s >= 0.5]
    rows = [(i, t) for i, _, _, t in brute_lines(rows)]
    text = dict(rows)
    alone = [i for i, _, c in brute_groups(rows, 5, 80, 100) if i == c]
    want = sorted((i, *p) for i in alone for p in expected_pieces(text[i]))
    got = corpus_pipeline.run(spark, sf).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    check_packed(got, 4096)


def test_stages_keep_columns_and_clean_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {i for i, _ in rows_of(docs)}
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == COLUMNS
        after = {i for i, _ in rows_of(docs)}
        assert after <= before
        if name in ("language", "quality"):
            good = {i for i in before if labels.get(i) == 1}
            assert len(good & after) >= 0.97 * len(good)
        if name == "lines":
            assert after == before
    assert all(r.n_chars == len(r.text) for r in docs.collect())


@pytest.mark.parametrize("empty", [False, True])
def test_odd_and_empty_documents(spark, tmp_path, empty):
    docs = odd_documents(spark)
    if empty:
        docs = docs.limit(0)
    docs.select(*COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_packed(got, 4096)
    assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def test_columns_with_the_names_of_results(spark, sf):
    names = ["score", "Rejected", "n_lines", "predicted", "lang_pred", "n_dropped", "_key", "_gone", "component_id", "node"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = materialize(docs.selectExpr("*", *[f"doc_id * 10 + {i} as {c}" for i, c in enumerate(names)]), "wide")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf), name)
        assert docs.columns == [*COLUMNS, *names]
    rows = docs.collect()
    assert rows and all(r[c] == r.doc_id * 10 + i for r in rows for i, c in enumerate(names))


def test_one_row_of_each_group_stays(spark, sf):
    same = "the same words stand here again and again for all to read and nothing else is said"
    other = "quite another text about something that has nothing to do with what the first ones say"
    rows = [(5, same, "a"), (5, same, "b"), (7, same, "c"), (5, other, "d"), (None, same, "e"), (None, same, "f"), (None, other, "g"), (9, None, "h"), (9, None, "i"), (11, "alone", "j")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tag string")
    got = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert [i for i, _ in got] == [0, 0, 5, 9, 11] and [t for i, t in got if i == 0] == sorted([same, other])


def test_stage_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "quality", "lines", "near_duplicates", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None and DOCS.startswith("doc_id")
