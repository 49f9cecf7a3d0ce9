import hashlib

import numpy as np
import pyarrow as pa
import pytest
from cases import empty_documents, odd_documents
from compare import assert_same

from vecpress.llm import line_dedup
from vecpress.llm.queries import op2_line_dedup, oracle_sql

WS = " \t\n\v\f\r"
LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
TOP = 2**63 - 1


def brute(rows, least=10):
    where = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(WS).translate(LOW)
            if len(k) >= least:
                where.setdefault(k, set()).add(TOP if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [x.strip(WS).translate(LOW) for x in lines]
        own = TOP if i is None else i
        kept = [x for x, k in zip(lines, keys) if not (len(k) >= least and len(where[k]) > 1 and min(where[k]) != own)]
        out.append((own, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def as_rows(df):
    return sorted((TOP if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect())


def test_query_matches_sql(spark, sf):
    assert assert_same(op2_line_dedup(spark, sf), oracle_sql()["op2_line_dedup"], sf) == 200


@pytest.mark.parametrize("sizes", [{}, {"send_bytes": 0, "per_shard": 2}, {"per_shard": 3}, {"send_bytes": 0, "per_task": 2}])
def test_odd_rows(spark, sizes):
    docs = odd_documents(spark)
    got = line_dedup.drop_repeated_lines(docs, **sizes)
    assert as_rows(got) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {"lang", "score", "shared", "label"} <= set(got.columns)


@pytest.mark.parametrize("sizes", [{}, {"send_bytes": 0, "per_task": 3}])
def test_columns_with_the_names_of_helpers(spark, sizes):
    docs = spark.createDataFrame([(i, "a line that all documents share\nown line of number %d" % i, i, "x", -i) for i in range(9)], "doc_id long, text string, _id long, _gone string, shard int")
    got = line_dedup.drop_repeated_lines(docs, **sizes)
    assert sorted((r.doc_id, r._id, r._gone, r.shard, r.n_dropped) for r in got.collect()) == [(i, i, "x", -i, int(i > 0)) for i in range(9)]


def test_shard_arrays():
    """Counts and smallest documents are read through the hash; a line that isn't a member is an error."""
    h = np.random.default_rng(2).integers(0, 2**63, (300, 2))
    table = pa.table({"shard": [0] * 300, "h1": h[:, 0], "h2": h[:, 1], "first": np.arange(300), "n_docs": np.arange(300) % 3 * 200 + 1})
    shard = line_dedup.Shard(line_dedup._build(table).column("payload")[0].as_py())
    h1, h2 = h.T.astype(np.uint64)
    assert shard.owners(h1, h2).tolist() == [line_dedup.NOT_SHARED if i % 3 == 0 else i for i in range(300)]
    assert shard.count.dtype == np.uint8 and sorted(set(shard.count.tolist())) == [1, 201, 255]
    with pytest.raises(RuntimeError):
        shard.owners(h1, h2 ^ np.uint64(1))


def test_empty_table(spark):
    assert line_dedup.drop_repeated_lines(empty_documents(spark)).collect() == []


def test_mph_is_minimal_and_perfect():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, (5000, 2)).astype(np.uint64)
    m = line_dedup.Mph(line_dedup.build_mph(h[:, 0], h[:, 1]))
    assert sorted(m.find(h[:, 0], h[:, 1])) == list(range(5000))
    assert len(line_dedup.Mph(line_dedup.build_mph(h[:0, 0], h[:0, 1])).find(h[:, 0], h[:, 1])) == 5000


def test_digest_of_whole_text(spark, sf):
    rows = {r.doc_id: r for r in op2_line_dedup(spark, sf).collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    for i, n, gone, text in brute(docs):
        assert (rows[i].n_lines, rows[i].n_dropped, rows[i].kept_sha256) == (n, gone, hashlib.sha256(text.encode()).hexdigest())
