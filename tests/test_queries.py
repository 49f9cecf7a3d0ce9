import numpy as np
import pytest
from compare import assert_same

import __spark_entry__ as entry
from vecpress.operators.huffman import build_codes
from vecpress.queries import ORACLES, PARTS, QUERIES, flagship


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, name):
    assert assert_same(QUERIES[name](spark, sf), ORACLES[name], sf) > 0


def test_trained_codebooks_against_plain_loops(spark):
    sf = "/root/testdata/sf0.01"  # more vectors than centroids
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in rows], np.float64)
    n, w = len(x), x.shape[1] // PARTS
    error, bits = 0.0, 0
    assert n > 256
    for p in range(PARTS):
        sub = x[:, p * w : (p + 1) * w]
        book = sub[:256].copy()
        for step in range(11):
            near = np.array([((v - book) ** 2).sum(axis=1).argmin() for v in sub])
            if step < 10:
                for c in set(near.tolist()):
                    book[c] = sub[near == c].mean(axis=0)
        error += ((sub - book[near]) ** 2).sum()
        counts = np.bincount(near)
        codes = build_codes(enumerate(counts.tolist()))
        bits += sum(int(k) * len(codes[s]) for s, k in enumerate(counts) if k)
    got = QUERIES["pq_trained"](spark, sf).first()
    assert (got.bits, round(got.pq_error, 5)) == (bits, round(error / n, 5))


def test_neighbour_files_round_as_doubles(spark):
    sf = "/root/testdata/sf0.01"  # two of its distances round to other decimals as 32-bit floats
    assert assert_same(QUERIES["neighbour_files_roundtrip"](spark, sf), ORACLES["neighbour_files_roundtrip"], sf) == 2500


def test_flagship(spark, sf):
    rows = flagship(spark, sf).collect()
    assert len(rows) == 8 and all(0 < r.compression_rate < 1 for r in rows)


def test_entry_lists_queries():
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
