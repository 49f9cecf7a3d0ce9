import random
import zlib

import numpy as np
import pytest
from cases import empty_documents, odd_documents

from vecpress.llm import packing
from vecpress.llm.queries import WORD_BPE, op1_packing


def check_packed(rows, capacity):
    """Sequences are gapless from 0 and no longer than the capacity."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected_pieces(text, capacity=4096, end=1):
    from tokenizers import Tokenizer

    ids = [*Tokenizer.from_file(WORD_BPE).encode(text or "", add_special_tokens=False).ids, end]
    return [(k // capacity, k, len(ids[k : k + capacity]), zlib.crc32(np.array(ids[k : k + capacity], "<u4").tobytes())) for k in range(0, len(ids), capacity)]


def test_query_against_brute_force(spark, sf):
    rows = op1_packing(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {k: expected_pieces(t) for k, t in docs.items()}
    least = -(-sum(r.length for r in rows) // 4096)
    assert least <= check_packed(rows, 4096) <= least + 1


def test_odd_rows_and_ids(spark):
    docs = odd_documents(spark)
    rows = packing.pack_documents(docs, WORD_BPE, capacity=64, ids=True).collect()
    check_packed(rows, 64)
    want = sorted((r.doc_id is None, r.doc_id or 0, *p) for r in docs.collect() for p in expected_pieces(r.text, 64))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)


def test_empty_table(spark):
    assert packing.pack_documents(empty_documents(spark), WORD_BPE).collect() == []


def test_columns_with_the_names_of_helpers(spark):
    pieces = spark.createDataFrame([(i, 3, "r", -i, 1.5, [i], "x") for i in range(20)], "doc_id long, length int, rank string, _bucket int, _row double, `a b` array<int>, offset string")
    rows = packing.pack_pieces(pieces, 8).collect()
    assert sorted((r.doc_id, r.rank, r._bucket, r._row, r["a b"]) for r in rows) == [(i, "r", -i, 1.5, [i]) for i in range(20)]
    assert check_packed(rows, 8) == 10


def test_bad_length_is_an_error(spark):
    with pytest.raises(ValueError):
        packing.pack_pieces(spark.createDataFrame([(1, 9)], "doc_id long, length long"), 8)


def optimum(items, capacity):
    """Fewest bins, by trying every place for each item."""
    best = [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for space in {b for b in bins if b >= items[i]}:
            rest = list(bins)
            rest[rest.index(space)] -= items[i]
            go(i + 1, rest)
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(40))
def test_reduction_keeps_the_optimum(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 17, 30])
    items = sorted((rnd.randint(1, capacity) for _ in range(rnd.randint(1, 9))), reverse=True)
    counts = {s: items.count(s) for s in items}
    fixed, rest = packing.reduce_dominated(dict(counts), capacity)
    left = [s for s, n in rest.items() for _ in range(n)]
    used = [s for runs, bins in fixed for s, k in runs for _ in range(k * bins)]
    assert sorted(left + used) == sorted(items)
    assert all(sum(s * k for s, k in runs) <= capacity for runs, _ in fixed)
    assert sum(b for _, b in fixed) + optimum(sorted(left, reverse=True), capacity) == optimum(items, capacity)


@pytest.mark.parametrize("seed", range(30))
def test_plan_holds_every_item_once(seed):
    rnd = random.Random(seed)
    capacity = rnd.choice([10, 100, 4096])
    counts = {rnd.randint(1, capacity): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
    groups = packing.plan_bins(counts, capacity)
    got = {}
    for runs, bins in groups:
        assert bins > 0 and sum(s * k for s, k in runs) <= capacity
        for s, k in runs:
            got[s] = got.get(s, 0) + k * bins
    assert got == counts
