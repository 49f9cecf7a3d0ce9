import re

import pyarrow as pa
import pytest
from cases import empty_documents, odd_documents

from vecpress.llm import jaccard
from vecpress.llm.queries import op4_jaccard

LOW = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


def shingles(text, k):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOW))
    if not w:
        return frozenset()
    return frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, k, num, den):
    """doc_id -> (size, component); rows of one id are one node, rows without an id have none."""
    sets = [(i, shingles(t, k)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            both = len(x & y)
            if x and y and den * both >= num * (len(x) + len(y) - both):
                p, q = find(i), find(j)
                parent[max(p, q)] = min(p, q)
    return sorted((TOP if i is None else i, len(shingles(t, k)), TOP if i is None else find(i)) for i, t in rows)


TOP = 2**63 - 1


def as_rows(df):
    return sorted((TOP if r.doc_id is None else r.doc_id, r.n_shingles, TOP if r.component_id is None else r.component_id) for r in df.collect())


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert as_rows(op4_jaccard(spark, sf)) == brute(rows, 3, 90, 100)


@pytest.mark.parametrize("setting", [jaccard.Settings(), jaccard.Settings(words=3, num=90), jaccard.Settings(words=1, num=50, broadcast_rows=0)])
def test_odd_rows(spark, setting):
    docs = odd_documents(spark)
    assert as_rows(jaccard.near_duplicates(docs, setting)) == brute([(r.doc_id, r.text) for r in docs.collect()], setting.words, setting.num, setting.den)


def test_a_large_group_of_near_copies(spark):
    """Copies with one to four changed words: a third of the links are near the threshold, and no copy is the original."""
    import random

    rnd = random.Random(5)
    base = [f"w{rnd.randint(0, 400)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(len(w))] = f"new{rnd.randint(0, 10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"alone {i} " + " ".join(f"x{rnd.randint(0, 10**6)}" for _ in range(30))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for s in (jaccard.Settings(words=3, num=90), jaccard.Settings(words=3, num=90, hubs=2, most_matches=1)):
        assert as_rows(jaccard.near_duplicates(docs, s)) == brute(rows, 3, 90, 100)


def test_every_link(spark, sf):
    """Pairs between classes are all the links that brute force finds."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    s = jaccard.Settings(words=2, num=30, part=3, often=(3, 10**6), ranges=2)
    pairs, members = jaccard.similar_pairs(spark.read.parquet(f"{sf}/documents.parquet"), s)
    classes = {}
    for i, t in rows:
        if x := shingles(t, 2):
            classes.setdefault(x, []).append(i)
    assert sorted((r.doc_id, r.node) for r in members.collect()) == sorted((i, min(c)) for c in classes.values() for i in c)
    sets = sorted((min(c), x) for x, c in classes.items())
    want = sorted((i, j) for k, (j, y) in enumerate(sets) for i, x in sets[:k] if 100 * len(x & y) >= 30 * len(x | y))
    assert sorted((r.a, r.b) for r in pairs.collect()) == want and want


def test_hot_shingles_and_split_lists(spark):
    """Shingles that nearly all documents hold, found by blocks, with lists split into parts of two."""
    import random

    rnd = random.Random(9)
    rows = []
    for i in range(60):
        common = [f"c{j}" for j in range(30)]
        rows.append((i, " ".join(common + [f"g{i % 6}x{j}" for j in range(20)] + [f"u{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(0, 4))])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    for s in (jaccard.Settings(words=3, num=90, part=2, often=(10, 10**6), ranges=3), jaccard.Settings(words=3, num=70, part=2, often=(10, 10**6), most_often=4, hubs=2)):
        assert as_rows(jaccard.near_duplicates(docs, s)) == brute(rows, 3, s.num, 100)


def test_empty_table(spark):
    assert jaccard.near_duplicates(empty_documents(spark)).collect() == []


def test_shingles_of_texts():
    texts = ["", "one", "one two", "One  TWO\tthree", "a b c a b c", " lead and trail "]
    _, at = jaccard.shingle_sets(pa.array(texts), 3)
    assert [int(n) for n in at[1:] - at[:-1]] == [len(shingles(t, 3)) for t in texts]
