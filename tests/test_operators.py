import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.operators import blocks, codec, compare, graph, huffman, knn, pq
from vecpress.operators.components import components
from vecpress.operators.positions import with_position
from vecpress.plans import jobs
from vecpress.sources import files


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "vec_id long, embedding array<float>")


def brute_nn(x, k):
    x = np.asarray(x, np.float32).astype(np.float64)
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {(i, r + 1): int(j) for i in range(len(x)) for r, j in enumerate(np.lexsort((np.arange(len(x)), d[i]))[: min(k, len(x) - 1)])}


def as_dict(nn):
    return {(r.vec_id, r["rank"]): r.nbr_id for r in nn.collect()}


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(120, 6)).round(2)
    x[10], x[11] = x[9], x[9]  # duplicates
    return x


@pytest.mark.parametrize("tiles", [None, 3])
def test_exact_neighbours(spark, points, tiles):
    assert as_dict(knn.exact_knn(table(spark, points), 4, tiles)) == brute_nn(points, 4)


def test_few_vectors(spark):
    one = table(spark, [[1.0, 2.0]])
    assert knn.exact_knn(one, 3).collect() == []
    assert knn.exact_knn(one.limit(0), 3).collect() == []
    assert as_dict(knn.exact_knn(table(spark, [[0.0], [1.0], [3.0]]), 5)) == {(0, 1): 1, (0, 2): 2, (1, 1): 0, (1, 2): 2, (2, 1): 1, (2, 2): 0}


def test_ties_go_to_the_smaller_id(spark):
    x = [[0.0, 0.0]] * 40 + [[1.0, 0.0]] * 40
    assert as_dict(knn.exact_knn(table(spark, x), 2, None)) == brute_nn(x, 2)


def test_blocks_that_cover_all_are_exact(spark, points):
    v = table(spark, points)
    assert as_dict(blocks.block_knn(v, 4, 2, 1, 0.0)) == brute_nn(points, 4)
    assert as_dict(blocks.block_knn(v, 4, 1, 2, 2.0, most_rows=17)) == brute_nn(points, 4)


def test_blocks_are_never_closer_than_exact(spark, points):
    v = table(spark, points)
    exact, fast = knn.exact_knn(v, 4), blocks.block_knn(v, 4, 2, 3, 0.1)
    j = exact.withColumnRenamed("dist", "e").join(fast, ["vec_id", "rank"]).filter("dist < e - 1e-9")
    assert j.count() == 0
    m = compare.missed(exact, exact, 120, 4).collect()
    assert all(r.missed == 0 and r.recall == 1.0 for r in m)


def test_merging_in_any_order_is_the_same(spark, points):
    v = table(spark, points)
    grid = dict(dims=2, blocks=2, overlap=0.2)
    a, b = (blocks.block_knn(v, 3, block_range=r, **grid) for r in ((0, 2), (2, 4)))
    whole = as_dict(blocks.block_knn(v, 3, **grid))
    assert as_dict(knn.merge_nn(a, b, 3)) == whole == as_dict(knn.merge_nn(knn.merge_nn(b, a, 3), a, 3))


def test_quantization_step(spark, points):
    v = table(spark, points)
    e0 = pq.quantization_error(pq.encode(v, pq.lloyd(v, 2, 8, 0))).first()[0]
    e5 = pq.quantization_error(pq.encode(v, pq.lloyd(v, 2, 8, 5))).first()[0]
    assert e5 < e0
    with pytest.raises(ValueError):
        pq.lloyd(v, 4, 8, 0)
    book = pq.lloyd(v, 2, 8, 2)
    again = pq.book_of(pq.centroid_table(spark, book))
    assert np.allclose(book, again)
    x = np.array([r.embedding for r in pq.reconstruct(pq.encode(v, book).select("vec_id", "codes"), pq.centroid_table(spark, book)).orderBy("vec_id").collect()])
    assert np.isclose(((x - points) ** 2).sum(axis=1).mean(), pq.quantization_error(pq.encode(v, book)).first()[0], atol=1e-4)


def brute_forest(n, edges):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = set()
    for d, u, v in sorted((d, min(a, b), max(a, b)) for a, b, d in edges):
        p, q = find(u), find(v)
        if p != q:
            parent[max(p, q)] = min(p, q)
            out.add((u, v))
    return out, [find(i) for i in range(n)]


@pytest.mark.parametrize("one_task", [10**6, 0])
def test_forest_and_components(spark, one_task):
    rng = np.random.default_rng(8)
    edges = [(int(a), int(b), float(d)) for a, b, d in zip(rng.integers(0, 60, 70), rng.integers(0, 60, 70), rng.integers(0, 6, 70)) if a != b]
    df = spark.createDataFrame(edges, "source long, target long, dist double")
    want, labels = brute_forest(60, edges)
    got = {(r.u, r.v) for r in graph.spanning_forest(df, one_task).collect()}
    assert got == want
    found = dict(components(df.selectExpr("source a", "target b"), one_task).collect())
    assert found == {i: labels[i] for i in {x for e in edges for x in e[:2]}}


def test_preorder_and_parents(spark):
    v = spark.range(8).select(F.col("id").alias("vec_id"))
    forest = spark.createDataFrame([(1, 3, 1.0), (3, 5, 1.0), (1, 2, 1.0), (4, 6, 1.0)], "u long, v long, dist double")
    rows = graph.tree_order(v, forest).orderBy("pos").collect()
    assert [(r.vec_id, r.parent_id) for r in rows] == [(0, None), (1, None), (2, 1), (3, 1), (5, 3), (4, None), (6, 4), (7, None)]
    places = graph.parents_from_counts([r.num_children for r in rows])
    assert [None if p is None else rows[p].vec_id for p in places] == [r.parent_id for r in rows]
    s = graph.forest_summary(v, forest).first()
    assert (s.vertices, s.edges, s.num_roots, s.weight) == (8, 4, 4, 4.0)


def codes_of(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [int(x) for x in rng.choice([0, 1, 127, 128, 255], 3, p=[0.5, 0.2, 0.1, 0.1, 0.1])]) for i in range(90)]
    return spark.createDataFrame(rows, "vec_id long, codes array<short>")


@pytest.mark.parametrize("mode", ["order0", "chained", "tree"])
def test_round_trip_with_ids(spark, mode, points):
    codes = codes_of(spark)
    tree = None
    if mode == "tree":
        nn = knn.exact_knn(table(spark, points[:90]), 2)
        tree = graph.tree_order(codes, graph.spanning_forest(graph.candidate_edges(nn, 2, codes, 0.5)))
    report, book, chunks = jobs.huffman_encode(codes, 3, context=mode == "chained", tree=tree, chunk_rows=90 if mode == "chained" else 16)
    assert jobs.huffman_decode(chunks, book, mode, 3, tree, codes).first()[0] == 0
    coded = chunks.agg(F.sum("n_bits")).first()[0]
    assert coded == report.first().bits  # raw roots and the first vector included


@pytest.mark.parametrize("rows", [1, 7, 90])
def test_a_tree_in_many_chunks(spark, points, rows):
    codes = codes_of(spark)
    nn = knn.exact_knn(table(spark, points[:90]), 2)
    tree = graph.tree_order(codes, graph.spanning_forest(graph.candidate_edges(nn, 2, codes, 0.5)))
    report, book, chunks = jobs.huffman_encode(codes, 3, tree=tree, tree_chunk_rows=rows)
    assert chunks.count() == -(-90 // rows)
    back = codec.stream_position(codec.decode(chunks, book, "tree", 3, tree))
    assert codec.mismatches(back, codes).first()[0] == 0
    assert {(r.vec_id, r.pos) for r in back.collect()} == {(r.vec_id, r.pos) for r in tree.collect()}
    if rows == 1:  # every parent lies in another chunk
        assert {r.n_bits for r in chunks.collect()} == {24}


def test_codes_longer_than_a_window(spark):
    books = {(0, huffman.NO_CTX): huffman.build_codes((s, 2**s) for s in range(30))}
    symbols = [29, 0, 17, 1, 29, 28, 3, 0, 0, 29]
    a = codec.BookArrays(books)
    bits = "".join(map(str, a.bits(a.find(0, huffman.NO_CTX, symbols), step=3).tolist()))
    assert bits == "".join(books[0, huffman.NO_CTX][s] for s in symbols)
    d = codec.Decoder(bits, books)
    assert [d.symbol(0) for _ in symbols[:5]] + [x for _ in symbols[5:] for x in d.row([huffman.NO_CTX])] == symbols
    assert d.at == len(bits)
    for want in (30, -1, 1 << 40):
        with pytest.raises(ValueError, match="no code"):
            a.find(0, huffman.NO_CTX, [want])
    cut = codec.Decoder(bits[:-1] + "", books)
    with pytest.raises(ValueError, match="no such code"):
        for _ in symbols:
            cut.symbol(0)


def test_spread_start(spark, points):
    v = table(spark, points)
    a, b = (pq.spread_vectors(v, 2, 8, seed=3) for _ in range(2))
    assert (a == b).all() and a.shape == (2, 8, points.shape[1] // 2)
    own = {tuple(np.float64(x)) for x in points[:, : points.shape[1] // 2].astype(np.float32)}
    assert all(tuple(c) in own for c in a[0]) and len({tuple(c) for c in a[0]}) == 8
    few = pq.spread_vectors(v, 2, 8, seed=3, sample=40)
    assert few.shape == a.shape
    e0, e5 = (pq.quantization_error(pq.encode(v, pq.lloyd(v, 2, 8, k, "spread", 3))).first()[0] for k in (0, 5))
    assert e5 <= e0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<float>")
    assert (pq.spread_vectors(same, 1, 3) == [1.0, 2.0]).all()


def test_all_jobs_in_a_chain(spark, points):
    rows = {r.mode: r for r in jobs.run_chain(table(spark, points), 3, k=4, take=2, penalty=0.5, centroids=6, iterations=3, exact=True).collect()}
    assert set(rows) == {"order0", "chained", "tree"}
    assert all(r.mismatches == 0 and r.num_vectors == 120 and 0 < r.compression_rate < 1 for r in rows.values())


@pytest.mark.parametrize("mode", ["order0", "chained", "tree"])
def test_stream_files(spark, points, tmp_path, mode):
    codes = codes_of(spark)
    tree = None
    if mode == "tree":
        nn = knn.exact_knn(table(spark, points[:90]), 2)
        tree = graph.tree_order(codes, graph.spanning_forest(graph.candidate_edges(nn, 2, codes, 0.5)))
    _, book, chunks = jobs.huffman_encode(codes, 3, context=mode == "chained", tree=tree, chunk_rows=16, tree_chunk_rows=16)
    data, counts = str(tmp_path / "data"), str(tmp_path / "counts") if tree else None
    files.save_streams(chunks, data, counts)
    with pytest.raises(FileExistsError):
        files.save_streams(chunks, data, counts)
    back = files.load_streams(spark, data, counts)
    assert back.agg(F.sum("n")).first()[0] == 90 and back.count() == 6
    want, got = (sorted((r.chunk, r.place, list(r.codes)) for r in codec.decode(c, book, mode, 3, tree).collect()) for c in (chunks, back))
    assert want == got


def test_selection_and_child_report(spark, points):
    v = table(spark, points)
    assert knn.by_id(v, v.filter("vec_id in (3, 5)")).count() == 2
    nn = knn.exact_knn(v, 2)
    forest, tree, report = jobs.spanning_tree(nn, 2, vectors=v)
    assert report is None and tree.count() == 120
    r = jobs.tree_children(tree).first()
    assert r.num_vectors == 120 and r.bits >= 120 and r.k_star >= 2


def test_damaged_stream_is_an_error(spark):
    codes = codes_of(spark)
    _, book, chunks = jobs.huffman_encode(codes, 3, context=False)
    bad = chunks.withColumn("n_bits", F.col("n_bits") - 1)
    with pytest.raises(Exception, match="stream|left over"):
        codec.decode(bad, book, "order0", 3).collect()


def test_positions(spark):
    df = spark.range(100).select((F.col("id") * 37 % 101).alias("k")).repartition(5)
    rows = with_position(df, ["k"], carry="k").orderBy("pos").collect()
    assert [r.pos for r in rows] == list(range(100)) and [r.prev for r in rows] == [None, *[r.k for r in rows][:-1]]
    assert [r.k for r in rows] == sorted(r.k for r in rows)


def test_report_and_dump(spark):
    codes = codes_of(spark)
    r = huffman.stats_report(huffman.part_cost(huffman.order0_hist(codes)), 90, 3, roots=2).first()
    bits = sum(p.bits for p in r.partials)
    assert r.bits == bits and abs(r.compression_rate - bits / (90 * 3 * 8)) < 1e-12
    assert '"num_vectors":90' in huffman.stats_json(spark.createDataFrame([r])).first()[0]
    assert huffman.dump(huffman.codebooks(huffman.order0_hist(codes))).count() > 0


def odd_vectors():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 4)) + 1000
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    rows += [(50, rows[3][1]), (51, [v + 1e-6 for v in rows[3][1]]), (7, [0.0, 0.0, 0.0, 1.0]), (7, rows[7][1])]  # copies, one id twice
    rows += [(60, None), (61, [1.0, None, 2.0, 3.0]), (62, [1.0]), (63, [2.5]), (64, []), (None, rows[0][1])]
    rows += [(70, [float("nan"), 0.0, 0.0, 0.0]), (71, [float("inf"), 0.0, 0.0, 0.0]), (72, [1e120, 0.0, 0.0, 0.0])]
    return rows


@pytest.mark.parametrize(("rows", "tiles"), [(odd_vectors(), 1), (odd_vectors(), 3), (odd_vectors()[:44], None), (odd_vectors()[:1], None), ([], None), ([(i, [1e6, 0.1]) for i in range(700)], None)])
def test_distance_totals_against_all_pairs(spark, rows, tiles):
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    plain = knn.self_distances(v).groupBy("vec_id").agg(F.count("*").alias("n"), F.sum("dist").alias("sum_dist"), F.min("dist").alias("min_dist"))
    want = {r.vec_id: r for r in plain.collect()}
    got = {r.vec_id: r for r in knn.distance_totals(v, tiles).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i].n == w.n and (got[i].sum_dist is None) == (got[i].min_dist is None) == (w.min_dist is None)
        if w.min_dist is not None:
            np.testing.assert_allclose([got[i].sum_dist, got[i].min_dist], [w.sum_dist, w.min_dist], rtol=1e-9, atol=1e-18)


def test_distance_totals_of_near_copies_in_blocks():
    x = np.random.default_rng(8).normal(size=(1300, 3)) * 1e5
    x = np.concatenate([x, x[:1200] + 1e-4])  # products lose these distances
    ids = np.arange(len(x))
    out, other = knn._Totals(1300), knn._Totals(1200)
    knn._compare((ids[:1300], x[:1300], ids[:1300], True), (ids[:1200], x[1300:], ids[1300:], True), out, other)
    d = ((x[:1300, None] - x[None, 1300:]) ** 2).sum(axis=2)
    for t, axis in ((out, 1), (other, 0)):
        np.testing.assert_allclose(t.least, d.min(axis=axis), rtol=1e-12)
        np.testing.assert_allclose(t.sum, d.sum(axis=axis), rtol=1e-12)
        assert set(t.seen) == {d.shape[axis]}


def test_self_join_query_lists_no_pairs(spark, sf):
    from vecpress.queries import QUERIES

    plan = QUERIES["l2_self_join"](spark, sf)._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
