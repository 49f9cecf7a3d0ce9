import numpy as np
import pytest
from pyspark.sql import functions as F

from vecpress.operators import huffman
from vecpress.plans import sql
from vecpress.sources import files, vecs
from vecpress.streaming import neighbours


@pytest.mark.parametrize("kind", ["fvecs", "ivecs", "bvecs", "lvecs", "fvecsl", "ivecsl", "bvecsl", "lvecsl"])
def test_every_kind(spark, tmp_path, kind):
    vecs.register(spark)
    m = np.arange(60).reshape(12, 5) * 4
    path = str(tmp_path / f"x.{kind}")
    vecs.write_rows(path, m)
    assert (vecs.read_rows(path) == m).all() and (vecs.read_rows(path, 3, 2, 1, 2) == m[3:5, 1:3]).all()
    df = spark.read.format("vecs").option("path", path).option("batch_size", 5).load().orderBy("vec_id")
    assert [list(r.embedding) for r in df.collect()] == m.tolist() and df.rdd.getNumPartitions() >= 1
    some = spark.read.format("vecs").option("path", path).option("sub_start", 2).option("sub_dim", 2).option("limit", 7).load()
    assert sorted(list(r.embedding) for r in some.collect()) == m[:7, 2:4].tolist()


def test_append_and_overwrite(spark, tmp_path):
    vecs.register(spark)
    path = str(tmp_path / "v")

    def put(ids, mode, parts):
        df = spark.createDataFrame([(i, [float(i), 0.5]) for i in ids], "vec_id long, embedding array<float>").repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
        df.write.format("vecs").option("path", path).option("kind", "fvecsl").mode(mode).save()

    def rows():
        return [int(r.embedding[0]) for r in spark.read.format("vecs").option("path", path).load().orderBy("vec_id").collect()]

    put(range(4), "append", 2)
    put(range(10, 14), "append", 2)
    assert rows() == [0, 1, 2, 3, 10, 11, 12, 13]
    put([7], "overwrite", 1)
    assert rows() == [7] and len(list((tmp_path / "v").iterdir())) == 1
    bad = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception):
        bad.write.format("vecs").option("path", path).mode("overwrite").save()
    assert rows() == [7] and len(list((tmp_path / "v").iterdir())) == 1


def test_tree_and_books_as_tables(spark, tmp_path):
    t, b = str(tmp_path / "t"), str(tmp_path / "b")
    targets = [[1, 2], [0], [0], [], [5], [4]]
    files.write_tree(t, targets)
    for rows in (2, 100):
        assert sorted(tuple(r) for r in files.load_tree(spark, t, rows).collect()) == [(i, j) for i, x in enumerate(targets) for j in x]
    for ctx in ([-1], [0, 1, 2]):
        hist = spark.createDataFrame([(p, c, s, 1 + s * (p + 1) + max(c, 0)) for p in range(2) for c in ctx for s in range(3)], "part int, ctx int, symbol int, cnt long")
        book = huffman.codebooks(hist)
        files.save_books(book, b, 3)
        want = sorted((r.part, r.ctx, r.symbol, r.bit_length, r.code) for r in book.collect())
        assert sorted(tuple(r) for r in files.load_books(spark, b).collect()) == want


def test_wrong_files(tmp_path):
    p = tmp_path / "x.fvecs"
    vecs.write_rows(str(p), np.ones((3, 4)))
    p.write_bytes(p.read_bytes()[:-1])
    with pytest.raises(ValueError):
        vecs.layout(str(p))
    with pytest.raises(ValueError):
        vecs.layout(str(tmp_path / "x.csv"))


def test_headers(tmp_path):
    p = tmp_path / "x.fvecsl"
    p.write_bytes(np.ones((3, 4), "<f4").tobytes())
    assert vecs.prepend_header(str(p), 3, 4) and not vecs.prepend_header(str(p), 3, 4)
    assert vecs.read_rows(str(p)).shape == (3, 4)
    q = tmp_path / "nn"
    q.write_bytes(b"h" * 8 + b"0123456789" * 3)
    assert vecs.strip_header(str(q)) and q.read_bytes() == b"0123456789" * 3 and not vecs.strip_header(str(q))


def test_interchange_files(tmp_path):
    t = str(tmp_path / "t")
    targets = [[1, 2], [0], [0], []]
    files.write_tree(t, targets)
    assert files.read_tree(t) == targets
    i, d = str(tmp_path / "i.ivecsl"), str(tmp_path / "d.fvecsl")
    files.write_neighbours(i, d, [[(1, 0.5)], [(0, 0.5), (2, 1.0)], []], 2)
    assert files.read_neighbours(i, d) == [(0, 1, 1, 0.5), (1, 1, 0, 0.5), (1, 2, 2, 1.0)]
    g = str(tmp_path / "g")
    bounds = [(0, 0, -1.0, 0.5), (0, 1, 0.25, 2.0), (1, 0, -3.0, 0.0), (1, 1, 0.0, 4.0)]
    files.write_grid(g, bounds, 2, 2, 0.5)
    assert files.read_grid(g) == (bounds, 2, 2, 0.5)
    s = str(tmp_path / "s")
    files.write_stream(s, 2**40, "10110")
    assert files.read_stream(s) == (2**40, "10110000")


def test_neighbour_files_keep_doubles(spark, tmp_path):
    rows = [(0, 1, 1, 0.12345), (0, 2, 2, 1e300), (1, 1, 2, 1.37654999999), (1, 2, 0, float("inf")), (2, 1, 1, 1e-300)]
    nn = spark.createDataFrame(rows, "vec_id long, rank int, nbr_id long, dist double")
    i, d, r = (str(tmp_path / x) for x in "idr")
    files.save_neighbours(spark.range(4).withColumnRenamed("id", "vec_id"), nn, 2, i, d, 2, r)
    assert sorted(tuple(x) for x in files.load_neighbours(spark, i, d, r).collect()) == rows
    short = [(*x[:3], float(np.float32(min(x[3], 1e39)))) for x in rows]
    assert sorted(tuple(x) for x in files.load_neighbours(spark, i, d).collect()) == short


def test_long_codes_survive_a_book_file(tmp_path):
    a, b = 1, 1
    counts = []
    for _ in range(1024):
        counts.append(a)
        a, b = b, a + b
    plain = huffman.build_codes(enumerate(counts))
    assert max(map(len, plain.values())) > 127
    context = {c * 32 + s: code for c in range(32) for s, code in huffman.build_codes(enumerate(counts[c : c + 32])).items()}
    path = str(tmp_path / "books")
    files.write_books(path, [files.dump_book(plain, 1024), files.dump_book(context, 32, True)])
    assert files.read_books(path) == [(plain, 1024, False), (context, 32, True)]


def test_decoding_a_sequence(tmp_path):
    from vecpress.operators.codec import Decoder

    text = "abacabadabacabaeabacabadabacaba"
    counts = [1, 4, 3, 8, 3, 8]
    for ctx in (False, True):
        books = {(0, c): huffman.build_codes(enumerate(counts)) for c in (range(6) if ctx else [huffman.NO_CTX])}
        bits, last, out = "", huffman.NO_CTX, []
        for ch in text:
            s = "abcdef".index(ch)
            bits += books[0, last if ctx and last >= 0 else (0 if ctx else huffman.NO_CTX)][s]
            last = s
        d, last = Decoder(bits, books), 0 if ctx else huffman.NO_CTX
        for _ in text:
            s = d.symbol(0, last)
            out.append("abcdef"[s])
            last = s if ctx else huffman.NO_CTX
        assert "".join(out) == text and d.at == len(bits)


def test_sql_functions(spark, tmp_path):
    sql.register(spark)
    r = spark.sql("select l2_sq(array(cast(1 as float)), array(cast(3 as float))) d, code_hamming(array(1, 2), array(1, 3)) h, huffman_cost(array(1L, 4L, 3L, 8L, 3L, 8L)) c, huffman_cost(array(0L, 7L)) one, huffman_codes(array(1L, 1L)) m").first()
    assert (r.d, r.h, r.c, r.one, r.m) == (4.0, 1, 65, 7, {0: "0", 1: "1"})
    rows = spark.sql("select place, codes from huffman_decode(X'B0', 4L, array(map(-1, map(0, '0', 7, '1'))))").collect()
    assert [(x.place, list(x.codes)) for x in rows] == [(0, [7]), (1, [0]), (2, [7]), (3, [7])]
    rows = spark.sql("select codes from huffman_decode(X'05C0', 10L, array(map(5, map(5, '1', 6, '0'))))").collect()
    assert [list(x.codes) for x in rows] == [[5], [5], [5]]
    assert spark.sql("select * from huffman_decode(cast(null as binary), 4L, array(map(-1, map(0, '0'))))").count() == 0
    path = str(tmp_path / "x.fvecs")
    vecs.write_rows(path, np.ones((3, 2)))
    assert spark.sql(f"select count(*) from vecs_scan('{path}')").first()[0] == 3


def test_stream_of_pairs(spark, tmp_path):
    pairs = [(i, j, float((i * 7 + j * 3) % 11)) for i in range(5) for j in range(5) if i != j]
    src, out = str(tmp_path / "src"), str(tmp_path / "nn")
    for half in (pairs[:9], pairs[5:]):
        spark.createDataFrame(half, "vec_id long, nbr_id long, dist double").coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema("vec_id long, nbr_id long, dist double").parquet(src)
        neighbours.stream_pairs(stream, out, str(tmp_path / "cp"), 2).awaitTermination()
    got = {(r.vec_id, r["rank"]): (r.dist, r.nbr_id) for r in neighbours.current(spark, out).collect()}
    want = {(i, k + 1): x for i in range(5) for k, x in enumerate(sorted((d, j) for a, j, d in pairs if a == i)[:2])}
    assert got == want
