"""Product quantization: codebooks by deterministic Lloyd steps, codes, and the error.

A codebook has at most ``parts * centroids`` rows of ``dim / parts`` numbers, whatever the number of
vectors, so it is sent to all tasks. A step's sums are formed per task before they are dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.operators.knn import matrix
from vecpress.session import ship_package

CENTROIDS = "part int, centroid_id int, centroid array<double>"


def first_vectors(vectors: DataFrame, parts: int, centroids: int = 256) -> np.ndarray:
    """The start: the vectors with the smallest ids, part by centroid by dimension."""
    rows = vectors.select("vec_id", "embedding").orderBy("vec_id").limit(centroids).toArrow()
    rows = rows.sort_by("vec_id")
    if not len(rows):
        raise ValueError("no vectors to quantize")
    m = matrix(rows.column("embedding").combine_chunks()).astype(np.float64)
    if m.shape[1] % parts:
        raise ValueError(f"{m.shape[1]} dimensions can't be split into {parts} equal parts")
    return m.reshape(len(m), parts, -1).transpose(1, 0, 2).copy()


def spread_vectors(vectors: DataFrame, parts: int, centroids: int = 256, seed: int = 0, sample: int = 65_536) -> np.ndarray:
    """The k-means++ start: each next centroid of a part is drawn with a chance in proportion to its squared
    distance to the nearest one so far.

    It is drawn on the driver from about ``sample`` vectors, those with the smallest hashes of id and
    seed (from all of them where there are no more); the steps that follow use every vector. Fewer
    distinct vectors than centroids leave repeated centroids.
    """
    n = vectors.count()
    some = vectors.select("vec_id", "embedding")
    if n > sample:
        some = some.filter(F.xxhash64(F.col("vec_id").cast("long"), F.lit(seed)) < F.lit(int(-(2**63) + 2**64 * (sample / n))))
    rows = some.toArrow().sort_by("vec_id")
    if not len(rows):
        raise ValueError("no vectors to quantize")
    m = matrix(rows.column("embedding").combine_chunks()).astype(np.float64)
    if m.shape[1] % parts:
        raise ValueError(f"{m.shape[1]} dimensions can't be split into {parts} equal parts")
    rng, sub = np.random.default_rng(seed), m.reshape(len(m), parts, -1)
    book = np.empty((parts, centroids, sub.shape[2]))
    for p in range(parts):
        x, near = sub[:, p], np.full(len(m), np.inf)
        pick = int(rng.integers(len(x)))
        for c in range(centroids):
            book[p, c] = x[pick]
            near = np.minimum(near, ((x - x[pick]) ** 2).sum(axis=1))
            total = near.sum()
            pick = int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x)))
    return book


def assign(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each part of each vector (ties: the smaller id), and the squared distances."""
    parts, k, w = book.shape
    codes, dist = np.empty((len(x), parts), np.int64), np.empty((len(x), parts))
    for i in range(0, len(x), 4096):
        sub = x[i : i + 4096].astype(np.float64).reshape(-1, parts, w)
        for p in range(parts):
            d = ((sub[:, p, None, :] - book[p][None]) ** 2).sum(axis=2) if k * w <= 4096 else (sub[:, p] ** 2).sum(1)[:, None] - 2 * sub[:, p] @ book[p].T + (book[p] ** 2).sum(1)[None]
            codes[i : i + 4096, p] = d.argmin(axis=1)
            dist[i : i + 4096, p] = ((sub[:, p] - book[p][codes[i : i + 4096, p]]) ** 2).sum(axis=1)
    return codes, dist


def _sums(book: np.ndarray):
    parts, k, w = book.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, k), np.int64), np.zeros((parts, k, w))
        for b in batches:
            x = matrix(b.column("embedding"), parts * w)
            codes, _ = assign(x, book)
            sub = x.astype(np.float64).reshape(-1, parts, w)
            for p in range(parts):
                n[p] += np.bincount(codes[:, p], minlength=k)
                np.add.at(s[p], codes[:, p], sub[:, p])
        p, c = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(c, pa.int32()), pa.array(n[p, c]), pa.array(list(s[p, c]), pa.list_(pa.float64()))], names=["part", "centroid_id", "n", "sums"])

    return run


def lloyd(vectors: DataFrame, parts: int, centroids: int = 256, iterations: int = 10, start: str = "first", seed: int = 0) -> np.ndarray:
    """A codebook after ``iterations`` steps from the ``first`` vectors or from a ``spread`` start (k-means++).

    An empty cluster keeps its centroid.
    """
    ship_package(vectors.sparkSession)
    book = {"first": lambda: first_vectors(vectors, parts, centroids), "spread": lambda: spread_vectors(vectors, parts, centroids, seed)}[start]()
    for _ in range(iterations):
        partial = vectors.select("embedding").mapInArrow(_sums(book), "part int, centroid_id int, n long, sums array<double>")
        exploded = partial.select("part", "centroid_id", "n", F.posexplode("sums").alias("pos", "v"))
        step = exploded.groupBy("part", "centroid_id", "pos").agg((F.sum("v") / F.sum("n")).alias("v"))
        got = step.toArrow()  # as large as the codebook
        book[got.column("part").to_numpy(), got.column("centroid_id").to_numpy(), got.column("pos").to_numpy()] = got.column("v").to_numpy()
    return book


def centroid_table(spark, book: np.ndarray) -> DataFrame:
    rows = [(p, c, book[p, c].tolist()) for p in range(book.shape[0]) for c in range(book.shape[1])]
    return spark.createDataFrame(rows, CENTROIDS)


def book_of(centroids: DataFrame) -> np.ndarray:
    """A codebook from its table, every (part, centroid) present once."""
    rows = sorted((r["part"], r["centroid_id"], r["centroid"]) for r in centroids.collect())
    parts = rows[-1][0] + 1
    return np.array([r[2] for r in rows], np.float64).reshape(parts, len(rows) // parts, -1)


def _encode(book: np.ndarray):
    parts, k, w = book.shape
    kind = pa.int16() if k <= 2**15 else pa.int32()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes, dist = assign(matrix(b.column("embedding"), parts * w), book)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, parts, dtype=np.int32)), pa.array(codes.ravel()).cast(kind))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), lists, pa.array(dist.sum(axis=1))], names=["vec_id", "codes", "residual"])

    return run


def encode(vectors: DataFrame, book: np.ndarray) -> DataFrame:
    """``vec_id, codes, residual``: a code for each part, and the squared distance to the decoded vector."""
    ship_package(vectors.sparkSession)
    kind = "short" if book.shape[1] <= 2**15 else "int"
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_encode(book), f"vec_id long, codes array<{kind}>, residual double")


def quantization_error(encoded: DataFrame) -> DataFrame:
    """Mean squared residual over all vectors."""
    return encoded.agg(F.avg("residual").alias("pq_error"))


def reconstruct(codes: DataFrame, centroids: DataFrame) -> DataFrame:
    """Decoded vectors: the centroids of a vector's codes, one after another."""
    long = codes.select("vec_id", F.posexplode("codes").alias("part", "centroid_id"))
    near = long.join(F.broadcast(centroids), ["part", "centroid_id"])  # a codebook's size is fixed
    return near.groupBy("vec_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "centroid"))), lambda s: s["centroid"])).alias("embedding"))
