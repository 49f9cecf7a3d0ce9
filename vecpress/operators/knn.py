"""Exact k nearest neighbours of all vectors, and the mergeable neighbour table.

``nn`` tables have ``vec_id, rank (from 1), nbr_id, dist`` with squared Euclidean distances; missing
neighbours are absent rows. Ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.functions.vectors import l2_sq
from vecpress.session import ship_package

#: Bytes of vectors that may be sent to every task; larger tables are compared tile by tile.
SEND_BYTES = 64 << 20
NN = "vec_id long, nbr_id long, dist double"
TOTALS = "vec_id long, n long, sum_dist double, min_dist double"
#: Rows of either side of a block of distances, which should stay in a core's cache.
BLOCK = (512, 512)
#: Greatest relative error of a least distance that isn't settled by a comparison of all near ones.
LOSS = 1e-10


def by_id(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    """The vectors with the ids of ``ids(vec_id)``, each once."""
    return vectors.join(ids.select("vec_id"), "vec_id", "left_semi")


def top_k(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of ``pairs(vec_id, nbr_id, dist)`` for each vector, numbered. The limit is applied before rows are dealt."""
    w = Window.partitionBy("vec_id").orderBy("dist", "nbr_id")
    out = pairs.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return out.select("vec_id", "rank", "nbr_id", "dist")


def merge_nn(old: DataFrame, new: DataFrame, k: int) -> DataFrame:
    """Neighbour tables of different runs as one: associative, and repeated pairs count once."""
    pairs = old.select("vec_id", "nbr_id", "dist").unionByName(new.select("vec_id", "nbr_id", "dist"))
    return top_k(pairs.groupBy("vec_id", "nbr_id").agg(F.min("dist").alias("dist")), k)


def self_distances(vectors: DataFrame) -> DataFrame:
    """All ordered pairs of different vectors with their distances, in SQL expressions alone: a row for each pair, so for small tables."""
    b = vectors.select(F.col("vec_id").alias("nbr_id"), F.col("embedding").alias("other"))
    return vectors.join(b, F.col("vec_id") != F.col("nbr_id")).select("vec_id", "nbr_id", l2_sq("embedding", "other").alias("dist"))


def matrix(column: pa.Array, dim: int | None = None) -> np.ndarray:
    """Vectors of a list column as a matrix; all must have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    n = len(column)
    if n and len(flat) % n or dim is not None and len(flat) != n * dim:
        raise ValueError("vectors have different lengths")
    return flat.reshape(n, -1)


def nearest(q: np.ndarray, q_ids: np.ndarray, r: np.ndarray, r_ids: np.ndarray, k: int, rows: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest rows of ``r`` with other ids: query ids, neighbour ids, distances.

    One matrix product a block of queries finds more than k candidates; their distances are then
    computed term by term, so that cancellation can't change the order.
    """
    out_q, out_n, out_d = [], [], []
    r64 = r.astype(np.float64)
    r_sq = np.einsum("ij,ij->i", r64, r64)
    extra = min(len(r), k + 9)
    for i in range(0, len(q), rows):
        part = q[i : i + rows].astype(np.float64)
        ids = q_ids[i : i + rows]
        d = r_sq[None] - 2 * (part @ r64.T)
        d[ids[:, None] == r_ids[None]] = np.inf
        cand = np.argpartition(d, extra - 1, axis=1)[:, :extra] if extra < len(r) else np.broadcast_to(np.arange(len(r)), d.shape)
        # ties at the cut would be lost: rows that have them take all candidates up to the cut
        far = np.take_along_axis(d, cand, axis=1).max(axis=1) if len(r) else np.zeros(len(part))
        exact = ((part[:, None, :] - r64[cand]) ** 2).sum(axis=2)
        exact[r_ids[cand] == ids[:, None]] = np.inf
        order = np.lexsort((r_ids[cand], exact), axis=1)[:, :k]
        best_d, best_i = np.take_along_axis(exact, order, axis=1), r_ids[np.take_along_axis(cand, order, axis=1)]
        if extra < len(r):
            p_sq = np.einsum("ij,ij->i", part, part)
            tight = np.flatnonzero(best_d[:, -1] >= far + p_sq - 1e-9)
            for t in tight:
                e = ((part[t] - r64) ** 2).sum(axis=1)
                e[r_ids == ids[t]] = np.inf
                o = np.lexsort((r_ids, e))[:k]
                best_d[t], best_i[t] = e[o], r_ids[o]
        real = np.isfinite(best_d)
        out_q.append(np.repeat(ids, real.sum(axis=1)))
        out_n.append(best_i[real])
        out_d.append(best_d[real])
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(out_q, np.int64), join(out_n, np.int64), join(out_d, np.float64)


def _table(q, n, d) -> dict:
    return {"vec_id": pa.array(q, pa.int64()), "nbr_id": pa.array(n, pa.int64()), "dist": pa.array(d, pa.float64())}


def _against_sent(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, m = sent.value
        for b in batches:
            t = _table(*nearest(matrix(b.column("embedding")), b.column("vec_id").to_numpy(), m, ids, k))
            yield pa.RecordBatch.from_arrays(list(t.values()), names=list(t))

    return run


def _tile(k: int):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table(_table([], [], []))
        column = lambda t, c: t.column(c).combine_chunks()
        return pa.table(_table(*nearest(matrix(column(left, "embedding")), column(left, "vec_id").to_numpy(), matrix(column(right, "embedding")), column(right, "vec_id").to_numpy(), k)))

    return run


def exact_knn(vectors: DataFrame, k: int, tiles: int | None = None, send_bytes: int = SEND_BYTES) -> DataFrame:
    """Exact k nearest neighbours of ``vectors(vec_id, embedding)``; a vector isn't its own neighbour.

    A table of up to ``send_bytes`` is sent to every task. A larger one is cut into tiles by id
    hash; every pair of tiles is one task's matrix product that keeps k rows a query, and the k best
    of a query over all tiles are its neighbours.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
    n, d = size["n"], size["d"] or 0
    if n * d * 4 <= send_bytes and not tiles:
        rows = v.orderBy("vec_id").toArrow()
        held = (rows.column("vec_id").to_numpy(), matrix(rows.column("embedding").combine_chunks()) if n else np.zeros((0, d), np.float32))
        sent = spark.sparkContext.broadcast(held)
        spread = max(1, min(spark.sparkContext.defaultParallelism, n // 256))
        pairs = v.repartition(spread).mapInArrow(_against_sent(sent, k), NN)
        # one task saw all candidates of a vector, so its k rows are final
        return top_k(pairs, k)
    tiles = tiles or max(2, -(-n * d * 4 // (send_bytes // 4)))
    dealt = v.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))
    left = dealt.withColumn("other", every).withColumnRenamed("tile", "mine")
    right = dealt.withColumn("mine", every).withColumnRenamed("tile", "other")
    pairs = left.groupBy("mine", "other").cogroup(right.groupBy("mine", "other")).applyInArrow(_tile(k), NN)
    return top_k(pairs, k)


class _Totals:
    """Sum, least and number of the distances of a tile's rows so far. Least is NaN where there is none but NaN."""

    def __init__(self, n: int):
        self.sum, self.least, self.seen = np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64)

    def add(self, at: np.ndarray, total: np.ndarray, seen) -> None:
        self.sum[at] += total
        self.seen[at] += seen

    def lower(self, at: np.ndarray, least: np.ndarray) -> None:
        self.least[at] = np.fmin(self.least[at], least)

    def open(self, at: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which rows' least distances may be undercut by distances of ``low`` or more."""
        return np.flatnonzero(~(low > self.least[at]))

    def table(self, ids: np.ndarray, n: np.ndarray) -> pa.Table:
        some = n > 0
        none = self.seen[some] == 0
        values = [pa.array(ids[some], pa.int64()), pa.array(n[some], pa.int64()), *(pa.array(x[some], pa.float64(), mask=none) for x in (self.sum, self.least))]
        return pa.table(values, names=["vec_id", "n", "sum_dist", "min_dist"])


def _by_length(column: pa.Array) -> dict[tuple[int, bool], tuple[np.ndarray, np.ndarray]]:
    """(length, whether all numbers are small enough to be squared and added) -> places and vectors as doubles.

    Vectors that are null or hold a null have no distances.
    """
    size = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    start = np.cumsum(np.maximum(size, 0)) - np.maximum(size, 0)
    flat = column.flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        size[np.repeat(np.arange(len(size)), np.maximum(size, 0))[flat.is_null().to_numpy(zero_copy_only=False)]] = -1
    out = {}
    for d in np.unique(size[size >= 0]).tolist():
        at = np.flatnonzero(size == d)
        m = values[start[at][:, None] + np.arange(d)]
        plain = (np.abs(m) < 1e100).all(axis=1)
        for kind in (True, False):
            if (plain == kind).any():
                out[d, kind] = at[plain == kind], m[plain == kind]
    return out


def _least(d: np.ndarray, q: np.ndarray, r: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Each row's least distance, term by term, from the products ``d`` that are wrong by ``off`` at most.

    The nearest by product may differ from the nearest only by rounding; where that counts, all that could be nearest are compared.
    """
    at = d.argmin(axis=1)
    low = d[np.arange(len(d)), at]
    out = ((q - r[at]) ** 2).sum(axis=1)
    for i in np.flatnonzero((2 * off > LOSS * out) & (out > 0) & (low < np.inf)):
        out[i] = ((q[i] - r[d[i] <= low[i] + 2 * off[i]]) ** 2).sum(axis=1).min()
    return np.where(low < np.inf, out, np.nan)


def _compare(q: tuple, r: tuple, q_out: _Totals, r_out: _Totals | None = None) -> None:
    """Add the distances of ``q`` to ``r`` (places, vectors, ids, fit for products) with other ids to ``q_out``, and to ``r_out`` the other way round if it is given."""
    (q_at, q_all, q_ids, q_fit), (r_at, r_all, r_ids, r_fit) = q, r
    first, last = np.searchsorted(r_ids, q_ids), np.searchsorted(r_ids, q_ids, "right")  # ids are sorted
    fit = q_fit and r_fit
    if fit:  # about their mean, where products lose least
        mean = (q_all.sum(axis=0) + r_all.sum(axis=0)) / (len(q_all) + len(r_all))
        left, right = q_all - mean, r_all - mean
        l_sq, r_sq = (left**2).sum(axis=1), (right**2).sum(axis=1)
        left = np.column_stack([-2 * left, l_sq, np.ones(len(left))])
        right = np.column_stack([right, np.ones(len(right)), r_sq])
        l_off, r_off, eps = np.sqrt(l_sq), np.sqrt(r_sq), (left.shape[1] + 2) * np.finfo(float).eps
        right_t, held = np.ascontiguousarray(right.T), np.empty(BLOCK)
    rows, columns = BLOCK if fit else (16, 1024)
    for i in range(0, len(q_all), rows):
        a, a_at = q_all[i : i + rows], q_at[i : i + rows]
        for j in range(0, len(r_all), columns):
            b, b_at = r_all[j : j + columns], r_at[j : j + columns]
            lo, hi = np.maximum(first[i : i + rows] - j, 0), np.minimum(last[i : i + rows] - j, len(b))
            own = [(x, slice(lo[x], hi[x])) for x in np.flatnonzero(lo < hi)]
            with np.errstate(invalid="ignore", over="ignore"):
                d = np.matmul(left[i : i + rows], right_t[:, j : j + columns], out=held[: len(a), : len(b)]) if fit else ((a[:, None] - b[None]) ** 2).sum(axis=2)
                for x, mine in own:
                    d[x, mine] = 0
                q_out.add(a_at, np.maximum(d.sum(axis=1), 0), len(b) - np.maximum(hi - lo, 0))
                if r_out is not None:
                    r_out.add(b_at, np.maximum(d.sum(axis=0), 0), len(a))
            for x, mine in own:
                d[x, mine] = np.inf if fit else np.nan
            if not fit:
                q_out.lower(a_at, np.fmin.reduce(d, axis=1))
                if r_out is not None:
                    r_out.lower(b_at, np.fmin.reduce(d, axis=0))
                continue
            off = eps * (l_off[i : i + rows] + r_off[j : j + columns].max()) ** 2
            x = q_out.open(a_at, d.min(axis=1) - off)
            q_out.lower(a_at[x], _least(d[x], a[x], b, off[x]))
            if r_out is not None:
                off = eps * (r_off[j : j + columns] + l_off[i : i + rows].max()) ** 2
                x = r_out.open(b_at, d.min(axis=0) - off)
                r_out.lower(b_at[x], _least(np.ascontiguousarray(d[:, x].T), b[x], a, off[x]))


def _pair_totals(key, left: pa.Table, right: pa.Table) -> pa.Table:
    def parts(t: pa.Table) -> tuple[np.ndarray, dict]:
        t = t.sort_by("vec_id")
        ids = t.column("vec_id").to_numpy()
        return ids, {k: (at, m, ids[at], k[1]) for k, (at, m) in _by_length(t.column("embedding").combine_chunks()).items()}

    same = key[0].as_py() == key[1].as_py()
    ids, mine = parts(left)
    out = _Totals(len(ids))
    if same:
        for a, q in mine.items():
            for b, r in mine.items():
                if a[0] == b[0]:
                    _compare(q, r, out)
        return out.table(ids, len(ids) - (np.searchsorted(ids, ids, "right") - np.searchsorted(ids, ids)))
    r_ids, theirs = parts(right)
    r_out = _Totals(len(r_ids))
    for a, q in mine.items():
        for b, r in theirs.items():
            if a[0] == b[0]:
                _compare(q, r, out, r_out)
    return pa.concat_tables([out.table(ids, np.full(len(ids), len(r_ids))), r_out.table(r_ids, np.full(len(r_ids), len(ids)))])


def distance_totals(vectors: DataFrame, tiles: int | None = None, tile_bytes: int = SEND_BYTES // 2) -> DataFrame:
    """``vec_id, n, sum_dist, min_dist`` of all pairs that ``self_distances`` lists, without a row for each pair.

    Vectors are cut into tiles by id hash (of ``tile_bytes`` as doubles at most, or fewer where cores
    would idle). A pair of tiles is one task's, which takes every distance between them once, from
    matrix products in blocks, for both tiles; least distances are computed term by term. Rows
    with the same id are no pairs and share a result; pairs of different lengths, with null vectors or
    with nulls in them count in ``n`` alone, rows without an id not at all. Work is quadratic, the
    shuffle is ``tiles`` times the table.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull())
    if not tiles:
        size = v.agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("d")).first()
        n, d = size["n"], max(size["d"] or 0, 1)
        busy = math.isqrt(8 * spark.sparkContext.defaultParallelism)  # four pairs of tiles a core
        tiles = max(1, -(-n * d * 8 // tile_bytes), min(busy, n // 256))
    dealt = v.withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.lit(tiles)).cast("int"))
    # tiles have no id in common, so only a tile with itself has pairs to leave out; it comes once, at the left
    left = dealt.withColumn("other", F.explode(F.sequence("tile", F.lit(tiles - 1)))).withColumnRenamed("tile", "mine")
    right = dealt.filter("tile > 0").withColumn("mine", F.explode(F.sequence(F.lit(0), F.col("tile") - 1))).withColumnRenamed("tile", "other")
    # so many tasks that few have two pairs, by size alone Spark would give several to some; many pairs even out by themselves
    tasks = min(2 * tiles * (tiles + 1), 10_000)
    left, right = (x.repartition(tasks, "mine", "other") for x in (left, right))
    pairs = left.groupBy("mine", "other").cogroup(right.groupBy("mine", "other")).applyInArrow(_pair_totals, TOTALS)
    return pairs.groupBy("vec_id").agg(F.sum("n").alias("n"), F.sum("sum_dist").alias("sum_dist"), F.min("min_dist").alias("min_dist"))


def distance_summary(nn: DataFrame, limit: float | None = None) -> DataFrame:
    """Least, greatest and total distance; with ``limit``, each vector's list ends before its first distance above it."""
    if limit is not None:
        w = Window.partitionBy("vec_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        nn = nn.withColumn("_far", F.max((F.col("dist") > limit).cast("int")).over(w)).filter("_far = 0")
    return nn.agg(F.min("dist").alias("min_dist"), F.max("dist").alias("max_dist"), F.sum("dist").alias("sum_dist"), F.count("*").alias("pairs"))
