"""Approximate k nearest neighbours within overlapping blocks of a grid.

The first dimensions are split at quantiles into intervals that overlap; a block is one interval of
each, and a vector belongs to all blocks whose intervals hold it. The grid has ``dims * blocks``
rows whatever the number of vectors.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecpress.operators.knn import NN, _table, matrix, merge_nn, nearest, top_k
from vecpress.operators.positions import with_position
from vecpress.session import ship_package


def block_bounds(vectors: DataFrame, dims: int = 5, blocks: int = 3, overlap: float = 0.3) -> DataFrame:
    """``dim, block, start, end``: block i spans sorted places N*i/B - N*o/2 to N*(i+1)/B + N*o/2, cut
    to the table; the first start is one below the least value, the last end one above the greatest.

    Exact places in each dimension's order: only the values at the bounds are picked.
    """
    n = vectors.count()
    out = None
    for dim in range(dims):
        placed = with_position(vectors.select(F.element_at("embedding", dim + 1).cast("double").alias("v"), "vec_id"), ["v", "vec_id"])
        picks = []
        for i in range(blocks):
            a = min(max(int(n * i / blocks - n * overlap / 2), 0), n - 1)
            b = min(max(int(n * (i + 1) / blocks + n * overlap / 2), 0), n - 1)
            picks.append((i, a, b))
        at = placed.agg(*[F.max(F.when(F.col("pos") == a, F.col("v"))).alias(f"s{i}") for i, a, _ in picks], *[F.max(F.when(F.col("pos") == b, F.col("v"))).alias(f"e{i}") for i, _, b in picks], F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows = F.array(*[F.struct(F.lit(dim).alias("dim"), F.lit(i).alias("block"), (F.col("lo") - 1 if i == 0 else F.col(f"s{i}")).alias("start"), (F.col("hi") + 1 if i == blocks - 1 else F.col(f"e{i}")).alias("end")) for i, _, _ in picks])
        part = at.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out.orderBy("dim", "block")


def stored_bounds(spark, path: str, build) -> DataFrame:
    """The grid stored at ``path``, or the one that ``build()`` makes, which is then stored there."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _sums(found: Column, digits: Column) -> Column:
    """Every sum of one number of each array."""
    return F.flatten(F.transform(found, lambda a: F.transform(digits, lambda b: a + b)))


def membership(vectors: DataFrame, bounds: DataFrame, dims: int, blocks: int, block_range: tuple[int, int] | None = None, prefix: int | None = None) -> DataFrame:
    """``vec_id, block_id, embedding`` for every block that holds a vector, both bounds included.

    The first dimension is the most significant digit of ``block_id``. The grid becomes an
    expression, so a vector's blocks are found without a join. ``block_range`` is half-open;
    ``prefix`` looks at the leading dimensions alone and leaves the other digits 0.
    """
    grid = {(r["dim"], r["block"]): (r["start"], r["end"]) for r in bounds.collect()}  # dims * blocks rows
    found: Column = F.array(F.lit(0).cast("long"))
    for dim in range(dims):
        v = F.element_at("embedding", dim + 1).cast("double")
        mask = blocks ** (dims - 1 - dim)
        if prefix is not None and dim >= prefix:
            continue
        digits = F.array_compact(F.array(*[F.when((v >= grid[dim, i][0]) & (v <= grid[dim, i][1]), F.lit(i * mask).cast("long")) for i in range(blocks)]))
        found = _sums(found, digits)
    out = vectors.select("vec_id", "embedding", F.explode(found).alias("block_id"))
    if block_range:
        out = out.filter((F.col("block_id") >= block_range[0]) & (F.col("block_id") < block_range[1]))
    return out.select("vec_id", "block_id", "embedding")


def block_sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("block_id").agg(F.count("*").alias("size"))


def _within(k: int):
    def run(key, queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not len(queries) or not len(rows):
            return pa.table(_table([], [], []))
        c = lambda t, n: t.column(n).combine_chunks()
        return pa.table(_table(*nearest(matrix(c(queries, "embedding")), c(queries, "vec_id").to_numpy(), matrix(c(rows, "embedding")), c(rows, "vec_id").to_numpy(), k)))

    return run


def block_knn(vectors: DataFrame, k: int, dims: int = 5, blocks: int = 3, overlap: float = 0.3, block_range: tuple[int, int] | None = None, bounds: DataFrame | None = None, most_rows: int = 100_000) -> DataFrame:
    """The k nearest neighbours of each vector among those that share a block with it.

    Every block is compared within itself and keeps k rows a vector; pairs found in several blocks
    count once. A block of more than ``most_rows`` vectors is cut into pieces, each pair of which is
    one task's, so no task holds more than two pieces.
    """
    ship_package(vectors.sparkSession)
    bounds = bounds if bounds is not None else block_bounds(vectors, dims, blocks, overlap)
    members = membership(vectors, bounds, dims, blocks, block_range)
    cuts = block_sizes(members).select("block_id", F.ceil(F.col("size") / F.lit(most_rows)).cast("int").alias("cuts"))
    # a grid's blocks are few next to the vectors, yet their number is the grid's, so Spark picks the join
    cut = members.join(cuts, "block_id").withColumn("piece", F.pmod(F.xxhash64("vec_id"), F.col("cuts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))
    left = cut.withColumn("other", every).withColumnRenamed("piece", "mine")
    right = cut.withColumn("mine", every).withColumnRenamed("piece", "other")
    right = right.select(*[F.col(c).alias(c) for c in right.columns])  # columns of its own, for the cogroup
    pairs = left.groupBy("block_id", "mine", "other").cogroup(right.groupBy("block_id", "mine", "other")).applyInArrow(_within(k), NN)
    return top_k(pairs.distinct(), k)


def continue_block_knn(old: DataFrame, vectors: DataFrame, k: int, block_range: tuple[int, int], **grid) -> DataFrame:
    """Add the blocks of ``block_range`` to a stored neighbour table."""
    return merge_nn(old, block_knn(vectors, k, block_range=block_range, **grid), k)
