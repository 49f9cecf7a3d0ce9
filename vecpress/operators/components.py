"""Connected components by alternating star contractions, without collecting anything."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.session import materialize, ship_package

#: Edges that one task joins in memory; more are contracted by all tasks.
ONE_TASK_EDGES = 1_000_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}
    for b in batches:
        for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist()):
            for x in (u, v):
                parent.setdefault(x, x)
            while parent[u] != u:
                parent[u] = parent[parent[u]]
                u = parent[u]
            while parent[v] != v:
                parent[v] = parent[parent[v]]
                v = parent[v]
            parent[max(u, v)] = min(u, v)
    labels = []
    for x in parent:
        r = x
        while parent[r] != r:
            r = parent[r]
        labels.append(r)
        while parent[x] != r:
            parent[x], x = r, parent[x]
    yield pa.RecordBatch.from_arrays([pa.array(list(parent), pa.int64()), pa.array(labels, pa.int64())], names=["node", "label"])


def components(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``node, label`` for each node of ``edges(a, b)``: the smallest node that it is connected with.

    Up to ``one_task`` edges are joined by one task. Beyond that, each turn hangs a node's larger neighbours on its smallest one, then a node and its smaller
    neighbours on the smallest of them; the edges end as stars around the labels, after a number of
    turns that grows with the logarithm of the largest component. Minima are taken before rows are
    dealt by node, and the joins are ones that Spark splits where a node is hot.
    """
    e = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "edges")
    if e.count() <= one_task:
        ship_package(e.sparkSession)
        rows = e.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
        return materialize(rows.coalesce(1).mapInArrow(_join, "node long, label long"), "labels")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(small, "small")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
