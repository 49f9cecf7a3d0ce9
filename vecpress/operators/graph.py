"""Minimum spanning forests of neighbour graphs, and their trees.

Edges are ordered by (dist, u, v), so the forest is unique. Contraction rounds run as aggregations:
each component picks its first edge, picked edges merge components, edges within one component go.
Once few edges are left they are finished by one task; a graph that is small from the start goes
there at once, its edges thinned by a forest of each partition first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecpress.functions.vectors import code_hamming
from vecpress.operators.components import components
from vecpress.session import materialize, ship_package

#: Edges that one task finishes in memory.
ONE_TASK_EDGES = 2_000_000


def penalised(dist: Column, hamming: Column, penalty: float) -> Column:
    """dist + penalty * hamming; an infinite penalty leaves the code distance alone, none (<= 0) the distance."""
    if penalty == float("inf"):
        return hamming.cast("double")
    return dist if penalty <= 0 else dist + F.lit(float(penalty)) * hamming


def candidate_edges(nn: DataFrame, take: int, codes: DataFrame | None = None, penalty: float = 0.0) -> DataFrame:
    """``source, target, dist``: the ``take`` best neighbours of each vector after the penalty.

    Without a penalty the stored ranks are the order already, so nothing is sorted again.
    """
    e = nn.filter("nbr_id is not null").select(F.col("vec_id").alias("source"), F.col("nbr_id").alias("target"), "dist", "rank")
    if penalty <= 0:
        return e.filter(F.col("rank") <= take).select("source", "target", "dist")
    if codes is None:
        raise ValueError("a penalty needs codes")
    a = codes.select(F.col("vec_id").alias("source"), F.col("codes").alias("_a"))
    b = codes.select(F.col("vec_id").alias("target"), F.col("codes").alias("_b"))
    e = e.join(a, "source").join(b, "target").withColumn("dist", penalised(F.col("dist"), code_hamming("_a", "_b"), penalty))
    w = Window.partitionBy("source").orderBy("dist", "target")
    return e.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= take).select("source", "target", "dist")


def undirected(edges: DataFrame) -> DataFrame:
    """``u < v, dist``, each pair once with its least distance."""
    e = edges.filter("source <> target").select(F.least("source", "target").alias("u"), F.greatest("source", "target").alias("v"), "dist")
    return e.groupBy("u", "v").agg(F.min("dist").alias("dist"))


def kruskal(u: np.ndarray, v: np.ndarray, dist: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the forest's edges among edges (u, v, dist) that tie nodes a and b."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    parent = list(range(len(nodes)))
    kept: list[int] = []
    for i in np.lexsort((v, u, dist)).tolist():
        p, q = int(x[i]), int(y[i])
        while parent[p] != p:
            parent[p] = parent[parent[p]]
            p = parent[p]
        while parent[q] != q:
            parent[q] = parent[parent[q]]
            q = parent[q]
        if p != q:
            parent[max(p, q)] = min(p, q)
            kept.append(i)
            if len(kept) == len(nodes) - 1:
                break
    return np.array(kept, np.int64)


EDGES = "u long, v long, dist double, cu long, cv long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        if len(held) > ONE_TASK_EDGES:  # the forest of a union lies in the union of the forests
            held = _thin(held)
    if held is not None:
        yield from _thin(held).combine_chunks().to_batches()


def _thin(t: pa.Table) -> pa.Table:
    c = [t.column(n).to_numpy() for n in ("u", "v", "dist", "cu", "cv")]
    return t.take(pa.array(np.sort(kruskal(*c))))


def spanning_forest(edges: DataFrame, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """``u, v, dist`` (u < v) of the minimum spanning forest of ``edges(source, target, dist)``."""
    ship_package(edges.sparkSession)
    e = undirected(edges).select(F.col("u").cast("long"), F.col("v").cast("long"), F.col("dist").cast("double"), F.col("u").cast("long").alias("cu"), F.col("v").cast("long").alias("cv"))
    e = materialize(e, "edges")
    n = e.count()
    picked: DataFrame | None = None
    while n > one_task:
        both = e.select(F.col("cu").alias("c"), "dist", "u", "v", "cu", "cv").unionByName(e.select(F.col("cv").alias("c"), "dist", "u", "v", "cu", "cv"))
        best = both.groupBy("c").agg(F.min(F.struct("dist", "u", "v", "cu", "cv")).alias("b")).select("b.*").distinct()
        best = materialize(best, "picked")
        picked = best.select("u", "v", "dist") if picked is None else picked.unionByName(best.select("u", "v", "dist"))
        labels = components(best.select(F.col("cu").alias("a"), F.col("cv").alias("b")), min(one_task, ONE_TASK_EDGES))
        for side in ("cu", "cv"):
            e = e.join(labels.withColumnRenamed("node", side), side, "left").withColumn(side, F.coalesce("label", side)).drop("label")
        # of the edges between two components only the first can be picked
        e = e.filter("cu <> cv").groupBy(F.least("cu", "cv").alias("cu"), F.greatest("cu", "cv").alias("cv")).agg(F.min(F.struct("dist", "u", "v")).alias("b"))
        e = materialize(e.select("b.u", "b.v", "b.dist", "cu", "cv"), "edges")
        n = e.count()
    rest = e.select("u", "v", "dist", "cu", "cv").mapInArrow(_forest, EDGES).repartition(1).mapInArrow(_forest, EDGES).select("u", "v", "dist")
    return rest if picked is None else picked.unionByName(rest)


def forest_summary(vectors: DataFrame, forest: DataFrame) -> DataFrame:
    """Vertices, edges, trees and total weight."""
    rows = vectors.select(F.lit(1).alias("v"), F.lit(0).alias("e"), F.lit(0.0).alias("w")).unionByName(forest.select(F.lit(0).alias("v"), F.lit(1).alias("e"), F.col("dist").alias("w")))
    return rows.agg(F.sum("v").alias("vertices"), F.sum("e").alias("edges"), (F.sum("v") - F.sum("e")).alias("num_roots"), F.sum("w").alias("weight"))


def symmetric(forest: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return forest.select(F.col("u").alias("source"), F.col("v").alias("target")).unionByName(forest.select(F.col("v").alias("source"), F.col("u").alias("target")))


def adjacency(forest: DataFrame) -> DataFrame:
    """Sorted neighbours of each vertex that has any."""
    return symmetric(forest).groupBy("source").agg(F.sort_array(F.collect_list("target")).alias("targets"))


TREE = "root_id long, place long, vec_id long, parent_id long, num_children int"


def _preorder(pdf: pd.DataFrame) -> pd.DataFrame:
    root = int(pdf["root_id"].iloc[0])
    near: dict[int, list[int]] = {}
    for a, b in zip(pdf["source"], pdf["target"]):
        if not pd.isna(b):
            near.setdefault(int(a), []).append(int(b))
    rows, stack = [], [(root, None)]
    while stack:
        node, parent = stack.pop()
        children = sorted((c for c in near.get(node, []) if c != parent), reverse=True)
        rows.append((root, len(rows), node, parent, len(children)))
        stack += [(c, node) for c in children]
    out = pd.DataFrame(rows, columns=["root_id", "place", "vec_id", "parent_id", "num_children"])
    out["parent_id"] = out["parent_id"].astype("Int64")
    return out


def tree_order(vectors: DataFrame, forest: DataFrame) -> DataFrame:
    """``pos, vec_id, parent_id, num_children, root_id``: depth-first preorder of all trees.

    A tree's root is its smallest id; trees follow one another by root, children by id. A tree is
    walked by one task, so its size is bounded by a task's memory; trees are independent.
    """
    ship_package(vectors.sparkSession)
    labels = components(forest.select(F.col("u").alias("a"), F.col("v").alias("b")))
    arcs = symmetric(forest).join(labels.withColumnRenamed("node", "source"), "source").select(F.col("label").alias("root_id"), "source", "target")
    alone = vectors.select(F.col("vec_id").cast("long").alias("source")).join(labels.select(F.col("node").alias("source")), "source", "left_anti")
    arcs = arcs.unionByName(alone.select(F.col("source").alias("root_id"), "source", F.lit(None).cast("long").alias("target")))
    walked = materialize(arcs.groupBy("root_id").applyInPandas(_preorder, TREE), "trees")
    from vecpress.operators.positions import with_position

    return with_position(walked, ["root_id", "place"]).select("pos", "vec_id", "parent_id", "num_children", "root_id")


def parents_from_counts(num_children: list[int]) -> list[int | None]:
    """The place of each preorder row's parent, rebuilt from the numbers of children; None for roots."""
    out: list[int | None] = []
    stack: list[list[int]] = []
    for i, n in enumerate(num_children):
        while stack and not stack[-1][1]:
            stack.pop()
        if stack:
            stack[-1][1] -= 1
            out.append(stack[-1][0])
        else:
            out.append(None)
        stack.append([i, n])
    return out


def child_count_hist(tree: DataFrame) -> DataFrame:
    return tree.groupBy(F.col("num_children").cast("int").alias("symbol")).agg(F.count("*").alias("cnt"))
