"""Comparison of an approximate neighbour table with the exact one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecpress.functions.vectors import safe_div, safe_inf


def rank_stats(nn: DataFrame, n: int) -> DataFrame:
    """Per rank: the total and mean distance there, and both over all ranks up to it."""
    per = nn.groupBy("rank").agg(F.sum("dist").alias("sum_dist"))
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # one row per rank
    return per.select("rank", "sum_dist", (F.col("sum_dist") / n).alias("avg_dist"), F.sum("sum_dist").over(w).alias("cum_dist"), (F.sum("sum_dist").over(w) / n).alias("cum_avg_dist"))


def distance_ratios(exact: DataFrame, fast: DataFrame, n: int) -> DataFrame:
    """Per rank: difference, relative difference and ratio of the total distances, at it and up to it.

    Division by about 0 gives 0; infinite totals become 1e100.
    """
    e, f = rank_stats(exact, n), rank_stats(fast, n)
    j = e.select("rank", F.col("sum_dist").alias("e"), F.col("cum_dist").alias("ce")).join(f.select("rank", F.col("sum_dist").alias("f"), F.col("cum_dist").alias("cf")), "rank", "left")
    j = j.select("rank", *[safe_inf(F.coalesce(c, F.lit(float("inf")))).alias(c) for c in ("e", "ce", "f", "cf")])
    return j.select(
        "rank",
        (F.col("f") - F.col("e")).alias("diff"),
        safe_div(F.col("f") - F.col("e"), F.col("e")).alias("rel_diff"),
        safe_div(F.col("f"), F.col("e")).alias("ratio"),
        (F.col("cf") - F.col("ce")).alias("cum_diff"),
        safe_div(F.col("cf"), F.col("ce")).alias("cum_ratio"),
    )


def missed(exact: DataFrame, fast: DataFrame, n: int, k: int) -> DataFrame:
    """Per rank j: neighbours among the first j of either list but not of both, over all vectors, and recall.

    A neighbour is found at j if both lists have it by j, so each common pair counts from the later
    of its two ranks on: no lists are compared for every j.
    """
    both = exact.select("vec_id", "nbr_id", F.col("rank").alias("_e")).join(fast.select("vec_id", "nbr_id", F.col("rank").alias("_f")), ["vec_id", "nbr_id"])
    found = both.groupBy(F.greatest("_e", "_f").alias("rank")).agg(F.count("*").alias("c"))
    e = exact.groupBy("rank").agg(F.count("*").alias("ne")).join(fast.groupBy("rank").agg(F.count("*").alias("nf")), "rank", "full")
    ranks = exact.sparkSession.range(1, k + 1).select(F.col("id").cast("int").alias("rank"))
    j = ranks.join(F.broadcast(found), "rank", "left").join(F.broadcast(e), "rank", "left").na.fill(0)
    w = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)  # k rows
    common, in_e, in_f = (F.sum(c).over(w) for c in ("c", "ne", "nf"))
    return j.select("rank", (in_e + in_f - common - F.lit(n) * F.col("rank")).cast("long").alias("missed"), (common / (F.lit(n) * F.col("rank"))).alias("recall"))


def compare_json(exact: DataFrame, fast: DataFrame, n: int, k: int) -> DataFrame:
    """All metrics as one JSON row."""
    m = missed(exact, fast, n, k).join(distance_ratios(exact, fast, n), "rank")
    rows = m.agg(F.sort_array(F.collect_list(F.struct(*m.columns))).alias("ranks"))
    return rows.select(F.to_json(F.struct(F.lit(n).alias("num_vectors"), F.lit(k).alias("num_nn"), "ranks")).alias("metrics"))
