"""Size estimates from optimal costs: by neighbour rank, and of a spanning tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.operators import huffman
from vecpress.operators.graph import child_count_hist


def neighbour_estimate(codes: DataFrame, nn: DataFrame, n: int, parts: int) -> DataFrame:
    """Per rank: bits if each vector's neighbour of that rank is coded given the vector.

    A vector without a neighbour of a rank is charged 8 bits a part.
    """
    hist = huffman.neighbour_hist(codes, nn)
    bits = huffman.part_cost(hist, "rank").groupBy("rank").agg(F.sum("bits").alias("bits"))
    known = nn.groupBy("rank").agg(F.count("*").alias("known"))
    j = known.join(bits, "rank")
    total = F.col("bits") + 8 * parts * (F.lit(n) - F.col("known"))
    return j.select("rank", F.col("known").cast("long").alias("known"), total.cast("long").alias("bits"), (total / F.lit(float(n * parts * 8))).alias("compression_rate"), (total / F.lit(float(n * parts))).alias("bits_per_byte"))


def tree_cost(codes: DataFrame, tree: DataFrame) -> DataFrame:
    """Per part: bits of child codes given those of their parents."""
    return huffman.part_cost(huffman.tree_hist(codes, tree))


def child_count_cost(tree: DataFrame) -> DataFrame:
    """Bits of the numbers of children, and their alphabet."""
    h = child_count_hist(tree)
    return h.agg(huffman.huffman_cost(F.collect_list("cnt")).alias("bits"), F.sum("cnt").alias("n"), (F.max("symbol") + 1).alias("alphabet"))


def child_count_report(tree: DataFrame) -> DataFrame:
    """The report of the numbers of children as one part whose alphabet is the largest number plus one."""
    cost = child_count_cost(tree).select(F.lit(0).alias("part"), "bits", "n", "alphabet")
    row = cost.first()
    return huffman.stats_report(cost.select("part", "bits"), row["n"], 1, k_star=row["alphabet"])
