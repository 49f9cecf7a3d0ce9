"""Huffman statistics: histograms, optimal cost, codebooks and size reports.

Histograms are ordinary aggregations over ``(part, ctx, symbol)`` and keep non-zero counts only. A
group's optimal cost is a fold inside Catalyst; codes are built in Arrow batches, one group (at most
as many rows as the alphabet has symbols) at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Context of symbols that are coded without one.
NO_CTX = -1

# -- histograms ----------------------------------------------------------------------------------------


def long_codes(codes: DataFrame) -> DataFrame:
    """``codes(vec_id, codes array)`` as one row per part: ``vec_id, part, code``."""
    return codes.select("vec_id", F.posexplode("codes").alias("part", "code"))


def order0_hist(codes: DataFrame) -> DataFrame:
    """Counts per (part, symbol), with the empty context."""
    h = long_codes(codes).groupBy("part", F.col("code").cast("int").alias("symbol")).agg(F.count("*").alias("cnt"))
    return h.select("part", F.lit(NO_CTX).alias("ctx"), "symbol", "cnt")


def chained(codes: DataFrame, order: str = "sorted", chunk: int | None = None, seed: int = 0) -> DataFrame:
    """Codes with those of the vector before, in a stated order: ``pos, vec_id, codes, prev``.

    ``order`` is ``sorted`` (by codes as unsigned numbers, then vec_id), ``input`` (by vec_id) or
    ``shuffled`` (by a hash of vec_id and ``seed``). Positions come from per-range row counts, so
    the order is total without one task that sorts everything. With ``chunk``, each run of so many
    vectors starts anew, without a vector before its first.
    """
    from vecpress.operators.positions import with_position

    keys = {"sorted": ["codes", "vec_id"], "input": ["vec_id"], "shuffled": ["_mix", "vec_id"]}[order]
    placed = with_position(codes.withColumn("_mix", F.xxhash64("vec_id", F.lit(seed))), keys, carry="codes").drop("_mix")
    if chunk:
        placed = placed.withColumn("prev", F.when(F.col("pos") % chunk != 0, F.col("prev")))
    return placed


def chained_hist(codes: DataFrame, order: str = "sorted", seed: int = 0) -> DataFrame:
    """Counts per (part, code of the vector before, code); the first vector is not counted."""
    pairs = chained(codes, order, seed=seed).filter("prev is not null")
    return _pair_hist(pairs, F.col("prev"), F.col("codes"))


def _pair_hist(df: DataFrame, ctx: Column, symbol: Column, *by: str) -> DataFrame:
    pairs = df.select(*by, F.posexplode(F.arrays_zip(ctx.alias("c"), symbol.alias("s"))).alias("part", "p"))
    keys = [*by, "part", F.col("p.c").cast("int").alias("ctx"), F.col("p.s").cast("int").alias("symbol")]
    return pairs.groupBy(*keys).agg(F.count("*").alias("cnt"))


def neighbour_hist(codes: DataFrame, nn: DataFrame) -> DataFrame:
    """Counts per (rank, part, code of the vector = context, code of its neighbour = symbol), all ranks in one pass."""
    mine = codes.select("vec_id", F.col("codes").alias("own"))
    theirs = codes.select(F.col("vec_id").alias("nbr_id"), F.col("codes").alias("other"))
    return _pair_hist(nn.select("vec_id", "rank", "nbr_id").join(mine, "vec_id").join(theirs, "nbr_id"), F.col("own"), F.col("other"), "rank")


def tree_hist(codes: DataFrame, tree: DataFrame) -> DataFrame:
    """Counts per (part, code of the parent, code of the child)."""
    own = codes.select("vec_id", F.col("codes").alias("child"))
    parents = codes.select(F.col("vec_id").alias("parent_id"), F.col("codes").alias("parent"))
    return _pair_hist(tree.filter("parent_id is not null").select("vec_id", "parent_id").join(own, "vec_id").join(parents, "parent_id"), F.col("parent"), F.col("child"))


# -- optimal cost, without codes -------------------------------------------------------------------------


def huffman_cost(counts: Column) -> Column:
    """Bits of an optimal prefix code for an array of counts: the sum of all merged weights.

    One symbol takes one bit each time; no symbols take none. Zero counts don't take part.
    """
    a = F.array_sort(F.filter(F.transform(counts, lambda c: c.cast("long")), lambda c: c > 0))
    start = F.struct(a.alias("l"), F.lit(0).cast("long").alias("t"))

    def step(s: Column, _: Column) -> Column:
        two = s["l"][0] + s["l"][1]
        rest = F.array_sort(F.concat(F.slice(s["l"], F.lit(3), F.greatest(F.size(s["l"]) - 2, F.lit(0))), F.array(two)))
        return F.struct(rest.alias("l"), (s["t"] + two).alias("t"))

    folded = F.aggregate(F.sequence(F.lit(2), F.size(a)), start, step)["t"]
    return F.when(F.size(a) == 0, F.lit(0).cast("long")).when(F.size(a) == 1, a[0]).otherwise(folded)


def group_cost(hist: DataFrame, *by: str) -> DataFrame:
    """Optimal bits per (by..., part, ctx); a group has at most one row per symbol."""
    return hist.groupBy(*by, "part", "ctx").agg(huffman_cost(F.collect_list("cnt")).alias("bits"), F.sum("cnt").alias("n"))


def part_cost(hist: DataFrame, *by: str) -> DataFrame:
    """Optimal bits per (by..., part), over all contexts."""
    return group_cost(hist, *by).groupBy(*by, "part").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n"))


# -- codebooks -------------------------------------------------------------------------------------------


def build_codes(counts: Iterable[tuple[int, int]]) -> dict[int, str]:
    """symbol -> code. Ties: lower count, then the tree that holds the smallest symbol; first popped gets 0.

    Symbols with count 0 get no code. A single symbol gets the code 0.
    """
    heap = [(c, s, s) for s, c in counts if c > 0]
    heapq.heapify(heap)
    if len(heap) == 1:
        return {heap[0][1]: "0"}
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), (a[2], b[2])))
    codes: dict[int, str] = {}
    stack = [(heap[0][2], "")] if heap else []
    while stack:
        node, code = stack.pop()
        if isinstance(node, tuple):
            stack += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            codes[node] = code
    return codes


def _book(pdf: pd.DataFrame) -> pd.DataFrame:
    codes = build_codes(zip(pdf["symbol"].tolist(), pdf["cnt"].tolist()))
    out = pdf[pdf["cnt"] > 0].copy()
    out["code"] = [codes[s] for s in out["symbol"].tolist()]
    out["bit_length"] = out["code"].str.len().astype("int32")
    return out[["part", "ctx", "symbol", "cnt", "bit_length", "code"]]


def codebooks(hist: DataFrame) -> DataFrame:
    """``part, ctx, symbol, cnt, bit_length, code`` for every symbol that occurs: one tree per (part, ctx)."""
    h = hist.select(F.col("part").cast("int").alias("part"), F.col("ctx").cast("int").alias("ctx"), F.col("symbol").cast("int").alias("symbol"), F.col("cnt").cast("long").alias("cnt"))
    return h.groupBy("part", "ctx").applyInPandas(_book, "part int, ctx int, symbol int, cnt long, bit_length int, code string")


def codebook_storage_bits(book: DataFrame) -> DataFrame:
    """Bits of the codes of a stored book, and their mean length, per part."""
    return book.groupBy("part").agg(F.sum("bit_length").cast("long").alias("codebook_bits"), F.avg("bit_length").alias("mean_length"))


def dump(book: DataFrame) -> DataFrame:
    """A readable line for each code: ``symbol: code (length)``, with ``context -> symbol`` for context books."""
    plain = F.format_string("%d: %s (%d)", "symbol", "code", "bit_length")
    return book.select("part", "ctx", "symbol", F.when(F.col("ctx") == NO_CTX, plain).otherwise(F.concat(F.format_string("%d -> ", "ctx"), plain)).alias("line"))


# -- reports ---------------------------------------------------------------------------------------------


def stats_report(cost: DataFrame, n: int, parts: int, roots: int = 0, root_bits: int = 8, k_star: int = 256) -> DataFrame:
    """One row: totals and rates of per-part bits. Every root costs ``root_bits`` more in each part."""
    per = cost.select(F.col("part").cast("int").alias("part"), (F.col("bits") + F.lit(root_bits * roots)).cast("long").alias("bits"))
    per = per.select("part", "bits", (F.col("bits") / F.lit(float(n * root_bits))).alias("rate"), (F.col("bits") / F.lit(float(n))).alias("bits_per_byte"))
    total = per.agg(F.sum("bits").alias("bits"), F.sort_array(F.collect_list(F.struct("part", "bits", "rate", "bits_per_byte"))).alias("partials"))
    return total.select(
        F.lit(n).cast("long").alias("num_vectors"),
        F.lit(parts).alias("m"),
        F.lit(k_star).alias("k_star"),
        F.lit(roots).cast("long").alias("num_roots"),
        "bits",
        (F.col("bits") / F.lit(float(n * parts * root_bits))).alias("compression_rate"),
        (F.col("bits") / F.lit(float(n * parts))).alias("bits_per_byte"),
        "partials",
    )


def stats_json(report: DataFrame) -> DataFrame:
    return report.select(F.to_json(F.struct(*report.columns)).alias("stats"))


def rank_of(order: list[str], *by: str) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order))
