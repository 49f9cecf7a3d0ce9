"""Registered queries of the vector engine and their SQL for DuckDB.

Parameters are small enough for the test tables; all rows of a table take part in every query.
Distances are rounded where they are results, as engines add numbers in different orders.
"""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.functions.vectors import l2_sq
from vecpress.operators import blocks, codec, compare, estimate, graph, huffman, knn, pq
from vecpress.operators.positions import with_position
from vecpress.session import materialize, ship_package

PARTS, CENTROIDS, K = 8, 16, 5
DIMS, BLOCKS, OVERLAP = 2, 3, 0.3
TAKE = 5
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- tables ----------------------------------------------------------------------------------------------


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vectors(spark, sf_dir) -> DataFrame:
    return _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")


def _codes(spark, sf_dir, iterations: int = 0) -> DataFrame:
    v = _vectors(spark, sf_dir)
    return pq.encode(v, pq.lloyd(v, PARTS, CENTROIDS, iterations))


def _exact(spark, sf_dir) -> DataFrame:
    return materialize(knn.exact_knn(_vectors(spark, sf_dir), K), "nn")


def _forest(spark, sf_dir) -> DataFrame:
    return materialize(graph.spanning_forest(graph.candidate_edges(_exact(spark, sf_dir), TAKE)), "forest")


def _tree(spark, sf_dir) -> DataFrame:
    return materialize(graph.tree_order(_vectors(spark, sf_dir), _forest(spark, sf_dir)), "tree")


# -- SQL pieces -------------------------------------------------------------------------------------------

_D = "list_sum(list_transform(list_zip({a}, {b}), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)))"
_W = 64 // PARTS
PAIRS = f"pairs AS (SELECT a.vec_id, b.vec_id AS nbr_id, {_D.format(a='a.embedding', b='b.embedding')} AS dist FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id)"
NN = f"{PAIRS}, nn AS (SELECT vec_id, nbr_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rank FROM pairs) WHERE rank <= {K})"
CODES = f"""sub AS (SELECT vec_id, p AS part, embedding[p * {_W} + 1 : (p + 1) * {_W}] AS sub FROM embeddings, range({PARTS}) t(p)),
cent AS (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS cid, sub AS c FROM sub WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {CENTROIDS})),
scored AS (SELECT s.vec_id, s.part, s.sub, c.cid, {_D.format(a='s.sub', b='c.c')} AS d FROM sub s JOIN cent c USING (part)),
codes AS (SELECT vec_id, part, any_value(sub) AS sub, arg_min(cid, (d, cid)) AS code, min(d) AS d FROM scored GROUP BY vec_id, part),
arrays AS (SELECT vec_id, list(code ORDER BY part) AS codes FROM codes GROUP BY vec_id)"""
BOUNDS = f"""placed AS (SELECT d AS dim, embedding[d + 1]::DOUBLE AS v, row_number() OVER (PARTITION BY d ORDER BY embedding[d + 1], vec_id) - 1 AS pos, count(*) OVER (PARTITION BY d) AS n FROM embeddings, range({DIMS}) t(d)),
bounds AS (SELECT dim, b AS block,
  CASE WHEN b = 0 THEN min(v) - 1 ELSE max(v) FILTER (WHERE pos = greatest(trunc(n * b / {BLOCKS}::DOUBLE - n * {OVERLAP} / 2), 0)) END AS start,
  CASE WHEN b = {BLOCKS - 1} THEN max(v) + 1 ELSE max(v) FILTER (WHERE pos = least(trunc(n * (b + 1) / {BLOCKS}::DOUBLE + n * {OVERLAP} / 2), n - 1)) END AS "end"
  FROM placed, range({BLOCKS}) t(b) GROUP BY dim, b),
members AS (SELECT e.vec_id, e.embedding, x.block * {BLOCKS} + y.block AS block_id FROM embeddings e
  JOIN bounds x ON x.dim = 0 AND e.embedding[1] BETWEEN x.start AND x."end" JOIN bounds y ON y.dim = 1 AND e.embedding[2] BETWEEN y.start AND y."end")"""


def _fast(where: str = "true") -> str:
    return f"""fpairs AS (SELECT DISTINCT a.vec_id, b.vec_id AS nbr_id, {_D.format(a='a.embedding', b='b.embedding')} AS dist FROM members a JOIN members b ON a.block_id = b.block_id AND a.vec_id <> b.vec_id WHERE {where}),
fast AS (SELECT vec_id, nbr_id, dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, nbr_id) AS rank FROM fpairs) WHERE rank <= {K})"""


def _cost(by: str) -> str:
    """From ``hist(<by>, cnt)``: ``cost(<by>, bits, n)``."""
    return f"""g AS (SELECT {by}, list_sort(list(cnt::BIGINT)) AS l FROM hist GROUP BY {by}),
h({by}, l, t) AS (SELECT {by}, l, 0::BIGINT FROM g UNION ALL SELECT {by}, list_sort(list_append(l[3:], l[1] + l[2])), t + l[1] + l[2] FROM h WHERE len(l) > 1),
cost AS (SELECT {by}, CASE WHEN max(len(l)) = 1 THEN max(l[1]) ELSE max(t) END AS bits, max(list_sum(l)) AS n FROM h GROUP BY {by})"""


EDGES = f"{NN}, edges AS (SELECT least(vec_id, nbr_id) AS u, greatest(vec_id, nbr_id) AS v, min(dist) AS dist FROM nn GROUP BY ALL)"
MST = f"""{EDGES}, numbered AS MATERIALIZED (SELECT u, v, dist, row_number() OVER (ORDER BY dist, u, v) AS i FROM edges),
nodes AS (SELECT list(vec_id ORDER BY vec_id) AS comp FROM embeddings),
k(i, comp, u, v, dist, kept) AS (
  SELECT 0::BIGINT, comp, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false FROM nodes
  UNION ALL
  SELECT e.i, CASE WHEN comp[e.u + 1] <> comp[e.v + 1] THEN list_transform(comp, lambda c: CASE WHEN c = greatest(k.comp[e.u + 1], k.comp[e.v + 1]) THEN least(k.comp[e.u + 1], k.comp[e.v + 1]) ELSE c END) ELSE comp END, e.u, e.v, e.dist, comp[e.u + 1] <> comp[e.v + 1]
  FROM k JOIN numbered e ON e.i = k.i + 1
), mst AS (SELECT u, v, dist FROM k WHERE kept)"""
TREE = f"""{MST}, arcs AS (SELECT u AS a, v AS b FROM mst UNION ALL SELECT v, u FROM mst),
final AS (SELECT comp FROM k ORDER BY i DESC LIMIT 1), roots AS (SELECT DISTINCT unnest(comp) AS vec_id FROM final),
tree(vec_id, parent_id) AS (SELECT vec_id, NULL::BIGINT FROM roots UNION ALL SELECT arcs.b, arcs.a FROM tree JOIN arcs ON arcs.a = tree.vec_id AND arcs.b IS DISTINCT FROM tree.parent_id)"""
REC = "WITH RECURSIVE "

# -- neighbours --------------------------------------------------------------------------------------------


@query(f"WITH {PAIRS} SELECT vec_id, count(*) AS n, round(sum(dist), 6) AS sum_dist, round(min(dist), 6) AS min_dist FROM pairs GROUP BY vec_id")
def l2_self_join(spark, sf_dir):
    d = knn.distance_totals(_vectors(spark, sf_dir))
    return d.select("vec_id", "n", F.round("sum_dist", 6).alias("sum_dist"), F.round("min_dist", 6).alias("min_dist"))


@query(f"WITH {NN} SELECT vec_id, rank, nbr_id, round(dist, 6) AS dist FROM nn")
def exact_knn(spark, sf_dir):
    nn = knn.exact_knn(_vectors(spark, sf_dir), K)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {NN} SELECT vec_id, rank, nbr_id, round(dist, 6) AS dist FROM nn")
def exact_knn_tiled(spark, sf_dir):
    nn = knn.exact_knn(_vectors(spark, sf_dir), K, tiles=3)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {NN}, s AS (SELECT rank, sum(dist) AS d FROM nn GROUP BY rank) SELECT rank, round(d, 6) AS sum_dist, round(d / (SELECT count(*) FROM embeddings), 6) AS avg_dist, round(sum(d) OVER (ORDER BY rank), 6) AS cum_dist FROM s")
def exact_knn_rank_stats(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    s = compare.rank_stats(knn.exact_knn(v, K), v.count())
    return s.select(F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in ("sum_dist", "avg_dist", "cum_dist")])


@query(f"WITH {NN} SELECT round(min(dist), 6) AS min_dist, round(max(dist), 6) AS max_dist, round(sum(dist), 6) AS sum_dist, count(*) AS pairs FROM (SELECT *, max((dist > 1.4)::INT) OVER (PARTITION BY vec_id ORDER BY rank) AS far FROM nn) WHERE far = 0")
def distance_summary(spark, sf_dir):
    s = knn.distance_summary(knn.exact_knn(_vectors(spark, sf_dir), K), 1.4)
    return s.select(*[F.round(c, 6).alias(c) for c in ("min_dist", "max_dist", "sum_dist")], "pairs")


# -- blocks -------------------------------------------------------------------------------------------------


@query(f'WITH {BOUNDS} SELECT dim, block, round(start, 6) AS start, round("end", 6) AS "end" FROM bounds')
def block_bounds(spark, sf_dir):
    b = blocks.block_bounds(_vectors(spark, sf_dir), DIMS, BLOCKS, OVERLAP)
    return b.select(F.col("dim").cast("long").alias("dim"), F.col("block").cast("long").alias("block"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


def _members(spark, sf_dir, block_range=None):
    v = _vectors(spark, sf_dir)
    return blocks.membership(v, blocks.block_bounds(v, DIMS, BLOCKS, OVERLAP), DIMS, BLOCKS, block_range)


@query(f"WITH {BOUNDS} SELECT vec_id, block_id FROM members")
def block_membership(spark, sf_dir):
    return _members(spark, sf_dir).select("vec_id", "block_id")


@query(f"WITH {BOUNDS} SELECT DISTINCT vec_id, block_id // {BLOCKS} * {BLOCKS} AS block_id FROM members")
def block_prefix_membership(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return blocks.membership(v, blocks.block_bounds(v, DIMS, BLOCKS, OVERLAP), DIMS, BLOCKS, prefix=1).select("vec_id", "block_id")


@query(f"WITH {BOUNDS} SELECT block_id, count(*) AS size FROM members GROUP BY block_id")
def block_sizes(spark, sf_dir):
    return blocks.block_sizes(_members(spark, sf_dir))


@query(f"WITH {BOUNDS}, {_fast()} SELECT vec_id, rank, nbr_id, round(dist, 6) AS dist FROM fast")
def block_knn(spark, sf_dir):
    nn = blocks.block_knn(_vectors(spark, sf_dir), K, DIMS, BLOCKS, OVERLAP)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {BOUNDS}, {_fast('a.block_id >= 2 AND a.block_id < 6')} SELECT vec_id, rank, nbr_id, round(dist, 6) AS dist FROM fast")
def block_knn_range(spark, sf_dir):
    nn = blocks.block_knn(_vectors(spark, sf_dir), K, DIMS, BLOCKS, OVERLAP, block_range=(2, 6))
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 6).alias("dist"))


@query(f"WITH {BOUNDS}, {_fast()} SELECT vec_id, rank, nbr_id, round(dist, 6) AS dist FROM fast")
def block_knn_resumed(spark, sf_dir):
    """Blocks in two runs, the second merged into the first one's table."""
    v = _vectors(spark, sf_dir)
    grid = dict(dims=DIMS, blocks=BLOCKS, overlap=OVERLAP)
    first = materialize(blocks.block_knn(v, K, block_range=(0, 4), **grid), "nn")
    nn = blocks.continue_block_knn(first, v, K, (4, BLOCKS**DIMS), **grid)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 6).alias("dist"))


def _both(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return v.count(), _exact(spark, sf_dir), materialize(blocks.block_knn(v, K, DIMS, BLOCKS, OVERLAP), "fast")


@query(f"""WITH {NN}, {BOUNDS}, {_fast()}, j AS (SELECT unnest(range(1, {K + 1})) AS rank),
l AS (SELECT j.rank, vec_id, len(list_distinct(list(nbr_id))) AS either FROM j JOIN (SELECT vec_id, nbr_id, rank AS r FROM nn UNION ALL SELECT vec_id, nbr_id, rank FROM fast) x ON x.r <= j.rank GROUP BY ALL)
SELECT rank, CAST(sum(either - rank) AS BIGINT) AS missed, round(1 - sum(either - rank) / (count(*) * rank), 6) AS recall FROM l GROUP BY rank""")
def knn_recall(spark, sf_dir):
    n, e, f = _both(spark, sf_dir)
    return compare.missed(e, f, n, K).select(F.col("rank").cast("long").alias("rank"), "missed", F.round("recall", 6).alias("recall"))


@query(f"""WITH {NN}, {BOUNDS}, {_fast()}, e AS (SELECT rank, sum(dist) AS d, sum(sum(dist)) OVER (ORDER BY rank) AS c FROM nn GROUP BY rank),
f AS (SELECT rank, sum(dist) AS d, sum(sum(dist)) OVER (ORDER BY rank) AS c FROM fast GROUP BY rank)
SELECT rank, round(f.d - e.d, 6) AS diff, round((f.d - e.d) / e.d, 6) AS rel_diff, round(f.d / e.d, 6) AS ratio, round(f.c - e.c, 6) AS cum_diff, round(f.c / e.c, 6) AS cum_ratio FROM e JOIN f USING (rank)""")
def knn_dist_ratio(spark, sf_dir):
    n, e, f = _both(spark, sf_dir)
    r = compare.distance_ratios(e, f, n)
    return r.select(F.col("rank").cast("long").alias("rank"), *[F.round(c, 6).alias(c) for c in ("diff", "rel_diff", "ratio", "cum_diff", "cum_ratio")])


@query()
def compare_metrics_json(spark, sf_dir):
    n, e, f = _both(spark, sf_dir)
    return compare.compare_json(e, f, n, K)


# -- quantization ---------------------------------------------------------------------------------------------


@query(f"WITH {CODES} SELECT vec_id, part, code FROM codes")
def pq_codes(spark, sf_dir):
    return huffman.long_codes(_codes(spark, sf_dir)).select("vec_id", F.col("part").cast("long").alias("part"), F.col("code").cast("long").alias("code"))


@query(f"""WITH {CODES}, flat AS (SELECT part, code, unnest(sub)::DOUBLE AS x, generate_subscripts(sub, 1) - 1 AS pos FROM codes)
SELECT part, code AS centroid_id, pos, round(avg(x), 6) AS value FROM flat GROUP BY ALL""")
def pq_lloyd1_centroids(spark, sf_dir):
    c = pq.centroid_table(spark, pq.lloyd(_vectors(spark, sf_dir), PARTS, CENTROIDS, 1))
    long = c.select(F.col("part").cast("long").alias("part"), F.col("centroid_id").cast("long").alias("centroid_id"), F.posexplode("centroid").alias("pos", "value"))
    return long.select("part", "centroid_id", F.col("pos").cast("long").alias("pos"), F.round("value", 6).alias("value"))


@query(f"WITH {CODES} SELECT round(sum(d) / (SELECT count(*) FROM embeddings), 6) AS pq_error FROM codes")
def pq_error(spark, sf_dir):
    return pq.quantization_error(_codes(spark, sf_dir)).select(F.round("pq_error", 6).alias("pq_error"))


@query(f"WITH {CODES}, r AS (SELECT vec_id, part, c.c FROM codes JOIN cent c ON c.part = codes.part AND c.cid = codes.code) SELECT vec_id, round(list_sum(flatten(list(c ORDER BY part))::DOUBLE[]), 6) AS total FROM (SELECT codes.vec_id, codes.part, c.c FROM codes JOIN cent c ON c.part = codes.part AND c.cid = codes.code) GROUP BY vec_id")
def pq_reconstruct(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    book = pq.lloyd(v, PARTS, CENTROIDS, 0)
    r = pq.reconstruct(pq.encode(v, book).select("vec_id", "codes"), pq.centroid_table(spark, book))
    return r.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 6).alias("total"))


# -- Huffman statistics ------------------------------------------------------------------------------------------


def _long(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[F.col(n).cast("long").alias(n) for n in names])


ORDER0 = f"{CODES}, hist AS (SELECT part, code AS symbol, count(*) AS cnt FROM codes GROUP BY ALL)"
SORTED = f"{CODES}, pairs2 AS (SELECT codes AS cur, lag(codes) OVER (ORDER BY codes, vec_id) AS prev FROM arrays)"
INPUT = f"{CODES}, pairs2 AS (SELECT codes AS cur, lag(codes) OVER (ORDER BY vec_id) AS prev FROM arrays)"
CHAIN = f", hist AS (SELECT p AS part, prev[p + 1] AS ctx, cur[p + 1] AS symbol, count(*) AS cnt FROM pairs2, range({PARTS}) t(p) WHERE prev IS NOT NULL GROUP BY ALL)"


@query(f"WITH {ORDER0} SELECT part, symbol, cnt FROM hist")
def order0_hist(spark, sf_dir):
    return _long(huffman.order0_hist(_codes(spark, sf_dir)), "part", "symbol", "cnt")


@query(f"{REC}{ORDER0}, {_cost('part')} SELECT part, CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n FROM cost")
def order0_cost(spark, sf_dir):
    return _long(huffman.part_cost(huffman.order0_hist(_codes(spark, sf_dir))), "part", "bits", "n")


@query(f"WITH {SORTED}{CHAIN} SELECT * FROM hist")
def chained_hist_sorted(spark, sf_dir):
    return _long(huffman.chained_hist(_codes(spark, sf_dir).select("vec_id", "codes"), "sorted"), "part", "ctx", "symbol", "cnt")


@query(f"WITH {INPUT}{CHAIN} SELECT * FROM hist")
def chained_hist_nosort(spark, sf_dir):
    return _long(huffman.chained_hist(_codes(spark, sf_dir).select("vec_id", "codes"), "input"), "part", "ctx", "symbol", "cnt")


@query(f"{REC}{SORTED}{CHAIN}, {_cost('part, ctx')} SELECT part, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS n FROM cost GROUP BY part")
def chained_cost(spark, sf_dir):
    return _long(huffman.part_cost(huffman.chained_hist(_codes(spark, sf_dir).select("vec_id", "codes"), "sorted")), "part", "bits", "n")


NBR = f"{NN}, {CODES}, hist AS (SELECT rank, p AS part, a.codes[p + 1] AS ctx, b.codes[p + 1] AS symbol, count(*) AS cnt FROM nn JOIN arrays a USING (vec_id) JOIN arrays b ON b.vec_id = nn.nbr_id, range({PARTS}) t(p) GROUP BY ALL)"


@query(f"WITH {NBR} SELECT * FROM hist")
def neighbor_rank_hist(spark, sf_dir):
    return _long(huffman.neighbour_hist(_codes(spark, sf_dir), knn.exact_knn(_vectors(spark, sf_dir), K)), "rank", "part", "ctx", "symbol", "cnt")


@query(f"{REC}{NBR}, {_cost('rank, part, ctx')} SELECT rank, CAST((SELECT count(*) FROM embeddings) AS BIGINT) AS known, CAST(sum(bits) AS BIGINT) AS bits, round(sum(bits) / (SELECT count(*) * {PARTS * 8} FROM embeddings), 6) AS compression_rate, round(sum(bits) / (SELECT count(*) * {PARTS} FROM embeddings), 6) AS bits_per_byte FROM cost GROUP BY rank")
def neighbor_rank_cost(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    e = estimate.neighbour_estimate(_codes(spark, sf_dir), knn.exact_knn(v, K), v.count(), PARTS)
    return e.select(F.col("rank").cast("long").alias("rank"), "known", "bits", F.round("compression_rate", 6).alias("compression_rate"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query(f"{REC}{ORDER0}, {_cost('part')}, n AS (SELECT count(*) AS n FROM embeddings) SELECT CAST((SELECT n FROM n) AS BIGINT) AS num_vectors, CAST(0 AS BIGINT) AS num_roots, CAST(sum(bits) AS BIGINT) AS bits, round(sum(bits) / ((SELECT n FROM n) * {PARTS * 8}), 6) AS compression_rate, round(sum(bits) / ((SELECT n FROM n) * {PARTS}), 6) AS bits_per_byte FROM cost")
def stats_report(spark, sf_dir):
    codes = _codes(spark, sf_dir)
    r = huffman.stats_report(huffman.part_cost(huffman.order0_hist(codes)), codes.count(), PARTS)
    return r.select("num_vectors", "num_roots", "bits", F.round("compression_rate", 6).alias("compression_rate"), F.round("bits_per_byte", 6).alias("bits_per_byte"))


@query("SELECT 0::BIGINT AS bad_groups")
def codebook_prefix_free(spark, sf_dir):
    """Groups whose code lengths break Kraft's equation, or whose size differs from the optimal cost."""
    hist = materialize(huffman.chained_hist(_codes(spark, sf_dir).select("vec_id", "codes"), "sorted"), "hist")
    book = huffman.codebooks(hist)
    per = book.groupBy("part", "ctx").agg(F.sum(F.pow(F.lit(2.0), -F.col("bit_length"))).alias("kraft"), F.sum(F.col("cnt") * F.col("bit_length")).alias("size"), F.count("*").alias("symbols"), F.countDistinct("code").alias("codes"))
    j = per.join(huffman.group_cost(hist), ["part", "ctx"])
    bad = ((F.col("symbols") > 1) & (F.abs(F.col("kraft") - 1) > 1e-9)) | (F.col("size") != F.col("bits")) | (F.col("symbols") != F.col("codes"))
    return j.filter(bad).agg(F.count("*").alias("bad_groups"))


# -- forests and trees ---------------------------------------------------------------------------------------------

_HAM = f"list_sum(list_transform(range({PARTS}), lambda p: (a.codes[p + 1] <> b.codes[p + 1])::INT))"


def _penalised(expr: str) -> str:
    return f"""WITH {NN}, {CODES}, e AS (SELECT nn.vec_id AS source, nn.nbr_id AS target, {expr} AS dist FROM nn JOIN arrays a USING (vec_id) JOIN arrays b ON b.vec_id = nn.nbr_id)
SELECT source, target, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY dist, target) AS r FROM e) WHERE r <= 3"""


def _edges(spark, sf_dir, penalty):
    e = graph.candidate_edges(knn.exact_knn(_vectors(spark, sf_dir), K), 3, _codes(spark, sf_dir), penalty)
    return e.select("source", "target", F.round("dist", 6).alias("dist"))


@query(_penalised(f"dist + 0.25 * {_HAM}"))
def penalised_edges(spark, sf_dir):
    return _edges(spark, sf_dir, 0.25)


@query(_penalised(f"{_HAM}::DOUBLE"))
def penalised_edges_inf(spark, sf_dir):
    return _edges(spark, sf_dir, float("inf"))


@query(f"{REC}{MST} SELECT u, v, round(dist, 6) AS dist FROM mst")
def mst_edges(spark, sf_dir):
    return _forest(spark, sf_dir).select("u", "v", F.round("dist", 6).alias("dist"))


@query(f"{REC}{MST} SELECT u, v, round(dist, 6) AS dist FROM mst")
def mst_edges_contracted(spark, sf_dir):
    """The same forest by contraction rounds alone, as a graph beyond one task's memory takes them."""
    f = graph.spanning_forest(graph.candidate_edges(_exact(spark, sf_dir), TAKE), one_task=0)
    return f.select("u", "v", F.round("dist", 6).alias("dist"))


@query(f"{REC}{MST} SELECT (SELECT count(*) FROM embeddings) AS vertices, count(*) AS edges, (SELECT count(*) FROM embeddings) - count(*) AS num_roots, round(sum(dist), 6) AS weight FROM mst")
def mst_summary(spark, sf_dir):
    s = graph.forest_summary(_vectors(spark, sf_dir), _forest(spark, sf_dir))
    return s.select("vertices", "edges", "num_roots", F.round("weight", 6).alias("weight"))


@query(f"{REC}{TREE}, c AS (SELECT t.vec_id, count(x.vec_id) AS symbol FROM tree t LEFT JOIN tree x ON x.parent_id = t.vec_id GROUP BY t.vec_id) SELECT symbol, count(*) AS cnt FROM c GROUP BY symbol")
def tree_child_hist(spark, sf_dir):
    return _long(graph.child_count_hist(_tree(spark, sf_dir)), "symbol", "cnt")


TREE_HIST = f"{TREE}, {CODES}, hist AS (SELECT p AS part, b.codes[p + 1] AS ctx, a.codes[p + 1] AS symbol, count(*) AS cnt FROM tree JOIN arrays a USING (vec_id) JOIN arrays b ON b.vec_id = tree.parent_id, range({PARTS}) t(p) GROUP BY ALL)"


@query(f"{REC}{TREE_HIST} SELECT * FROM hist")
def tree_context_hist(spark, sf_dir):
    return _long(huffman.tree_hist(_codes(spark, sf_dir), _tree(spark, sf_dir)), "part", "ctx", "symbol", "cnt")


@query(f"{REC}{TREE_HIST}, {_cost('part, ctx')} SELECT part, CAST(sum(bits) AS BIGINT) AS bits, CAST(sum(n) AS BIGINT) AS n FROM cost GROUP BY part")
def tree_cost(spark, sf_dir):
    return _long(estimate.tree_cost(_codes(spark, sf_dir), _tree(spark, sf_dir)), "part", "bits", "n")


@query(f"{REC}{TREE}, o(vec_id, parent_id, path) AS (SELECT vec_id, parent_id, [vec_id] FROM tree WHERE parent_id IS NULL UNION ALL SELECT t.vec_id, t.parent_id, list_append(o.path, t.vec_id) FROM tree t JOIN o ON t.parent_id = o.vec_id) SELECT row_number() OVER (ORDER BY path) - 1 AS pos, vec_id, parent_id, path[1] AS root_id FROM o")
def dfs_order(spark, sf_dir):
    return _tree(spark, sf_dir).select("pos", "vec_id", "parent_id", "root_id")


@query(f"{REC}{TREE}, d AS (SELECT t.vec_id, count(x.vec_id) AS symbol FROM tree t LEFT JOIN tree x ON x.parent_id = t.vec_id GROUP BY t.vec_id), hist AS (SELECT 0 AS part, symbol, count(*) AS cnt FROM d GROUP BY symbol), {_cost('part')} SELECT CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n, (SELECT max(symbol) + 1 FROM hist) AS alphabet FROM cost")
def child_count_cost(spark, sf_dir):
    return _long(estimate.child_count_cost(_tree(spark, sf_dir)), "bits", "n", "alphabet")


@query(f"{REC}{MST}, arcs AS (SELECT u AS a, v AS b FROM mst UNION ALL SELECT v, u FROM mst) SELECT a AS source, count(*) AS degree, string_agg(b::VARCHAR, ',' ORDER BY b) AS targets FROM arcs GROUP BY a")
def forest_adjacency(spark, sf_dir):
    a = graph.adjacency(_forest(spark, sf_dir))
    return a.select("source", F.size("targets").cast("long").alias("degree"), F.array_join(F.transform("targets", lambda x: x.cast("string")), ",").alias("targets"))


@query(f"WITH {NN} SELECT vec_id, sum(CASE WHEN near THEN 1 ELSE 0 END)::BIGINT AS mutual FROM (SELECT a.vec_id, b.vec_id IS NOT NULL AS near FROM nn a LEFT JOIN nn b ON a.vec_id = b.nbr_id AND a.nbr_id = b.vec_id) GROUP BY vec_id")
def mutual_neighbours(spark, sf_dir):
    """How many of a vector's neighbours have it among their own."""
    nn = _exact(spark, sf_dir)
    back = nn.select(F.col("nbr_id").alias("vec_id"), F.col("vec_id").alias("nbr_id"), F.lit(1).alias("near"))
    return nn.join(back, ["vec_id", "nbr_id"], "left").groupBy("vec_id").agg(F.sum(F.coalesce("near", F.lit(0))).cast("long").alias("mutual"))


@query()
def pq_trained(spark, sf_dir):
    """Codes' error and bits with trained codebooks: 256 centroids, 10 steps. SQL is too slow for it; a test holds it against plain loops."""
    from vecpress.plans import jobs

    codes, _, error = jobs.quantize(_vectors(spark, sf_dir), PARTS)
    bits = huffman.part_cost(huffman.order0_hist(materialize(codes, "codes"))).agg(F.sum("bits").cast("long").alias("bits"))
    return error.select(F.round("pq_error", 6).alias("pq_error")).join(bits)  # one row each


# -- coding ----------------------------------------------------------------------------------------------------------


ONE_CHUNK = 1 << 40


def _roundtrip(spark, sf_dir, mode: str, order: str = "sorted", seed: int = 0) -> DataFrame:
    """Mismatches after decoding small chunks, and the bits of the streams when each is one chunk."""
    codes = materialize(_codes(spark, sf_dir).select("vec_id", "codes"), "codes")
    tree = None
    if mode == "tree":
        tree = _tree(spark, sf_dir)
        book = materialize(huffman.codebooks(huffman.tree_hist(codes, tree)), "book")
        chunks, whole = (codec.encode_tree(codes, tree, book, n) for n in (100, ONE_CHUNK))
    elif mode == "chained":
        book = materialize(huffman.codebooks(huffman.chained_hist(codes, order, seed)), "book")
        chunks, whole = (codec.encode_chained(codes, book, order, n, seed) for n in (100, ONE_CHUNK))
    else:
        book = materialize(huffman.codebooks(huffman.order0_hist(codes)), "book")
        chunks, whole = (codec.encode_order0(codes, book, order, n, seed) for n in (100, ONE_CHUNK))
    wrong = codec.mismatches(codec.decode(materialize(chunks, "chunks"), book, mode, PARTS, tree), codes)
    sizes = whole.agg(F.sum("n_bits").cast("long").alias("n_bits"), F.sum("counts_bits").cast("long").alias("counts_bits"), F.sum(F.octet_length("data")).cast("long").alias("bytes"))
    return wrong.join(sizes)  # one row each


def _sizes(bits: str, counts: str = "0") -> str:
    return f"SELECT 0::BIGINT AS mismatches, ({bits})::BIGINT AS n_bits, ({counts})::BIGINT AS counts_bits, CAST(ceil(({bits}) / 8.0) AS BIGINT) AS bytes"


@query(f"{REC}{ORDER0}, {_cost('part')} {_sizes('SELECT sum(bits) FROM cost')}")
def codec_roundtrip_order0(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "order0")


@query(f"{REC}{SORTED}{CHAIN}, {_cost('part, ctx')} {_sizes(f'SELECT sum(bits) + {8 * PARTS} FROM cost')}")
def codec_roundtrip_chained(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "chained")


DEGREES = f"dhist AS (SELECT symbol, count(*) AS cnt FROM (SELECT t.vec_id, count(x.vec_id) AS symbol FROM tree t LEFT JOIN tree x ON x.parent_id = t.vec_id GROUP BY t.vec_id) GROUP BY symbol)"
_DEGREE_COST = _cost("part").replace("hist", "(SELECT 0 AS part, cnt FROM dhist)").replace("g AS", "dg AS").replace("h(", "dh(").replace("FROM g", "FROM dg").replace("FROM h", "FROM dh").replace("cost AS", "dcost AS")


@query(f"{REC}{TREE_HIST}, {_cost('part, ctx')}, {DEGREES}, {_DEGREE_COST} SELECT 0::BIGINT AS mismatches, ((SELECT sum(bits) FROM cost) + {8 * PARTS} * (SELECT count(*) FROM roots))::BIGINT AS n_bits, (SELECT sum(bits) FROM dcost)::BIGINT AS counts_bits")
def codec_roundtrip_tree(spark, sf_dir):
    return _roundtrip(spark, sf_dir, "tree").drop("bytes")


@query("SELECT 0::BIGINT AS mismatches")
def shuffle_encode(spark, sf_dir):
    """The order is by a hash of Spark's own, so SQL has no bits for it; they are those of the shuffled order's histogram."""
    codes = materialize(_codes(spark, sf_dir).select("vec_id", "codes"), "codes")
    cost = huffman.part_cost(huffman.chained_hist(codes, "shuffled", 42)).agg((F.sum("bits") + 8 * PARTS).alias("bits"))
    got = _roundtrip(spark, sf_dir, "chained", "shuffled", 42)
    return got.join(cost).select((F.col("mismatches") + F.abs(F.col("n_bits") - F.col("bits"))).cast("long").alias("mismatches"))


@query(f"{REC}{SORTED}{CHAIN}, {_cost('part, ctx')} SELECT part::BIGINT AS part, round(sum(bits) / sum(n), 6) AS mean_length FROM cost GROUP BY part")
def mean_code_length(spark, sf_dir):
    book = huffman.codebooks(huffman.chained_hist(_codes(spark, sf_dir).select("vec_id", "codes"), "sorted"))
    return book.groupBy(F.col("part").cast("long").alias("part")).agg(F.round(F.sum(F.col("cnt") * F.col("bit_length")) / F.sum("cnt"), 6).alias("mean_length"))


@query(f"WITH {CODES}, pairs3 AS (SELECT a.vec_id, b.vec_id AS other, {_D.format(a='a.embedding', b='b.embedding')} AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT p.vec_id, round(d, 6) AS d, (SELECT list_sum(list_transform(range({PARTS}), lambda k: (x.codes[k + 1] <> y.codes[k + 1])::INT)) FROM arrays x, arrays y WHERE x.vec_id = p.vec_id AND y.vec_id = p.other)::BIGINT AS hamming FROM pairs3 p")
def sql_distances(spark, sf_dir):
    """The SQL functions of distances, on each vector and the next."""
    from vecpress.plans import sql

    sql.register(spark)
    both = _vectors(spark, sf_dir).join(_codes(spark, sf_dir).select("vec_id", F.col("codes").cast("array<int>").alias("codes")), "vec_id")
    both.createOrReplaceTempView("vecpress_vectors")
    return spark.sql("select a.vec_id, round(l2_sq(a.embedding, b.embedding), 6) as d, cast(code_hamming(a.codes, b.codes) as bigint) as hamming from vecpress_vectors a join vecpress_vectors b on b.vec_id = a.vec_id + 1")


@query(f"{REC}{ORDER0}, {_cost('part')} SELECT part::BIGINT AS part, CAST(bits AS BIGINT) AS bits, CAST(bits AS BIGINT) AS coded FROM cost")
def sql_huffman(spark, sf_dir):
    """Optimal bits by one SQL function, and those of the codes that another one builds."""
    from vecpress.plans import sql

    sql.register(spark)
    huffman.order0_hist(_codes(spark, sf_dir)).createOrReplaceTempView("vecpress_hist")
    return spark.sql(f"""
        with h as (select part, transform(sequence(0, {CENTROIDS - 1}), s -> coalesce(element_at(map_from_entries(collect_list(struct(symbol, cnt))), s), 0L)) as counts from vecpress_hist group by part),
        c as (select part, counts, huffman_codes(counts) as codes from h)
        select cast(part as bigint) as part, huffman_cost(counts) as bits, cast(aggregate(sequence(0, {CENTROIDS - 1}), 0L, (s, i) -> s + counts[i] * coalesce(length(codes[i]), 0)) as bigint) as coded from c""")


@query(f"{REC}{CODES} SELECT vec_id, codes[1]::BIGINT AS first, codes[{PARTS}]::BIGINT AS last, list_sum(codes)::BIGINT AS total FROM arrays")
def sql_huffman_decode(spark, sf_dir):
    """Chained chunks of a hundred vectors, decoded by the SQL table function."""
    from vecpress.plans import sql

    sql.register(spark)
    codes = materialize(_codes(spark, sf_dir).select("vec_id", "codes"), "codes")
    book = materialize(huffman.codebooks(huffman.chained_hist(codes, "sorted")), "book")
    materialize(codec.encode_chained(codes, book, "sorted", 100), "chunks").createOrReplaceTempView("vecpress_chunks")
    book.createOrReplaceTempView("vecpress_book")
    return spark.sql("""
        with c as (select part, ctx, map_from_entries(collect_list(struct(symbol, code))) as codes from vecpress_book group by part, ctx),
        p as (select part, map_from_entries(collect_list(struct(ctx, codes))) as book from c group by part),
        b as (select transform(array_sort(collect_list(struct(part, map_entries(book) as e)), (x, y) -> x.part - y.part), x -> map_from_entries(x.e)) as books from p)
        select k.vec_ids[d.place] as vec_id, cast(d.codes[0] as bigint) as first, cast(element_at(d.codes, -1) as bigint) as last, aggregate(d.codes, 0L, (s, x) -> s + x) as total
        from vecpress_chunks k cross join b, lateral huffman_decode(k.data, k.n_bits, b.books) d""")


@query(f"WITH {NN} SELECT vec_id, rank, nbr_id, round(dist, 4) AS dist FROM nn")
def neighbour_files_roundtrip(spark, sf_dir):
    """Exact neighbours written as files of the exchange format, in three parts, and read back.

    The format's distances are 32-bit floats, which round to other decimals now and then; a file beside them holds the rest.
    """
    from vecpress.session import shared_dir
    from vecpress.sources import files

    root = tempfile.mkdtemp(prefix="nn-", dir=_made(shared_dir(spark)))
    v = _vectors(spark, sf_dir)
    files.save_neighbours(v, _exact(spark, sf_dir), K, f"{root}/ids", f"{root}/dist", 3, f"{root}/rest")
    nn = materialize(files.load_neighbours(spark, f"{root}/ids", f"{root}/dist", f"{root}/rest"), "nn")
    shutil.rmtree(root)
    return nn.select("vec_id", F.col("rank").cast("long").alias("rank"), "nbr_id", F.round("dist", 4).alias("dist"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding[9:16], lambda x: x::DOUBLE)), 4) AS sub, len(embedding[9:16])::BIGINT AS dims FROM embeddings ORDER BY vec_id LIMIT 100")
def vecs_sub_dim_limit(spark, sf_dir):
    """Dimensions 8 to 15 of the first hundred rows of a file, chosen at the scan."""
    from vecpress.session import shared_dir
    from vecpress.sources import vecs

    vecs.register(spark)
    root = tempfile.mkdtemp(prefix="vecs-", dir=_made(shared_dir(spark)))
    v = _vectors(spark, sf_dir).repartitionByRange(2, "vec_id").sortWithinPartitions("vec_id")
    v.write.format("vecs").option("path", f"{root}/x").option("kind", "fvecs").mode("overwrite").save()
    some = spark.read.format("vecs").option("path", f"{root}/x").option("sub_start", 8).option("sub_dim", 8).option("limit", 100).load()
    got = materialize(some, "some")
    shutil.rmtree(root)
    return got.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 4).alias("sub"), F.size("embedding").cast("long").alias("dims"))


def _made(folder: str) -> str:
    folder = folder.removeprefix("file://").removeprefix("file:")
    os.makedirs(folder, exist_ok=True)
    return folder


@query("SELECT 0::BIGINT AS mismatches")
def vecs_io_roundtrip(spark, sf_dir):
    """Vectors written as files of the exchange format and read back; ids follow the order of files and rows."""
    from vecpress.session import shared_dir
    from vecpress.sources import vecs

    vecs.register(spark)
    root = tempfile.mkdtemp(prefix="vecs-", dir=_made(shared_dir(spark)))
    v = materialize(_vectors(spark, sf_dir).repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id"), "vectors")
    for kind in ("fvecs", "fvecsl"):
        v.coalesce(1).sortWithinPartitions("vec_id").select("vec_id", "embedding").write.format("vecs").option("path", f"{root}/{kind}").option("kind", kind).mode("append").save()
    a, b = (materialize(spark.read.format("vecs").option("path", f"{root}/{kind}").load(), kind) for kind in ("fvecs", "fvecsl"))
    shutil.rmtree(root)
    lack = [x.exceptAll(y) for x, y in ((a, v), (v, a), (b, v), (v, b))]
    return lack[0].unionByName(lack[1]).unionByName(lack[2]).unionByName(lack[3]).agg(F.count("*").alias("mismatches"))


# -- the same statistics over larger tables ------------------------------------------------------------------------------

_LINE = "line AS (SELECT l_quantity::INT AS a, round(l_discount * 100)::INT AS b, round(l_tax * 100)::INT AS c, l_returnflag AS flag FROM lineitem)"


@query(f"{REC}{_LINE}, hist AS (SELECT 0 AS part, a AS s, count(*) AS cnt FROM line GROUP BY ALL UNION ALL SELECT 1, b, count(*) FROM line GROUP BY ALL UNION ALL SELECT 2, c, count(*) FROM line GROUP BY ALL), {_cost('part')} SELECT part::BIGINT AS part, CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n FROM cost")
def lineitem_order0_cost(spark, sf_dir):
    t = _read(spark, sf_dir, "lineitem")
    parts = F.array(F.col("l_quantity").cast("int"), F.round(F.col("l_discount") * 100).cast("int"), F.round(F.col("l_tax") * 100).cast("int"))
    hist = t.select(F.posexplode(parts).alias("part", "symbol")).groupBy("part", "symbol").agg(F.count("*").alias("cnt")).withColumn("ctx", F.lit(huffman.NO_CTX))
    return _long(huffman.part_cost(hist), "part", "bits", "n")


@query(f"{REC}{_LINE}, hist AS (SELECT flag, a AS s, count(*) AS cnt FROM line GROUP BY ALL), {_cost('flag')} SELECT flag, CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n FROM cost")
def lineitem_context_cost(spark, sf_dir):
    t = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.col("l_quantity").cast("int").alias("s")).agg(F.count("*").alias("cnt"))
    return t.groupBy("flag").agg(huffman.huffman_cost(F.collect_list("cnt")).alias("bits"), F.sum("cnt").alias("n"))


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for b in batches:
        t = b.column(0)
        if len(t):
            o = np.frombuffer(t.buffers()[1], np.int32)[t.offset : t.offset + len(t) + 1]
            total += np.bincount(np.frombuffer(t.buffers()[2] or b"", np.uint8)[o[0] : o[-1]], minlength=256)
    s = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(s, pa.int32()), pa.array(total[s])], names=["symbol", "cnt"])


@query(f"""{REC}bytes AS (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS symbol FROM documents WHERE text IS NOT NULL),
hist AS (SELECT 0 AS part, symbol, count(*) AS cnt FROM bytes GROUP BY symbol), {_cost('part')} SELECT CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n FROM cost""")
def document_bytes_cost(spark, sf_dir):
    ship_package(spark)
    t = _read(spark, sf_dir, "documents").select(F.coalesce("text", F.lit("")).alias("text"))
    hist = t.mapInArrow(_byte_counts, "symbol int, cnt long").groupBy("symbol").agg(F.sum("cnt").alias("cnt"))
    return hist.agg(huffman.huffman_cost(F.collect_list("cnt")).alias("bits"), F.sum("cnt").alias("n"))


@query(f"""{REC}p AS (SELECT event_type AS s, lag(event_type) OVER (ORDER BY event_id) AS ctx FROM events), hist AS (SELECT ctx, s, count(*) AS cnt FROM p WHERE ctx IS NOT NULL GROUP BY ALL), {_cost('ctx')}
SELECT ctx, CAST(bits AS BIGINT) AS bits, CAST(n AS BIGINT) AS n FROM cost""")
def event_chain_cost(spark, sf_dir):
    t = with_position(_read(spark, sf_dir, "events").select("event_id", "event_type"), ["event_id"], carry="event_type")
    h = t.filter("prev is not null").groupBy(F.col("prev").alias("ctx"), "event_type").agg(F.count("*").alias("cnt"))
    return h.groupBy("ctx").agg(huffman.huffman_cost(F.collect_list("cnt")).alias("bits"), F.sum("cnt").alias("n"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their histogram, and the optimal size of each part."""
    codes = _codes(spark, sf_dir)
    n = codes.count()
    cost = huffman.part_cost(huffman.order0_hist(codes))
    return cost.select(F.col("part").cast("long").alias("part"), "bits", (F.col("bits") / F.lit(8.0 * n)).alias("compression_rate"), (F.col("bits") / F.lit(float(n))).alias("bits_per_byte")).orderBy("part")
