"""The eight jobs of the engine, with the parameters that a command line would take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.operators import blocks, codec, compare, estimate, graph, huffman, knn, pq
from vecpress.session import materialize


def nn_exact(vectors: DataFrame, k: int = 50) -> DataFrame:
    return knn.exact_knn(vectors, k)


def nn_fast(vectors: DataFrame, k: int = 50, dims: int = 5, n_blocks: int = 3, overlap: float = 0.3, block_range: tuple[int, int] | None = None, old: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Block neighbours; with ``old``, merged into an earlier run's table."""
    new = blocks.block_knn(vectors, k, dims, n_blocks, overlap, block_range, bounds)
    return new if old is None else knn.merge_nn(old, new, k)


def quantize(vectors: DataFrame, parts: int, centroids: int = 256, iterations: int = 10, start: str = "first", seed: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Codes, centroids and the error."""
    book = pq.lloyd(vectors, parts, centroids, iterations, start, seed)
    encoded = pq.encode(vectors, book)
    return encoded.select("vec_id", "codes"), pq.centroid_table(vectors.sparkSession, book), pq.quantization_error(encoded)


def estimate_neighbours(codes: DataFrame, nn: DataFrame, parts: int) -> DataFrame:
    return estimate.neighbour_estimate(codes, nn, codes.count(), parts)


def spanning_tree(nn: DataFrame, take: int, codes: DataFrame | None = None, penalty: float = 0.0, parts: int | None = None, vectors: DataFrame | None = None):
    """Forest, preorder and, with codes, the report of its estimated size (``tree_children`` has that of the child counts)."""
    nodes = (vectors if vectors is not None else codes if codes is not None else nn).select("vec_id").distinct()
    forest = materialize(graph.spanning_forest(graph.candidate_edges(nn, take, codes, penalty)), "forest")
    tree = graph.tree_order(nodes, forest)
    report = None
    if codes is not None and parts:
        n = codes.count()
        roots = tree.filter("parent_id is null").count()
        report = huffman.stats_report(estimate.tree_cost(codes, tree), n, parts, roots)
    return forest, tree, report


def tree_children(tree: DataFrame) -> DataFrame:
    """Report of the second stream of a coded tree: the numbers of children."""
    return estimate.child_count_report(tree)


def huffman_encode(codes: DataFrame, parts: int, sort: str = "sorted", context: bool = True, tree: DataFrame | None = None, only_estimate: bool = False, chunk_rows: int = codec.CHUNK_ROWS, seed: int = 0, tree_chunk_rows: int = codec.CHUNK_ROWS):
    """Report, codebooks and chunks (None with ``only_estimate``). The tree mode never reorders codes."""
    n = codes.count()
    if tree is not None:
        hist, roots = huffman.tree_hist(codes, tree), tree.filter("parent_id is null").count()
    elif context:
        hist, roots = huffman.chained_hist(codes, sort, seed), 1
    else:
        hist, roots = huffman.order0_hist(codes), 0
    hist = materialize(hist, "hist")
    report = huffman.stats_report(huffman.part_cost(hist), n, parts, roots)
    if only_estimate:
        return report, None, None
    book = materialize(huffman.codebooks(hist), "book")
    if tree is not None:
        return report, book, codec.encode_tree(codes, tree, book, tree_chunk_rows)
    if context:
        # codes across a chunk's edge are raw, so every pair within a chunk is in the book
        return report, book, codec.encode_chained(codes, book, sort, chunk_rows, seed)
    return report, book, codec.encode_order0(codes, book, sort, chunk_rows, seed)


def huffman_decode(chunks: DataFrame, book: DataFrame, mode: str, parts: int, tree: DataFrame | None = None, check: DataFrame | None = None) -> DataFrame:
    """Decoded codes with ids; with ``check``, the number of rows that differ instead."""
    out = codec.decode(chunks, book, mode, parts, tree)
    return out if check is None else codec.mismatches(out, check)


def run_chain(vectors: DataFrame, parts: int, k: int = 50, take: int = 5, penalty: float = 0.0, centroids: int = 256, iterations: int = 10, exact: bool = False) -> DataFrame:
    """All jobs, one after another: quantize, find neighbours, build the tree, code without context, chained and
    along the tree, decode and check. A row for each coding: ``mode, num_vectors, bits, compression_rate, mismatches``."""
    codes = materialize(quantize(vectors, parts, centroids, iterations)[0], "codes")
    nn = materialize(nn_exact(vectors, k) if exact else nn_fast(vectors, k), "nn")
    tree = materialize(spanning_tree(nn, take, codes, penalty, vectors=vectors)[1], "tree")
    out: DataFrame | None = None
    for mode in ("order0", "chained", "tree"):
        own = tree if mode == "tree" else None
        report, book, chunks = huffman_encode(codes, parts, context=mode == "chained", tree=own)
        checked = huffman_decode(materialize(chunks, "chunks"), book, mode, parts, own, codes)
        row = report.select(F.lit(mode).alias("mode"), "num_vectors", "bits", "compression_rate").join(checked)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def compare_nn(exact: DataFrame, fast: DataFrame, k: int) -> DataFrame:
    n = exact.agg(F.countDistinct("vec_id")).first()[0]
    return compare.compare_json(exact, fast, n, k)
