"""Trees, codebooks, neighbour results and block grids in their binary interchange forms."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Mapping

import numpy as np

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecpress.functions.bits import decode_varint, encode_varint, pack_bits, unpack_bits
from vecpress.session import ship_package
from vecpress.sources import vecs
from vecpress.sources.vecs import read_rows, write_rows

#: Stands for a missing neighbour in result files; its distance is infinite: fixed value.
MISSING = 2**32 - 1


def write_tree(path: str, targets: list[list[int]]) -> None:
    """Neighbours of vertices 0..V-1; an edge occurs at both of its ends."""
    degree = np.array([len(t) for t in targets], "<i4")
    flat = np.array([x for t in targets for x in t], "<u4")
    with open(path, "wb") as f:
        f.write(struct.pack("<qq", len(targets), len(flat)) + flat.tobytes() + degree.tobytes())


def read_tree(path: str) -> list[list[int]]:
    with open(path, "rb") as f:
        data = f.read()
    v, e = struct.unpack_from("<qq", data)
    if len(data) != 16 + 4 * e + 4 * v:
        raise ValueError(f"{path}: the size doesn't fit {v} vertices and {e} edges")
    flat, degree = np.frombuffer(data, "<u4", e, 16), np.frombuffer(data, "<i4", v, 16 + 4 * e)
    ends = np.cumsum(degree)
    if v and ends[-1] != e:
        raise ValueError(f"{path}: degrees don't add up to the edges")
    return [flat[b - n : b].tolist() for b, n in zip(ends, degree)]


def dump_book(codes: Mapping[int, str], alphabet: int, context: bool = False) -> bytes:
    """A book: alphabet, kind, the length of each item as a varint, then the codes' bits, filled up to a byte.

    Items are symbols, or context * alphabet + symbol.
    """
    items = [codes.get(i, "") for i in range(alphabet * alphabet if context else alphabet)]
    return struct.pack("<iB", alphabet, context) + b"".join(encode_varint(len(c)) for c in items) + pack_bits("".join(items))


def load_book(data: bytes, at: int = 0) -> tuple[dict[int, str], int, bool, int]:
    """Codes, alphabet, whether it has contexts, and the place after the book."""
    alphabet, context = struct.unpack_from("<iB", data, at)
    at += 5
    sizes = []
    for _ in range(alphabet * alphabet if context else alphabet):
        n, at = decode_varint(data, at)
        sizes.append(n)
    size = -(-sum(sizes) // 8)
    bits, codes, place = unpack_bits(data[at : at + size]), {}, 0
    for i, n in enumerate(sizes):
        if n:
            codes[i] = bits[place : place + n]
        place += n
    return codes, alphabet, bool(context), at + size


def write_books(path: str, books: list[bytes], prefix: bool = True) -> None:
    with open(path, "wb") as f:
        f.write((struct.pack("<I", len(books)) if prefix else b"") + b"".join(books))


def read_books(path: str, prefix: bool = True) -> list[tuple[dict[int, str], int, bool]]:
    with open(path, "rb") as f:
        data = f.read()
    at = 4 if prefix else 0
    n = struct.unpack_from("<I", data)[0] if prefix else 1
    out = []
    for _ in range(n):
        *book, at = load_book(data, at)
        out.append(tuple(book))
    return out


def write_stream(path: str, n: int | None, bits: str) -> None:
    """A bit stream, after the number of vectors if there is one."""
    with open(path, "wb") as f:
        f.write((b"" if n is None else struct.pack("<Q", n)) + pack_bits(bits))


def read_stream(path: str, counted: bool = True) -> tuple[int | None, str]:
    with open(path, "rb") as f:
        data = f.read()
    return (struct.unpack_from("<Q", data)[0], unpack_bits(data[8:])) if counted else (None, unpack_bits(data))


def write_neighbours(ids_path: str, dist_path: str, rows: list[list[tuple[int, float]]], k: int) -> None:
    """Neighbour lists as two light files, filled up with missing neighbours."""
    ids, dist = np.full((len(rows), k), MISSING, "<u4"), np.full((len(rows), k), np.inf, "<f4")
    for i, r in enumerate(rows):
        ids[i, : len(r)], dist[i, : len(r)] = [x for x, _ in r], [d for _, d in r]
    write_rows(ids_path, ids.view("<i4"))
    write_rows(dist_path, dist)


def read_neighbours(ids_path: str, dist_path: str) -> list[tuple[int, int, int, float]]:
    """(vec_id, rank, nbr_id, dist) without missing neighbours; both files must have the same shape."""
    ids, dist = read_rows(ids_path), read_rows(dist_path)
    if ids.shape != dist.shape:
        raise ValueError(f"shapes differ: {ids.shape} and {dist.shape}")
    ids = ids.astype(np.int64) & MISSING
    at = np.argwhere(ids != MISSING)
    return [(int(i), int(j) + 1, int(ids[i, j]), float(dist[i, j])) for i, j in at]


def write_grid(path: str, bounds: list[tuple[int, int, float, float]], dims: int, blocks: int, overlap: float) -> None:
    """A block grid from (dim, block, start, end); the first dimension is the most significant."""
    with open(path, "wb") as f:
        f.write(struct.pack("<idiq", dims, overlap, blocks, blocks**dims))
        for d in range(dims):
            own = sorted((b, s, e) for dim, b, s, e in bounds if dim == d)
            f.write(struct.pack("<iq", d, blocks ** (dims - 1 - d)) + np.array([s for _, s, _ in own] + [e for _, _, e in own], "<f4").tobytes())


def read_grid(path: str) -> tuple[list[tuple[int, int, float, float]], int, int, float]:
    with open(path, "rb") as f:
        data = f.read()
    dims, overlap, blocks, _ = struct.unpack_from("<idiq", data)
    at, out = struct.calcsize("<idiq"), []
    for _ in range(dims):
        d, _mask = struct.unpack_from("<iq", data, at)
        x = np.frombuffer(data, "<f4", 2 * blocks, at + 12)
        out += [(d, b, float(x[b]), float(x[blocks + b])) for b in range(blocks)]
        at += 12 + 8 * blocks
    return out, dims, blocks, overlap


# -- as tables -----------------------------------------------------------------------------------------


def load_neighbours(spark: SparkSession, ids_path: str, dist_path: str, rest_path: str | None = None) -> DataFrame:
    """``vec_id, rank, nbr_id, dist`` from files or folders of light files, without missing neighbours.

    Distances are as exact as 32-bit floats; with ``rest_path`` they are the doubles that were saved.
    """
    vecs.register(spark)
    ids, dist = (spark.read.format("vecs").option("path", p).load() for p in (ids_path, dist_path))
    both = ids.join(dist.select("vec_id", F.col("embedding").alias("dist")), "vec_id")
    lists = [F.col("embedding").alias("i"), F.col("dist").alias("d")]
    if rest_path:
        rest = spark.read.format("vecs").option("path", rest_path).load()
        both = both.join(rest.select("vec_id", F.col("embedding").alias("rest")), "vec_id")
        lists.append(F.col("rest").alias("r"))
    rows = both.select("vec_id", F.posexplode(F.arrays_zip(*lists)).alias("at", "x"))
    nbr = F.col("x.i").cast("long").bitwiseAND(F.lit(MISSING))
    near = F.col("x.d").cast("double")
    if rest_path:
        near = F.when(near == float("inf"), F.col("x.r")).otherwise(near + F.col("x.r"))
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("rank"), nbr.alias("nbr_id"), near.alias("dist")).filter(F.col("nbr_id") != MISSING)


def save_neighbours(vectors: DataFrame, nn: DataFrame, k: int, ids_path: str, dist_path: str, parts: int = 1, rest_path: str | None = None) -> None:
    """``nn(vec_id, rank, nbr_id, dist)`` as two folders of light files, a row for each of ``vectors(vec_id)``
    by ascending vec_id, which should be 0, 1, ... Lists are filled up with missing neighbours.

    The format's distances are 32-bit floats. ``rest_path`` gets a third folder, of what each lacks of
    its double (the double itself where the float is infinite), so that nothing is lost.
    """
    vecs.register(vectors.sparkSession)
    near = nn.filter(F.col("rank") <= k).groupBy("vec_id").agg(F.sort_array(F.collect_list(F.struct("rank", "nbr_id", "dist"))).alias("l"))
    rows = vectors.select("vec_id").join(near, "vec_id", "left").withColumn("l", F.coalesce("l", F.array().cast("array<struct<rank:int,nbr_id:bigint,dist:double>>")))

    def filled(values, missing):
        return F.concat(values, F.array_repeat(missing, F.lit(k) - F.size("l")))

    def lacking(x):
        held = x["dist"].cast("float").cast("double")
        return F.when(held == float("inf"), x["dist"]).otherwise(x["dist"] - held)

    signed = F.transform("l", lambda x: F.when(x["nbr_id"] > 2**31 - 1, x["nbr_id"] - 2**32).otherwise(x["nbr_id"]).cast("int"))
    placed = rows.select("vec_id", filled(signed, F.lit(-1)).alias("ids"), filled(F.transform("l", lambda x: x["dist"].cast("float")), F.lit(float("inf")).cast("float")).alias("dist"), filled(F.transform("l", lacking), F.lit(0.0)).alias("rest"))
    placed = placed.repartitionByRange(parts, "vec_id").sortWithinPartitions("vec_id")
    for column, path, kind in (("ids", ids_path, "ivecsl"), ("dist", dist_path, "fvecsl"), ("rest", rest_path, "dvecsl")):
        if path:
            placed.select("vec_id", F.col(column).alias("embedding")).write.format("vecs").option("path", path).option("kind", kind).mode("overwrite").save()


def _tree_ranges(path: str, rows: int) -> list[tuple[int, int, int, int, int]]:
    """First vertex, vertices, first edge and all vertices and edges of each range; degrees are added up range by range."""
    with open(path, "rb") as f:
        v, e = struct.unpack("<qq", f.read(16))
        out, edge = [], 0
        for first in range(0, v, rows):
            n = min(rows, v - first)
            f.seek(16 + 4 * e + 4 * first)
            out.append((first, n, edge, v, e))
            edge += int(np.frombuffer(f.read(4 * n), "<i4").sum())
    if edge != e:
        raise ValueError(f"{path}: degrees don't add up to the edges")
    return out


def load_tree(spark: SparkSession, path: str, rows: int = 1 << 20) -> DataFrame:
    """``source, target`` of a tree file, each edge at both of its ends; a task reads a range of vertices."""
    import pyarrow as pa

    def run(batches):
        for b in batches:
            for first, n, edge, v, e in zip(*(b.column(c).to_pylist() for c in ("first", "n", "edge", "v", "e"))):
                with open(path, "rb") as f:
                    f.seek(16 + 4 * e + 4 * first)
                    degree = np.frombuffer(f.read(4 * n), "<i4")
                    f.seek(16 + 4 * edge)
                    target = np.frombuffer(f.read(4 * int(degree.sum())), "<u4")
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(first, first + n), degree)), pa.array(target.astype(np.int64))], names=["source", "target"])

    ship_package(spark)
    path = path.removeprefix("file://").removeprefix("file:")
    ranges = spark.createDataFrame(_tree_ranges(path, rows), "first long, n long, edge long, v long, e long")
    return ranges.repartition(max(1, ranges.count())).mapInArrow(run, "source long, target long")


def save_streams(chunks: DataFrame, path: str, counts_path: str | None = None) -> None:
    """A file ``<chunk>.bin`` of each coded chunk: the number of its vectors, then its bits, filled up to a byte.

    ``counts_path`` gets those of a tree's numbers of children. The folders must be ones that executors
    can open and hold no streams yet. A file appears whole or not at all, so tasks may run again.
    """
    folders = [(path, "data")] + ([(counts_path, "counts")] if counts_path else [])
    for folder, _ in folders:
        os.makedirs(folder, exist_ok=True)
        if any(f.endswith(".bin") for f in os.listdir(folder)):
            raise FileExistsError(f"{folder} holds streams")

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                for folder, column in folders:
                    part = f"{folder}/.{r['chunk']}-{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(struct.pack("<Q", r["n"]) + r[column])
                    os.replace(part, f"{folder}/{r['chunk']}.bin")
            yield b.select(["chunk"])

    ship_package(chunks.sparkSession)
    done = chunks.select("chunk", "n", "data", "counts").mapInArrow(run, "chunk long")
    done.write.format("noop").mode("overwrite").save()


def load_streams(spark: SparkSession, path: str, counts_path: str | None = None) -> DataFrame:
    """Chunks, as ``codec.decode`` reads them, from folders of streams: without ids, with bits filled up to a byte."""

    def streams(folder: str, name: str) -> DataFrame:
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(folder)
        head = F.hex(F.substring("content", 1, 8))
        n = F.conv(F.concat(*[F.substring(head, i, 2) for i in range(15, 0, -2)]), 16, 10).cast("long")
        return files.select(F.regexp_extract("path", r"(\d+)\.bin$", 1).cast("long").alias("chunk"), n.alias("n"), F.expr("substring(content, 9)").alias(name))

    rows = streams(path, "data")
    counts = F.lit(None).cast("binary").alias("counts")
    if counts_path:
        rows, counts = rows.join(streams(counts_path, "counts").drop("n"), "chunk", "left"), F.col("counts")
    none = F.lit(None)
    return rows.select("chunk", "n", none.cast("long").alias("n_bits"), "data", none.cast("array<long>").alias("vec_ids"), counts, none.cast("long").alias("counts_bits"))


def load_books(spark: SparkSession, path: str, prefix: bool = True) -> DataFrame:
    """``part, ctx, symbol, bit_length, code`` of a file of codebooks, whose size depends on the alphabet alone."""
    rows = []
    for part, (codes, alphabet, context) in enumerate(read_books(path, prefix)):
        rows += [(part, i // alphabet if context else -1, i % alphabet, len(c), c) for i, c in codes.items()]
    return spark.createDataFrame(rows, "part int, ctx int, symbol int, bit_length int, code string")


def save_books(book: DataFrame, path: str, alphabet: int = 256, prefix: bool = True) -> None:
    """A file of the codebooks ``book(part, ctx, symbol, code)``, one for each part."""
    books: dict[int, dict[int, str]] = {}
    context = False
    for r in book.select("part", "ctx", "symbol", "code").collect():  # at most parts * alphabet * alphabet rows
        context = context or r["ctx"] >= 0
        books.setdefault(r["part"], {})[(r["ctx"] * alphabet if r["ctx"] >= 0 else 0) + r["symbol"]] = r["code"]
    write_books(path, [dump_book(books[p], alphabet, context) for p in sorted(books)], prefix)
