"""Huffman coding of code tables into bit streams, and back, with ids.

A stream is cut into chunks that are coded and decoded alone; a chunk is one task's, and its size is
the caller's. In the chained mode each chunk starts with raw symbols, in the tree mode so do vectors
whose parent lies in an earlier chunk. Codebooks have at most ``parts * 256 * 256`` rows, whatever the number of vectors, and are
sent to all tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.functions.bits import unpack_bits
from vecpress.operators import huffman
from vecpress.operators.graph import parents_from_counts
from vecpress.operators.positions import with_position
from vecpress.session import ship_package

RAW_BITS = 8
CHUNK = "chunk long, n long, n_bits long, data binary, vec_ids array<long>, counts binary, counts_bits long"
#: Vectors of a chunk.
CHUNK_ROWS = 65_536


def book_map(book: DataFrame) -> dict[tuple[int, int], dict[int, str]]:
    out: dict[tuple[int, int], dict[int, str]] = {}
    for r in book.select("part", "ctx", "symbol", "code").collect():
        out.setdefault((r["part"], r["ctx"]), {})[r["symbol"]] = r["code"]
    return out


class BookArrays:
    """Codes of a codebook, and the raw symbols, as arrays in which many are looked up at once."""

    #: The part of raw symbols.
    RAW = -1

    def __init__(self, books: dict[tuple[int, int], dict[int, str]]):
        rows = [(part, ctx, s, code) for (part, ctx), codes in books.items() for s, code in codes.items()]
        rows += [(self.RAW, huffman.NO_CTX, s, f"{s:0{RAW_BITS}b}") for s in range(1 << RAW_BITS)]
        part, ctx, symbol = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.base = int(max(ctx.max(), symbol.max())) + 2
        keys = self._keys(part, ctx, symbol)
        order = np.argsort(keys)
        codes = [rows[k][3] for k in order.tolist()]
        self.keys = keys[order]
        self.size = np.array(list(map(len, codes)), np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.flat = np.frombuffer("".join(codes).encode(), np.uint8) - ord("0")

    def _keys(self, part, ctx, symbol) -> np.ndarray:
        return ((np.asarray(part, np.int64) + 1) * self.base + ctx + 1) * self.base + symbol

    def find(self, part, ctx, symbol) -> np.ndarray:
        """Places of codes; a symbol without a code is an error."""
        symbol, ctx = np.asarray(symbol, np.int64), np.asarray(ctx, np.int64)
        keys = self._keys(part, ctx, symbol)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        if (self.keys[at] != keys).any() or (symbol < 0).any() or (symbol >= self.base).any() or (ctx < huffman.NO_CTX).any() or (ctx >= self.base - 1).any():
            raise ValueError("a symbol has no code")
        return at

    def bits(self, at: np.ndarray, step: int = 1 << 18) -> np.ndarray:
        """The bits of the codes at these places, one after another."""
        out = [np.zeros(0, np.uint8)]
        for i in range(0, len(at), step):
            size, start = self.size[at[i : i + step]], self.start[at[i : i + step]]
            before = np.cumsum(size) - size
            out.append(self.flat[np.repeat(start - before, size) + np.arange(int(size.sum()))])
        return np.concatenate(out)


#: Bits that a decoder looks up at once.
WINDOW = 10


class PrefixTable:
    """Symbols of one group by the bits that come next; codes longer than a window by their whole bits."""

    def __init__(self, codes: dict[int, str]):
        self.shift = WINDOW - min(WINDOW, max(map(len, codes.values()), default=0))
        self.short: list[tuple[int, int] | None] = [None] * (1 << (WINDOW - self.shift))
        self.long = {code: s for s, code in codes.items() if len(code) > WINDOW}
        self.lengths = sorted({len(code) for code in self.long})
        for s, code in codes.items():
            if len(code) <= WINDOW:
                fill = WINDOW - self.shift - len(code)
                first = int(code, 2) << fill
                self.short[first : first + (1 << fill)] = [(s, len(code))] * (1 << fill)


def prefix_tables(books: dict[tuple[int, int], dict[int, str]]) -> dict[tuple[int, int], PrefixTable]:
    """Of each group its table."""
    return {k: PrefixTable(v) for k, v in books.items()}


def windows(bits: str) -> memoryview:
    """The next ``WINDOW`` bits at each place of a stream, zeros after its end."""
    one = np.zeros(len(bits) + WINDOW, np.uint16)
    one[: len(bits)] = np.frombuffer(bits.encode(), np.uint8) - ord("0")
    out = np.zeros(len(bits) + 1, np.uint16)
    for k in range(WINDOW):
        out = out << 1 | one[k : k + len(out)]
    return memoryview(out)


class Decoder:
    """Reads symbols of one stream through prefix tables; the tables of many streams may be made once."""

    def __init__(self, bits: str, books: dict[tuple[int, int], dict[int, str]], tables: dict | None = None):
        self.bits, self.at, self.end = bits, 0, len(bits)
        self.tables = prefix_tables(books) if tables is None else tables
        self.windows = windows(bits)

    def raw(self) -> int:
        self.at += RAW_BITS
        if self.at > self.end:
            raise ValueError("the stream ends within a symbol")
        return int(self.bits[self.at - RAW_BITS : self.at], 2)

    def symbol(self, part: int, ctx: int = huffman.NO_CTX) -> int:
        table = self.tables.get((part, ctx))
        if table is None:
            raise ValueError(f"no codes for part {part} after {ctx}")
        found = table.short[self.windows[self.at] >> table.shift]
        if found is None:
            found = next(((s, n) for n in table.lengths if (s := table.long.get(self.bits[self.at : self.at + n])) is not None), None)
        if found is None or self.at + found[1] > self.end:
            raise ValueError("the stream holds no such code")
        self.at += found[1]
        return found[0]

    def row(self, ctx: list[int]) -> list[int]:
        """A symbol of each part, after ``ctx``."""
        out, at, tables, win, last = [], self.at, self.tables, self.windows, self.end
        for p, c in enumerate(ctx):
            table = tables.get((p, c))
            found = None if table is None else table.short[win[at] >> table.shift]
            if found is None or at + found[1] > last:  # a long code, or an error
                self.at = at
                out.append(self.symbol(p, c))
                at = self.at
            else:
                out.append(found[0])
                at += found[1]
        self.at = at
        return out


def _encode(sent, mode: str):
    made: list[BookArrays] = []  # of a task's chunks

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        books, counts_book = sent.value
        if not made:
            made.append(BookArrays(books))
            if mode == "tree":
                made.append(BookArrays({(0, huffman.NO_CTX): counts_book}))
        pdf = pdf.sort_values("pos")
        codes = np.concatenate(pdf["codes"].to_list()).astype(np.int64).reshape(len(pdf), -1)
        part = np.broadcast_to(np.arange(codes.shape[1]), codes.shape)
        ctx = np.full(codes.shape, huffman.NO_CTX, np.int64)
        if mode != "order0":
            known = pdf["ctx"].notna().to_numpy()
            part = np.where(known[:, None], part, BookArrays.RAW)
            if known.any():
                ctx[known] = np.concatenate(pdf["ctx"][known].to_list()).reshape(-1, codes.shape[1])
        bits = made[0].bits(made[0].find(part.ravel(), ctx.ravel(), codes.ravel()))
        counts = made[1].bits(made[1].find(0, huffman.NO_CTX, pdf["num_children"].to_numpy())) if mode == "tree" else np.zeros(0, np.uint8)
        row = (int(pdf["chunk"].iloc[0]), len(pdf), len(bits), np.packbits(bits).tobytes(), pdf["vec_id"].tolist(), np.packbits(counts).tobytes(), len(counts))
        return pd.DataFrame([row], columns=["chunk", "n", "n_bits", "data", "vec_ids", "counts", "counts_bits"])

    return run


def _send(rows: DataFrame, book: DataFrame, mode: str, counts: dict[int, str] | None = None) -> DataFrame:
    spark = rows.sparkSession
    ship_package(spark)
    sent = spark.sparkContext.broadcast((book_map(book), counts))
    return rows.groupBy("chunk").applyInPandas(_encode(sent, mode), CHUNK)


def encode_order0(codes: DataFrame, book: DataFrame, order: str = "sorted", chunk_rows: int = CHUNK_ROWS, seed: int = 0) -> DataFrame:
    placed = huffman.chained(codes, order, chunk_rows, seed)
    rows = placed.select(F.floor(F.col("pos") / chunk_rows).alias("chunk"), "pos", "vec_id", "codes", F.lit(None).cast("array<int>").alias("ctx"), F.lit(0).alias("num_children"))
    return _send(rows, book, "order0")


def encode_chained(codes: DataFrame, book: DataFrame, order: str = "sorted", chunk_rows: int = CHUNK_ROWS, seed: int = 0) -> DataFrame:
    """Codes given those of the vector before; the first vector of a chunk is raw."""
    placed = huffman.chained(codes, order, chunk_rows, seed)
    rows = placed.select(F.floor(F.col("pos") / chunk_rows).alias("chunk"), "pos", "vec_id", "codes", F.col("prev").alias("ctx"), F.lit(0).alias("num_children"))
    return _send(rows, book, "chained")


def child_count_codes(tree: DataFrame) -> dict[int, str]:
    hist = tree.groupBy(F.col("num_children").alias("s")).agg(F.count("*").alias("c")).collect()  # a row for each degree
    return huffman.build_codes(sorted((r["s"], r["c"]) for r in hist))


def encode_tree(codes: DataFrame, tree: DataFrame, book: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Codes in preorder given those of the parent. Numbers of children form a second stream.

    A chunk is a run of the preorder, so one large tree is coded and decoded by many tasks. Roots are
    raw, and so are vectors whose parent lies in an earlier chunk: the numbers of children tell them,
    since no vector of their own chunk lacks a child when they come.
    """
    chunk = F.floor(F.col("pos") / chunk_rows)
    own = codes.select("vec_id", "codes")
    parents = tree.select(F.col("vec_id").alias("parent_id"), chunk.alias("parent_chunk")).join(codes.select(F.col("vec_id").alias("parent_id"), F.col("codes").alias("ctx")), "parent_id")
    rows = tree.join(own, "vec_id").join(parents, "parent_id", "left").withColumn("chunk", chunk)
    ctx = F.when(F.col("chunk") == F.col("parent_chunk"), F.col("ctx"))
    rows = rows.select("chunk", "pos", "vec_id", "codes", ctx.alias("ctx"), F.col("num_children").cast("int").alias("num_children"))
    return _send(rows, book, "tree", child_count_codes(tree))


def _decode(sent, mode: str, parts: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books, counts_book = sent.value
        tables, no_ctx = prefix_tables(books), [huffman.NO_CTX] * parts
        count_tables = prefix_tables({(0, huffman.NO_CTX): counts_book}) if mode == "tree" else None
        for pdf in batches:
            for r in pdf.itertuples():
                known = not pd.isna(r.n_bits)  # streams from files are filled up to a byte
                d = Decoder(unpack_bits(r.data, int(r.n_bits) if known else None), books, tables)
                rows: list[list[int]] = []
                parent: list[int | None] = []
                if mode == "tree":
                    c = Decoder(unpack_bits(r.counts), {}, count_tables)
                    parent = parents_from_counts([c.symbol(0) for _ in range(r.n)])
                for i in range(r.n):
                    if mode == "order0":
                        rows.append(d.row(no_ctx))
                        continue
                    before = rows[parent[i]] if mode == "tree" and parent[i] is not None else rows[-1] if mode == "chained" and rows else None
                    rows.append([d.raw() for _ in range(parts)] if before is None else d.row(before))
                if d.end - d.at > (0 if known else 7):
                    raise ValueError("bits are left over")
                ids = [None] * r.n if r.vec_ids is None else list(r.vec_ids)
                yield pd.DataFrame({"chunk": r.chunk, "place": range(r.n), "vec_id": pd.array(ids, "Int64"), "codes": rows})

    return run


def decode(chunks: DataFrame, book: DataFrame, mode: str, parts: int, tree: DataFrame | None = None) -> DataFrame:
    """``chunk, place, vec_id, codes`` from ``chunks``; ``mode`` is order0, chained or tree.

    Streams from files have no ids and no number of bits: their vec_id is null, and fewer than 8 bits may be left.
    """
    spark = chunks.sparkSession
    ship_package(spark)
    counts = child_count_codes(tree) if mode == "tree" else None
    sent = spark.sparkContext.broadcast((book_map(book), counts))
    return chunks.mapInPandas(_decode(sent, mode, parts), "chunk long, place long, vec_id long, codes array<short>")


def mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: how many (vec_id, codes) of either table the other lacks, repeats counted."""
    x, y = (t.select(F.col("vec_id").cast("long"), F.col("codes").cast("array<int>").alias("codes")) for t in (a, b))
    return x.exceptAll(y).unionByName(y.exceptAll(x)).agg(F.count("*").alias("mismatches"))


def stream_position(decoded: DataFrame) -> DataFrame:
    """Decoded rows with their places in the whole stream."""
    return with_position(decoded, ["chunk", "place"])
