"""Document fingerprints: invertible Bloom lookup tables of hashed paragraphs.

A paragraph (a line, cut further after sentence ends) is hashed to 64 bits together with how often
it occurred before in its text, so a text is a set of digests. A digest is added to three cells of a
small table, one in each third: its count, the XOR of the digests and the XOR of their check hashes.
Subtracting two versions' tables leaves the differing digests, which peeling recovers: a cell that
holds a single digest gives it away, and taking it out of its other cells uncovers more. Stored
fingerprints are subtracted and peeled as they are; when peeling gets stuck, both tables are built
anew with twice the cells.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.llm.hashing import GOLD, mix
from vecpress.session import ship_package

#: Cells of a stored fingerprint.
CELLS = 24
#: A stored cell: count, digest XOR, check XOR.
CELL = np.dtype([("n", ">u4"), ("k", ">u8"), ("c", ">u4")])


def digests(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Digests of all texts' paragraphs, distinct within a text, and the offsets of each text's."""
    import xxhash

    marked = pc.replace_substring_regex(text, r"([.!?]) +", "\\1\n")
    lists = pc.split_pattern(marked, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    coded = values.dictionary_encode()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = np.diff(offsets)
    of = np.repeat(np.arange(len(n)), n)
    # how often the paragraph occurred before in its text
    order = np.lexsort((codes, of))
    c, o = codes[order], of[order]
    new = np.ones(len(c), bool)
    new[1:] = (c[1:] != c[:-1]) | (o[1:] != o[:-1])
    start = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
    before = np.empty(len(c), np.uint64)
    before[order] = (np.arange(len(c)) - start).astype(np.uint64)
    with np.errstate(over="ignore"):
        return mix(h[codes] + before * GOLD), offsets


def _cells(d: np.ndarray, cells: int) -> np.ndarray:
    """Three cells of each digest, one in each third."""
    third = cells // 3
    with np.errstate(over="ignore"):
        return np.stack([(mix(d + GOLD * np.uint64(k + 1)) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)])


def _check(d: np.ndarray) -> np.ndarray:
    """Check hashes of 32 bits, as fingerprints store them."""
    return mix(d ^ GOLD) & np.uint64(0xFFFFFFFF)


def tables(d: np.ndarray, owner: np.ndarray, n: int, cells: int, sign: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts, digest XORs and check XORs of ``n`` tables; digests with sign -1 are subtracted."""
    at = (_cells(d, cells) + owner * cells).ravel()
    count = np.bincount(at, None if sign is None else np.tile(sign, 3), n * cells).astype(np.int64)
    key, check = np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint64)
    np.bitwise_xor.at(key, at, np.tile(d, 3))
    np.bitwise_xor.at(check, at, np.tile(_check(d), 3))
    return count.reshape(n, cells), key.reshape(n, cells), check.reshape(n, cells)


def peel(count: np.ndarray, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Recover the digests of many subtracted tables at once: table, digest, sign; and which tables emptied."""
    n, cells = count.shape
    count, key, check = count.copy(), key.copy(), check.copy()
    rows, keys, signs = [], [], []
    live = np.arange(n)
    while len(live):
        pure = (np.abs(count[live]) == 1) & (_check(key[live]) == check[live])
        r, c = np.nonzero(pure)
        if not len(r):
            break
        r = live[r]
        pairs = np.zeros(len(r), [("r", "<i8"), ("k", "<u8"), ("s", "<i8")])
        pairs["r"], pairs["k"], pairs["s"] = r, key[r, c], count[r, c]
        pairs = np.unique(pairs)
        rows.append(pairs["r"])
        keys.append(pairs["k"])
        signs.append(pairs["s"])
        for at in _cells(pairs["k"], cells):
            np.subtract.at(count, (pairs["r"], at), pairs["s"])
            np.bitwise_xor.at(key, (pairs["r"], at), pairs["k"])
            np.bitwise_xor.at(check, (pairs["r"], at), _check(pairs["k"]))
        live = np.unique(pairs["r"])
    done = ~(count.any(axis=1) | key.any(axis=1) | check.any(axis=1))
    join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
    return join(rows, np.int64), join(keys, np.uint64), join(signs, np.int64), done


def _gather(d: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)[which]
    at = np.repeat(offsets[:-1][which] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return d[at], np.repeat(np.arange(len(which)), n)


def stored_tables(prints: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of digests, counts, digest XORs and check XORs of fingerprints of equally many cells."""
    sizes, cells = zip(*(p.split(":") for p in prints))
    raw = np.frombuffer(bytes.fromhex("".join(cells)), CELL).reshape(len(prints), -1)
    return np.array([int(n, 16) for n in sizes]), raw["n"].astype(np.int64), raw["k"].astype(np.uint64), raw["c"].astype(np.uint64)


def subtract(a: list[str], b: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Peel pairs of stored fingerprints: pair, digest, sign (1: in a alone), and which pairs were recovered whole."""
    if not a:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    (_, n, k, c), (_, m, l, d) = stored_tables(a), stored_tables(b)
    return peel(n - m, k ^ l, c ^ d)


def differing(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, cells: int = CELLS, stored: tuple[list[str], list[str]] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Differing digests of pairs of texts (a's i-th with b's i-th): pair, digest, and sign (1: in a alone).

    The ``stored`` fingerprints of ``cells`` cells are peeled first, or without them tables as large;
    pairs whose difference doesn't peel are tried again with twice the cells, until all are recovered.
    """
    left = np.arange(len(a_at) - 1)
    out = []
    if stored is not None:
        r, k, s, done = subtract(*stored)
        good = done[r]
        out.append((r[good], k[good], s[good]))
        left = np.flatnonzero(~done)
        cells *= 2
    while len(left):
        step = max(1, 4_000_000 // cells)  # cells held at once
        failed = []
        for i in range(0, len(left), step):
            part = left[i : i + step]
            da, oa = _gather(a, a_at, part)
            db, ob = _gather(b, b_at, part)
            sign = np.concatenate([np.ones(len(da)), -np.ones(len(db))])
            r, k, s, done = peel(*tables(np.concatenate([da, db]), np.concatenate([oa, ob]), len(part), cells, sign))
            good = done[r]
            out.append((part[r[good]], k[good], s[good]))
            failed.append(part[~done])
        left = np.concatenate(failed)
        cells *= 2
    parts = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]
    return tuple(parts)


def likeness(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray, cells: int = CELLS, stored: tuple[list[str], list[str]] | None = None) -> np.ndarray:
    """Jaccard similarity of pairs of texts, from the sizes of their sets and of the recovered difference."""
    n_a, n_b = np.diff(a_at), np.diff(b_at)
    pair, _, _ = differing(a, a_at, b, b_at, cells, stored)
    diff = np.bincount(pair, minlength=len(n_a))
    common = (n_a + n_b - diff) / 2
    return np.where(n_a + n_b > 0, common / np.maximum(1, n_a + n_b - common), 1.0)


def fingerprints(d: np.ndarray, offsets: np.ndarray, cells: int = CELLS) -> list[str]:
    """The tables as text: number of digests, then per cell the count, digest XOR and check XOR in hex."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    out = []
    step = 20_000
    for i in range(0, n, step):
        j = min(n, i + step)
        part = slice(offsets[i], offsets[j])
        count, key, check = tables(d[part], owner[part] - i, j - i, cells)
        raw = np.zeros((j - i, cells), CELL)
        raw["n"], raw["k"], raw["c"] = count, key, check
        data, width = raw.tobytes(), raw.dtype.itemsize * cells
        out += [f"{m:x}:" + data[k * width : (k + 1) * width].hex() for k, m in enumerate(np.diff(offsets[i : j + 1]).tolist())]
    return out


# -- edits to the next document ------------------------------------------------------------------------

OUT = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]


def _edited(texts: list[str], following: list[str]) -> list[str]:
    out = []
    for t, u in zip(texts, following):
        n = len(t) // 2
        out.append(t[: len(t) - n] + u[:n])
    return out


def _compare(ids: pa.Array, texts: list[str], following: list[str], cells: int) -> pa.RecordBatch:
    edited = _edited(texts, following)
    k = len(texts)
    d, at = digests(pa.array(texts + edited + following, pa.string()))
    own, own_at = d[: at[k]], at[: k + 1]
    ed, ed_at = d[at[k] : at[2 * k]], at[k : 2 * k + 1] - at[k]
    nx, nx_at = d[at[2 * k] :], at[2 * k :] - at[2 * k]
    own_print, ed_print, nx_print = fingerprints(own, own_at, cells), fingerprints(ed, ed_at, cells), fingerprints(nx, nx_at, cells)
    columns = [
        ids,
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]),
        pa.array(own_print),
        pa.array(ed_print),
        pa.array(likeness(own, own_at, ed, ed_at, cells, (own_print, ed_print))),
        pa.array(likeness(own, own_at, nx, nx_at, cells, (own_print, nx_print))),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[n for n, _ in OUT])


def _walk(cells: int, limit: int):
    """Rows come sorted by range and id; each range ends with copies of the first row of the next."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, follow, size = [], [], [], 0
        last = None  # range, id, text
        for b in batches:
            for r, i, t, extra in zip(*(b.column(k).to_pylist() for k in ("range", "doc_id", "text", "extra"))):
                if last is not None:
                    if last[0] != r:
                        raise RuntimeError("a range lacks the row after its last")
                    ids.append(last[1])
                    texts.append(last[2])
                    follow.append(t)
                    size += len(last[2]) + len(t) + 128 * cells  # fingerprints too, so that empty texts count
                    if size > limit:
                        yield _compare(pa.array(ids, pa.int64()), texts, follow, cells)
                        ids, texts, follow, size = [], [], [], 0
                last = None if extra else (r, i, t)
        if last is not None:
            raise RuntimeError("a range lacks the row after its last")
        if ids:
            yield _compare(pa.array(ids, pa.int64()), texts, follow, cells)

    return run


def compare_with_next(docs: DataFrame, cells: int = CELLS, range_bytes: int = 12 << 20) -> DataFrame:
    """Fingerprint ``docs(doc_id, text)`` and each text's edit by the next document.

    The edit replaces the last half of the code points, rounded down, by the first as many of the
    next document in ascending doc_id (the first one's after the last). Documents are dealt to
    ranges of ids, each with a copy of the first row of the next range, so a range is walked alone;
    one key per range reaches the driver, for at most 20,000 ranges (at least the session's shuffle partitions). Null texts are empty, and an
    empty text is one empty paragraph; a null doc_id sorts first; rows with equal doc_id follow one
    another in the order of their texts' hashes. A single document is its own next one. An empty
    table gives no row; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    src = src.withColumn("_i", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("_x", F.col("_i").cast("double"))
    seen = src.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    ddl = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not seen["n"]:
        return spark.createDataFrame([], ddl)
    ranges = min(20_000, seen["n"], max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["b"] // range_bytes)))
    cuts = sorted(set(src.approxQuantile("_x", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    dealt = Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="_x", outputCol="_r").transform(src) if cuts else src.withColumn("_r", F.lit(0))
    dealt = dealt.select("doc_id", "text", "_i", F.col("_r").cast("int").alias("range"), F.xxhash64("text").alias("_h"))
    first = dealt.groupBy("range").agg(F.min(F.struct("_i", "_h")).alias("f")).collect()
    first = sorted((r["range"], r["f"]["_i"], r["f"]["_h"]) for r in first)
    heads = spark.createDataFrame([(i, h, first[k - 1][0]) for k, (_, i, h) in enumerate(first)], "_i long, _h long, _to int")
    # the first row of a range also goes to the end of the range before it
    both = dealt.join(F.broadcast(heads), ["_i", "_h"], "left").withColumn("_place", F.explode(F.array_compact(F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.when(F.col("_to").isNotNull(), F.struct(F.col("_to").alias("range"), F.lit(True).alias("extra")))))))
    rows = both.select("_place.range", "_place.extra", "_i", "_h", "doc_id", "text").repartitionById(ranges, F.col("range")).sortWithinPartitions("range", "extra", "_i", "_h")
    return rows.mapInArrow(_walk(cells, 4 << 20), ddl)
