"""Exact line deduplication through sharded minimal perfect hashes.

Line keys are hashed to 128 bits. All distinct hashes are dealt to shards; each shard numbers its
hashes without gaps by a minimal perfect hash (cascaded bit vectors with ranks) that indexes two
compact arrays: a 16-bit fingerprint, and the number of documents (up to 255, which means at least
as many). Where the count is 2 or more, a third array holds the smallest document. Every line of the documents
is a member, so the count decides; the fingerprint finds documents that changed between reads.
Documents probe the arrays; lines are not joined. Arrays up to ``send_bytes`` together are sent to
the executors; larger ones stay sharded and the hashes of lines visit them, those of a shard with
many in several parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpress.llm.blocks import one, text_blocks, tidied, unused
from vecpress.llm.bpe import pack, unpack
from vecpress.llm.hashing import GOLD, mix
from vecpress.session import discard, materialize, ship_package

#: Stands for a missing doc_id: after all others.
NO_ID = 2**63 - 1


# -- minimal perfect hash ----------------------------------------------------------------------------


def _places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        seed = GOLD * np.uint64(level + 1)
        return (mix(h1 + seed) ^ mix(h2 ^ seed)) % np.uint64(size)


def build_mph(h1: np.ndarray, h2: np.ndarray, gamma: float = 2.0) -> list[np.ndarray]:
    """Bit vectors by level. On each level, keys alone on their bit set it; the others go on to the next."""
    levels: list[np.ndarray] = []
    while len(h1):
        size = max(64, int(gamma * len(h1)) + 63 & ~63)
        at = _places(h1, h2, len(levels), size)
        alone = np.bincount(at.astype(np.int64), minlength=size) == 1
        levels.append(np.packbits(alone, bitorder="little"))
        left = ~alone[at.astype(np.int64)]
        if len(levels) > 200:
            raise ValueError("keys repeat")
        h1, h2 = h1[left], h2[left]
    return levels


class Mph:
    """Looks up keys: their number from 0 to n-1; any number or -1 for keys that aren't members."""

    def __init__(self, levels: list[np.ndarray]):
        self.bits = [np.unpackbits(x, bitorder="little") for x in levels]
        ends = np.cumsum([0, *(int(b.sum()) for b in self.bits)])
        self.rank = [np.cumsum(b, dtype=np.int32) + np.int32(e) - 1 for b, e in zip(self.bits, ends)]

    def find(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        out = np.full(len(h1), -1, np.int64)
        left = np.arange(len(h1))
        for level, bits in enumerate(self.bits):
            if not len(left):
                break
            at = _places(h1[left], h2[left], level, len(bits)).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = self.rank[level][at[hit]]
            left = left[~hit]
        return out


class Shard:
    """A shard's minimal perfect hash with its arrays."""

    def __init__(self, data: bytes):
        x = unpack(data)
        self.mph = Mph([np.frombuffer(b, np.uint8) for b in x.column("levels")[0].as_py()])
        self.fingerprint = x.column("fingerprint").flatten().to_numpy()
        self.count = x.column("count").flatten().to_numpy()
        self.first = x.column("first").flatten().to_numpy()
        self.place = np.cumsum(self.count >= 2) - 1  # of a shared line's smallest document

    def owners(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """The smallest document of each line; NOT_SHARED if the line is in one document only."""
        at = self.mph.find(h1, h2)
        if len(at) and (at.min() < 0 or (self.fingerprint[at] != h2.astype(np.uint16)).any()):
            raise RuntimeError("a line isn't known: the documents must read the same each time")
        out = np.full(len(h1), NOT_SHARED, np.int64)
        shared = self.count[at] >= 2
        out[shared] = self.first[self.place[at[shared]]]
        return out


NOT_SHARED = -1 - NO_ID


def _build(table: pa.Table) -> pa.Table:
    h1 = one(table.column("h1")).to_numpy().view(np.uint64)
    h2 = one(table.column("h2")).to_numpy().view(np.uint64)
    levels = build_mph(h1, h2)
    order = np.argsort(Mph(levels).find(h1, h2))
    count = np.minimum(one(table.column("n_docs")).to_numpy()[order], 255)
    payload = pack(
        levels=pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary())),
        fingerprint=pa.array([h2[order].astype(np.uint16)], pa.list_(pa.uint16())),
        count=pa.array([count.astype(np.uint8)], pa.list_(pa.uint8())),
        first=pa.array([one(table.column("first")).to_numpy()[order][count >= 2]], pa.list_(pa.int64())),
    )
    return pa.table({"shard": table.column("shard").slice(0, 1), "payload": pa.array([payload], pa.binary())})


# -- lines -------------------------------------------------------------------------------------------


def lines_of(table: pa.Table, least: int) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines, offsets of each text's lines, each line's text, positions of lines with long enough keys, and those keys' hashes."""
    import xxhash

    lists = pc.split_pattern(one(table.column("text")), "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lines = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
    offsets = offsets - offsets[0]
    keys = pc.ascii_lower(pc.ascii_trim_whitespace(lines))
    long = np.flatnonzero(pc.greater_equal(pc.utf8_length(keys), least).to_numpy(zero_copy_only=False))
    digests = b"".join(map(xxhash.xxh3_128_digest, keys.take(pa.array(long)).cast(pa.binary()).to_pylist()))
    h = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    return lines, offsets, text, long, h[:, 0].copy(), h[:, 1].copy()


def _ids(table: pa.Table) -> np.ndarray:
    return pc.fill_null(one(table.column("doc_id")).cast(pa.int64()), NO_ID).to_numpy()


def _hashes(least: int):
    """(h1, h2, doc_id): each key once for each document of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            _, _, text, long, h1, h2 = lines_of(table, least)
            doc = text[long]
            order = np.lexsort((h2, h1, doc))
            d, a, b = doc[order], h1[order], h2[order]
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(a[new].view(np.int64)), pa.array(b[new].view(np.int64)), pa.array(_ids(table)[d[new]])], names=["h1", "h2", "doc_id"])

    return run


def _rebuild(table: pa.Table, names: list[str], dropped: np.ndarray, lines: pa.Array, offsets: np.ndarray) -> pa.RecordBatch:
    n_lines = np.diff(offsets)
    gone = np.concatenate([[0], np.cumsum(dropped)])[offsets]
    kept = lines.filter(pa.array(~dropped))
    at = offsets - gone
    text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), kept), "\n")
    new = {"text": text, "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(np.diff(gone), pa.int64())}
    return pa.RecordBatch.from_arrays([new[n] if n in new else one(table.column(n)) for n in names], names=names)


def _probe_sent(sent, shards: int, names: list[str], least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {k: Shard(v) for k, v in sent.value.items()}
        for table in text_blocks(batches):
            lines, offsets, text, long, h1, h2 = lines_of(table, least)
            owner = np.full(len(long), NOT_SHARED, np.int64)
            shard = (h1 % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            ends = np.searchsorted(shard[order], np.arange(shards + 1))
            for k, x in held.items():
                own = order[ends[k] : ends[k + 1]]
                owner[own] = x.owners(h1[own], h2[own])
            dropped = np.zeros(len(lines), bool)
            dropped[long] = (owner != NOT_SHARED) & (owner != _ids(table)[text[long]])
            yield _rebuild(table, names, dropped, lines, offsets)

    return run


def _probe_shard(key, probes: pa.Table, arrays: pa.Table) -> pa.Table:
    out = {"doc_id": pa.array([], pa.int64()), "h1": pa.array([], pa.int64()), "h2": pa.array([], pa.int64())}
    if len(arrays) and len(probes):
        x = Shard(arrays.column("payload")[0].as_py())
        h1, h2, doc = (one(probes.column(n)).to_numpy() for n in ("h1", "h2", "doc_id"))
        owner = x.owners(h1.view(np.uint64), h2.view(np.uint64))
        hit = (owner != NOT_SHARED) & (owner != doc)
        out = {"doc_id": pa.array(doc[hit]), "h1": pa.array(h1[hit]), "h2": pa.array(h2[hit])}
    return pa.table(out)


def _drop_listed(names: list[str], least: int, gone: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            lines, offsets, text, long, h1, h2 = lines_of(table, least)
            lists = one(table.column(gone))
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy().astype(np.int64)
            flat = lists.flatten()
            rows = np.zeros(len(flat), [("d", "<i8"), ("a", "<i8"), ("b", "<i8")])
            rows["d"] = np.repeat(np.arange(len(n)), n)
            rows["a"], rows["b"] = flat.field("h1").to_numpy(zero_copy_only=False), flat.field("h2").to_numpy(zero_copy_only=False)
            own = np.zeros(len(long), rows.dtype)
            own["d"], own["a"], own["b"] = text[long], h1.view(np.int64), h2.view(np.int64)
            dropped = np.zeros(len(lines), bool)
            dropped[long] = np.isin(own.view("V24"), rows.view("V24")) if len(rows) else False
            yield _rebuild(table, names, dropped, lines, offsets)

    return run


def drop_repeated_lines(docs: DataFrame, least: int = 10, send_bytes: int = 32 << 20, per_shard: int = 100_000, per_task: int = 2_000_000) -> DataFrame:
    """Keep a line that many documents share only in the smallest ``doc_id`` that holds it.

    A line's key is the line without ASCII white space at its ends, A-Z in lower case. Keys shorter
    than ``least`` code points always stay. Returns the columns of ``docs`` with the kept lines as
    ``text``, and ``n_lines`` (before) and ``n_dropped``; input columns of these names are replaced,
    all others stay whatever their names.
    Null and empty texts have one empty line. Rows with equal doc_id count as one document, whose
    shared lines stay in each of them. A null doc_id counts as one document after all others. Empty
    tables give no row. Very long texts are taken whole. Around ``per_task`` lines probe at once;
    ``docs`` must read the same each time, as files do.
    """
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("n_lines", "n_dropped").withColumn("doc_id", F.col("doc_id").cast("long")).withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    names = schema.fieldNames()
    found = materialize(docs.select("doc_id", "text").mapInArrow(_hashes(least), "h1 long, h2 long, doc_id long"), "lines")
    shards = max(1, -(-found.count() // per_shard))
    shard = F.expr(f"cast(pmod(pmod(h1, {shards}L) + if(h1 < 0, {2**64 % shards}L, 0L), {shards}L) as int)")  # h1 as an unsigned number
    distinct = found.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.when(F.min("doc_id") < F.max("doc_id"), F.count("*")).otherwise(1).alias("n_docs"))
    arrays = materialize(distinct.withColumn("shard", shard).groupBy("shard").applyInArrow(tidied(_build), "shard int, payload binary"), "mph", "uncompressed")
    size = arrays.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    if size <= send_bytes:
        discard(found)
        sent = spark.sparkContext.broadcast({r["shard"]: bytes(r["payload"]) for r in arrays.collect()})
        return docs.mapInArrow(_probe_sent(sent, shards, names, least), schema)
    # the lines of one shard may be a large part of all: it is copied for each part of its own probes
    probes = found.withColumn("shard", shard)
    salts = probes.groupBy("shard").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts"))
    copies = materialize(arrays.join(salts, "shard").select("shard", "payload", "salts"), "mph", "uncompressed")
    probes = probes.join(copies.select("shard", "salts"), "shard").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.col("salts")).cast("int"))
    copies = copies.select("shard", "payload", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hits = probes.select("shard", "salt", "h1", "h2", "doc_id").groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInArrow(_probe_shard, "doc_id long, h1 long, h2 long")
    key, gone = unused("_id", names), unused("_gone", names)
    hits = hits.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("h1", "h2")).alias(gone))
    joined = docs.withColumn(key, F.coalesce("doc_id", F.lit(NO_ID))).join(hits, key, "left").drop(key)
    return joined.mapInArrow(_drop_listed(names, least, gone), schema)
