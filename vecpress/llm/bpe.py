"""Byte-pair encoding and decoding of a corpus through a table of its distinct words.

Documents are split into words at ASCII white space, which no token of a white-space-dropping
vocabulary crosses. A block of documents keeps its words as positions in the block's own word list;
only those lists travel, a message for each shard of words that the block has: at most as many as
it has distinct words, however many shards there are. Every distinct word of the corpus lands in
one shard and is encoded there once, so a shard holds a frequent word once for each block; the ids
go back to the blocks that hold the word, and are laid out by position. Decoding joins ids
to the vocabulary's pieces, a table whose size is that of the vocabulary, whatever the corpus.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.llm.blocks import one, spans, split_words, text_blocks, tidied
from vecpress.llm.hashing import squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from vecpress.session import ship_package

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Bytes of stored input for each shard of the word table.
SHARD_INPUT = 16 << 20


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """The tokenizer in a worker; truncation and padding are off."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        check_splits_at_space(json.load(f))
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def check_splits_at_space(spec: dict) -> None:
    """The word table is right only for vocabularies whose tokens hold no white space."""
    steps = spec.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    if not any(s.get("type") == "Split" and s.get("behavior") == "Removed" and s.get("invert") and "\\s" in json.dumps(s.get("pattern")) for s in steps):
        raise ValueError("this vocabulary doesn't drop white space; a table of words can't encode it")


def encode_words(path: str, words: pa.Array, step: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words, one after another, and how many each word has."""
    t = tokenizer(path)
    ids, sizes = [], []
    for i in range(0, len(words), step):
        got = [e.ids for e in t.encode_batch_fast(words.slice(i, step).to_pylist(), add_special_tokens=False)]
        sizes.append(np.fromiter(map(len, got), np.int32, len(got)))
        ids.append(np.fromiter(chain.from_iterable(got), np.uint32, int(sizes[-1].sum())))
    return np.concatenate(ids or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int32)])


# -- compact columns ------------------------------------------------------------------------------


def pack(**columns: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack(data) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def by_frequency(words: pa.Array, codes: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The same words, numbered from the most frequent down (ties as before)."""
    order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return words.take(pa.array(order)), rank[codes]


def shard_of(words: pa.Array, shards: int) -> np.ndarray:
    import xxhash

    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))
    return (h % np.uint64(shards)).astype(np.int64)


# -- the three steps ------------------------------------------------------------------------------

PIECES = "block string, part int, shard int, payload binary"


def _joined(*parts: bytes) -> bytes:
    return struct.pack(f"<{len(parts)}I", *map(len, parts)) + b"".join(parts)


def _parted(data: bytes, n: int) -> list[bytes]:
    ends = np.cumsum([4 * n, *struct.unpack_from(f"<{n}I", data)]).tolist()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def _word_message(words: pa.Array, at: np.ndarray) -> bytes:
    """Words of a block and their ascending places in its list. Words hold no line break."""
    own = words.take(pa.array(at))
    raw = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), "\n").cast(pa.binary())[0].as_py()
    return _joined(struct.pack("<I", len(raw)), pa.compress(raw, codec="zstd", asbytes=True), squeeze_sorted(at))


def _read_words(data: bytes) -> tuple[pa.Array, bytes]:
    size, raw, at = _parted(data, 3)
    text = pa.decompress(raw, decompressed_size=struct.unpack("<I", size)[0], codec="zstd", asbytes=True)
    return pc.split_pattern(pa.array([text.decode()], pa.string()), "\n").values, at


def _cut(table: pa.Table):
    """A block's key, from all that it holds, and its words."""
    text = one(table.column("text"))
    words, codes, offsets = split_words(text)
    key = hashlib.blake2b(digest_size=16)
    ids = table.column("doc_id").to_pylist()
    key.update(repr(ids).encode())
    key.update(np.ascontiguousarray(offsets).tobytes())
    key.update(np.ascontiguousarray(codes))
    raw = words.cast(pa.large_string())
    key.update(np.ascontiguousarray(pc.binary_length(raw).to_numpy(zero_copy_only=False)))
    key.update(raw.buffers()[2] or b"")
    words, codes = by_frequency(words, codes)
    return key.hexdigest(), words, codes, offsets


def _word_lists(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches):
            key, words, _, _ = _cut(table)
            shard = shard_of(words, shards)
            order = np.argsort(shard, kind="stable")
            present, starts = np.unique(shard[order], return_index=True)
            rows = []
            for s, a, b in zip(present.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
                at = order[a:b]  # ascending, as the sort is stable
                rows.append((s, _word_message(words, at)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([key] * len(rows), pa.string()), pa.array([1] * len(rows), pa.int32()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["block", "part", "shard", "payload"],
            )

    return run


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in text_blocks(batches):
        key, words, codes, offsets = _cut(table)
        payload = pack(
            doc_id=pa.array([table.column("doc_id").to_pylist()], pa.list_(pa.int64())),
            offsets=pa.array([offsets], pa.list_(pa.int64())),
            codes=pa.array([squeeze(codes)], pa.binary()),
            words=pa.array([len(words)], pa.int64()),
        )
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([0], pa.int32()), pa.array([-1], pa.int32()), pa.array([payload], pa.binary())], names=["block", "part", "shard", "payload"])


def _encode_shard(path: str):
    def run(table: pa.Table) -> pa.Table:
        lists = [_read_words(p.as_py()) for p in table.column("payload")]
        coded = pa.concat_arrays([words for words, _ in lists]).dictionary_encode()
        ids, sizes = encode_words(path, coded.dictionary)
        starts = np.cumsum(sizes, dtype=np.int64) - sizes
        codes = coded.indices.to_numpy(zero_copy_only=False)
        rows, done = [], 0
        for words, at in lists:
            own = codes[done : done + len(words)]
            done += len(words)
            n = sizes[own]
            rows.append(_joined(at, squeeze(n), squeeze(ids[spans(starts[own], n.astype(np.int64))])))
        table_blocks = table.column("block").to_pylist()
        k = len(rows)
        return pa.table({"block": pa.array(table_blocks, pa.string()), "part": pa.array([1] * k, pa.int32()), "shard": pa.array([0] * k, pa.int32()), "payload": pa.array(rows, pa.binary())})

    return run


def _flat(x: pa.RecordBatch, name: str) -> np.ndarray:
    return x.column(name).flatten().to_numpy(zero_copy_only=False)


def _join_block(make, schema: pa.Schema):
    def run(table: pa.Table) -> pa.Table:
        parts = np.array(table.column("part").to_pylist())
        payload = table.column("payload")
        heads = [unpack(payload[int(i)].as_py()) for i in np.flatnonzero(parts == 0)]
        if not heads:
            raise RuntimeError("a block's words came without its documents: the documents must read the same each time")
        n_words = heads[0].column("words")[0].as_py()
        sizes, starts, flat, done, seen = np.zeros(n_words, np.int32), np.zeros(n_words, np.int64), [], 0, 0
        got: set[bytes] = set()
        for i in np.flatnonzero(parts == 1):
            raw = payload[int(i)].as_py()
            if raw in got:  # repeated blocks, from repeated rows, bring equal lists
                continue
            got.add(raw)
            at, n, ids = _parted(raw, 3)
            at, n, ids = unsqueeze_sorted(at).astype(np.int64), unsqueeze(n).astype(np.int32), unsqueeze(ids).astype(np.uint32, copy=False)
            sizes[at] = n
            starts[at] = done + np.cumsum(n, dtype=np.int64) - n
            flat.append(ids)
            done += len(ids)
            seen += len(at)
        if seen != n_words:
            raise RuntimeError("a block lacks words: the documents must read the same each time")
        flat = np.concatenate(flat or [np.zeros(0, np.uint32)])
        out = []
        for head in heads:
            doc_ids = head.column("doc_id").flatten()
            offsets = _flat(head, "offsets")
            codes = unsqueeze(head.column("codes")[0].as_py())
            step = 1_000_000  # words laid out at once, or those of one document
            i = 0
            while i < len(doc_ids):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + step, side="right")) - 1)
                j = min(j, len(doc_ids))
                own = codes[offsets[i] : offsets[j]]
                per_word = sizes[own].astype(np.int64)
                ids = flat[spans(starts[own], per_word)]
                at = np.concatenate([[0], np.cumsum(per_word)])[offsets[i : j + 1] - offsets[i]]
                out.append(make(doc_ids.slice(i, j - i), ids, at))
                i = j
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


@lru_cache(maxsize=4)
def pieces(path: str) -> pa.Array:
    """id -> piece; its size is the vocabulary's. Ids without a piece are null."""
    t = tokenizer(path)
    known = {i: p for p, i in t.get_vocab(with_added_tokens=True).items()}
    return pa.array([known.get(i) for i in range(max(known) + 1)], pa.string())


def decode_ids(path: str, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text's pieces joined by a space, as the library decodes where no decoder is set."""
    if tokenizer(path).decoder is not None:
        t = tokenizer(path)
        return pa.array([t.decode(ids[a:b].tolist(), skip_special_tokens=False) for a, b in zip(offsets[:-1], offsets[1:])], pa.string())
    got = pieces(path).take(pa.array(ids.astype(np.int64)))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), got), " ")


DIGESTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("decoded", pa.string())])


def _digests(path: str):
    def make(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Table:
        raw = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
        sha = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
        text = decode_ids(path, ids, at)
        o = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1]
        data = memoryview(text.buffers()[2] or b"").cast("B")
        back = [hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(o[:-1].tolist(), o[1:].tolist())]
        return pa.table([doc_ids.cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sha, pa.string()), pa.array(back, pa.string())], schema=DIGESTS)

    return make


def _tokens(path: str):
    def make(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Table:
        lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int64)))
        return pa.table([doc_ids.cast(pa.int64()), lists, decode_ids(path, ids, at)], schema=TOKENS)

    return make


def _schema_ddl(schema: pa.Schema) -> str:
    kinds = {pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.list_(pa.int64()): "array<long>", pa.list_(pa.int32()): "array<int>"}
    return ", ".join(f"`{f.name}` {kinds[f.type]}" for f in schema)


def shards_for(docs: DataFrame) -> int:
    """Shards of the word table: the session's shuffle partitions, and more as Spark's estimate of the input grows."""
    least = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(least, size // SHARD_INPUT) if size < 1 << 60 else least


def through_words(docs: DataFrame, path: str, make, schema: pa.Schema, shards: int | None = None) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and hand bounded groups of documents to ``make(doc_ids, ids, offsets)``,
    which returns their rows as a table of ``schema``.

    ``docs`` is read twice and must read the same each time, as files do; otherwise an error is
    raised rather than a wrong result returned.
    """
    spark = docs.sparkSession
    ship_package(spark)
    shards = shards or shards_for(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lists = src.mapInArrow(_word_lists(shards), PIECES)
    coded = lists.groupBy("shard").applyInArrow(tidied(_encode_shard(path)), PIECES)
    heads = src.mapInArrow(_documents, PIECES)
    return heads.unionByName(coded).groupBy("block").applyInArrow(tidied(_join_block(make, schema)), _schema_ddl(schema))


def encode(docs: DataFrame, path: str, shards: int | None = None, digests: bool = False) -> DataFrame:
    """Encode and decode ``docs(doc_id, text)`` with the vocabulary file at ``path``.

    Returns one row for each row of ``docs``: ``doc_id, ids, decoded``, or with ``digests`` the
    columns ``doc_id, n_tokens, ids_sha256, decoded_sha256``. Other columns of ``docs`` are ignored.
    Null and empty texts have no ids and decode to an empty text. A null doc_id is kept; repeated
    rows each give a row. Very long texts form a block of their own. An empty table gives no row.
    """
    schema = DIGESTS if digests else TOKENS
    make = (_digests if digests else _tokens)(path)
    return through_words(docs, path, make, schema, shards)
