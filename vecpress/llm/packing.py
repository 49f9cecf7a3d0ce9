"""Best-fit packing of token pieces into sequences, after Martello-Toth dominance reduction.

Only a histogram of piece lengths reaches the driver: at most ``capacity`` numbers, however many
documents there are. On it, item sets that provably dominate every other way to fill their bin are
fixed for good, which shrinks the instance; best-fit decreasing packs what remains. Bins with equal
contents are handled as one group, so the plan's size depends on the capacity, not on the corpus.
Pieces then find their place from their rank among the pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpress.llm.blocks import unused
from vecpress.llm.bpe import through_words
from vecpress.session import materialize

# -- the plan: runs of equal lengths in groups of equal bins ---------------------------------------

Group = tuple[tuple[tuple[int, int], ...], int]  # ((length, how many), ...), bins


class _Sizes:
    """A multiset of lengths with its distinct values in order."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.live = sorted(self.n)

    def take(self, s: int, k: int) -> None:
        self.n[s] -= k
        if not self.n[s]:
            del self.n[s]
            del self.live[bisect_left(self.live, s)]

    def largest(self, most: int, but: int) -> int | None:
        """Largest length up to ``most``, one item of length ``but`` being set aside."""
        i = bisect_right(self.live, most) - 1
        if i >= 0 and self.live[i] == but and self.n[but] == 1:
            i -= 1
        return self.live[i] if i >= 0 else None

    def smallest(self, k: int, but: int, over: int = 0) -> list[int]:
        """The k smallest items above ``over``, one item of length ``but`` being set aside."""
        out: list[int] = []
        i = bisect_right(self.live, over)
        while len(out) < k and i < len(self.live):
            s = self.live[i]
            out += [s] * min(k - len(out), self.n[s] - (s == but))
            i += 1
        return out


def _best_pair(sizes: _Sizes, free: int, but: int) -> tuple[int, int] | None:
    """Two other items with the largest sum up to ``free``, the larger first; ties: the larger larger item."""
    best = None
    i = bisect_right(sizes.live, free) - 1
    while i >= 0:
        a = sizes.live[i]
        i -= 1
        left = sizes.n[a] - (a == but)
        if left <= 0:
            continue
        j = bisect_right(sizes.live, min(a, free - a)) - 1
        while j >= 0:
            b = sizes.live[j]
            have = sizes.n[b] - (b == but) - (b == a)
            if have > 0:
                if best is None or a + b > sum(best):
                    best = (a, b)
                break
            j -= 1
        if best and 2 * a < sum(best):
            break
    return best


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Group], dict[int, int]]:
    """Fix bins whose contents dominate all other feasible contents with the same item.

    For an item with ``free`` space beside it, contents F dominate if the items of any feasible set
    can be exchanged for single items of F that are as large: (a) nothing else fits: alone;
    (b) one other item fills ``free`` exactly; (c) no two other items fit: the largest that fits;
    (d) no three fit, and the largest that fits is as large as the best pair's sum: that one item;
    (e) no three fit, the best pair holds the largest item that fits, and no feasible pair has a
    smaller half above the pair's smaller half: that pair. Passes repeat until nothing is fixed.
    """
    sizes, fixed, changed = _Sizes(counts), [], True

    def fix(s: int, others: tuple[int, ...]) -> None:
        need: dict[int, int] = {}
        for x in (s, *others):
            need[x] = need.get(x, 0) + 1
        k = min(sizes.n[x] // c for x, c in need.items())
        for x, c in need.items():
            sizes.take(x, c * k)
        fixed.append((tuple(sorted(need.items(), reverse=True)), k))

    while changed:
        changed = False
        for s in sorted(sizes.n, reverse=True):
            while sizes.n.get(s):
                free = capacity - s
                low = sizes.smallest(3, s)
                top = sizes.largest(free, s)
                if top is None:
                    fix(s, ())
                elif top == free or len(low) < 2 or low[0] + low[1] > free:
                    fix(s, (top,))
                elif len(low) < 3 or sum(low) > free:
                    a, b = _best_pair(sizes, free, s)
                    over = sizes.smallest(2, s, over=b)
                    if top >= a + b:
                        fix(s, (top,))
                    elif a == top and (len(over) < 2 or sum(over) > free):
                        fix(s, (a, b))
                    else:
                        break
                else:
                    break
                changed = True
    return fixed, sizes.n


def best_fit(counts: dict[int, int], capacity: int) -> list[Group]:
    """Best-fit decreasing: each item goes to the fullest bin that takes it."""
    open_: dict[int, list[Group]] = {}
    spaces: list[int] = []

    def put(space: int, runs: tuple, bins: int) -> None:
        if space not in open_:
            open_[space] = []
            insort(spaces, space)
        open_[space].append((runs, bins))

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            i = bisect_left(spaces, s)
            if i == len(spaces):
                each = capacity // s
                runs, bins, space = (), (n + each - 1) // each, capacity
            else:
                space = spaces[i]
                runs, bins = open_[space].pop()
                if not open_[space]:
                    del open_[space], spaces[i]
                each = space // s
            full = min(bins, n // each)
            if full:
                put(space - each * s, (*runs, (s, each)), full)
                n -= full * each
            if n and full < bins:  # fewer are left than one more bin takes
                put(space - n * s, (*runs, (s, n)), 1)
                bins, n = bins - 1, 0
            if bins - full > 0 and runs:
                put(space, runs, bins - full)
    return [g for groups in open_.values() for g in groups]


def plan_bins(counts: dict[int, int], capacity: int) -> list[Group]:
    fixed, rest = reduce_dominated(counts, capacity)
    return fixed + best_fit(rest, capacity)


def slots(groups: list[Group]) -> dict[str, np.ndarray]:
    """Where the r-th piece of a length goes: intervals of ranks, by length and first rank."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for runs, bins in groups:
        offset = 0
        for length, each in runs:
            rows.append((length, used.get(length, 0), each, sequence, offset))
            used[length] = used.get(length, 0) + each * bins
            offset += length * each
        sequence += bins
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "rank", "each", "sequence", "offset"), table.T.copy()))


# -- pieces of documents ----------------------------------------------------------------------------

PIECE = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]


def _cut(capacity: int, end_id: int, schema: pa.Schema):
    def make(doc_ids: pa.Array, ids: np.ndarray, at: np.ndarray) -> pa.Table:
        ids = np.insert(ids, at[1:], end_id).astype("<u4")
        at = at + np.arange(len(at))
        total = np.diff(at)
        pieces = -(-total // capacity)
        doc = np.repeat(np.arange(len(total)), pieces)
        piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = piece * capacity
        length = np.minimum(capacity, total[doc] - start)
        first = at[doc] + start
        raw = memoryview(ids).cast("B")
        crc = np.fromiter((zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())), np.int64, len(doc))
        columns = [doc_ids.take(pa.array(doc)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
        if "ids" in schema.names:  # pieces follow one another without gaps
            columns.append(pa.ListArray.from_arrays(pa.array(np.append(first, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
        return pa.table(columns, schema=schema)

    return make


def cut_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Token pieces of ``docs(doc_id, text)``: the ids of a text, then ``end_id``, cut at ``capacity``.

    One row per piece: ``doc_id, piece, start, length, ids_crc32`` and on request ``ids``. Null and
    empty texts give the piece of ``end_id`` alone.
    """
    schema = pa.schema(PIECE + [("ids", pa.list_(pa.int32()))] * ids)
    return through_words(docs, path, _cut(capacity, end_id, schema), schema)


def _place(table: dict[str, np.ndarray], ranked: str):
    # one sorted key for (length, rank); ranks stay below 2**40
    keys = (table["length"] << 40) + table["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column(ranked).to_numpy()
            at = np.searchsorted(keys, (length << 40) + rank, side="right") - 1
            k = rank - table["rank"][at]
            each = table["each"][at]
            out = {name: b.column(name) for name in b.schema.names if name != ranked}
            out["sequence_id"] = pa.array(table["sequence"][at] + k // each)
            out["offset"] = pa.array(table["offset"][at] + k % each * length)
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give every row of ``pieces`` (a column ``length`` from 1 to ``capacity``) a ``sequence_id`` and an ``offset``.

    ``pieces`` should be a stored table: it is read three times. Rows with equal values may change
    places with one another. Ranks within a length are counted in buckets, so that a length that
    many pieces share is ranked by many tasks. Lengths outside 1..capacity, or null, are an error.
    Other columns stay, whatever their names, but for those of the results, which are replaced; a
    map can't be among them. An empty table gives no row.
    """
    pieces = pieces.drop("sequence_id", "offset").withColumn("length", F.col("length").cast("long"))
    wrong = pieces.filter(F.col("length").isNull() | ~F.col("length").between(1, capacity))
    total = pieces.count()
    if wrong.limit(1).count():
        raise ValueError(f"a piece's length must be from 1 to {capacity}")
    buckets = max(64, -(-total // 100_000))
    bucket, row, base, n, rank = (unused(c, pieces.columns) for c in ("_bucket", "_row", "_base", "_n", "_rank"))
    keyed = pieces.withColumn(bucket, F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns]), F.lit(buckets)).cast("int"))
    counts = keyed.groupBy("length", bucket).agg(F.count("*").alias(n))
    histogram = {r[0]: r[1] for r in counts.groupBy("length").agg(F.sum(n)).collect()}
    table = slots(plan_bins(histogram, capacity))
    before = Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", bucket, F.coalesce(F.sum(n).over(before), F.lit(0)).cast("long").alias(base))
    within = Window.partitionBy("length", bucket).orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in pieces.columns] or [F.lit(0)])
    ranked = keyed.withColumn(row, F.row_number().over(within)).join(bases, ["length", bucket])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in pieces.columns], (F.col(base) + F.col(row) - 1).cast("long").alias(rank))
    schema = T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return ranked.mapInArrow(_place(table, rank), schema)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, ids: bool = False) -> DataFrame:
    """Pack whole documents into as few sequences of at most ``capacity`` tokens as the method finds.

    Returns a row per piece: ``doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset``.
    Only documents longer than the capacity are cut. Null and empty texts give one piece of one id;
    repeated rows are packed as often as they occur; an empty table gives no row; other columns are
    ignored.
    """
    return pack_pieces(materialize(cut_pieces(docs, path, capacity, end_id, ids), "pieces"), capacity)
