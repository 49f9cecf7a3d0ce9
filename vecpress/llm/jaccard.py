"""Exact Jaccard similarity join of word-shingle sets with adaptive multi-match prefixes.

Documents with equal sets form a class, of which the smallest id goes on. Shingles are ordered by
how many documents hold them, rare ones first. Two sets that are similar enough share a shingle
among the first few of each; with a prefix longer by l-1, they share at least l. Each document
picks its l by the estimated cost of the candidates that its prefix would bring.

The order is found by steps, so that most shingles are never shuffled. The first step counts only
the shingles of a fixed slice of the hash space: a document is settled if so many of them are its
own alone that any other document lacks all of a prefix. The next step counts a wider slice of the
documents still open, the last one all their shingles, which makes the order exact. Counts travel
as byte planes of sorted shingle numbers, a message for each block of texts and range of numbers.
Shingles that a large share of documents hold are found beforehand, by adding up what blocks hold
several times; they count as shared and stay out of the messages, so no range holds a hot one.

Documents that share a prefix shingle are not all paired. In each round, every shingle's documents
are compared with its hubs, those with the fewest shingles of their own; links merge components,
and a shingle is done when all its documents are in one. The number of hubs grows from round to
round, so that the rounds end after a few even if nothing links. The components are those of all
links between all documents. A pair's prefixes are matched before its sets are read, and shingles
with many documents are split over many tasks, each with its own copy of the hubs.
``similar_pairs`` compares all documents that share enough of their prefixes and lists every link.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vecpress.llm.blocks import one, split_words, text_blocks, tidied
from vecpress.llm.hashing import GOLD, mix, squeeze, squeeze_sorted, unsqueeze, unsqueeze_sorted
from vecpress.operators.components import components
from vecpress.session import discard, materialize, ship_package

#: Bits of a shingle's number in the order of shingles; its hash has 63.
BITS = 48
#: Bytes of text whose shingles are held at once.
BLOCK = 8 << 20


@dataclass(frozen=True)
class Settings:
    words: int = 5  # of a shingle
    num: int = 80  # similar: den * intersection >= num * union
    den: int = 100
    slices: tuple[float, ...] = (1.5, 4.0)  # sizes of the first slices, in base prefixes
    most_matches: int = 4  # the largest l
    verify_cost: float = 0.02  # of one shingle of a candidate, in prefix postings read
    hubs: int = 16  # times as many in each round
    broadcast_rows: int = 500_000  # ids that may be sent to all tasks
    often: tuple[int, int] = (1000, 2000)  # a hot shingle is in so many documents, and in so small a part of all
    most_often: int = 1_000_000  # hot shingles sent to all tasks; with more, only hotter ones count as such
    ranges: int = 64  # of shingle numbers, at least: few of them grow with the input, and so do the rows a text is split into
    range_tokens: int = 2_000_000  # shingles counted by one task at once, about
    part: int = 1000  # documents of a shingle that one task compares with its hubs

    def prefix(self, n):
        """Length of the base prefix of a set of n."""
        return n - -(-self.num * n // self.den) + 1

    @property
    def prefix_sql(self) -> str:
        return f"(n - (({self.num} * n + {self.den - 1}) div {self.den}) + 1)"

    @property
    def steps(self) -> list[int]:
        """Ends of the slices; the last one is all."""
        ends = [int(x * (1 - self.num / self.den) * 2**BITS) for x in self.slices]
        return [*[e for e in ends if e < 2**BITS // 2], 2**BITS]


def shingle_sets(text: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """63-bit hashes of each text's distinct shingles of ``k`` words, ascending, and offsets of texts.

    A text of fewer words has its whole sequence as the one shingle; a text without words has none.
    """
    import xxhash

    words, codes, offsets = split_words(pc.ascii_lower(text))
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)[codes]
    offsets = np.concatenate([[0], np.cumsum(real)])[offsets]
    codes = codes[real]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.cast(pa.binary()).to_pylist()), np.uint64, len(words))[codes]
    n = np.diff(offsets)
    size = len(h) - k + 1
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    text_of = np.repeat(np.arange(len(n)), n)
    with np.errstate(over="ignore"):
        if size > 0:
            x = np.zeros(size, np.uint64)
            for i in range(k):
                x = mix(x * GOLD + h[i : i + size])
            whole = text_of[:size] == text_of[k - 1 :]
            parts.append((text_of[:size][whole], x[whole]))
        short = np.flatnonzero((n > 0) & (n < k))
        if len(short):
            y = np.zeros(len(short), np.uint64)
            for i in range(k):
                on = n[short] > i
                y[on] = mix(y[on] * GOLD + h[offsets[short[on]] + i])
            parts.append((short, mix(y + n[short].astype(np.uint64))))
    owner, x = (np.concatenate(p) for p in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
    x = x >> np.uint64(1)
    if len(parts) == 2:
        order = np.argsort(owner, kind="stable")
        owner, x = owner[order], x[order]
    ends = np.searchsorted(owner, np.arange(len(n) + 1))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        x[a:b].sort()
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (owner[1:] != owner[:-1])
    at = np.concatenate([[0], np.cumsum(new)])[ends]
    return x[new], at


def _signature(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each set's shingles."""
    out = []
    with np.errstate(over="ignore"):
        for seed in (1, 2):
            total = np.concatenate([[np.uint64(0)], np.cumsum(mix(x + GOLD * np.uint64(seed)), dtype=np.uint64)])
            out.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
    return out[0], out[1]


def _hashed(table: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    x, at = shingle_sets(one(table.column("text")), k)
    return x, at, *_signature(x, at)


def _distinct(ids: np.ndarray, n: np.ndarray, sig1: np.ndarray, sig2: np.ndarray) -> np.ndarray:
    """Which texts of a block to count: of equal sets the one with the smallest id, and no empty ones."""
    order = np.lexsort((ids, sig2, sig1, n))
    a, b, m = sig1[order], sig2[order], n[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (m[1:] != m[:-1])
    out = np.zeros(len(order), bool)
    out[order] = first
    return out & (n > 0)


def _numbers(x: np.ndarray, at: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the shingles of some texts, and the text of each; one text has a number once.

    Where two shingles of a text have one number, its list is shorter than its set. Prefixes are as
    long as the set asks for, which is long enough for the list too.
    """
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    tok = x >> np.uint64(63 - BITS)
    on = np.ones(len(tok), bool)
    on[1:] = (tok[1:] != tok[:-1]) | (text[1:] != text[:-1])
    on &= texts[text]
    return tok[on], text[on]


def _sizes(s: Settings):
    """Each text's set size and signature; with a block's first text the shingles that eight or more of its texts hold."""
    least = 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, limit=BLOCK):
            x, at, sig1, sig2 = _hashed(table, s.words)
            n = np.diff(at)
            ids = pc.fill_null(one(table.column("doc_id")), 2**63 - 1).to_numpy()
            tok, _ = _numbers(x, at, _distinct(ids, n, sig1, sig2))
            tok.sort()
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]])) if len(tok) else np.zeros(0, np.int64)
            count = np.diff(np.append(start, len(tok)))
            often = count >= least
            sizes = np.zeros(len(n) + 1, np.int32)
            sizes[1:] = int(often.sum())
            lists = [pa.ListArray.from_arrays(pa.array(sizes), pa.array(v[often].astype(np.int64))) for v in (tok[start], count)]
            yield pa.RecordBatch.from_arrays([one(table.column("doc_id")), pa.array(n, pa.int64()), pa.array(sig1), pa.array(sig2), *lists], names=["doc_id", "n", "sig1", "sig2", "often", "counts"])

    return run


def _wanted(table: pa.Table, ids: np.ndarray, n: np.ndarray, sig1: np.ndarray, sig2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a block's texts, and which texts to read: those whose set is the node's, or all distinct ones."""
    if "node" not in table.column_names:
        return ids, _distinct(ids, n, sig1, sig2)
    return one(table.column("node")).to_numpy(), one(table.column("want")).to_numpy() == sig1


def _messages(s: Settings, end: int, ranges: int, hot: Broadcast, lists: bool):
    """Shingle numbers below ``end`` and the nodes that have them, a row for each range of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = hot.value[0]
        for table in text_blocks(batches, limit=BLOCK):
            x, at, sig1, sig2 = _hashed(table, s.words)
            ids = pc.fill_null(one(table.column("doc_id")), 2**63 - 1).to_numpy()
            nodes, texts = _wanted(table, ids, np.diff(at), sig1, sig2)
            tok, text = _numbers(x, at, texts)
            on = tok < np.uint64(end)
            tok, text = tok[on], text[on]
            rows = []

            def send(place: int, kind: int, tok: np.ndarray, text: np.ndarray) -> None:
                own, index = np.unique(text, return_inverse=True)
                parts = [squeeze_sorted(nodes[own].view(np.uint64)), squeeze(index), squeeze_sorted(tok)]
                rows.append((place, struct.pack("<B3I", kind, *map(len, parts)) + b"".join(parts)))

            if len(top):
                at_top = np.minimum(np.searchsorted(top, tok), len(top) - 1)
                is_hot = top[at_top] == tok
                if lists and is_hot.any():  # their counts are known: any range may hand them on
                    order = np.argsort(at_top[is_hot], kind="stable")
                    send(int(tok[0]) % ranges, 1, at_top[is_hot][order].astype(np.uint64), text[is_hot][order])
                tok, text = tok[~is_hot], text[~is_hot]
            order = np.argsort(tok, kind="stable")
            tok, text = tok[order], text[order]
            place = tok // np.uint64(-(-end // ranges))
            start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(tok) else np.zeros(0, np.int64)
            for a, b in zip(start.tolist(), [*start[1:].tolist(), len(tok)]):
                send(int(place[a]), 0, tok[a:b], text[a:b])
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["place", "payload"])

    return run


def _open_message(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    kind, *sizes = struct.unpack_from("<B3I", data)
    cut = np.cumsum([struct.calcsize("<B3I"), *sizes]).tolist()
    nodes, index, tok = (f(data[a:b]) for f, a, b in zip((unsqueeze_sorted, unsqueeze, unsqueeze_sorted), cut, cut[1:]))
    return kind, nodes.view(np.int64), index.astype(np.int64), tok


def _count(hot: Broadcast, lists: bool):
    """Of one range: how many shingles each node has alone, and on request its shared ones with their document counts."""

    def by_node(nodes: np.ndarray, index: np.ndarray, tok: np.ndarray, df: np.ndarray, own: np.ndarray) -> pa.Table:
        out = {"node": pa.array(nodes), "own": pa.array(own, pa.int64())}
        if lists:
            order = np.argsort(index, kind="stable")
            at = pa.array(np.searchsorted(index[order], np.arange(len(nodes) + 1)).astype(np.int32))
            out |= {"toks": pa.ListArray.from_arrays(at, pa.array(tok[order].astype(np.int64))), "dfs": pa.ListArray.from_arrays(at, pa.array(df[order].astype(np.int64)))}
        return pa.table(out)

    def run(table: pa.Table) -> pa.Table:
        out, held, done = [], [], 0
        for data in table.column("payload"):
            kind, nodes, index, tok = _open_message(data.as_py())
            if kind == 1:
                at = tok.astype(np.int64)
                out.append(by_node(nodes, index, hot.value[0][at], hot.value[1][at], np.zeros(len(nodes), np.int64)))
            else:
                held.append((nodes, index + done, tok))
                done += len(nodes)
        if held:
            nodes, index, tok = (np.concatenate(c) for c in zip(*held))
            order = np.argsort(tok, kind="stable")
            tok, index = tok[order], index[order]
            start = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
            n = np.diff(np.append(start, len(tok)))
            df = np.repeat(n, n)
            own = np.bincount(index[df == 1], minlength=len(nodes))
            shared = df > 1
            out.append(by_node(nodes, index[shared], tok[shared], df[shared], own))
        return pa.concat_tables(out)

    return run


def _whole_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, limit=BLOCK):
            x, at, sig1, _ = _hashed(table, k)
            on = pa.array(one(table.column("want")).to_numpy() == sig1)
            lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.view(np.int64)))
            yield pa.RecordBatch.from_arrays([one(table.column("node")).filter(on), lists.filter(on)], names=["node", "shingles"])

    return run


def choose_matches(df: np.ndarray, n: int, own: int, s: Settings) -> int:
    """The l with the least estimated cost, from the document counts of the shared shingles in order.

    A prefix with l brings the postings of its shared shingles to read. Documents that match it l
    times are at most their sum divided by l; each costs a look at about n shingles.
    """
    best, cost = 1, None
    total = np.cumsum(np.concatenate([[0], df]))
    for l in range(1, min(s.most_matches, -(-s.num * n // s.den)) + 1):
        read = float(total[min(len(df), max(0, s.prefix(n) + l - 1 - own))])
        now = read + s.verify_cost * n * read / l
        if cost is None or now < cost:
            best, cost = l, now
    return best


def _prefixes(s: Settings):
    """Each node's rarest shared shingles, as many as its l needs. A prefix for a smaller l is a beginning of it, ``base`` + l - 1 long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, (node, n, own) in enumerate(zip(*(b.column(c).to_pylist() for c in ("node", "n", "own")))):
                tok, df = (b.column(c)[i].values.to_numpy() for c in ("toks", "dfs"))
                order = np.lexsort((tok, df))
                l = choose_matches(df[order], n, own, s)
                base = s.prefix(n) - own
                take = order[: max(0, base + l - 1)]
                if len(take):
                    rows.append((node, n, own, l, base, tok[take], df[take]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            columns = list(zip(*rows)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["node", "n", "own", "l", "base", "toks", "dfs"])

    return run


def _verify(s: Settings):
    """Pairs whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for i in range(len(b)):
                x, y = b.column("shingles")[i].values.to_numpy(), b.column("hub_shingles")[i].values.to_numpy()
                both = np.concatenate([x, y])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if s.den * common >= s.num * (len(x) + len(y) - common):
                    keep.append(i)
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("hub").take(at), b.column("node").take(at)], names=["a", "b"])

    return run


# -- steps -------------------------------------------------------------------------------------------


def _sent(df: DataFrame, s: Settings) -> DataFrame:
    """A stored table, sent to all tasks if its rows are few enough."""
    return F.broadcast(df) if df.count() <= s.broadcast_rows else df


def _hot(first: DataFrame, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the hot shingles, ascending, and their counts. How many there can be depends on the
    mean size of a set, not on the number of documents: each takes a fixed part of them."""
    least, part = s.often
    bound = max(least, first.count() // part)
    often = first.filter("size(often) > 0").select(F.explode(F.arrays_zip("often", "counts")).alias("o")).groupBy("o.often").agg(F.sum("o.counts").alias("df"))
    often = materialize(often.filter(F.col("df") >= bound), "often")
    while (n := often.filter(F.col("df") >= bound).count()) > s.most_often:
        bound *= 2
    got = often.filter(F.col("df") >= bound).toArrow() if n else None
    discard(often)
    if got is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tok, df = (one(got.column(c)).to_numpy() for c in ("often", "df"))
    order = np.argsort(tok)
    return tok[order].astype(np.uint64), df[order]


def _representatives(first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``members(doc_id, node)`` of all documents with a set, and ``reps(doc_id, want, node, n, tied)``:
    the smallest doc_id of each class, its signature and the class's node. That is the doc_id, or a number from the
    signature where the doc_id (``tied``) has other sets too."""
    real = first.filter("n > 0 and doc_id is not null").select("doc_id", "n", "sig1", "sig2")
    tied = real.groupBy("doc_id").agg(F.min(F.struct("sig1", "sig2", "n")).alias("a"), F.max(F.struct("sig1", "sig2", "n")).alias("b")).filter("a <> b").select("doc_id", F.lit(True).alias("tied"))
    classes = real.groupBy("sig1", "sig2", "n").agg(F.min("doc_id").alias("doc_id"))
    node = F.when(F.col("tied"), F.col("sig1").bitwiseOR(F.lit(-(2**63)))).otherwise(F.col("doc_id"))
    classes = classes.join(tied, "doc_id", "left").withColumn("tied", F.coalesce("tied", F.lit(False))).withColumn("node", node)
    classes = materialize(classes, "classes")
    members = real.join(classes.select("sig1", "sig2", "n", "node"), ["sig1", "sig2", "n"]).select("doc_id", "node")
    return members, classes.select("doc_id", F.col("sig1").alias("want"), "node", "n", "tied")


def prepare(docs: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """``sizes(doc_id, n)`` of all documents, ``members(doc_id, node)``, ``reps``, and of the nodes that may
    have a link ``heads(node, n, own, l, base, toks, dfs)`` with their prefixes, and ``sets(node, shingles)``."""
    spark = docs.sparkSession
    ship_package(spark)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    first = materialize(src.mapInArrow(_sizes(s), "doc_id long, n long, sig1 long, sig2 long, often array<long>, counts array<long>"), "sizes")
    hot = spark.sparkContext.broadcast(_hot(first, s))
    members, reps = _representatives(first)
    open_, texts = None, src.filter("doc_id is not null")
    for end in s.steps:
        last = end == 2**BITS
        if open_ is not None or last:
            some = reps if open_ is None else open_
            texts = src.join(_sent(some.select("doc_id", "want", "node"), s), "doc_id")
        total = ((first if open_ is None else open_).agg(F.sum("n")).first()[0] or 0) * end / 2**BITS
        ranges = max(s.ranges, int(total) // s.range_tokens)
        sent = texts.mapInArrow(_messages(s, end, ranges, hot, last), "place int, payload binary")
        kind = "node long, own long" + ", toks array<long>, dfs array<long>" * last
        counted = sent.groupBy("place").applyInArrow(tidied(_count(hot, last)), kind)
        if last:
            break
        own = counted.groupBy("node").agg(F.sum("own").alias("own"))
        before = open_
        if open_ is None:  # the first step knows texts by doc_id alone
            left = reps.join(own.withColumnRenamed("node", "doc_id"), "doc_id", "left").filter(f"tied or coalesce(own, 0) < {s.prefix_sql}")
        else:
            left = open_.join(own, "node", "left").filter(f"coalesce(own, 0) < {s.prefix_sql}")
        open_ = materialize(left.select("doc_id", "want", "node", "n"), "open")
        discard(before)
    lists = counted.groupBy("node").agg(F.sum("own").alias("own"), F.flatten(F.collect_list("toks")).alias("toks"), F.flatten(F.collect_list("dfs")).alias("dfs"))
    lists = lists.join((reps if open_ is None else open_).select("node", "n"), "node").filter(f"own < {s.prefix_sql}")
    heads = materialize(lists.select("node", "n", "own", "toks", "dfs").mapInArrow(_prefixes(s), "node long, n long, own long, l int, base int, toks array<long>, dfs array<long>"), "prefixes")
    some = materialize((reps if open_ is None else open_).join(heads.select("node"), "node", "left_semi").select("doc_id", "want", "node"), "heads")
    sets = materialize(src.join(_sent(some, s), "doc_id").mapInArrow(_whole_sets(s.words), "node long, shingles array<long>").dropDuplicates(["node"]), "sets")
    discard(open_, some)
    return first.select("doc_id", "n"), members, reps, heads, sets


def _postings(heads: DataFrame, s: Settings) -> DataFrame:
    """A row for each prefix shingle of each node; ``part`` deals the nodes of a shingle that many have."""
    rows = heads.select("node", "n", "own", F.explode(F.arrays_zip("toks", "dfs")).alias("t"))
    parts = F.expr(f"cast(t.dfs div {s.part} + 1 as int)")
    return rows.select("node", "n", "own", F.col("t.toks").alias("tok"), parts.alias("parts"), F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"))


def _every_part(rows: DataFrame) -> DataFrame:
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))


def _room(s: Settings) -> Column:
    """Whether neither the sizes of a node and a hub nor the shingles that no other document has rule the pair out."""
    most = F.least(F.col("n") - F.col("own"), F.col("hub_n") - F.col("hub_own"))
    return s.den * most >= s.num * (F.col("n") + F.col("hub_n") - most)


def _with_prefixes(rows: DataFrame, heads: DataFrame, hubs: bool = False) -> DataFrame:
    """The prefix of each row's node, or of its hub."""
    names = ("l", "base", "toks")
    if hubs:
        return rows.join(heads.select(F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in names]), "hub")
    return rows.join(heads.select("node", *names), "node")


def _matched() -> Column:
    """Whether two prefixes match as often as the smaller l asks for, each as long as that l makes it; sets aren't read."""
    least = "least(l, hub_l)"
    shared = F.array_intersect(F.expr(f"slice(toks, 1, greatest(base + {least} - 1, 0))"), F.expr(f"slice(hub_toks, 1, greatest(hub_base + {least} - 1, 0))"))
    return F.size(shared) >= F.expr(least)


def _here() -> Column:
    """Whether a row's shingle is the smallest that both prefixes hold, so that a pair is compared once."""
    return F.array_min(F.array_intersect("toks", "hub_toks")) == F.col("tok")


def _similar(pairs: DataFrame, sets: DataFrame, s: Settings) -> DataFrame:
    hub_sets = sets.select(F.col("node").alias("hub"), F.col("shingles").alias("hub_shingles"))
    return pairs.join(sets, "node").join(hub_sets, "hub").mapInArrow(_verify(s), "a long, b long")


def _linked(heads: DataFrame, sets: DataFrame, s: Settings) -> tuple[DataFrame | None, DataFrame | None]:
    """Links ``a, b`` that join the components of all links, and ``node, label`` of these; None without any."""
    postings = _postings(heads, s).withColumn("comp", F.col("node"))
    links, labels, n_hubs, stored = None, None, 1, None
    while True:
        # shingles whose documents are in one component are done
        still = postings.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("parts").alias("parts")).filter("lo <> hi").select("tok", "parts")
        before, stored = stored, materialize(postings.join(_every_part(still).select("tok", "part"), ["tok", "part"], "left_semi"), "postings")
        discard(before)
        if not stored.limit(1).count():
            break
        order = Window.partitionBy("tok").orderBy("own", "node")
        hubs = stored.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_hubs)
        hubs = materialize(hubs.select("tok", "parts", "place", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("own").alias("hub_own"), F.col("comp").alias("hub_comp")), "hubs")
        mine = stored.join(hubs.select("tok", F.col("hub").alias("node"), F.col("place").alias("own_place")), ["tok", "node"], "left")
        apart = F.expr("comp <> hub_comp and (own_place is null or own_place > place)") & _room(s)
        if n_hubs == 1:
            pairs = mine.join(_every_part(hubs).drop("parts"), ["tok", "part"]).filter(apart).select("hub", "node").distinct()
            chosen = _with_prefixes(_with_prefixes(pairs, heads), heads, True).filter(_matched()).select("hub", "node")
        else:
            # each shingle's list goes on until its documents are compared or in one component, so
            # no pair is passed over by waiting for its smallest shingle
            left, right = _with_prefixes(mine, heads), _with_prefixes(hubs, heads, True)
            chosen = left.join(_every_part(right).drop("parts"), ["tok", "part"]).filter(apart & _here() & _matched()).select("hub", "node")
        new = materialize(_similar(chosen, sets, s), "links")
        if new.limit(1).count():
            links = new if links is None else links.unionByName(new)
            labels = components(links)
        rest = mine.filter("own_place is null").select("node", "n", "own", "tok", "parts", "part")
        if labels is None:
            postings = rest.withColumn("comp", F.col("node"))
        else:
            postings = rest.join(labels, "node", "left").withColumn("comp", F.coalesce("label", "node")).drop("label")
        if n_hubs > 1:
            discard(old_hubs)
        old_hubs = hubs
        n_hubs *= s.hubs
    discard(stored)
    return links, labels


def similar_pairs(docs: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Every link: ``pairs(a, b)`` between classes of equal sets, a < b, and ``members(doc_id, node)``.

    All documents that share enough of their prefixes are compared, so the work grows with the
    candidates of each shingle; ``near_duplicates`` needs fewer for the components alone. Texts
    without words and rows without a doc_id are in no class; a class's node is its smallest doc_id,
    or a negative number where that has several different texts. An empty table gives no rows.
    """
    _, members, _, heads, sets = prepare(docs, s)
    left = _with_prefixes(_postings(heads, s), heads)
    right = left.select("tok", "parts", F.col("node").alias("hub"), *[F.col(c).alias(f"hub_{c}") for c in ("n", "own", "l", "base", "toks")])
    pairs = left.join(_every_part(right).drop("parts"), ["tok", "part"]).filter((F.col("hub") < F.col("node")) & _room(s) & _here() & _matched())
    return _similar(pairs.select("hub", "node"), sets, s), members


def near_duplicates(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``docs(doc_id, text)``.

    ``component_id`` is the smallest doc_id reachable by links between similar sets, the row's own
    included. Texts without words, and null texts, have size 0 and no links. A row without a doc_id
    has no component and no links; rows with equal doc_id count as linked. Repeated texts form a
    class; very long texts are taken whole; other columns are ignored; an empty table gives no row.
    """
    sizes, members, reps, heads, sets = prepare(docs, s)
    links, _ = _linked(heads, sets, s)
    owned = members.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("other"))
    # different texts of one doc_id tie their classes together
    tied = owned.filter("node <> other").select("doc_id", F.col("node").alias("a"))
    if tied.limit(1).count():
        ties = members.join(tied, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
        links = ties if links is None else links.unionByName(ties)
    labels = owned.select("doc_id", F.col("node"))
    if links is None:
        found = labels.join(reps.select("node", F.col("doc_id").alias("component_id")), "node").select("doc_id", "component_id")
    else:
        of = components(links)
        low = of.join(reps.select("node", F.col("doc_id").alias("rep")), "node")
        low = materialize(of.join(low.groupBy("label").agg(F.min("rep").alias("low")), "label").select("node", "low"), "components")
        found = labels.join(reps.select("node", F.col("doc_id").alias("rep")), "node").join(low, "node", "left").select("doc_id", F.coalesce("low", "rep").alias("component_id"))
    discard(heads, sets)
    return sizes.join(found, "doc_id", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
