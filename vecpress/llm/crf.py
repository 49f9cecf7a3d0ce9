"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potentials come from shares of character classes, word
shapes and repeats in the line and in its neighbours; transitions tie neighbouring labels. Only
documents carry labels, so those of lines are latent. Training starts with each document's label on
all its lines, each line taken by itself, and then lets most lines decide: of all distributions over labels whose length-weighted
mean agrees with the document (at least ``agree`` of it is labelled alike), the one nearest to the
model's own is what the model is fitted to, found anew every few steps. Steps are full-batch
gradients in numpy on a bounded sample; a part of the sample serves calibration alone.
Forward-backward marginals of all of a document's lines, weighted by line length, give its quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpress.llm.blocks import one, text_blocks
from vecpress.llm.sampling import held_out, sample_by_class
from vecpress.session import materialize, ship_package


#: Bytes of text scored at once.
SCORED_BYTES = 2 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of training."""

    per_class: int = 1000  # labelled documents of a class to learn from, about
    lines: int = 400_000  # of all of them together; more lines mean fewer documents
    span: int = 1000  # lines of a chain in training; longer documents are several chains
    steps: int = 100
    rate: float = 0.1
    penalty: float = 1e-3
    carried: int = 50  # first steps, with documents' labels on all their lines and no neighbours
    anew: int = 10  # steps after which lines are labelled anew
    agree: float = 0.95  # of a document's length
    seed: int = 3


# character classes: fixed values
_CLASSES = {
    "lower": range(97, 123),
    "upper": range(65, 91),
    "digit": range(48, 58),
    "space": [9, 11, 12, 13, 32],
    "stop": [33, 46, 63],
    "comma": [34, 39, 40, 41, 44, 45, 58, 59],
    "bar": [124],
    "symbol": [35, 36, 37, 38, 42, 43, 47, 60, 61, 62, 64, 91, 92, 93, 94, 95, 96, 123, 125, 126],
    "other": [*range(0, 9), 10, *range(14, 32), 127],
    "wide": range(128, 256),
}
_NUMBER = np.zeros(256, np.uint8)
for _k, _codes in enumerate(_CLASSES.values()):
    _NUMBER[list(_codes)] = _k
_K = len(_CLASSES)
#: Numbers of a line: class shares, exclamation share, log length, word length, repeated words, distinct words, repeated line.
N_OWN = _K + 7
N_FEATURES = 1 + 3 * N_OWN + 2  # bias; the line, the one before, the one after; first, last


def line_numbers(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of all lines, their lengths in bytes, and the offsets of each text's lines."""
    lists = pc.split_pattern(text, "\n")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    lines = pa.concat_arrays([lists.values.slice(offsets[0], offsets[-1] - offsets[0])])
    offsets = offsets - offsets[0]
    n = len(lines)
    at = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    size = np.diff(at)
    kind = _NUMBER[raw]
    line = np.repeat(np.arange(n, dtype=np.int32), size)
    counts = np.bincount(line * np.int64(_K) + kind, minlength=n * _K).reshape(n, _K)
    calls = np.bincount(line[raw == 33], minlength=n)
    words = pc.ascii_split_whitespace(lines)
    w_at = words.offsets.to_numpy().astype(np.int64)
    codes = words.values.slice(w_at[0], w_at[-1] - w_at[0]).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    w_at = w_at - w_at[0]
    n_words = np.diff(w_at)
    of = np.repeat(np.arange(n), n_words)
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (of[1:] == of[:-1])
    again = np.bincount(of[same], minlength=n)
    distinct = np.bincount(np.unique(of * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=n)
    key = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    first = np.zeros(n, bool)
    first[offsets[:-1][np.diff(offsets) > 0]] = True
    like_last = np.zeros(n)
    like_last[1:] = (key[1:] == key[:-1]) & ~first[1:]
    some = np.maximum(1, size)[:, None]
    out = np.empty((n, N_OWN), np.float32)
    out[:, :_K] = counts / some
    many = np.maximum(1, n_words)
    out[:, _K] = calls / some[:, 0]
    out[:, _K + 1] = np.log1p(size) / 8
    out[:, _K + 2] = np.log1p(size / many) / 4
    out[:, _K + 3] = again / many
    out[:, _K + 4] = distinct / many
    out[:, _K + 5] = like_last
    out[:, _K + 6] = counts[:, 1] / np.maximum(1, counts[:, 0] + counts[:, 1] + counts[:, 9])
    return out, size, offsets


def with_neighbours(own: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Features of lines: bias, own numbers and those of the neighbours, and marks of a text's first and last line."""
    n = len(own)
    x = np.zeros((n, N_FEATURES), np.float32)
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    full = np.diff(offsets) > 0
    first[offsets[:-1][full]] = True
    last[offsets[1:][full] - 1] = True
    x[:, 0] = 1
    x[:, 1 : 1 + N_OWN] = own
    x[1:, 1 + N_OWN : 1 + 2 * N_OWN] = own[:-1] * ~first[1:, None]
    x[:-1, 1 + 2 * N_OWN : 1 + 3 * N_OWN] = own[1:] * ~last[:-1, None]
    x[:, -2], x[:, -1] = first, last
    return x


@dataclass
class Model:
    weights: np.ndarray  # of a line's features for label good against bad
    stay: np.ndarray  # 2 x 2 transition scores
    mean: np.ndarray
    scale: np.ndarray
    slope: float = 1.0  # of the log odds of the weighted marginals
    shift: float = 0.0


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def marginals(unary: np.ndarray, length: np.ndarray, trans: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains padded to one length (chain x line, log odds of good): P(good), expected transitions
    over all chains, each counted by its ``weight``, and log partitions."""
    weight = np.ones(len(unary)) if weight is None else weight
    b, t = unary.shape
    score = np.stack([np.zeros_like(unary), unary], axis=2)
    alpha, beta = np.empty((b, t, 2)), np.zeros((b, t, 2))
    alpha[:, 0] = score[:, 0]
    for i in range(1, t):
        step = _lse(alpha[:, i - 1][:, :, None] + trans[None], 1) + score[:, i]
        alpha[:, i] = np.where((i < length)[:, None], step, alpha[:, i - 1])
    for i in range(t - 2, -1, -1):
        step = _lse(trans[None] + (score[:, i + 1] + beta[:, i + 1])[:, None, :], 2)
        beta[:, i] = np.where((i + 1 < length)[:, None], step, 0)
    total = _lse(alpha[:, -1], 1)
    p = np.exp(alpha + beta - total[:, None, None])[:, :, 1]
    pairs = np.zeros((2, 2))
    for i in range(1, t):
        on = i < length
        if not on.any():
            break
        e = alpha[on, i - 1][:, :, None] + trans[None] + (score[on, i] + beta[on, i])[:, None, :] - total[on][:, None, None]
        pairs += np.tensordot(weight[on], np.exp(e), 1)
    return p, pairs, total


def _padded(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(offsets)
    out = np.zeros((len(n), max(1, int(n.max(initial=1)))))
    out[np.arange(out.shape[1])[None] < n[:, None]] = values
    return out, n


@dataclass
class _Chains:
    """Chains of one label and similar length, padded together."""

    label: int
    rows: np.ndarray  # of the lines
    length: np.ndarray
    share: np.ndarray  # weight of each line of a chain
    sizes: np.ndarray  # length of each line, as parts of its chain's mean; padded
    target: np.ndarray  # P(good) that training fits; padded
    pairs: np.ndarray  # its transitions, by weight

    @property
    def on(self) -> np.ndarray:
        return np.arange(self.sizes.shape[1])[None] < self.length[:, None]

    def pad(self, values: np.ndarray) -> np.ndarray:
        return _padded(values[self.rows], np.concatenate([[0], np.cumsum(self.length)]))[0]

    def relabel(self, unary: np.ndarray, trans: np.ndarray, agree: float) -> None:
        """The nearest distribution whose length-weighted mean agrees with the label: the model's own, each line shifted by its length."""
        u, n, sign = self.pad(unary), np.maximum(1, self.length), 1 if self.label else -1
        low, high = np.zeros(len(u)), np.full(len(u), 30.0)

        def mean(shift):
            p = _good(u + sign * shift[:, None] * self.sizes, self.length, trans)
            p = p if self.label else 1 - p
            return (p * self.sizes * self.on).sum(axis=1) / n

        done = mean(low) >= agree
        for _ in range(10):
            mid = (low + high) / 2
            enough = mean(mid) >= agree
            low, high = np.where(enough, low, mid), np.where(enough, mid, high)
        shift = np.where(done, 0, high)
        self.target, self.pairs, _ = marginals(u + sign * shift[:, None] * self.sizes, self.length, trans, self.share)


def gradient(x: np.ndarray, chains: list[_Chains], w: np.ndarray, trans: np.ndarray, penalty: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Of the weighted log loss against the targets, up to the targets' own entropy: by weights and transitions, and the loss."""
    gt = penalty * trans
    unary = x @ w
    off = np.zeros(len(x))
    loss = 0.5 * penalty * ((w * w).sum() + (trans * trans).sum())
    for c in chains:
        u = c.pad(unary)
        p, pairs, total = marginals(u, c.length, trans, c.share)
        off[c.rows] = ((p - c.target) * c.share[:, None])[c.on]
        gt = gt + pairs - c.pairs
        loss += (c.share * (total - (u * c.target * c.on).sum(axis=1))).sum() - (c.pairs * trans).sum()
    return penalty * w + x.T @ off, gt, float(loss)


def chains_of(offsets: np.ndarray, sizes: np.ndarray, labels: np.ndarray, span: int) -> list[_Chains]:
    """Chains of at most ``span`` lines in groups; both classes weigh the same, and so do a class's documents."""
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    per_line = weight / np.maximum(1, np.diff(offsets))
    starts = [np.arange(a, max(b, a + 1), span) for a, b in zip(offsets[:-1], offsets[1:])]
    of = np.repeat(np.arange(len(labels)), [len(a) for a in starts])
    ends = np.append(np.concatenate(starts), offsets[-1])
    n, share, label = np.diff(ends), per_line[of], labels[of]
    out = []
    for lab in (0, 1):
        own = np.flatnonzero(label == lab)
        own = own[np.argsort(n[own], kind="stable")]
        for g in np.array_split(own, 6):
            if not len(g):
                continue
            rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in g])
            long, length = _padded(sizes[rows] + 1.0, np.concatenate([[0], np.cumsum(n[g])]))
            long = long * (length / np.maximum(1e-9, long.sum(axis=1)))[:, None]
            pairs = np.zeros((2, 2))
            pairs[lab, lab] = (share[g] * np.maximum(0, length - 1)).sum()
            out.append(_Chains(lab, rows, length, share[g], long, np.full(long.shape, float(lab)), pairs))
    return out


def train(own: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray, s: Settings = Settings()) -> Model:
    """Fit on documents' line numbers; both classes weigh the same. Every fifth document of each class serves calibration alone, where there are ten or more."""
    rng = np.random.default_rng(s.seed)
    held = np.zeros(len(labels), bool)
    for lab in (0, 1):
        of = rng.permutation(np.flatnonzero(labels == lab))
        held[of[: len(of) // 5 if len(of) >= 10 else 0]] = True
    fit = np.flatnonzero(~held)
    cal = np.flatnonzero(held) if len(set(labels[held].tolist())) == 2 else fit
    offsets = np.cumsum([0, *(len(own[i]) for i in fit)])
    x = with_neighbours(np.concatenate([own[i] for i in fit]), offsets)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    mean[0], scale[0] = 0, 1
    x = ((x - mean) / scale).astype(np.float64)
    chains = chains_of(offsets, np.concatenate([sizes[i] for i in fit]), labels[fit], s.span)
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros((2, 2)), np.zeros((2, 2))]
    for step in range(1, s.steps + 1):
        if step > s.carried and (step - s.carried) % s.anew == 1:
            unary = x @ w
            for c in chains:
                c.relabel(unary, trans, s.agree)
        gw, gt, _ = gradient(x, chains, w, trans, s.penalty)
        if step <= s.carried:  # lines by themselves: with neighbours, a bad line within a good document would be learned as good
            gw[1 + N_OWN :], gt = 0, np.zeros((2, 2))
        for k, (v, grad) in enumerate(((w, gw), (trans, gt))):
            m1, m2 = moments[2 * k], moments[2 * k + 1]
            m1 += 0.1 * (grad - m1)
            m2 += 0.01 * (grad * grad - m2)
            v -= s.rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-9)
    model = Model(w, trans, mean.astype(np.float32), scale.astype(np.float32))
    _calibrate(model, [own[i] for i in cal], [sizes[i] for i in cal], np.cumsum([0, *(len(own[i]) for i in cal)]), labels[cal])
    return model


def _log_odds(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def _calibrate(m: Model, own: list[np.ndarray], sizes: list[np.ndarray], offsets: np.ndarray, labels: np.ndarray) -> None:
    """A logistic slope and shift on the documents' log odds, so that 0.5 parts the classes."""
    z = _log_odds(_weighted(m, np.concatenate(own), np.concatenate(sizes), offsets))
    if len(set(labels.tolist())) < 2:
        return
    weight = np.where(labels == 1, 0.5 / (labels == 1).sum(), 0.5 / (labels == 0).sum())
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton's steps on two numbers, lightly held at the start
        p = 1 / (1 + np.exp(-(a * z + b)))
        g = np.array([(weight * (p - labels) * z).sum() + 1e-3 * (a - 1), (weight * (p - labels)).sum() + 1e-3 * b])
        v = weight * p * (1 - p)
        h = np.array([[(v * z * z).sum() + 1e-3, (v * z).sum()], [(v * z).sum(), v.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
    m.slope, m.shift = float(max(a, 0.05)), float(b)


def _weighted(m: Model, own: np.ndarray, sizes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Length-weighted mean of P(good) over each text's lines."""
    n = np.diff(offsets)
    out = np.full(len(n), 0.5)
    unary = np.empty(len(own))
    step = 200_000
    full = with_neighbours(own, offsets)
    for i in range(0, len(own), step):
        unary[i : i + step] = ((full[i : i + step] - m.mean) / m.scale) @ m.weights
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    i = 0
    while i < len(order):  # chains of similar length together, a bounded number of lines at once
        j = i + 1
        while j < len(order) and n[order[j]] <= 1.3 * n[order[i]] + 2 and (j - i + 1) * n[order[j]] <= 400_000:
            j += 1
        g = order[i:j]
        rows = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in g])
        u, length = _padded(unary[rows], np.concatenate([[0], np.cumsum(n[g])]))
        p = _good(u, length, m.stay)
        wt, _ = _padded(sizes[rows] + 1.0, np.concatenate([[0], np.cumsum(n[g])]))
        out[g] = (p * wt).sum(axis=1) / wt.sum(axis=1)
        i = j
    return out


def _good(unary: np.ndarray, length: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """P(good) of padded chains, by log odds carried along in both directions."""
    b, t = unary.shape

    def carry(r):  # log odds of the next label's message, from those of this one
        return np.logaddexp(trans[0, 1], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[1, 0] + r)

    def carry_back(r):
        return np.logaddexp(trans[1, 0], trans[1, 1] + r) - np.logaddexp(trans[0, 0], trans[0, 1] + r)

    ahead, back = np.zeros((b, t)), np.zeros((b, t))
    for i in range(1, t):
        ahead[:, i] = carry(ahead[:, i - 1] + unary[:, i - 1])
    for i in range(t - 2, -1, -1):
        back[:, i] = np.where(i + 1 < length, carry_back(back[:, i + 1] + unary[:, i + 1]), 0)
    z = np.clip(ahead + back + unary, -60, 60)
    return 1 / (1 + np.exp(-z))


def score_texts(m: Model, text: pa.Array) -> np.ndarray:
    own, sizes, offsets = line_numbers(text)
    z = m.slope * _log_odds(_weighted(m, own, sizes, offsets)) + m.shift
    return 1 / (1 + np.exp(-z))


# -- in Spark ----------------------------------------------------------------------------------------


def _numbers():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, limit=SCORED_BYTES):
            own, sizes, offsets = line_numbers(one(table.column("text")))
            parts = [(own[a:b].astype("<f4").tobytes(), sizes[a:b].astype("<i8").tobytes()) for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([one(table.column("doc_id")), one(table.column("quality")), pa.array([p[0] for p in parts], pa.binary()), pa.array([p[1] for p in parts], pa.binary())], names=["doc_id", "quality", "own", "sizes"])

    return run


def learn(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from a bounded sample of documents with a label 0 or 1, outside the held-out fold.

    Other labels, null ids and documents without a label are left out; of several labels of a
    document the larger counts; repeated rows count as often as they occur; very long documents are
    several chains; other columns are ignored. Without a sample, the model scores 0.5.
    """
    ship_package(docs.sparkSession)
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(~held_out() & F.col("quality").isin(0, 1))
    marked = marked.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sample, _ = sample_by_class(marked, "quality", s.per_class, s.seed)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id")
    got = materialize(rows.select("doc_id", "quality", "text").mapInArrow(_numbers(), "doc_id long, quality int, own binary, sizes binary"), "line-numbers")
    n_lines = got.agg(F.sum(F.length("sizes") / 8)).first()[0] or 0
    if n_lines > s.lines:
        got, _ = sample_by_class(got, "quality", s.per_class, s.seed + 1, F.length("sizes") / 8, s.lines)
    got = got.toPandas().sort_values(["doc_id", "own"])
    if not len(got):
        return Model(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES, np.float32), np.ones(N_FEATURES, np.float32))
    own = [np.frombuffer(b, "<f4").reshape(-1, N_OWN) for b in got["own"]]
    model = train(own, [np.frombuffer(b, "<i8") for b in got["sizes"]], got["quality"].to_numpy(), s)
    pa.default_memory_pool().release_unused()  # what the sample took is the driver's again
    return model


def _score(m: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, limit=SCORED_BYTES):
            p = score_texts(m, one(table.column("text")))
            new = {"score": pa.array(p), "predicted": pa.array((p >= 0.5).astype(np.int32))}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else one(table.column(n)) for n in names], names=names)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``score`` (0 to 1, higher is better) and ``predicted`` (1 from 0.5 on) to ``docs(text, ...)``.

    A null or empty text is one empty line and gets that line's score; a null text comes back empty.
    Without labels to learn from, every score is 0.5. Input columns of these names are replaced, all
    others stay. Repeated rows score equally, very long texts are scored whole, and an empty table
    gives no row.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("score", "predicted").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(_score(model, schema.fieldNames()), schema)
