"""Language identification by averaged hashed subword embeddings and a linear softmax.

A word's subwords are its byte n-grams, with marks at its ends, hashed into a fixed number of
buckets. A text is the mean of its subwords' embeddings; a linear softmax on it is trained with the
embeddings by stochastic gradient descent in numpy, on a bounded sample. A temperature calibrates
the probabilities on a part of the sample that training doesn't see. A text is rejected when its
best probability or its share of known subwords is too low: long subwords that several training
documents hold are known, and the least share lies between those of unseen texts of the learned languages and
those that texts of each language have when all of it is left out. As the model is linear after the
mean, a trained bucket is a row of class scores, and each distinct word of a block is scored once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vecpress.llm.blocks import one, split_words, text_blocks
from vecpress.llm.sampling import held_out, sample_by_class
from vecpress.session import ship_package

UNKNOWN = "und"
_PRIME = np.uint32(16777619)


#: Bytes of text scored at once.
SCORED_BYTES = 4 << 20


@dataclass(frozen=True)
class Settings:
    """Bounds of the sample and of training."""

    per_class: int = 1000  # documents of a language to learn from, about
    chars: int = 32_000_000  # of all of them together; longer texts mean fewer documents
    buckets: int = 1 << 15
    dim: int = 16
    grams: tuple[int, ...] = (2, 3, 4)
    epochs: int = 4
    rate: float = 0.5
    batch: int = 32
    max_rejected: float = 0.001  # share of calibration texts below the rejection threshold
    known_gram: int = 4  # length of the subwords that are known or not
    known_buckets: int = 1 << 20
    known_docs: int = 2  # training documents that hold a known one
    known_low: float = 0.01  # quantile of calibration texts that stands for the learned languages
    known_prior: float = 2.0  # known subwords added to each text, for short ones
    seed: int = 7


@dataclass
class Model:
    settings: Settings
    classes: list[str]
    scores: np.ndarray  # bucket x class
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: np.ndarray | None = None  # bit of each long subword's bucket
    least_known: float = 0.0


def subwords(words: pa.Array, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' n-grams, and the word of each."""
    marked = pc.binary_join_element_wise("<", words, ">", "")
    raw = np.frombuffer(marked.buffers()[2] or b"", np.uint8)
    ends = np.frombuffer(marked.buffers()[1], np.int32)[marked.offset : marked.offset + len(marked) + 1].astype(np.int64)
    raw = raw[ends[0] : ends[-1]]
    ends = ends - ends[0]
    word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(ends))
    left = (np.repeat(ends[1:], np.diff(ends)) - np.arange(len(raw))).astype(np.int32)
    h = np.full(len(raw), 2166136261, np.uint32)
    buckets, owners = [], []
    with np.errstate(over="ignore"):
        for n in range(1, max(s.grams) + 1):
            h = (h[: len(raw) - n + 1] ^ raw[n - 1 :]) * _PRIME
            if n in s.grams:
                fits = left[: len(h)] >= n
                x = h[fits]
                buckets.append(((x ^ (x >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(7)) % np.uint32(s.buckets))
                owners.append(word[: len(h)][fits])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def _lettered(text: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct lower-case words with a letter, the word of each place (-1: none), and offsets of texts."""
    words, codes, offsets = split_words(pc.utf8_lower(text))
    has = pc.match_substring_regex(words, r"\p{L}").to_numpy(zero_copy_only=False)
    number = np.full(len(words), -1, np.int32)
    number[has] = np.arange(int(has.sum()), dtype=np.int32)
    return words.filter(pa.array(has)), number[codes], offsets


def _long(s: Settings) -> Settings:
    return replace(s, grams=(s.known_gram,), buckets=s.known_buckets)


def _known_share(seen: np.ndarray, n: np.ndarray, s: Settings) -> np.ndarray:
    return (seen + s.known_prior) / (n + s.known_prior)


# -- training ----------------------------------------------------------------------------------------


def _counts(texts: list[str], s: Settings, step: int = 100) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and how often it has them; the subwords of a few texts are held at once."""
    for i in range(0, len(texts), step):
        words, codes, offsets = _lettered(pa.array(texts[i : i + step], pa.string()))
        buckets, owner = subwords(words, s)
        order = np.argsort(owner, kind="stable")
        buckets, ends = buckets[order].astype(np.int32), np.searchsorted(owner[order], np.arange(len(words) + 1))
        for a, b in zip(offsets[:-1], offsets[1:]):
            own = codes[a:b]
            parts = [buckets[ends[w] : ends[w + 1]] for w in own[own >= 0]]
            ids, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            yield ids, n.astype(np.int32)


def _bags(texts: list[str], s: Settings) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's buckets and their shares."""
    return [(ids, (n / max(1, n.sum())).astype(np.float32)) for ids, n in _counts(texts, s)]


def _excerpts(texts: list[str], labels: np.ndarray, rng: np.random.Generator) -> tuple[list[str], np.ndarray]:
    """The texts, and a few words from within each: short texts have to be told apart too."""
    short = []
    for t in texts:
        w = t.split()
        n = int(rng.integers(1, 6))
        at = int(rng.integers(0, max(1, len(w) - n)))
        short.append(" ".join(w[at : at + n]))
    return texts + short, np.concatenate([labels, labels])


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(texts: list[str], labels: list[str], classes: list[str], s: Settings = Settings()) -> Model:
    """Fit on ``texts``; every fifth of them serves calibration alone."""
    rng = np.random.default_rng(s.seed)
    number = {c: i for i, c in enumerate(classes)}
    y = np.array([number[c] for c in labels], np.int64)
    order = rng.permutation(len(texts))
    cal, fit = order[: len(order) // 5], order[len(order) // 5 :]
    fit_texts, fit_y = _excerpts([texts[i] for i in fit], y[fit], rng)
    bags = _bags(fit_texts, s)
    emb = rng.uniform(-1 / s.dim, 1 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    w = np.zeros((s.dim, len(classes)), np.float32)
    bias = np.zeros(len(classes), np.float32)
    steps = s.epochs * -(-len(bags) // s.batch)
    step = 0
    for _ in range(s.epochs):
        mixed = rng.permutation(len(bags))
        for i in range(0, len(mixed), s.batch):
            rows = [j for j in mixed[i : i + s.batch] if len(bags[j][0])]
            rate = s.rate * (1 - step / steps)
            step += 1
            if not rows:
                continue
            sizes = [len(bags[j][0]) for j in rows]
            ids, share = np.concatenate([bags[j][0] for j in rows]), np.concatenate([bags[j][1] for j in rows])
            text = np.repeat(np.arange(len(rows)), sizes)
            starts = np.cumsum([0, *sizes[:-1]])
            x = np.add.reduceat(emb[ids] * share[:, None], starts, axis=0)
            d = _softmax(x @ w + bias)
            d[np.arange(len(rows)), fit_y[rows]] -= 1
            back = d @ w.T
            w -= rate * (x.T @ d)
            bias -= rate * 0.1 * d.sum(axis=0)
            # each text's step is spread over its buckets; frequent ones move as far as their share
            np.add.at(emb, ids, -rate * 20 * share[:, None] * back[text])
    del bags, fit_texts
    model = Model(s, classes, (emb @ w).astype(np.float32), bias)
    cal_texts, cal_y = _excerpts([texts[i] for i in cal], y[cal], rng)
    _calibrate(model, cal_texts, cal_y, len(cal))
    _learn_known(model, [texts[i] for i in fit], y[fit], [texts[i] for i in cal], y[cal])
    return model


def _learn_known(m: Model, fit: list[str], fit_y: np.ndarray, cal: list[str], cal_y: np.ndarray) -> None:
    """Known subwords, and the least share of them: midway between calibration texts as they are and with
    their language left out; where these overlap, what keeps the calibration texts."""
    s = m.settings
    holders = np.zeros(s.known_buckets, np.uint16)  # languages that know the subword
    only = np.full(s.known_buckets, -1, np.int32)
    for c in range(len(m.classes)):
        docs = np.zeros(s.known_buckets, np.int32)
        for ids, _ in _counts([fit[i] for i in np.flatnonzero(fit_y == c)], _long(s)):
            docs[ids] += 1
        own = docs >= s.known_docs
        holders += own
        only[own] = c
    known = holders > 0
    m.known = np.packbits(known)
    inside, outside = [], []
    for (ids, n), c in zip(_counts(cal, _long(s)), cal_y):
        if len(ids):
            others = (holders[ids] > 1) | ((holders[ids] == 1) & (only[ids] != c))
            inside.append(_known_share((n * known[ids]).sum(), n.sum(), s))
            outside.append(_known_share((n * others).sum(), n.sum(), s))
    if inside:
        low, high = np.quantile(inside, s.known_low), np.quantile(outside, 0.99)
        rest = np.sort(inside)[int(len(inside) * s.max_rejected)] * 0.9
        m.least_known = float((low + high) / 2 if len(m.classes) > 1 and high < low else rest)


def _calibrate(m: Model, texts: list[str], y: np.ndarray, whole: int) -> None:
    """The temperature with the least log loss; the threshold from the whole texts among them."""
    if not texts:
        return
    z = np.array([m.bias + (sh[:, None] * m.scores[ids]).sum(axis=0) for ids, sh in _bags(texts, m.settings)])
    loss = {t: -np.log(np.maximum(_softmax(z / t)[np.arange(len(y)), y], 1e-12)).mean() for t in np.geomspace(0.02, 5, 40)}
    m.temperature = float(min(loss, key=loss.get))
    top = np.sort(_softmax(z[:whole] / m.temperature).max(axis=1))
    m.threshold = float(min(top[int(len(top) * m.settings.max_rejected)] * 0.9, 0.5))


# -- prediction --------------------------------------------------------------------------------------


def predict_texts(m: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class number (-1: no letter), probability, and whether the text is rejected."""
    words, codes, offsets = _lettered(text)
    k = len(m.classes)
    per_word = np.zeros((len(words) + 1, k + 3))  # the last row, for words without a letter, stays 0
    known = np.unpackbits(m.known) if m.known is not None else np.ones(m.settings.known_buckets, np.uint8)
    step = 30_000
    for i in range(0, len(words), step):
        part = words.slice(i, step)
        buckets, owner = subwords(part, m.settings)
        for c in range(k):
            per_word[i : i + len(part), c] = np.bincount(owner, m.scores[buckets, c], len(part))
        per_word[i : i + len(part), k] = np.bincount(owner, minlength=len(part))
        buckets, owner = subwords(part, _long(m.settings))
        per_word[i : i + len(part), k + 1] = np.bincount(owner, minlength=len(part))
        per_word[i : i + len(part), k + 2] = np.bincount(owner, known[buckets], len(part))
    sums = np.zeros((len(offsets) - 1, k + 3))
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for c in range(k + 3):
        sums[:, c] = np.bincount(doc, per_word[codes, c], len(sums))
    some = sums[:, k] > 0
    p = _softmax((m.bias + sums[:, :k] / np.maximum(1, sums[:, k : k + 1])) / m.temperature) if k else np.zeros((len(sums), 1))
    best = p.argmax(axis=1)
    top = np.where(some & (k > 0), p[np.arange(len(p)), best], 0.0)
    return np.where(some & (k > 0), best, -1), top, ~some | (top < m.threshold) | (_known_share(sums[:, k + 2], sums[:, k + 1], m.settings) < m.least_known)


def _predict(m: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels = np.array([*m.classes, UNKNOWN], object)
        for table in text_blocks(batches, limit=SCORED_BYTES):
            best, top, rejected = predict_texts(m, one(table.column("text")))
            new = {"lang_pred": pa.array(labels[best], pa.string()), "score": pa.array(top), "rejected": pa.array(rejected)}
            yield pa.RecordBatch.from_arrays([new[n] if n in new else one(table.column(n)) for n in names], names=names)

    return run


def learn(docs: DataFrame, s: Settings = Settings()) -> Model:
    """Learn from a bounded sample of ``docs(doc_id, text, lang)`` outside the held-out fold."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, classes = sample_by_class(rows, "lang", s.per_class, s.seed, F.length("text"), s.chars)
    got = sample.select("doc_id", "text", "lang").toPandas()
    got = got.sort_values(["doc_id", "text", "lang"])
    model = train(got["text"].tolist(), got["lang"].tolist(), classes, s)
    pa.default_memory_pool().release_unused()  # what the sample took is the driver's again
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add ``lang_pred``, ``score`` (calibrated probability) and ``rejected`` to ``docs(text, ...)``.

    A null text, or one without a letter, is ``und`` with score 0 and is rejected; so is every text
    where the model has no classes. Others are rejected below the model's
    threshold or with too few known subwords, and keep their nearest language in ``lang_pred``. Input columns
    of these names are replaced; a null text comes back empty. Only the text is an input.
    """
    ship_package(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "rejected").withColumn("text", F.col("text").cast("string"))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return docs.mapInArrow(_predict(model, schema.fieldNames()), schema)
