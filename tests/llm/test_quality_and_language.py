import numpy as np
import pyarrow as pa
import pytest
from cases import empty_documents, odd_documents

from vecpress.llm import crf, langid
from vecpress.llm.queries import op3_quality, op8_language_id

SF = "/root/testdata/sf0.01"


def crc_fold(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_quality_of_held_out_documents(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = op3_quality(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == crc_fold(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([a == b for a, b in seen]) > 0.97


def test_quality_ignores_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality", "toxic")
    a, b = crf.learn(docs, labels), crf.learn(docs, flipped)
    assert np.array_equal(a.weights, b.weights) and a.shift == b.shift


def brute_marginals(unary, trans):
    from itertools import product

    t = len(unary)
    total, good = 0.0, np.zeros(t)
    for y in product((0, 1), repeat=t):
        w = np.exp(sum(unary[i] * y[i] for i in range(t)) + sum(trans[y[i], y[i + 1]] for i in range(t - 1)))
        total += w
        good += w * np.array(y)
    return good / total


@pytest.mark.parametrize("seed", range(5))
def test_marginals_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    lengths = np.array([1, 3, 6])
    unary, trans = rng.normal(size=(3, 6)) * 2, rng.normal(size=(2, 2))
    p, _, _ = crf.marginals(unary, lengths, trans)
    q = crf._good(unary, lengths, trans)
    for i, n in enumerate(lengths):
        want = brute_marginals(unary[i, :n], trans)
        assert np.allclose(p[i, :n], want) and np.allclose(q[i, :n], want)


@pytest.mark.parametrize("carried", [True, False])
def test_gradient_against_differences(carried):
    rng = np.random.default_rng(5)
    n = [1, 4, 7, 2, 9, 3]
    offsets, x = np.cumsum([0, *n]), rng.normal(size=(sum(n), 3))
    chains = crf.chains_of(offsets, rng.integers(1, 90, sum(n)), np.array([1, 0, 1, 0, 1, 0]), 4)
    w, trans = rng.normal(size=3), rng.normal(size=(2, 2))
    if not carried:
        for c in chains:
            c.relabel(x @ w, trans, 0.9)
            p = c.target if c.label else 1 - c.target
            assert ((p * c.sizes * c.on).sum(axis=1) / c.length >= 0.9 - 1e-2).all()
    w, trans = w + 0.3, trans - 0.2
    gw, gt, _ = crf.gradient(x, chains, w, trans, 1e-3)
    loss = lambda a, b: crf.gradient(x, chains, a, b, 1e-3)[2]
    for i in range(3):
        e = np.eye(3)[i] * 1e-5
        assert np.isclose((loss(w + e, trans) - loss(w - e, trans)) / 2e-5, gw[i], atol=1e-6)
    for i in range(4):
        e = np.eye(4)[i].reshape(2, 2) * 1e-5
        assert np.isclose((loss(w, trans + e) - loss(w, trans - e)) / 2e-5, gt.ravel()[i], atol=1e-6)


def test_lines_of_mixed_documents_are_told_apart():
    """Junk lines within good documents are labelled bad, though no line has a label of its own."""
    rng = np.random.default_rng(6)
    good, bad = "A calm sentence of several plain words number %d that ends well.", "%%%% ### %d *** !!! |||"
    texts, labels = [], []
    for i in range(200):
        lines = [(good if i % 2 else bad) % rng.integers(1000) for _ in range(20)]
        if i % 2:
            lines[5] = bad % rng.integers(1000)
        texts.append("\n".join(lines))
        labels.append(i % 2)
    own, sizes, at = crf.line_numbers(pa.array(texts))
    m = crf.train([own[a:b] for a, b in zip(at, at[1:])], [sizes[a:b] for a, b in zip(at, at[1:])], np.array(labels))
    x = (crf.with_neighbours(own, at) - m.mean) / m.scale
    p = crf._good((x @ m.weights).reshape(200, 20), np.full(200, 20), m.stay)
    assert (p[1::2, 5] < 0.5).mean() > 0.9 and (np.delete(p[1::2], 5, axis=1) > 0.5).mean() > 0.95 and (p[::2] < 0.5).all()


def brute_score(m, text):
    """A text's score from the model's numbers, line by line and with plain sums over two labels."""
    own, sizes, at = crf.line_numbers(pa.array([text]))
    u = ((crf.with_neighbours(own, at) - m.mean) / m.scale).astype(float) @ m.weights
    a, ahead = np.array([0.0, u[0]]), []
    for v in u[1:]:
        ahead.append(a)
        a = np.array([np.logaddexp(a[0] + m.stay[0, y], a[1] + m.stay[1, y]) + v * y for y in (0, 1)])
    ahead.append(a)
    b, q = np.zeros(2), np.zeros(len(u))
    for i in range(len(u) - 1, -1, -1):
        z = ahead[i] + b
        q[i] = np.exp(z[1] - np.logaddexp(*z))
        b = np.array([np.logaddexp(m.stay[y, 0] + b[0], m.stay[y, 1] + b[1] + u[i]) for y in (0, 1)])
    mean = np.clip((q * (sizes + 1)).sum() / (sizes + 1).sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(m.slope * np.log(mean / (1 - mean)) + m.shift)))


def test_scores_against_brute_force(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = crf.learn(docs, labels)
    rows = crf.score(docs, m).select("doc_id", "text", "score").collect()
    assert max(abs(brute_score(m, r.text) - r.score) for r in rows) < 1e-3


def test_equal_texts_score_equally_alone_and_together(spark):
    m = crf.learn(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    together = crf.score_texts(m, pa.array(texts))
    alone = np.concatenate([crf.score_texts(m, pa.array([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-5)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (5, None), (6, 1)], "doc_id long, quality int")
    got = crf.score(docs, crf.learn(docs, labels)).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    none = crf.score(docs, crf.learn(docs, labels.limit(0))).collect()
    assert {r.score for r in none} == {0.5}
    assert crf.score(empty_documents(spark), crf.learn(docs, labels)).collect() == []


def test_language_of_held_out_documents(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op8_language_id(spark, SF).collect()
    assert len(rows) == 1000 and all(r.held_out == crc_fold(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.01


def test_language_of_odd_rows(spark):
    m = langid.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    docs = odd_documents(spark)
    got = {(r.doc_id, r.text): r for r in langid.identify(docs, m).collect()}
    for (doc_id, text), r in got.items():
        if not any(c.isalpha() for c in text or ""):
            assert (r.lang_pred, r.score, r.rejected) == ("und", 0.0, True)
        else:
            assert r.lang_pred in ("de", "en", "es", "fr")
    assert len(got) == 12  # the repeated row comes once per key
    assert langid.identify(empty_documents(spark), m).collect() == []


def test_language_without_labels(spark):
    docs = odd_documents(spark).withColumn("lang", __import__("pyspark.sql.functions", fromlist=["lit"]).lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(docs, langid.learn(docs)).collect()} == {"und"}


def gibberish():
    import base64

    rng = np.random.default_rng(4)
    yield " ".join("".join(rng.choice(list("bcdfghjklmnpqrstvwxz"), 7)) for _ in range(40))
    yield base64.b64encode(rng.bytes(300)).decode()
    yield "for (int i = 0; i < n; i++) { buf[i] = malloc(sizeof(struct node)); ptr->next = NULL; }"


FOREIGN = [
    "La mattina presto il vecchio pescatore scendeva verso il porto e guardava le barche che tornavano lentamente dal mare aperto.",
    "O homem caminhava pela rua enquanto as crianças brincavam no jardim e não havia ninguém à janela.",
    "De oude man liep langzaam door de straten van het dorp terwijl de kinderen speelden.",
    "Vanha mies käveli hitaasti kylän katuja pitkin samalla kun lapset leikkivät puutarhassa.",
    "Старый человек медленно шёл по улицам города, пока дети играли в саду.",
]


@pytest.mark.parametrize("sf_dir", [SF, "/root/testdata/sf0.1"])
def test_unlearned_languages_and_gibberish_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    m = langid.learn(docs)
    _, _, rejected = langid.predict_texts(m, pa.array([*FOREIGN, *gibberish()]))
    assert rejected.all()
    seen = [r.text for r in docs.filter("text is not null").orderBy("doc_id").limit(2000).collect()]
    assert langid.predict_texts(m, pa.array(seen))[2].mean() < 0.01


def test_a_language_left_out_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for lang in ("de", "fr"):
        m = langid.learn(docs.filter(f"lang <> '{lang}'"))
        got = langid.identify(docs.filter(f"lang = '{lang}'"), m).collect()
        assert np.mean([r.rejected for r in got]) > 0.9


def test_quality_learns_from_lines_beyond_the_first_thirty(spark):
    bad = "%%% ### 12345 *** !!!"
    good = "A calm sentence of several plain words that ends well."
    # both classes start with the same 40 lines and differ only after them
    rows = [(i, "\n".join([f"Line number {k} of the common opening part." for k in range(40)] + [good if i % 2 else bad] * 60)) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    for s in (crf.Settings(), crf.Settings(span=32), crf.Settings(lines=4000)):
        got = crf.score(docs, crf.learn(docs, labels, s)).collect()
        assert all(r.predicted == r.doc_id % 2 for r in got)


def test_language_learns_from_text_beyond_its_start(spark):
    start = "12345 67890 " * 200  # no letter in the first 2400 characters
    docs = spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id", "lang", f"concat('{start}', text) as text")
    got = langid.identify(docs, langid.learn(docs)).collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.97 and np.mean([r.rejected for r in got]) < 0.01
    few = langid.learn(docs, langid.Settings(chars=800_000))
    assert np.mean([r.lang_pred == r.lang for r in langid.identify(docs, few).collect()]) > 0.9
