import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import empty_documents, odd_documents
from compare import assert_same
from pyspark.sql import functions as F

from vecpress.llm import audio, iblt, licenses
from vecpress.llm.queries import op5_fingerprints, op6_licenses, op9_media, oracle_sql


def paragraphs(text):
    out, seen = set(), {}
    for p in re.sub(r"([.!?]) +", "\\1\n", text).split("\n"):
        out.add((p, seen.get(p, 0)))
        seen[p] = seen.get(p, 0) + 1
    return out


def alike(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return round(len(a & b) / len(a | b), 9)


def expected(rows):
    rows = sorted(((-(2**63) if i is None else i), t or "") for i, t in rows)
    out = []
    for k, (i, t) in enumerate(rows):
        u = rows[(k + 1) % len(rows)][1]
        n = len(t) // 2
        e = t[: len(t) - n] + u[:n]
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), alike(t, e), alike(t, u)))
    return sorted(out)


def as_rows(df):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in df.collect())


def test_fingerprint_query_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op5_fingerprints(spark, sf)
    assert as_rows(got) == expected(docs)
    by = {}
    texts = dict(docs)
    for r in got.collect():
        by.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())


@pytest.mark.parametrize("size", [1, 100_000, 1 << 30])
def test_fingerprints_of_odd_rows(spark, size):
    docs = odd_documents(spark).dropDuplicates(["doc_id"])
    assert as_rows(iblt.compare_with_next(docs, range_bytes=size)) == expected([(r.doc_id, r.text) for r in docs.collect()])


def test_fingerprints_of_repeated_rows(spark):
    docs = odd_documents(spark)
    rows = iblt.compare_with_next(docs, range_bytes=1000).collect()
    assert len(rows) == docs.count()
    one = iblt.compare_with_next(docs.filter("doc_id = 1")).first()
    assert one.near_next == 1.0
    assert iblt.compare_with_next(empty_documents(spark)).collect() == []


def test_stored_fingerprints_peel_to_the_difference(spark, sf):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").limit(200).collect()]
    edited = [t + "\nA new end." if i % 3 else t[len(t) // 2 :] for i, t in enumerate(texts)]
    (a, a_at), (b, b_at) = iblt.digests(pa.array(texts)), iblt.digests(pa.array(edited))
    prints = iblt.fingerprints(a, a_at), iblt.fingerprints(b, b_at)
    pair, key, sign, done = iblt.subtract(*prints)
    assert iblt.stored_tables(prints[0])[0].tolist() == np.diff(a_at).tolist()
    assert done[[i for i in range(len(texts)) if i % 3]].all()
    for i in np.flatnonzero(done):
        x, y = set(a[a_at[i] : a_at[i + 1]].tolist()), set(b[b_at[i] : b_at[i + 1]].tolist())
        at = pair == i
        assert {(int(k), int(s)) for k, s in zip(key[at], sign[at])} == {(k, 1) for k in x - y} | {(k, -1) for k in y - x}
    # those too different for the stored cells are recovered from larger tables
    pair, key, sign = iblt.differing(a, a_at, b, b_at, stored=prints)
    want = {(i, k) for i in range(len(texts)) for k in set(a[a_at[i] : a_at[i + 1]].tolist()) ^ set(b[b_at[i] : b_at[i + 1]].tolist())}
    assert set(zip(pair.tolist(), key.tolist())) == want and len(pair) == len(want)
    assert iblt.subtract([], [])[3].tolist() == []


def test_peeling_recovers_the_difference():
    rng = np.random.default_rng(2)
    for size in (0, 1, 10, 500):
        common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (300, size, size // 2))
        x, y = np.concatenate([common, a]), np.concatenate([b, common])
        pair, key, sign = iblt.differing(x, np.array([0, len(x)]), y, np.array([0, len(y)]), cells=24)
        assert sorted(key[sign == 1]) == sorted(a) and sorted(key[sign == -1]) == sorted(b)


def media_row(text):
    data = (text or "").encode()
    payload = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


def test_media_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    features = {}
    for r in op9_media(spark, sf).collect():
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == media_row(texts[r.doc_id])
        media = audio.to_wav(audio.padded(texts[r.doc_id].encode()), 16000)
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())
        features.setdefault(texts[r.doc_id], set()).add(r.feature)
    assert all(len(v) == 1 for v in features.values())


def test_media_of_odd_rows(spark):
    docs = odd_documents(spark)
    rows = audio.analyse(audio.store(docs)).collect()
    key = lambda r: (r[0] is None, *(x or 0 for x in r[:2]), *r[2:])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(((r.doc_id, *media_row(r.text)) for r in docs.collect()), key=key)
    for r in rows:
        batch = audio.from_ipc(r.tensors)
        assert len(batch) == r.n_segments and isinstance(batch.schema.field(0).type, pa.FixedShapeTensorType)
        assert all(a < b for a, b in zip(batch.column("start_s").to_pylist(), batch.column("end_s").to_pylist()))
    assert audio.analyse(audio.store(empty_documents(spark))).collect() == []


def test_stored_tensors_against_plain_loops(spark):
    """Frames, bands and spans of the stored tensors, recomputed with a written-out Fourier sum."""
    s = audio.Settings()
    text = "The quick brown fox jumps over the lazy dog, again and again. " * 40 + "\n" * 900 + "Another part, after a pause. " * 30
    row = audio.analyse(audio.store(spark.createDataFrame([(1, text)], "doc_id long, text string"))).first()
    batch = audio.from_ipc(row.tensors)
    tensors = batch.column("log_mel").to_numpy_ndarray()
    spans = list(zip(batch.column("start_s").to_pylist(), batch.column("end_s").to_pylist()))
    x = (np.frombuffer(audio.padded(text.encode()), np.uint8).astype(float) - 128) / 128
    y = audio.resample(x.astype(np.float32), 1, 2).astype(float)
    top = 2595 * np.log10(1 + s.to_rate / 2 / 700)
    edge = [700 * (10 ** (top * i / (s.mels + 1) / 2595) - 1) for i in range(s.mels + 2)]
    t = np.arange(s.window)
    for part, (start, end) in zip(tensors, spans):
        first = round(start * s.to_rate / s.hop)
        frames = round((end * s.to_rate - s.window) / s.hop) + 1 - first
        for k in (0, frames - 1):
            cut = y[(first + k) * s.hop : (first + k) * s.hop + s.window]
            cut = np.append(cut, np.zeros(s.window - len(cut))) * (0.5 - 0.5 * np.cos(2 * np.pi * t / (s.window - 1)))
            power = [abs((cut * np.exp(-2j * np.pi * f * t / s.window)).sum()) ** 2 for f in range(s.window // 2 + 1)]
            for band in (0, 7, s.mels - 1):
                weight = [max(0, min((f * s.to_rate / s.window - edge[band]) / (edge[band + 1] - edge[band]), (edge[band + 2] - f * s.to_rate / s.window) / (edge[band + 2] - edge[band + 1]))) for f in range(s.window // 2 + 1)]
                want = np.log(np.dot(power, weight) / max(sum(weight), 1e-6) + 1e-6)
                assert abs(part[k][band] / 100 - want) < 0.02
        assert (part[frames:] == -1382).all()
    assert (row.feature, row.n_segments) == (audio.describe(row.tensors)[0], len(spans)) and len(spans) > 1


def test_media_without_bytes(spark):
    got = audio.analyse(spark.createDataFrame([(1, 5, None)], "doc_id long, n_bytes long, media binary")).collect()
    assert [(r.doc_id, r.n_bytes, r.payload_bytes, r.feature, r.tensors) for r in got] == [(1, 5, None, None, None)]


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1), (160, 147)])
def test_resampling_keeps_a_tone(up, down):
    rate, n = 16000, 8000
    x = np.sin(np.arange(n) * 2 * np.pi * 440 / rate).astype(np.float32)
    y = audio.resample(x, up, down)
    want = np.sin(np.arange(len(y)) * 2 * np.pi * 440 / (rate * up / down))
    assert len(y) == -(-n * up // down) and np.abs(y - want)[100:-100].max() < 0.01


def test_segments_with_hysteresis():
    e = np.array([0, 0, 1, 0.5, 0.4, 0.1, 0, 0.5, 0, 0.9, 0.4, 1])
    assert audio.segments(e, 0.6, 0.3) == [(2, 5), (9, 12)]
    assert audio.segments(np.ones(4), 0.6, 0.3) == [(0, 4)]


def test_license_query_matches_sql(spark):
    assert assert_same(op6_licenses(spark, "/root/testdata/sf0.01"), oracle_sql()["op6_licenses"], "/root/testdata/sf0.01") == 1000


def test_license_inheritance_and_odd_rows(spark):
    rows = [
        (1, "a/LICENSE", "Released under the MIT License."),
        (2, "a/b/c/x.py", "no notice"),
        (3, "a/b/LICENSE.txt", "Licensed under the Apache License, Version 2.0."),
        (4, "a/b/y.py", "# Licensed under CC BY-NC 4.0.\ncode"),
        (5, "z/q.py", "code"),
        (6, None, "Released under the MIT License."),
        (7, None, None),
        (None, "a/w.py", "Released under the MIT License."),
        (8, "a/v.py", ""),
        (8, "a/v.py", ""),
    ]
    docs = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, path string, text string, score double, tf int")
    got = sorted(((r.doc_id or 0, r.license, r.origin, r.from_dir) for r in licenses.scan(docs).collect()), key=str)
    want = [(1, "MIT", "header", None), (2, "Apache-2.0", "inherited", "a/b"), (3, "Apache-2.0", "header", None), (4, "CC-BY-NC-4.0", "header", None), (5, None, "none", None), (6, "MIT", "header", None), (7, None, "none", None), (0, "MIT", "inherited", "a"), (8, "MIT", "inherited", "a"), (8, "MIT", "inherited", "a")]
    assert got == sorted(want, key=str)
    assert licenses.scan(empty_documents(spark).withColumn("path", F.lit("x"))).collect() == []


def test_license_plan_has_no_python(spark, sf):
    plan = op6_licenses(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def wrapped(text, mark="", width=60):
    import textwrap

    return "\n".join(mark + line for line in textwrap.wrap(text, width))


GNU_HEADER = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
PROSE = "The river rose in the night and the bridge was closed. {} Nobody crossed before the morning came."


def test_licenses_of_files_blocks_and_sentences(spark):
    text = dict(licenses.unit_templates()[-len(licenses.TEXTS) :])
    cases = [(f"{k}/LICENSE", "Copyright (c) 2020 Jane Doe\n\n" + body, lic) for k, (lic, body) in enumerate(text.items())]
    cases += [
        ("x/LICENSE", "GNU GENERAL PUBLIC LICENSE\nVersion 2, June 1991", "GPL-2.0"),
        ("x/a.c", wrapped(GNU_HEADER.format(2), " * ") + "\nint main() { return 0; }", "GPL-2.0"),
        ("x/b.c", wrapped(GNU_HEADER.format(3), "# ") + "\nimport os", "GPL-3.0"),
        ("x/c.c", GNU_HEADER.format(2), "GPL-2.0"),
        ("x/d.c", "import os\n" + wrapped(text["ISC"], "// ") + "\nreturn value", "ISC"),
        ("x/e.txt", PROSE.format("Released under the MIT License."), "MIT"),
        ("x/f.txt", PROSE.format("This work is licensed under the GNU General Public License, version 3."), "GPL-3.0"),
        ("x/g.txt", wrapped(PROSE.format("This program is licensed under the GNU General Public License, version 2."), width=45), "GPL-2.0"),
        ("y/h.txt", PROSE.format("The driver lost his licence and had no permission to drive."), None),
    ]
    docs = spark.createDataFrame([(k, p, t) for k, (p, t, _) in enumerate(cases)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [(c[0], got[k].license) for k, c in enumerate(cases)] == [(c[0], c[2]) for c in cases]
    assert all((got[k].origin == "header") == (c[2] is not None) for k, c in enumerate(cases))
    assert got[len(text) + 4].line_no == 1 and got[len(text) + 5].line_no == 0
    assert all(re.search(licenses.ANCHOR, t) for _, t in licenses.unit_templates())
