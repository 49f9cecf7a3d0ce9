import base64
import hashlib
import io
import zlib

import pytest

from vecpress.llm import warc
from vecpress.llm.queries import op7_warc


def b32(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def expected(pages, least=0):
    last = {}
    for i, html in pages:
        data = (html or "").encode()
        if len(data) >= least and i is not None:
            last[data] = max(i, last.get(data, i))
    out = []
    for i, html in pages:
        data = (html or "").encode()
        ref = last.get(data) if len(data) >= least and [h or "" for _, h in pages].count(html or "") > 1 else None
        ref = None if ref == i else ref
        out.append((i, len(data), b32(data), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


def as_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_query_against_brute_force(spark, sf):
    pages = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert as_rows(op7_warc(spark, sf)) == expected(pages)


@pytest.mark.parametrize("least", [0, 1, 3])
def test_odd_pages(spark, least):
    pages = [(1, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (5, "WARC/1.1\r\n\r\n"), (6, "x" * 300_000), (7, "x" * 300_000), (7, "é你")]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", h, 1) for i, h in pages], "page_id long, url string, html string, ref int")
    archives = warc.write_archives(df, least, archive_bytes=500)
    assert as_rows(warc.read_archives(archives)) == expected(pages, least)
    back = {r.page_id: r.payload for r in warc.read_archives(archives).collect() if r.record_type == "response" and r.page_id not in (7, None)}
    assert all(bytes(v).decode() == (dict(pages)[k] or "") for k, v in back.items())


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(df)).collect() == []


def test_file_round_trip(tmp_path):
    f = tmp_path / "x.warc.gz"
    data = [warc.page_member(i, "u", p, b32(p), None, "1970-01-01T00:00:00Z") for i, p in enumerate([b"", b"abc", bytes(range(256)) * 900])]
    f.write_bytes(b"".join(data))
    for chunk in (1, 7, 1 << 16):
        with f.open("rb") as s:
            assert [r.payload for r in warc.read(s, chunk)] == [b"", b"abc", bytes(range(256)) * 900]


def test_archive_files_through_binary_file(spark, tmp_path):
    pages = [(1, "a"), (2, "a"), (3, None), (4, "é\r\n\r\n" * 1000)]
    df = spark.createDataFrame([(i, "http://h/", h) for i, h in pages], "page_id long, url string, html string")
    for r in warc.write_archives(df, archive_bytes=300).collect():
        (tmp_path / f"{r.archive}.warc.gz").write_bytes(r.content)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(str(tmp_path))
    assert files.count() > 1
    assert as_rows(warc.read_archives(files)) == expected(pages)


def test_a_block_beyond_its_length_is_not_inflated():
    head = b"WARC/1.1\r\nContent-Length: 3\r\n\r\n"
    z = zlib.compressobj(9, zlib.DEFLATED, 31)
    bomb = z.compress(head + b"abc" + bytes(200 << 20)) + z.flush()
    m = warc.Member(io.BytesIO(bomb), b"", 1 << 10)
    with pytest.raises(warc.WarcError, match="Content-Length"):
        warc.read_record(m)
    assert len(m.held) < 1 << 20


@pytest.mark.parametrize("harm", ["cut", "flip", "length", "digest"])
def test_damage_is_found(harm):
    p = b"payload " * 50
    good = warc.page_member(1, "u", p, b32(p), None, "d")
    if harm == "cut":
        bad = good[:-9]
    elif harm == "flip":
        bad = good[:40] + bytes([good[40] ^ 255]) + good[41:]
    elif harm == "digest":
        bad = warc.page_member(1, "u", p, b32(p + b"x"), None, "d")
    else:
        raw = zlib.decompress(good, 31).replace(b"\r\n\r\n", b"\r\n\r\nmore", 1)
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        bad = z.compress(raw) + z.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read(io.BytesIO(bad)))
