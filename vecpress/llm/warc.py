"""WARC 1.1 archives: one gzip member per record, written and read in order.

The reader is sequential: it feeds a stream in small chunks to an incremental zlib decompressor,
starts a new one at each member's end, frames a record's block by its Content-Length while inflating
(what exceeds it is never inflated) and checks the block and payload digests. In Spark an archive is a row of bytes in a table of the shared folder,
since Python workers can't open every store; files that ``binaryFile`` reads have the same form.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.session import materialize, ship_package

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Archive bytes after which a task starts the next archive.
ARCHIVE_BYTES = 8 << 20
#: A header that hasn't ended after so many bytes is damage.
HEADER_BYTES = 64 << 20


class WarcError(ValueError):
    """The archive is cut off, framed wrongly, or its bytes don't match a digest."""


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


# -- writing ---------------------------------------------------------------------------------------


def _header(first: str, fields: Iterable[tuple[str, str]]) -> bytes:
    """Line breaks in a value would end the field: they become spaces."""
    lines = [first, *(f"{k}: {' '.join(v.splitlines())}" for k, v in fields)]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def member(kind: str, record_id: str, block: bytes, fields: Iterable[tuple[str, str]], date: str, level: int = 6) -> bytes:
    """A record as one gzip member."""
    head = _header(
        "WARC/1.1",
        [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *fields, ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))],
    )
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A response with its payload, or a revisit that has the HTTP header alone."""
    http = _header("HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))])
    fields = [("WARC-Target-URI", url or "about:blank"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if page_id is not None:
        fields.append(("Page-Id", str(page_id)))
    record_id = f"<urn:page:{'none' if page_id is None else page_id}>"
    if refers_to is None:
        return member("response", record_id, http + payload, fields, date)
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    return member("revisit", record_id, http, fields, date)


# -- reading ---------------------------------------------------------------------------------------


class Member:
    """One gzip member of a stream, inflated as its bytes are asked for.

    ``raw`` is what was read from the stream and not inflated yet: at the member's end, the start of the next one.
    """

    def __init__(self, stream, raw: bytes, chunk: int):
        self.stream, self.raw, self.chunk = stream, raw, chunk
        self.z, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        """Inflate a little more; False at the member's end."""
        if self.z.eof:
            return False
        self.raw = self.raw or self.stream.read(self.chunk)
        if not self.raw:
            raise WarcError("the archive ends within a record")
        try:
            self.held += self.z.decompress(self.raw, 4 * self.chunk)
        except zlib.error as e:
            raise WarcError(f"a gzip member is damaged: {e}") from e
        self.raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def until(self, mark: bytes) -> bytes:
        """Bytes before the next ``mark``, which is passed over."""
        seen = 0
        while (end := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if len(self.held) > HEADER_BYTES or not self._more():
                raise WarcError("a record's header has no end")
        out = bytes(self.held[:end])
        del self.held[: end + len(mark)]
        return out

    def exactly(self, n: int) -> bytes:
        while len(self.held) < n and self._more():
            pass
        if len(self.held) < n:
            raise WarcError("a record's length differs from its Content-Length")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out

    def end(self, mark: bytes) -> None:
        """Nothing but ``mark`` must be left; no more than that is inflated to find out."""
        while len(self.held) <= len(mark) and self._more():
            pass
        if self.held != mark:
            raise WarcError("a record's length differs from its Content-Length")


def _fields(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *lines = raw.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError(f"a header line has no colon: {line!r}")
        out[name.lower()] = value.strip()
    return first, out


def read_record(m: Member) -> Record:
    """The record in a member, its block framed by Content-Length, its framing and digests checked."""
    version, headers = _fields(m.until(b"\r\n\r\n"))
    if not version.startswith("WARC/"):
        raise WarcError(f"not a record: {version!r}")
    size = headers.get("content-length", "")
    if not (size.isascii() and size.isdigit()):
        raise WarcError(f"a record's Content-Length is {size!r}")
    block = m.exactly(int(size))
    m.end(b"\r\n\r\n")
    if (want := headers.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        raise WarcError("a block doesn't match its digest")
    record = Record(headers, block)
    if headers.get("content-type", "").startswith("application/http"):
        cut = block.find(b"\r\n\r\n")
        if cut < 0:
            raise WarcError("an HTTP header has no end")
        _, record.http = _fields(block[:cut])
        record.payload = block[cut + 4 :]
        if headers.get("warc-type") == "response" and (want := headers.get("warc-payload-digest")) and want != f"sha1:{sha1_base32(record.payload)}":
            raise WarcError("a payload doesn't match its digest")
    return record


def read(stream, chunk: int = 1 << 16) -> Iterator[Record]:
    """All records of a stream, in order: one is held at a time."""
    raw = stream.read(chunk)
    while raw:
        m = Member(stream, raw, chunk)
        yield read_record(m)
        raw = m.raw or stream.read(chunk)


# -- in Spark ----------------------------------------------------------------------------------------


def _write(date: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n = [], 0, 0

        def archive():
            data = b"".join(parts)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(data).hexdigest()]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["archive", "n_records", "content"])

        for b in batches:
            for i in range(len(b)):
                page_id, url, html, ref = (b.column(k)[i].as_py() for k in range(4))
                payload = (html or "").encode()
                if not parts:
                    info = b"software: vecpress\r\nformat: WARC File Format 1.1\r\n"
                    parts.append(member("warcinfo", f"<urn:archive:{'none' if page_id is None else page_id}>", info, [("Content-Type", "application/warc-fields")], date))
                parts.append(page_member(page_id, url, payload, sha1_base32(payload), ref, date))
                size, n = size + len(parts[-1]), n + 1
                if size >= limit:
                    yield archive()
                    parts, size, n = [], 0, 0
        if parts:
            yield archive()

    return run


def write_archives(pages: DataFrame, least: int = 0, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives of ``pages(page_id, url, html)`` as rows ``archive, n_records, content``.

    Of pages with equal payloads of at least ``least`` bytes, that with the largest page_id is a
    response and the others revisit it. A null html is an empty payload, a null url about:blank. A
    page without page_id never is what others refer to, and pages that repeat the largest page_id
    are responses all. Other columns are ignored; an empty table gives no archive.
    """
    ship_package(pages.sparkSession)
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = p.select("*", F.when(F.octet_length(payload) >= least, F.unhex(F.sha1(payload))).alias("_key"))
    same = keyed.filter("_key is not null").groupBy("_key").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1 and _last is not null").drop("_n")
    # stored, its size is known: Spark sends it to all tasks only if it is below the session's threshold
    same = materialize(same, "payloads")
    ref = F.when(F.col("page_id").eqNullSafe(F.col("_last")), F.lit(None)).otherwise(F.col("_last"))
    roles = keyed.join(same, "_key", "left").select("page_id", "url", "html", ref.alias("ref"))
    return roles.mapInArrow(_write(date, archive_bytes), "archive string, n_records long, content binary")


def _read(with_payload: bool):
    names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", *["payload"] * with_payload]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), *[pa.binary()] * with_payload]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                rows, size = [], 0
                for r in read(io.BytesIO(content.as_py())):
                    kind = r.headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    page, ref = r.headers.get("page-id"), r.headers.get("warc-refers-to")
                    row = (
                        int(page) if page else None,
                        r.headers.get("warc-target-uri"),
                        kind,
                        int(r.http.get("content-length", len(r.payload))),
                        r.headers.get("warc-payload-digest", "").removeprefix("sha1:"),
                        int(ref.strip("<>").rpartition(":")[2]) if ref else None,
                    )
                    rows.append((*row, *[r.payload if kind == "response" else None] * with_payload))
                    size += len(r.payload) * with_payload
                    if len(rows) >= 5000 or size > 16 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def read_archives(archives: DataFrame, payload: bool = True) -> DataFrame:
    """Page records of ``archives(content)``, such as ``binaryFile`` loads: ``page_id, url,
    record_type, payload_bytes, payload_digest, refers_to[, payload]``; size and digest are those of
    the full payload. A damaged archive raises an error; a null archive has no records."""
    ship_package(archives.sparkSession)
    ddl = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long" + ", payload binary" * payload
    return archives.select("content").filter("content is not null").mapInArrow(_read(payload), ddl)
