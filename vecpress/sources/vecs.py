"""Vector files as a Spark data source: ``spark.read.format("vecs")`` after ``register(spark)``.

Rows of ``fvecs``, ``ivecs``, ``bvecs``, ``lvecs`` and ``dvecs`` (doubles) files carry their length before them; the
light forms (``fvecsl`` and so on) have one header of the numbers of rows and of dimensions. A file
is read in ranges of rows, each a partition's. Paths are ones that executors can open: a shared
mount, or a local folder of a single machine.
"""

from __future__ import annotations

import glob
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# kind -> numpy type, Spark type; the light forms end with l: fixed values
KINDS = {"f": ("<f4", "float"), "i": ("<i4", "int"), "b": ("u1", "short"), "l": ("<i8", "long"), "d": ("<f8", "double")}
#: Rows of a partition.
ROWS = 131_072


@dataclass
class Layout:
    kind: str
    light: bool
    n: int
    dim: int

    @property
    def dtype(self) -> np.dtype:
        return np.dtype(KINDS[self.kind][0])

    @property
    def row_bytes(self) -> int:
        return self.dim * self.dtype.itemsize + (0 if self.light else 4)

    @property
    def start(self) -> int:
        return 8 if self.light else 0


def _kind(path: str) -> tuple[str, bool]:
    suffix = os.path.splitext(path)[1].lstrip(".")
    if len(suffix) < 5 or suffix[0] not in KINDS or suffix[1:5] != "vecs" or suffix[5:] not in ("", "l"):
        raise ValueError(f"not a vector file: {path}")
    return suffix[0], suffix.endswith("l")


def layout(path: str) -> Layout:
    """Type, rows and dimensions of a file; its size must fit them exactly."""
    kind, light = _kind(path)
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        head = np.frombuffer(f.read(8), "<u4")
    if light:
        out = Layout(kind, True, int(head[0]), int(head[1]))
    elif not size:
        return Layout(kind, False, 0, 0)
    else:
        out = Layout(kind, False, 0, int(head[0]))
        out.n = size // out.row_bytes
    if out.start + out.n * out.row_bytes != size:
        raise ValueError(f"{path}: {size} bytes don't make whole rows of {out.dim} dimensions")
    return out


def read_rows(path: str, first: int = 0, n: int | None = None, sub_start: int = 0, sub_dim: int | None = None) -> np.ndarray:
    """Rows first..first+n-1 as a matrix of the chosen dimensions."""
    x = layout(path)
    n = max(0, min(x.n - first, x.n if n is None else n))
    with open(path, "rb") as f:
        f.seek(x.start + first * x.row_bytes)
        raw = np.frombuffer(f.read(n * x.row_bytes), np.uint8).reshape(n, x.row_bytes)
    if not x.light and n and (raw[:, :4].copy().view("<u4") != x.dim).any():
        raise ValueError(f"{path}: rows have different lengths")
    body = np.ascontiguousarray(raw[:, 0 if x.light else 4 :]).view(x.dtype)
    end = x.dim if sub_dim is None else sub_start + sub_dim
    if not 0 <= sub_start <= end <= x.dim:
        raise ValueError("the chosen dimensions aren't in the file")
    return body[:, sub_start:end]


def write_rows(path: str, rows: np.ndarray) -> None:
    """A whole file; one-dimensional data become a column."""
    kind, light = _kind(path)
    rows = np.atleast_2d(rows.T).T if rows.ndim == 1 else rows
    rows = np.ascontiguousarray(rows, KINDS[kind][0])
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "wb") as f:
        if light:
            f.write(np.array(rows.shape, "<u4").tobytes() + rows.tobytes())
        else:
            head = np.full((len(rows), 1), rows.shape[1], "<u4")
            f.write(np.hstack([head.view(np.uint8), rows.view(np.uint8).reshape(len(rows), -1)]).tobytes())


def prepend_header(path: str, n: int, dim: int) -> bool:
    """Give a headerless light file its header; a file that has one already is left alone."""
    kind, _ = _kind(path)
    body = n * dim * np.dtype(KINDS[kind][0]).itemsize
    size = os.path.getsize(path)
    if size == body + 8:
        return False
    if size != body:
        raise ValueError(f"{path}: {size} bytes are neither {body} nor 8 more")
    with open(path, "rb") as f:
        data = f.read()
    with open(path, "wb") as f:
        f.write(np.array([n, dim], "<u4").tobytes() + data)
    return True


def strip_header(path: str, row_bytes: int = 10) -> bool:
    """Drop the first 8 bytes of a file whose size leaves 8 when divided by ``row_bytes``."""
    if os.path.getsize(path) % row_bytes != 8 % row_bytes:
        return False
    with open(path, "rb") as f:
        data = f.read()[8:]
    with open(path, "wb") as f:
        f.write(data)
    return True


class _Range(InputPartition):
    def __init__(self, path: str, first: int, n: int, offset: int):
        self.path, self.first, self.n, self.offset = path, first, n, offset


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://").removeprefix("file:")
    if os.path.isdir(path):
        return sorted(f for f in glob.glob(f"{path}/*") if "vecs" in os.path.basename(f))
    found = sorted(glob.glob(path))
    if not found:
        raise FileNotFoundError(path)
    return found


class VecsReader(DataSourceReader):
    def __init__(self, options):
        self.files = _files(options["path"])
        self.rows = int(options.get("batch_size", ROWS))
        self.sub_start, sub = int(options.get("sub_start", 0)), options.get("sub_dim")
        self.sub_dim = None if sub is None else int(sub)
        self.limit = None if options.get("limit") is None else int(options["limit"])

    def partitions(self):
        out, offset = [], 0
        for path in self.files:
            n = layout(path).n
            if self.limit is not None:
                n = min(n, self.limit - offset)
            out += [_Range(path, i, min(self.rows, n - i), offset + i) for i in range(0, max(0, n), self.rows)]
            offset += max(0, n)
        return out or [_Range(self.files[0], 0, 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        m = read_rows(part.path, part.first, part.n, self.sub_start, self.sub_dim)
        kind = pa.int16() if m.dtype == np.uint8 else pa.from_numpy_dtype(m.dtype)
        step = 8192
        for i in range(0, len(m), step):
            x = m[i : i + step]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, max(1, x.shape[1]), dtype=np.int32)[: len(x) + 1]), pa.array(x.ravel()).cast(kind))
            ids = pa.array(np.arange(part.offset + i, part.offset + i + len(x)), pa.int64())
            yield pa.RecordBatch.from_arrays([ids, lists], names=["vec_id", "embedding"])


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str | None  # none for a task without rows


class VecsWriter(DataSourceArrowWriter):
    """Each task attempt writes a file of its own in a hidden folder; rows are as the task has them, so
    sort within partitions first. The commit moves the files of successful tasks into place, in the
    order of partitions and after the files that are there already; an overwrite deletes those first.
    A failed job leaves the folder's files as they were."""

    def __init__(self, options, overwrite: bool):
        self.path, self.suffix = options["path"].removeprefix("file://").removeprefix("file:").rstrip("/"), options.get("kind", "fvecs")
        _kind(f"x.{self.suffix}")
        self.overwrite, self.job = overwrite, uuid.uuid4().hex
        self.hidden = f"{self.path}/.writing-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        parts = []
        for b in batches:
            lists = b.column("embedding")
            if len(b):
                parts.append(lists.flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1))
        number = TaskContext.get().partitionId()
        if not parts:
            return Written(number, None)
        file = f"{self.hidden}/{uuid.uuid4().hex}.{self.suffix}"
        write_rows(file, np.concatenate(parts))
        return Written(number, file)

    def commit(self, messages: list[Written | None]) -> None:
        os.makedirs(self.path, exist_ok=True)
        old = [f for f in glob.glob(f"{self.path}/*") if "vecs" in os.path.basename(f)]
        done = sorted((m.part, m.file) for m in messages if m is not None and m.file)
        numbers = [int(m.group(1)) for f in old if (m := re.match(r"part-(\d+)-", os.path.basename(f)))]
        if not self.overwrite and old and len(numbers) < len(old):
            raise ValueError(f"{self.path} has files of other writers: rows can't be put after theirs")
        first = max(numbers, default=-1) + 1
        for i, (_, file) in enumerate(done):
            os.replace(file, f"{self.path}/part-{first + i:08d}-{self.job}.{self.suffix}")
        if self.overwrite:
            for f in old:
                os.remove(f)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class VecsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecs"

    def schema(self) -> str:
        kind, _ = _kind(_files(self.options["path"])[0])
        return f"vec_id long, embedding array<{KINDS[kind][1]}>"

    def reader(self, schema: StructType) -> VecsReader:
        return VecsReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> VecsWriter:
        return VecsWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    from vecpress.session import ship_package

    ship_package(spark)
    spark.dataSource.register(VecsSource)
