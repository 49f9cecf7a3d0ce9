"""Audio columns: lossless 8-bit samples in WAV bytes, and features of them.

A clip's samples are resampled by a polyphase filter, cut into overlapping windows for log-mel
filterbanks, and segmented by frame energy with hysteresis. Segments are stored as fixed-shape Arrow
tensors with their time spans. Each clip is handled alone, so equal bytes give equal features.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecpress.session import ship_package


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000  # of the stored samples
    to_rate: int = 8_000  # at which features are computed
    window: int = 256
    hop: int = 128
    mels: int = 20
    frames: int = 32  # of a stored tensor
    taps: int = 8  # of the filter, on each side of a sample, at the lower rate
    on: float = 0.6  # share of the energy's range above its floor that starts a segment
    off: float = 0.3  # and below which it ends


# -- storage -------------------------------------------------------------------------------------------


def to_wav(payload: bytes, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> tuple[bytes, int]:
    with wave.open(io.BytesIO(data), "rb") as w:
        if w.getnchannels() != 1 or w.getsampwidth() != 1:
            raise ValueError("one channel of 8-bit samples is expected")
        return w.readframes(w.getnframes()), w.getframerate()


def padded(data: bytes, unit: int = 64) -> bytes:
    """Zero bytes appended up to a positive multiple of ``unit``."""
    return data + bytes(max(unit, -(-len(data) // unit) * unit) - len(data))


# -- features ------------------------------------------------------------------------------------------


@lru_cache(maxsize=8)
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """Phases of a windowed-sinc low pass: row r serves outputs that fall r/up after an input sample."""
    cut = min(1.0, up / down)
    half = int(np.ceil(taps / cut))
    k = np.arange(-half, half + 1)
    at = k[None, :] - np.arange(up)[:, None] / up
    h = cut * np.sinc(cut * at) * (0.5 + 0.5 * np.cos(np.pi * np.clip(at / (half + 1), -1, 1)))
    return (h / h.sum(axis=1, keepdims=True)).astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int = 8) -> np.ndarray:
    """Polyphase resampling by up/down: only the outputs that stay are computed, each from one phase."""
    g = gcd(up, down)
    up, down = up // g, down // g
    phases = _filter(up, down, taps)
    half = phases.shape[1] // 2
    n = -(-len(x) * up // down)
    edge = np.pad(x, half)
    views = np.lib.stride_tricks.sliding_window_view(edge, 2 * half + 1)
    out = np.empty(n, np.float32)
    for r in range(up):
        # outputs i with i * down % up == r; consecutive ones are `down` inputs apart
        first = next((i for i in range(min(up, n)) if i * down % up == r), None)
        if first is not None:
            at = np.arange(first, n, up) * down // up
            step = at[1] - at[0] if len(at) > 1 else 1
            out[first::up] = views[at[0] : at[-1] + 1 : step] @ phases[r]
    return out


@lru_cache(maxsize=8)
def _mel(rate: int, window: int, mels: int) -> np.ndarray:
    """Triangles that overlap by half, evenly spaced on the mel scale."""
    top = 2595 * np.log10(1 + rate / 2 / 700)
    hz = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    up, down = (f - hz[:-2]) / (hz[1:-1] - hz[:-2]), (hz[2:] - f) / (hz[2:] - hz[1:-1])
    bank = np.maximum(0, np.minimum(up, down))
    return (bank / np.maximum(bank.sum(axis=0), 1e-6)).astype(np.float32)


def log_mel(x: np.ndarray, s: Settings) -> np.ndarray:
    """Log-mel energies of overlapping windows, frame by band; a clip has at least one frame."""
    n = max(1, -(-max(0, len(x) - s.window) // s.hop) + 1)
    x = np.pad(x, (0, (n - 1) * s.hop + s.window - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, s.window)[:: s.hop] * np.hanning(s.window).astype(np.float32)
    spectrum = np.fft.rfft(frames, axis=1)
    power = spectrum.real**2 + spectrum.imag**2
    return np.log(power.astype(np.float32) @ _mel(s.to_rate, s.window, s.mels) + np.float32(1e-6))


def segments(energy: np.ndarray, on: float, off: float) -> list[tuple[int, int]]:
    """Frame ranges that start where energy passes ``on`` of its range and end where it falls below ``off``."""
    low, high = float(energy.min()), float(energy.max())
    if high - low < 1e-3:
        return [(0, len(energy))]
    start, stop = energy >= low + on * (high - low), energy < low + off * (high - low)
    # the last event before each frame decides whether it lies within a segment
    event = np.where(start, 1, np.where(stop, -1, 0))
    last = np.maximum.accumulate(np.where(event != 0, np.arange(len(event)), -1))
    inside = (last >= 0) & (event[np.maximum(last, 0)] == 1)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], inside.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


@dataclass
class Features:
    tensors: np.ndarray  # segment x frame x band, quantised to hundredths, short ones padded with the floor
    spans: list[tuple[float, float]]  # seconds


def features(payload: bytes, s: Settings = Settings()) -> Features:
    """Segments longer than a tensor are continued in the next one, so that no frame is left out."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - np.float32(128)) / np.float32(128)
    mel = log_mel(resample(x, s.to_rate, s.rate, s.taps), s)
    parts, spans = [], []
    cells = np.rint(np.clip(mel, -300, 300) * 100).astype(np.int16)
    for a, b in segments(np.round(mel.mean(axis=1), 3), s.on, s.off):
        for i in range(a, b, s.frames):
            j = min(b, i + s.frames)
            part = np.full((s.frames, s.mels), -1382, np.int16)  # the log of the floor
            part[: j - i] = cells[i:j]
            parts.append(part)
            spans.append((i * s.hop / s.to_rate, ((j - 1) * s.hop + s.window) / s.to_rate))
    return Features(np.array(parts, np.int16).reshape(-1, s.frames, s.mels), spans)


def to_arrow(f: Features) -> pa.RecordBatch:
    """Segments as a column of fixed-shape tensors with their spans."""
    kind = pa.fixed_shape_tensor(pa.int16(), f.tensors.shape[1:])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(f.tensors.ravel()), int(np.prod(f.tensors.shape[1:])))
    return pa.RecordBatch.from_arrays(
        [pa.ExtensionArray.from_storage(kind, flat), pa.array([a for a, _ in f.spans], pa.float64()), pa.array([b for _, b in f.spans], pa.float64())], names=["log_mel", "start_s", "end_s"]
    )


def to_ipc(f: Features) -> bytes:
    sink = pa.BufferOutputStream()
    batch = to_arrow(f)
    with pa.ipc.new_stream(sink, batch.schema) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_ipc(data: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def describe(data: bytes) -> tuple[str, int]:
    """Shape and digest of stored tensors and their spans, and how many there are."""
    batch = from_ipc(data)
    column = batch.column("log_mel")
    seen = hashlib.sha256(column.storage.flatten().to_numpy())
    for span in ("start_s", "end_s"):
        seen.update(batch.column(span).to_numpy())
    return f"{'x'.join(map(str, (len(column), *column.type.shape)))}:{seen.hexdigest()[:32]}", len(column)


# -- in Spark ------------------------------------------------------------------------------------------


def _store(s: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = b.column(1)
            rows, held, size = [], [], 0
            for i in range(len(b)):
                data = (text[i].as_py() or "").encode()
                rows.append((len(data), to_wav(padded(data), s.rate)))
                held.append(i)
                size += len(rows[-1][1])
                if size > 4 << 20 or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(held)), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["doc_id", "n_bytes", "media"])
                    rows, held, size = [], [], 0

    return run


def store(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_bytes, media``: each text's UTF-8 bytes, padded with zeros to a positive multiple
    of 64, as 8-bit samples of a WAV file. A null text is empty; other columns are ignored; repeated
    rows and null ids are kept; an empty table gives no row."""
    ship_package(docs.sparkSession)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(_store(s), "doc_id long, n_bytes long, media binary")


def _analyse(s: Settings):
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_segments", "tensors"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i, (doc_id, n_bytes) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist())):
                data = b.column("media")[i].as_py()
                if data is None:
                    rows.append((doc_id, n_bytes, *[None] * 8))
                else:
                    payload, _ = from_wav(data)
                    tensors = to_ipc(features(payload, s))
                    feature, n = describe(tensors)
                    rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature, n, tensors))
                    size += len(tensors)
                if len(rows) >= 200 or size > 4 << 20 or i + 1 == len(b):
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0

    return run


def analyse(media: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Read stored media back: digests, the tensors as an Arrow stream for each row (``from_ipc``),
    and a ``feature`` that names the shape and digest of the tensors and spans in that stream.

    Rows of ``media(doc_id, n_bytes, media)`` are kept as they are, repeated ones too; a null media
    has nulls in all that would come from it; bytes that aren't 8-bit WAV raise an error; very long
    clips are taken whole; an empty table gives no row; other columns are ignored.
    """
    ship_package(media.sparkSession)
    ddl = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_segments int, tensors binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_analyse(s), ddl)
