"""Audio features of media columns.

A payload is stored losslessly as the samples of an 8-bit mono WAV file, read back from its chunks, resampled by a
polyphase filter, cut into overlapping frames and turned into log-mel energies. Frames whose energy passes an upper
threshold, together with their neighbours above a lower one, form segments with time spans. Energies are stored in
tensors of one fixed shape (frames, bands), the last of a recording filled up with the floor.

Each recording is worked on alone, so equal payloads give equal values. Filters and transforms run over pieces of a fixed
number of samples; what a recording holds besides are its samples as floats, before and after resampling, and its
features, in all about 20 bytes a sample.

The query stores each recording's features as Arrow's fixed-shape tensors with their time spans, reads these back and
derives its feature string from them alone.

Cases: a null or empty text gives the least payload, 192 blanks; texts of any length are taken whole; repeated rows
give the same values; an empty table gives no rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import read_table, texts_of

UNIT = 192

#: Outputs of the filter, and frames, that are worked on at a time.
PIECE, FRAMES = 1 << 16, 1024


@dataclass(frozen=True)
class Settings:
    rate: int = 16_000
    up: int = 3
    down: int = 4
    taps: int = 16  # of each phase of the filter
    frame: int = 256
    hop: int = 128
    bands: int = 24
    tensor_frames: int = 64
    upper: float = 1.2  # of the energy's median: a segment's core
    lower: float = 0.9  # and what may surround it
    floor: float = 1e-10


def payload_of(text: bytes) -> bytes:
    """The text and blanks up to a positive multiple of UNIT bytes."""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b" ")


def to_wav(payload: bytes, rate: int) -> bytes:
    """8-bit mono PCM in a RIFF container."""
    pad = b"\0" * (len(payload) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """The samples and the rate, from the container's chunks."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, data = 12, 0, None
    while at + 8 <= len(media):
        kind, size = struct.unpack_from("<4sI", media, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            data = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if data is None or not rate:
        raise ValueError("a chunk is missing")
    return data, rate


@lru_cache
def low_pass(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc filter at the lower of both rates' limits, as `up` phases of `taps` taps."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) * np.hamming(n)
    return (h / h.sum() * up).reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int, down: int, taps: int) -> np.ndarray:
    """Output k is phase (k * down) % up of the filter at input (k * down) // up; no zero is ever multiplied."""
    phases = low_pass(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps // 2, np.float32), x, np.zeros(taps + down, np.float32)])
    out = np.empty(n, np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    for first in range(min(up, n)):
        h, at = np.ascontiguousarray(phases[first * down % up][::-1]), first * down // up
        own = windows[at : at + -(-(n - first) // up) * down : down][: -(-(n - first) // up)]
        for lo in range(0, len(own), PIECE):
            out[first + lo * up : first + (lo + PIECE) * up : up] = own[lo : lo + PIECE] @ h
    return out


@lru_cache
def mel_bank(rate: float, frame: int, bands: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(frame // 2 + 1) * rate / frame
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - lo) / (mid - lo), (hi - f) / (hi - mid))).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: float, s: Settings) -> np.ndarray:
    """Overlapping frames to log-mel energies, one row a frame."""
    if len(x) < s.frame:
        x = np.pad(x, (0, s.frame - len(x)))
    frames = np.lib.stride_tricks.sliding_window_view(x, s.frame)[:: s.hop]
    window, bank = np.hanning(s.frame).astype(np.float32), mel_bank(rate, s.frame, s.bands)
    out = np.empty((len(frames), s.bands), np.float32)
    for lo in range(0, len(frames), FRAMES):
        spectrum = np.fft.rfft(frames[lo : lo + FRAMES] * window, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        out[lo : lo + FRAMES] = np.log(np.maximum(power @ bank, s.floor))
    return out


def hysteresis(energy: np.ndarray, upper: float, lower: float) -> list[tuple[int, int]]:
    """Runs of frames above `lower` that hold one above `upper`."""
    above = np.concatenate([[False], energy > lower, [False]])
    edges = np.flatnonzero(above[1:] != above[:-1])
    return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if (energy[a:b] > upper).any()]


@dataclass
class Features:
    mel: np.ndarray  # frames, bands
    segments: list[tuple[float, float]]  # seconds
    frame_s: float
    hop_s: float

    def tensors(self, frames: int, fill: float) -> np.ndarray:
        n = max(1, -(-len(self.mel) // frames))
        out = np.full((n * frames, self.mel.shape[1]), fill, np.float32)
        out[: len(self.mel)] = self.mel
        return out.reshape(n, frames, -1)


def analyse(samples: bytes, rate: int, s: Settings = Settings()) -> Features:
    x = (np.frombuffer(samples, dtype=np.uint8).astype(np.float32) - 128) / 128
    y = resample(x, s.up, s.down, s.taps)
    new_rate = rate * s.up / s.down
    mel = log_mel(y - y.mean(), new_rate, s)
    energy = np.exp(mel.astype(np.float64)).sum(axis=1)
    middle, hop = float(np.median(energy)), s.hop / new_rate
    spans = [(round(a * hop, 6), round((b - 1) * hop + s.frame / new_rate, 6)) for a, b in hysteresis(energy, s.upper * middle, s.lower * middle)]
    return Features(mel, spans, s.frame / new_rate, hop)


def stored(f: Features, s: Settings) -> pa.Buffer:
    """The features as an Arrow stream: one row a fixed-shape tensor, with its time span, its frames and its segments."""
    tensors = f.tensors(s.tensor_frames, float(np.log(s.floor)))
    starts, ends = spans(f, len(tensors), s)
    frames = [min(s.tensor_frames, len(f.mel) - k * s.tensor_frames) for k in range(len(tensors))]
    own = [[{"start_s": a, "end_s": b} for a, b in f.segments if lo <= a < lo + s.tensor_frames * f.hop_s] for lo in starts]
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(tensors), pa.array(starts), pa.array(ends), pa.array(frames), pa.array(own, SEGMENTS)], names=["log_mel", "start_s", "end_s", "frames", "segments"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


def feature_string(stream: pa.Buffer) -> str:
    """Of a recording as `stored` gives it: frames, segments, seconds within segments, and the mean and spread of each band."""
    table = pa.ipc.open_stream(stream).read_all().combine_chunks()
    tensors, frames = table["log_mel"].chunk(0).to_numpy_ndarray(), table["frames"].to_pylist()
    mel = np.concatenate([t[:n] for t, n in zip(tensors, frames, strict=True)])
    segments = [x for own in table["segments"].to_pylist() for x in own]
    mean = mel.mean(axis=0, dtype=np.float64)
    spread = np.sqrt(np.maximum(0, (mel.astype(np.float64) ** 2).mean(axis=0) - mean**2))
    parts = f"{len(mel)};{len(segments)};{sum(x['end_s'] - x['start_s'] for x in segments):.3f};"
    return parts + ("%.2f," * (2 * len(mean))) % (*mean.tolist(), *spread.tolist())


SEGMENTS = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def spans(f: Features, n: int, s: Settings) -> tuple[list[float], list[float]]:
    """Start and end of each tensor, in seconds."""
    starts = [k * s.tensor_frames * f.hop_s for k in range(n)]
    return starts, [min(a + (s.tensor_frames - 1) * f.hop_s, (len(f.mel) - 1) * f.hop_s) + f.frame_s for a in starts]


def tensor_rows(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and text to fixed-shape tensors with their time spans, and the segments of the recording."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                f = analyse(*from_wav(to_wav(payload_of(text), s.rate)), s)
                t = f.tensors(s.tensor_frames, float(np.log(s.floor)))
                n = len(t)
                starts, ends = spans(f, n, s)
                flat = pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * t[0].size, pa.array(t.ravel()))
                within = pa.array([[{"start_s": a, "end_s": b} for a, b in f.segments if a < e and b > b0] for b0, e in zip(starts, ends, strict=True)], SEGMENTS)
                yield pa.RecordBatch.from_arrays([pa.array([doc] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array(starts), pa.array(ends), flat, within], names=["doc_id", "tensor", "start_s", "end_s", "log_mel", "segments"])

    schema = "doc_id long, tensor long, start_s double, end_s double, log_mel array<float>, segments array<struct<start_s: double, end_s: double>>"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def as_tensors(log_mel: pa.ListArray | pa.ChunkedArray, s: Settings = Settings()) -> pa.ExtensionArray:
    """A column of tensor_rows as Arrow's fixed-shape tensors."""
    if isinstance(log_mel, pa.ChunkedArray):
        log_mel = log_mel.combine_chunks()
    kind = pa.fixed_shape_tensor(pa.float32(), (s.tensor_frames, s.bands))
    return pa.ExtensionArray.from_storage(kind, log_mel.cast(pa.list_(pa.float32(), s.tensor_frames * s.bands)))


TYPES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def digests(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id and text to digests of the stored form and of what is read back, and the features as one string."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                media = to_wav(payload_of(text), s.rate)
                samples, rate = from_wav(media)
                feature = feature_string(stored(analyse(samples, rate, s), s))
                rows.append((doc, len(text), len(samples), hashlib.sha256(samples).hexdigest(), crc32(samples[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), TYPES.types, strict=True)], schema=TYPES)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read_table(spark, sf_dir, "documents"))
