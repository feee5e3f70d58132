"""Audio features of media columns.

``store`` keeps payloads as 8-bit mono WAV, without loss; ``features`` reads such media
and gives log-mel tensors and segments: polyphase resampling, overlapped frames, a mel
filterbank, and segments by energy with hysteresis.

A document's tensors are one Arrow stream (binary) with the columns ``mel``, a
fixed-shape tensor of ``FRAMES`` by ``MELS`` float32, ``start`` and ``end`` in seconds,
and ``valid``, the frames that are not padding. Features depend on the stored bytes
alone, so equal payloads have equal values.

Defined results: a null text is the empty payload, which is 64 zero bytes; silence has
no segments; media that is no 8-bit mono PCM WAV raises; rows repeat as they come;
extra columns are kept; an empty table gives an empty table.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import small_batches
from .common import arrow_map, claim, trim

UNIT = 64
#: Sampling rates stored and analysed.
RATE_IN, RATE = 16_000, 8_000
WINDOW, HOP, MELS, FRAMES = 256, 128, 24, 32
#: Frames whose spectra are held at once.
PIECE = 4096
#: Segment thresholds in dB above the mean frame energy: begin, and go on.
BEGIN_DB, KEEP_DB = 1.0, -1.0
TAPS = 8  # zero crossings on each side of the resampling filter
WAV = struct.Struct("<4sI4s4sIHHIIHH4sI")


def padded(payload: bytes) -> bytes:
    """Zero bytes up to a positive multiple of ``UNIT``."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def to_wav(payload: bytes, rate: int = RATE_IN) -> bytes:
    n = len(payload)
    return WAV.pack(b"RIFF", 36 + n, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n) + payload


def from_wav(media: bytes) -> tuple[bytes, int]:
    """Samples and rate, checked."""
    if len(media) < WAV.size:
        raise ValueError("media cut short")
    riff, total, wave, fmt, size, kind, channels, rate, _, width, bits, data, n = WAV.unpack_from(media)
    if (riff, wave, fmt, data) != (b"RIFF", b"WAVE", b"fmt ", b"data") or (size, kind, channels, width, bits) != (16, 1, 1, 1, 8):
        raise ValueError("not an 8-bit mono PCM WAV")
    if total != 36 + n or len(media) != WAV.size + n:
        raise ValueError("WAV length differs from its header")
    return media[WAV.size :], rate


@lru_cache(maxsize=8)
def _filter(up: int, down: int) -> tuple[np.ndarray, int]:
    """Windowed sinc at the upsampled rate, in phases: (up, taps per phase)."""
    half = TAPS * max(up, down)
    t = np.arange(-half, half + 1)
    cut = 1 / max(up, down)
    taps = up * cut * np.sinc(cut * t) * np.hanning(2 * half + 3)[1:-1]
    size = -(-len(taps) // up)
    taps = np.append(taps, np.zeros(size * up - len(taps)))
    return np.ascontiguousarray(taps.reshape(size, up).T.astype(np.float32)), half


def resample(x: np.ndarray, rate_in: int, rate: int) -> np.ndarray:
    """``x`` at another rate: only the products that an output needs, phase by phase."""
    g = gcd(rate_in, rate)
    up, down = rate // g, rate_in // g
    if up == down:
        return x.astype(np.float32)
    phases, half = _filter(up, down)
    n, size = -(-len(x) * up // down), phases.shape[1]
    side = np.zeros(size + down, np.float32)
    base = np.concatenate([side, x.astype(np.float32), side, side])
    out = np.zeros(n, np.float32)
    for first in range(min(up, n)):  # outputs first, first + up, ... share a phase
        centre = first * down + half
        phase, at = centre % up, centre // up + len(side)
        count = -(-(n - first) // up)
        acc = np.zeros(count, np.float32)
        for k, tap in enumerate(phases[phase]):
            acc += tap * base[at - k : at - k + (count - 1) * down + 1 : down]
        out[first::up] = acc
    return out


@lru_cache(maxsize=4)
def _mel(rate: int) -> np.ndarray:
    """Triangular filters, equally spaced in mel: (bins, MELS)."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), MELS + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    f = np.arange(WINDOW // 2 + 1) * rate / WINDOW
    rise = (f[:, None] - edge[:-2]) / (edge[1:-1] - edge[:-2])
    fall = (edge[2:] - f[:, None]) / (edge[2:] - edge[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_HANN = np.hanning(WINDOW + 1)[:-1].astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values (frames, MELS) and frame energies in dB; the end is zero-padded.
    Spectra are taken ``PIECE`` frames at a time: of long media only what is returned grows."""
    frames = max(1, -(-(len(x) - WINDOW) // HOP) + 1)
    mel, energy = np.empty((frames, MELS), np.float32), np.empty(frames)
    for first in range(0, frames, PIECE):
        some = min(PIECE, frames - first)
        piece = x[first * HOP : (first + some - 1) * HOP + WINDOW]
        piece = np.append(piece, np.zeros((some - 1) * HOP + WINDOW - len(piece), np.float32))
        cut = np.lib.stride_tricks.sliding_window_view(piece, WINDOW)[::HOP] * _HANN
        power = np.abs(np.fft.rfft(cut, axis=1)).astype(np.float32) ** 2
        mel[first : first + some] = np.log(power @ _mel(rate) + np.float32(1e-6))
        energy[first : first + some] = 10 * np.log10(np.square(cut, dtype=np.float64).mean(axis=1) + 1e-10)
    return mel, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Runs of frames (first, last) that keep above the lower threshold and reach the
    upper one somewhere. Both stand relative to the mean energy, so silence has none."""
    level = energy.mean()
    keep, begin = energy >= level + KEEP_DB, energy >= level + BEGIN_DB
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    reached = np.concatenate([[0], np.cumsum(begin)])
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True) if reached[b] > reached[a]]


def _tensors(mel: np.ndarray, rate: int) -> bytes:
    n = -(-len(mel) // FRAMES)
    cells = np.zeros((n, FRAMES, MELS), np.float32)
    cells.reshape(n * FRAMES, MELS)[: len(mel)] = mel
    valid = np.minimum(FRAMES, len(mel) - FRAMES * np.arange(n))
    start = np.arange(n) * FRAMES * HOP / rate
    end = start + ((valid - 1) * HOP + WINDOW) / rate
    batch = pa.RecordBatch.from_arrays([pa.FixedShapeTensorArray.from_numpy_ndarray(cells), pa.array(start), pa.array(end), pa.array(valid, pa.int32())], names=["mel", "start", "end", "valid"])
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, batch.schema) as stream:
        stream.write_batch(batch)
    return sink.getvalue()


def tensors(stored: bytes) -> pa.Table:
    """The table behind a value of the column ``tensors``."""
    return pa.ipc.open_stream(stored).read_all()


def store(df: DataFrame, text: str = "text") -> DataFrame:
    """``text`` replaced by ``n_bytes`` (its UTF-8 length) and ``media``; columns of
    these names give way."""
    df = df.drop(*({"n_bytes", "media"} - {text}))
    at = df.columns.index(text)
    fields = list(df.schema.fields)
    fields[at : at + 1] = [T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("audio", lambda: None)
        for batch in small_batches(batches):
            raw = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            arrays, names = list(batch.columns), list(batch.schema.names)
            arrays[at : at + 1] = [pa.array([len(x) for x in raw], pa.int64()), pa.array([to_wav(padded(x)) for x in raw], pa.binary())]
            names[at : at + 1] = ["n_bytes", "media"]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return arrow_map(df, run, T.StructType(fields))


_SEGMENTS = pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))


def features(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with ``payload`` (the samples), ``tensors``, ``frames`` and ``segments``
    (time spans in seconds) at the end; columns of these names give way."""
    span = T.ArrayType(T.StructType([T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType())]))
    more = [T.StructField("payload", T.BinaryType()), T.StructField("tensors", T.BinaryType()), T.StructField("frames", T.IntegerType()), T.StructField("segments", span)]
    kept = [f for f in df.schema.fields if f.name not in {m.name for m in more}]
    at = [f.name for f in kept].index(media)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("audio", lambda: None)
        for batch in small_batches(batches, 128):
            payloads, stored, frames, spans = [], [], [], []
            for wav in batch.column(at).to_pylist():
                payload, rate = from_wav(wav)
                x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
                mel, energy = log_mel(resample(x, rate, RATE), RATE)
                payloads.append(payload)
                stored.append(_tensors(mel, RATE))
                frames.append(len(mel))
                spans.append([{"start": a * HOP / RATE, "end": (b * HOP + WINDOW) / RATE} for a, b in segments(energy)])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(payloads, pa.binary()), pa.array(stored, pa.binary()), pa.array(frames, pa.int32()), pa.array(spans, _SEGMENTS)],
                names=[*batch.schema.names, "payload", "tensors", "frames", "segments"],
            )
        trim()

    return arrow_map(df.drop(*(f.name for f in more)), run, T.StructType([*kept, *more]))
