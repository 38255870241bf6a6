"""Media columns: audio features of byte payloads kept as 8-bit sound.

A payload (here a text's UTF-8 bytes, zero-padded to a positive multiple of 64)
is stored without loss as a WAV file of unsigned 8-bit mono samples.  The stored
bytes are then read back, resampled by a polyphase filter, cut into
overlapping frames, turned into log-mel energies, and segmented by energy with
hysteresis.  Log-mel frames are kept as Arrow fixed-shape tensors of
``FRAMES`` x ``MELS`` values with the time span of each, in an Arrow IPC stream.

Everything is computed row by row in blocks of fixed size, so memory follows the
longest single payload; there is no shuffle, and a lost task is simply run again.

Defined results: null and empty texts are 64 zero bytes; equal texts give equal
values, bit for bit; repeated rows and null ids pass through; an empty table
gives no rows; columns beside id and text are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from siltstone.llm import words as W
from siltstone.llm.shared import lean

RATE = 20_000  # samples a second of the stored sound
UP, DOWN = 2, 5  # polyphase ratio: 20 kHz to 8 kHz
WIDTH, HOP = 256, 128  # samples of a frame, and between frames
MELS, FRAMES = 24, 16  # shape of a tensor
ON_DB, OFF_DB = 0.2, -0.2  # of the median frame energy
_HALF = 8  # zero crossings of the filter on either side
_ROW = 16  # steps of DOWN samples that one matrix row covers
_ROWS = 4096
_HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def to_wav(payload: bytes) -> bytes:
    return _HEADER.pack(b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def from_wav(media: bytes) -> np.ndarray:
    """The samples of a WAV file as this module writes it."""
    riff, _, wave, fmt, _, kind, channels, _, _, _, bits, data, size = _HEADER.unpack_from(media)
    if (riff, wave, fmt, data, kind, channels, bits) != (b"RIFF", b"WAVE", b"fmt ", b"data", 1, 1, 8) or len(media) != _HEADER.size + size:
        raise ValueError("not an 8-bit mono PCM file")
    return np.frombuffer(media, np.uint8, size, _HEADER.size)


@cache
def _filter() -> tuple[np.ndarray, int]:
    """A matrix that takes a row of samples to _ROW * UP outputs, and the first sample's place."""
    half = _HALF * max(UP, DOWN)
    t = np.arange(-half, half + 1)
    taps = np.sinc(t / max(UP, DOWN)) * np.kaiser(len(t), 8.0)
    taps *= UP / taps.sum()
    first = -(half // UP)
    width = (_ROW - 1) * DOWN + (half + (UP - 1) * DOWN) // UP - first + 1
    out = np.zeros((width, _ROW * UP), np.float32)
    for n in range(_ROW * UP):
        for k in range(width):
            at = n * DOWN - (k + first) * UP
            if abs(at) <= half:
                out[k, n] = taps[at + half]
    return out, first


def resample(samples: np.ndarray) -> np.ndarray:
    """Samples in -1..1 at RATE * UP / DOWN a second."""
    matrix, first = _filter()
    step, width = _ROW * DOWN, len(matrix)
    n_out = -(-len(samples) * UP // DOWN)
    rows = -(-n_out // (_ROW * UP))
    out = np.empty((rows, _ROW * UP), np.float32)
    for a in range(0, rows, _ROWS):
        b = min(a + _ROWS, rows)
        lo, hi = a * step + first, (b - 1) * step + first + width
        x = np.zeros(hi - lo, np.float32)
        s, e = max(lo, 0), min(hi, len(samples))
        x[s - lo : e - lo] = samples[s:e]
        x[s - lo : e - lo] -= np.float32(128)
        x *= np.float32(1 / 128)
        np.matmul(np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, width)[::step]), matrix, out=out[a:b])
    return out.reshape(-1)[:n_out]


@cache
def _mel() -> tuple[np.ndarray, np.ndarray]:
    rate = RATE * UP / DOWN
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60.0), mel(rate / 2), MELS + 2) / 2595) - 1)
    f = np.arange(WIDTH // 2 + 1) * rate / WIDTH
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.clip(np.minimum(up, down), 0, None).astype(np.float32), np.hanning(WIDTH + 1)[:-1].astype(np.float32)


def log_mel(sound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames, MELS) energies in dB, and each frame's own energy in dB; the last frame is filled up with zeros.

    Values are rounded to 1/100 dB, so that libraries whose sums differ in their last bits give the same.
    """
    bank, window = _mel()
    count = max(-(-(len(sound) - WIDTH) // HOP), 0) + 1
    sound = np.concatenate((sound, np.zeros(WIDTH + (count - 1) * HOP - len(sound), np.float32)))
    frames = np.lib.stride_tricks.sliding_window_view(sound, WIDTH)[::HOP]
    mels, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for a in range(0, len(frames), 2048):
        x = frames[a : a + 2048] * window
        spectrum = np.fft.rfft(x)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[a : a + 2048] = power @ bank
        energy[a : a + 2048] = np.einsum("ij,ij->i", x, x)
    floor = np.float32(1e-8)
    return tuple((np.round(np.log10(np.maximum(x, floor).astype(np.float64)) * 1000) / 100 + 0.0).astype(np.float32) for x in (mels, energy))


def segments(energy: np.ndarray) -> list[tuple[float, float]]:
    """Time spans that begin where energy reaches the upper level and last until it falls to the lower one."""
    level = np.median(energy)
    mark = np.where(energy >= level + ON_DB, 1, np.where(energy <= level + OFF_DB, 0, -1))
    set_at = np.where(mark >= 0, np.arange(len(mark)), -1)
    last = np.maximum.accumulate(set_at)
    on = (last >= 0) & (mark[np.maximum(last, 0)] == 1)
    change = np.flatnonzero(np.diff(np.concatenate(([0], on.astype(np.int8), [0]))))
    second = HOP * DOWN / (RATE * UP)
    return [(float(a * second), float((b - 1) * second + WIDTH * DOWN / (RATE * UP))) for a, b in zip(change[::2], change[1::2], strict=True)]


_TENSOR = pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS])
_TENSORS = pa.schema([("start_s", pa.float64()), ("end_s", pa.float64()), ("frames", pa.int32()), ("log_mel", _TENSOR)])


def to_tensors(mels: np.ndarray) -> bytes:
    """An Arrow IPC stream of fixed-shape tensors with time spans; the last one is padded with zeros."""
    n = -(-len(mels) // FRAMES)
    padded = np.zeros((n * FRAMES, MELS), np.float32)
    padded[: len(mels)] = mels
    count = np.minimum(FRAMES, len(mels) - np.arange(n) * FRAMES).astype(np.int32)
    start = np.arange(n) * FRAMES * HOP * DOWN / (RATE * UP)
    end = start + ((count - 1) * HOP + WIDTH) * DOWN / (RATE * UP)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(padded.reshape(-1)), FRAMES * MELS)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _TENSORS) as out:
        out.write_batch(pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(count), pa.ExtensionArray.from_storage(_TENSOR, storage)], schema=_TENSORS))
    return sink.getvalue().to_pybytes()


def from_tensors(stored: bytes) -> pa.Table:
    return pa.ipc.open_stream(stored).read_all()


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, offsets = W.texts_of(batch.column("text"))
        for i, j in W.slabs(offsets, 1 << 20):
            for a in range(i, j, 512):
                media, n_bytes, tensors, spans, frames = [], [], [], [], []
                b = min(a + 512, j)
                for k in range(a, b):
                    own = raw[offsets[k] : offsets[k + 1]].tobytes()
                    stored = to_wav(own + bytes(max(64, -(-len(own) // 64) * 64) - len(own)))
                    mels, energy = log_mel(resample(from_wav(stored)))
                    media.append(stored)
                    n_bytes.append(len(own))
                    frames.append(len(mels))
                    tensors.append(to_tensors(mels))
                    spans.append([{"start_s": s, "end_s": e} for s, e in segments(energy)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(a, b - a), pa.array(n_bytes, pa.int64()), pa.array(media, pa.binary()), pa.array(frames, pa.int64()), pa.array(spans, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), pa.array(tensors, pa.binary())],
                    ["id", "n_bytes", "media", "n_frames", "segments", "tensors"],
                )


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, n_bytes, media (WAV), n_frames, segments (time spans), tensors (Arrow IPC stream)."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    out = read.mapInArrow(lean(_rows), f"id {kind}, n_bytes long, media binary, n_frames long, segments array<struct<start_s:double,end_s:double>>, tensors binary")
    return out.withColumnRenamed("id", id_col)


def payload(media: Column) -> Column:
    """The payload read back from a stored WAV file."""
    return F.substring(media, _HEADER.size + 1, 2**31 - 1)


def digest(out: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Checksums of what was stored, and a string that holds what was computed."""
    back = payload(F.col("media"))
    spans = F.concat_ws(",", F.transform("segments", lambda s: F.format_string("%.4f-%.4f", s["start_s"], s["end_s"])))
    return out.select(
        id_col, "n_bytes", F.length(back).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"), F.crc32(F.substring("media", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat(F.lit("frames="), "n_frames", F.lit(";segments="), spans, F.lit(";log_mel="), F.sha2("tensors", 256)).alias("feature"),
    )
