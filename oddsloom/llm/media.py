"""Media columns: texts as WAV files with spectral-peak pair fingerprints.

The UTF-8 bytes of a text, padded with spaces to a positive multiple of 192, are the 8-bit mono samples of a WAV file
written and read back by the wave module. A short-time Fourier transform (Hann window of 192 samples, hop 96) gives each
frame its strongest bin; a peak is paired with those of the next three frames. Pairs are stored as two arrays: the frame
they start in and ``first bin << 12 | second bin << 4 | frames between``. Equal texts have equal values; a null or empty
text is one frame of spaces, without pairs. Long texts are transformed block by block.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialize, small_batches

UNIT, HOP, RATE, FAN = 192, 96, 8000, 3
_FRAMES = 20_000
_WINDOW = np.hanning(UNIT + 1)[:-1].astype(np.float32)


def to_wav(text: str | None) -> tuple[int, bytes]:
    """Unpadded length and the WAV file."""
    data = (text or "").encode()
    padded = data.ljust(max(UNIT, -(-len(data) // UNIT) * UNIT), b" ")
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(padded)
    return len(data), out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: np.ndarray) -> np.ndarray:
    """Strongest bin (never the constant one) of each frame."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, UNIT)[::HOP]
    out = np.empty(len(frames), np.int32)
    for i in range(0, len(frames), _FRAMES):
        spectrum = np.fft.rfft((frames[i : i + _FRAMES].astype(np.float32) - np.float32(128)) * _WINDOW, axis=1)
        power = spectrum.real[:, 1:] ** 2 + spectrum.imag[:, 1:] ** 2
        out[i : i + _FRAMES] = power.argmax(1) + 1
    return out


def pairs(peak: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start frames and codes of peak pairs, in order of frame, then distance."""
    times, codes = [], []
    for gap in range(1, FAN + 1):
        if len(peak) > gap:
            times.append(np.arange(len(peak) - gap, dtype=np.int32))
            codes.append(peak[:-gap] << 12 | peak[gap:] << 4 | gap)
    if not times:
        return np.empty(0, np.int32), np.empty(0, np.int32)
    time, code = np.concatenate(times), np.concatenate(codes).astype(np.int32)
    order = np.lexsort((code & 15, time))
    return time[order], code[order]


def _many(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of several payloads. Frames never cross payloads; all frames of a batch are transformed together."""
    joined = peaks(np.frombuffer(b"".join(payloads), np.uint8))
    at = np.cumsum([0, *[len(p) // HOP for p in payloads]])
    return [pairs(joined[a : b - 1]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes``, ``media`` (WAV), ``pair_time``, ``pair_code``. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            stored = [to_wav(t) for t in batch.column(1).to_pylist()]
            found = _many([from_wav(m) for _, m in stored])
            arrays = [pa.array([n for n, _ in stored], pa.int64()), pa.array([m for _, m in stored], pa.binary()), pa.array([t for t, _ in found], pa.list_(pa.int32())), pa.array([c for _, c in found], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[id_col, "n_bytes", "media", "pair_time", "pair_code"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, media binary, pair_time array<int>, pair_code array<int>")


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What the query returns of the media columns, stored and read again: sizes and digests of the media and of the pair arrays."""
    columns = materialize(media_columns(docs, id_col, text_col), "media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at=2):
            medias = batch.column(2).to_pylist()
            payloads = [from_wav(m) for m in medias]
            times, codes = (_rows(batch.column(i)) for i in (3, 4))
            features = [f"frames={len(p) // HOP - 1};pairs={len(t)};sha256={hashlib.sha256(t.astype('<i4').tobytes() + c.astype('<i4').tobytes()).hexdigest()}" for p, t, c in zip(payloads, times, codes, strict=True)]
            out = [
                batch.column(1), pa.array([len(p) for p in payloads], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payloads]),
                pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()), pa.array([len(m) for m in medias], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in medias]), pa.array(features)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *out], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return columns.select(id_col, "n_bytes", "media", "pair_time", "pair_code").mapInArrow(run, schema)


def _rows(lists: pa.Array) -> list[np.ndarray]:
    """The values of each list."""
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    return np.split(flat, ends[:-1])
