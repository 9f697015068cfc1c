"""Media columns: texts as WAV, read by the wave module, with short-time Fourier transforms and spectral-peak pairs.

A fingerprint is an array of (time, delta, low, high): two peaks of the spectrogram, the frame of the first, the
frames between them and their frequency bins. A passage moved by other than a multiple of HOP samples falls into frames
otherwise and keeps only some of its pairs.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read, slices

RATE, UNIT, FRAME, HOP, PEAKS, FAN_OUT, REACH = 8000, 192, 192, 96, 3, 3, 8
#: Frames transformed at a time.
_FRAMES = 2048
_WINDOW = np.hanning(FRAME).astype(np.float32)
FIELDS = pa.struct([("time", pa.int32()), ("delta", pa.int16()), ("low", pa.int16()), ("high", pa.int16())])


def encode(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, WAV of one channel of 8-bit samples): UTF-8 and spaces up to a positive multiple of UNIT."""
    raw = (text or "").encode()
    size = max(UNIT, -(-len(raw) // UNIT) * UNIT)
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(raw.ljust(size, b" "))
    return len(raw), out.getvalue()


def decode(media: bytes) -> bytes:
    """The samples of a WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> np.ndarray:
    """The loudest PEAKS local maxima of each frame's spectrum, loudest first, 0 where there are fewer.

    Frames of FRAME samples start every HOP samples, the first and last reach over the ends by as much, so that each
    sample has the same weight in all.
    """
    x = np.frombuffer(b" " * HOP + samples + b" " * HOP, np.uint8)
    x = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    out = []
    for lo in range(0, len(x), _FRAMES):
        frames = x[lo : lo + _FRAMES].astype(np.float32)
        frames -= frames.mean(axis=1, keepdims=True)
        spectrum = np.abs(np.fft.rfft(frames * _WINDOW, axis=1))
        inner = spectrum[:, 1:-1]
        loud = np.where((inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]), inner, 0)
        bins = np.argsort(-loud, axis=1, kind="stable")[:, :PEAKS]
        out.append(np.where(np.take_along_axis(loud, bins, axis=1) > 0, bins + 1, 0))
    return np.concatenate(out) if out else np.zeros((0, PEAKS), np.int64)


def pairs(peak: np.ndarray) -> np.ndarray:
    """(time, delta, low, high) rows: each peak with the next FAN_OUT peaks of another bin within REACH later frames."""
    n, taken, out = len(peak), np.zeros(peak.shape, np.int8), [np.zeros((0, 4), np.int64)]
    for delta in range(1, min(REACH, n - 1) + 1):
        if not ((taken[: n - delta] < FAN_OUT) & (peak[: n - delta] > 0)).any():
            break
        for k in range(PEAKS):
            high = peak[delta:, k, None]
            low = peak[: n - delta]
            a, i = np.nonzero((low > 0) & (high > 0) & (low != high) & (taken[: n - delta] < FAN_OUT))
            taken[a, i] += 1
            out.append(np.stack([a, np.full(len(a), delta), low[a, i], high[a, 0]], axis=1))
    rows = np.concatenate(out)
    return rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]


def digest(rows: np.ndarray) -> str:
    return f"{len(rows)}:" + hashlib.sha256(np.ascontiguousarray(rows, "<i8").tobytes()).hexdigest()


def media_columns(docs: DataFrame, keep: bool = True) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, media,
    fingerprint): each text as WAV and what is read back from it.

    feature is a digest of the fingerprint; media and fingerprint are null unless keep is set. Null and empty texts
    are one unit of spaces. Equal texts have equal values, repeated rows are repeated, other columns are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("media", pa.binary()), ("fingerprint", pa.list_(FIELDS))])

    def run(batches):
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n, media = encode(text)
                back = decode(media)
                found = pairs(peaks(back))
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), digest(found), media if keep else None, [dict(zip(("time", "delta", "low", "high"), r)) for r in found.tolist()] if keep else None))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, media binary, fingerprint array<struct<time:int,delta:smallint,low:smallint,high:smallint>>")


def op5_wav_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(read(spark, sf_dir, "documents"), keep=False).drop("media", "fingerprint")
