"""Media columns: texts as WAV samples, and spectral-peak pair fingerprints.

A payload of bytes is stored losslessly as an 8-bit mono WAV file by the standard ``wave`` module and read back by it.
Features come from the samples that were read back: a short-time Fourier transform (Hann window of 64 samples, hop 32),
the strongest bins of each frame that exceed their neighbours in frequency, and pairs of each peak with the next peaks
in time (the constellation scheme published for audio search). A fingerprint is an array of structs
``(frame, code)``, where ``code = f1 << 16 | f2 << 8 | frames between``.

Defined results: a null text is the empty text, whose payload is 64 zero bytes, with no peaks and an empty array; a very
long text is one payload of any length, transformed in blocks of frames, so memory grows with the samples and their
peaks only; equal texts give equal values in every column but ``doc_id``; an empty table gives an empty table; further
columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from meshwright.llm.common import per_text, table

WINDOW, HOP, FAN_OUT, REACH, BLOCK = 64, 32, 3, 32, 4096
_HANN = np.hanning(WINDOW).astype(np.float32)


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """The WAV file whose 8-bit samples are the bytes of ``payload``."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of a WAV file."""
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def padded(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of 64."""
    return data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))


def peaks(samples: bytes, per_frame: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order of time and frequency."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    x[np.frombuffer(samples, np.uint8) == 0] = 0  # padding is silence
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    at, bins = [], []
    for lo in range(0, len(frames), BLOCK):
        power = np.abs(np.fft.rfft(frames[lo : lo + BLOCK] * _HANN, axis=1))[:, 1:]
        power = np.floor(power * 16)  # ties and rounding noise settle here
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, 0)
        best = np.argsort(-top, axis=1, kind="stable")[:, :per_frame]
        best.sort(axis=1)
        rows, cols = np.nonzero(np.take_along_axis(top, best, 1) > 0)
        at.append(rows + lo)
        bins.append(best[rows, cols] + 2)
    return np.concatenate(at), np.concatenate(bins)


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, code) of each pair of a peak with one of the ``FAN_OUT`` next peaks within ``REACH`` frames."""
    at, f = peaks(samples)
    times, codes = [], []
    for k in range(1, FAN_OUT + 1):
        gap = at[k:] - at[:-k]
        near = gap <= REACH
        times.append(at[:-k][near])
        codes.append((f[:-k][near] << 16) | (f[k:][near] << 8) | gap[near])
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order], codes[order]


_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_pairs long, feature string"


def media_columns(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, n_bytes (of the text), the WAV file (``media``) and its fingerprint (``pairs``: time-coded array) of every text."""

    def step(keys: list, texts: list[bytes]) -> dict:
        media = [to_wav(padded(t)) for t in texts]
        pairs = [fingerprint(from_wav(m)) for m in media]
        return {key: keys, "n_bytes": list(map(len, texts)), "media": media, "pairs": [[{"frame": int(a), "code": int(c)} for a, c in zip(*p, strict=True)] for p in pairs]}

    kind = dict(df.dtypes)[key]
    return per_text(df, key, text, f"`{key}` {kind}, n_bytes long, media binary, pairs array<struct<frame:int,code:int>>", step)


def media_digest(columns: DataFrame) -> DataFrame:
    """Digests of the stored media and pairs (:func:`media_columns`), with the payload read back from the files by the wave module."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, media, pairs = batch.columns
            ends, values = pairs.offsets.to_numpy(), pairs.values
            frames, codes = (values.field(n).to_numpy(zero_copy_only=False) for n in ("frame", "code"))
            rows = []
            for m, lo, hi in zip(media, ends[:-1], ends[1:], strict=True):
                file = m.as_py()
                back = from_wav(file)
                feature = hashlib.sha256(np.stack([frames[lo:hi], codes[lo:hi]]).astype("<i8").tobytes()).hexdigest()
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(file), hashlib.sha256(file).hexdigest(), int(hi - lo), feature))
            made = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([keys, sizes, *made], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "n_pairs", "feature"])

    return columns.mapInArrow(run, _SCHEMA)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(media_columns(table(spark, sf_dir, "documents")))
