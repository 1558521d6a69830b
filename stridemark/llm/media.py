"""Media columns: texts' bytes kept as WAV, read back by the wave module, and fingerprinted by pairs of spectral peaks.

A payload is the text in UTF-8, filled up with spaces to a positive multiple of the frame length, stored as 8-bit mono
samples. The sound is cut into frames of ``FRAME`` samples at every ``HOP``; of each frame's Hann-windowed spectrum the
strongest local peaks are kept, and every frame's strongest peak is paired with its second and with the peaks of the next
``REACH`` frames.
A fingerprint is an array of longs: time of the first peak << 24 | its bin << 16 | other bin << 8 | frames between.

Defined cases. Null text: as empty, one frame of spaces. Equal texts: equal values, whatever rows stand around them,
as every document is transformed by itself. Silent frames (no local peak above zero) give no peak. Ties: of equal peaks
the lower bin is the stronger one. Very long texts: frames are transformed 2,048 at a time, but a document's payload and
sound are in one task's memory. Repeated rows: each by itself. Empty table: no rows. Columns of the input named like the
new ones are replaced by them; all others stay. Null media: payload null, no fingerprint.
"""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

UNIT = 192
FRAME, HOP, REACH, RATE = 192, 96, 2, 8000


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("not 8-bit mono")
        return w.readframes(w.getnframes())


def fingerprint(payload: bytes) -> np.ndarray:
    """Pairs of spectral peaks, in order of time."""
    samples = np.frombuffer(payload, np.uint8).astype(np.float32) - 128.0
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    n = len(frames)
    window = np.hanning(FRAME).astype(np.float32)
    bins, power = np.zeros((n, 2), np.int64), np.zeros((n, 2), np.float32)
    for a in range(0, n, 2048):  # bounded memory, however long the sound is
        spectrum = np.abs(np.fft.rfft(frames[a : a + 2048] * window, axis=1)).astype(np.float32)
        inner = spectrum[:, 1:-1]
        inner = np.where((inner > spectrum[:, :-2]) & (inner >= spectrum[:, 2:]), inner, 0)
        rows = np.arange(len(inner))
        for j in range(2):
            best = inner.argmax(axis=1)
            bins[a : a + len(inner), j], power[a : a + len(inner), j] = best + 1, inner[rows, best]
            inner[rows, best] = 0
    out = []
    for step in range(REACH + 1):
        for j in range(0 if step else 1, 2):
            first, other = np.arange(n - step), np.arange(step, n)
            ok = (power[first, 0] > 0) & (power[other, j] > 0)
            out.append((first[ok] << 24) | (bins[first[ok], 0] << 16) | (bins[other[ok], j] << 8) | step)
    return np.sort(np.concatenate(out)) if out else np.zeros(0, np.int64)


def encode(docs: DataFrame, text: str = "text", into: str = "media") -> DataFrame:
    """The rows with their text's bytes as a WAV column."""
    bounded_batches(docs.sparkSession, rows=500)

    @F.pandas_udf("binary")
    def wav(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            payloads = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            yield pd.Series([to_wav(p + b" " * (-len(p) % UNIT or (0 if p else UNIT))) for p in payloads], dtype=object)

    return docs.withColumn(into, wav(F.col(text)))


def decode(docs: DataFrame, media: str = "media", payload: str = "payload", into: str = "fingerprint") -> DataFrame:
    """The rows with the payload read back from the WAV column and its fingerprint."""

    @F.pandas_udf(f"{payload} binary, {into} array<bigint>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for sounds in batches:
            payloads = [from_wav(m) if m is not None else None for m in sounds]
            yield pd.DataFrame({payload: pd.Series(payloads, dtype=object), into: pd.Series([fingerprint(p) if p else [] for p in payloads], dtype=object)})

    found = f"__read_{uuid.uuid4().hex}"  # no column of the input has that name
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (payload, into)]
    return docs.withColumn(found, read(F.col(media))).select(*kept, *[F.col(f"{found}.{c}").alias(c) for c in (payload, into)])
