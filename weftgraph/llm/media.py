"""Audio columns: bytes stored as 8-bit WAV, short-time Fourier transforms, and spectral-peak pair fingerprints."""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftgraph.llm.common import kept, sliced

#: Samples of one frame and between frames; a payload is padded to a multiple of PAD.
FRAME, HOP, PAD = 128, 96, 192
RATE = 8000
#: Frames after an anchor whose peaks pair with it, and frames transformed at once.
FAN, BLOCK = 3, 2048


def padded(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of text (null: empty) with spaces appended up to a positive multiple of PAD, and its length before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    size = max(PAD, -(-len(raw) // PAD) * PAD)
    return raw.ljust(size, b" "), len(raw)


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(rate)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    """The samples of an 8-bit mono WAV."""
    with wave.open(io.BytesIO(media), "rb") as w:
        if (w.getnchannels(), w.getsampwidth()) != (1, 1):
            raise ValueError("8-bit mono expected")
        return w.readframes(w.getnframes())


def spectral_peaks(samples: bytes, window: np.ndarray) -> np.ndarray:
    """The strongest bin of each frame (bin 0 left out), ties going to the lowest bin."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128.0
    n = max(1, -(-max(0, len(x) - FRAME) // HOP) + 1)
    if (n - 1) * HOP + FRAME > len(x):
        x = np.concatenate([x, np.zeros((n - 1) * HOP + FRAME - len(x), np.float32)])
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    peaks = []
    for at in range(0, n, BLOCK):
        part = frames[at : at + BLOCK]
        spectrum = np.fft.rfft((part - part.mean(axis=1, keepdims=True)) * window, axis=1)
        # Rounded, so that the last bits of the transform never decide between two bins.
        power = np.round(spectrum.real**2 + spectrum.imag**2, 1)
        peaks.append(power[:, 1:].argmax(axis=1) + 1)
    return np.concatenate(peaks)


def peak_pairs(peaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes): each frame's peak with those of the next FAN frames; code = anchor bin, target bin, frames between."""
    times, codes = [], []
    for gap in range(1, FAN + 1):
        anchor, target = peaks[:-gap], peaks[gap:]
        times.append(np.arange(len(anchor)))
        codes.append((anchor << 10) | (target << 2) | gap)
    t, c = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((c, t))
    return t[order].astype(np.int32), c[order].astype(np.int32)


def wav_column(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep columns, n_bytes (of the unpadded UTF-8 text) and media: the text's bytes as the samples of an 8-bit WAV.

    Null and empty texts give PAD spaces. Each row stands alone: equal texts give equal media, row order does not matter,
    an empty table gives no rows; columns not in keep are dropped, and one of keep that is named like a result gives way
    to it.
    """
    keep = kept(keep, ["n_bytes", "media"])
    schema = T.StructType([*[df.schema[k] for k in keep], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    columns = list(dict.fromkeys([*keep, text]))
    at = columns.index(text)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, at):
            made = [padded(x) for x in batch.column(text).to_pylist()]
            cols = [batch.column(k) for k in keep]
            cols += [pa.array([n for _, n in made], pa.int64()), pa.array([to_wav(b) for b, _ in made], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, "n_bytes", "media"])

    return df.select(*columns).mapInArrow(encode, schema)


def wav_fingerprints(df: DataFrame, media: str, keep: list[str]) -> DataFrame:
    """keep columns, what the stored bytes hold (payload and media digests) and the fingerprint as time-coded arrays.

    fp_times[i] is the frame of the i-th anchor and fp_codes[i] its pair code; both are empty for media of one frame. A
    null media gives nulls. Rows stand alone, as for wav_column.
    """
    new = [
        ("payload_bytes", T.LongType(), pa.int64()),
        ("payload_sha256", T.StringType(), pa.string()),
        ("tail_crc32", T.LongType(), pa.int64()),
        ("media_bytes", T.LongType(), pa.int64()),
        ("media_sha256", T.StringType(), pa.string()),
        ("fp_times", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
        ("fp_codes", T.ArrayType(T.IntegerType()), pa.list_(pa.int32())),
    ]
    keep = kept(keep, [n for n, _, _ in new])
    schema = T.StructType([*[df.schema[k] for k in keep], *[T.StructField(n, t) for n, t, _ in new]])

    columns = list(dict.fromkeys([*keep, media]))
    at = columns.index(media)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window = np.hanning(FRAME + 1)[:-1].astype(np.float32)
        for batch in sliced(batches, at):
            rows = []
            for value in batch.column(media).to_pylist():
                if value is None:
                    rows.append((None,) * len(new))
                    continue
                payload = from_wav(value)
                times, codes = peak_pairs(spectral_peaks(payload, window))
                rows.append(
                    (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(value), hashlib.sha256(value).hexdigest(), times, codes)
                )
            cols = [batch.column(k) for k in keep]
            cols += [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(new)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *[n for n, _, _ in new]])

    return df.select(*columns).mapInArrow(features, schema)
