"""Media columns: a text stored as an 8-bit mono WAV, read back, and fingerprinted.

The payload is the text's UTF-8 bytes (null: empty) and zero bytes up to a
positive multiple of 64.  It is written and read by the ``wave`` module, so the
samples that the features see are those that were stored.  The short-time
Fourier transform takes Hann windows of 64 samples every 32 samples; the two
strongest bins of each frame are its peaks, and each of them is paired with both
of each of the next three frames.  A pair is a time-coded number: frame, two bins
and their distance in frames.  The fingerprint is the array of all pairs in order
of time; the feature is a short text made of it.

Equal texts give equal values.  Empty and null texts have a payload of 64 zero
bytes, which is silent and has no pairs.  Repeated rows stay repeated; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, chunks, splitmix

RATE, FRAME, HOP, PEAKS, AHEAD, KEEP = 8000, 64, 32, 2, 3, 8
_WINDOW = np.hanning(FRAME).astype(np.float32)


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
        return w.readframes(w.getnframes())


def spectrum(samples: np.ndarray) -> np.ndarray:
    """Magnitudes of every frame: (frames, FRAME // 2 + 1)."""
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP]
    return np.abs(np.fft.rfft((frames.astype(np.float32) - 128) * _WINDOW, axis=1))


def peak_pairs(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Time-coded pairs and their strengths for one run of samples (a multiple of 64)."""
    parts = [_pairs(samples, at, min(at + (1 << 14), (len(samples) - FRAME) // HOP + 1)) for at in range(0, (len(samples) - FRAME) // HOP + 1, 1 << 14)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _pairs(samples: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose earlier peak is in frames first to last."""
    if not samples.any():
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    total = (len(samples) - FRAME) // HOP + 1
    end = min(last + AHEAD, total)
    m = spectrum(samples[first * HOP : (end - 1) * HOP + FRAME])[:, 1:]
    rows, tops, powers = np.arange(len(m)), [], []
    for _ in range(PEAKS):
        top = np.argmax(m, axis=1)
        tops.append(top)
        powers.append(m[rows, top])
        m[rows, top] = -1
    codes, strength = [], []
    for d in range(1, AHEAD + 1):
        n = min(last, total - d) - first
        if n > 0:
            t = np.arange(first, first + n, dtype=np.int64)
            for top, power in zip(tops, powers, strict=True):
                for to, its in zip(tops, powers, strict=True):
                    codes.append((t << 12) | (top[:n] << 7) | (to[d : d + n] << 2) | d)
                    strength.append(np.minimum(power[:n], its[d : d + n]))
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    codes, strength = np.concatenate(codes), np.concatenate(strength)
    order = np.argsort(codes)
    return codes[order], strength[order]


def describe(codes: np.ndarray, strength: np.ndarray) -> str:
    """pairs:digest of all pairs:the KEEP strongest pairs in time order."""
    if not len(codes):
        return "0:0:"
    with np.errstate(over="ignore"):
        digest = int(splitmix(codes.astype(np.uint64) + U(1)).sum(dtype=np.uint64))
    best = np.sort(codes[np.argsort(-np.round(strength, 2), kind="stable")[:KEEP]])
    return f"{len(codes)}:{digest:x}:{'.'.join(format(c, 'x') for c in best.tolist())}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False, keep_pairs: bool = False) -> DataFrame:
    """id, sizes and digests of payload and media, feature; with keep_pairs all pairs (fingerprint array<long>), with keep_media the WAV itself (media binary)."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string" + ", fingerprint array<long>" * keep_pairs + ", media binary" * keep_media

    def store(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            ids = batch.column(0)
            for part in chunks(batch.column(1)):
                rows = []
                raw, off = part.data.tobytes(), part.off.tolist()
                for i in range(len(part)):
                    text = raw[off[i] : off[i + 1]]
                    media = to_wav(text + bytes(-len(text) % 64 or (0 if text else 64)))
                    payload = from_wav(media)
                    row = (len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest())
                    codes, strength = peak_pairs(np.frombuffer(payload, np.uint8))
                    rows.append(row + (describe(codes, strength),) + (codes,) * keep_pairs + (media,) * keep_media)
                types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int64())] * keep_pairs + [pa.binary()] * keep_media
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"] + ["fingerprint"] * keep_pairs + ["media"] * keep_media
                yield pa.RecordBatch.from_arrays([ids.slice(part.first, len(part)), *cols], names=names)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(store, schema)


def op8_media_columns(spark, sf_dir):
    from .common import table

    return media_columns(table(spark, sf_dir, "documents"), keep_pairs=True)
