"""Media columns: WAV files of 8-bit samples, short-time Fourier transforms and spectral-peak pairs.

A payload is stored losslessly as the samples of a WAV file and read back with the wave module. Frames
of 64 samples, 32 apart, are windowed and transformed; in each block of eight frames the strongest bin
of two bands is a peak. Each peak is paired with the next FAN peaks, and a pair's two frequencies
and their distance in time make a hash, stored beside the time of the first as arrays.

Defined cases: a null text is an empty payload, 64 zero bytes. Equal texts have equal values in every
column. Ties between bins go to the earlier frame and then the lower frequency. Frames are transformed
65,536 at a time, so that a very long text needs bounded memory beside itself.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib

import numpy as np
from pyspark.sql import DataFrame

from revloom.llm.common import map_rows

FRAME, HOP, BLOCK, FAN, RATE = 64, 32, 8, 2, 8000
_WINDOW = np.hanning(FRAME + 1)[:-1].astype(np.float32)
_BANDS = ((1, 12), (12, 33))


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % 64 if raw else 64)


def to_wav(samples: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(samples)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def peaks(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(frame, bin) of the spectral peaks, in order of time."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - np.float32(128)
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    times, bins = [], []
    for i in range(0, len(frames), 1 << 16):
        z = np.fft.rfft(frames[i : i + (1 << 16)] * _WINDOW, axis=1)
        power = z.real**2 + z.imag**2
        short = -len(power) % BLOCK
        power = np.pad(power, ((0, short), (0, 0)), constant_values=-1).reshape(-1, BLOCK, power.shape[1])
        for lo, hi in _BANDS:
            at = power[:, :, lo:hi].reshape(len(power), -1).argmax(axis=1)
            times.append(i + np.arange(len(power)) * BLOCK + at // (hi - lo))
            bins.append(lo + at % (hi - lo))
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def fingerprint(samples: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(times, hashes) of the pairs of peaks, as int32."""
    t, f = peaks(samples)
    times, hashes = [], []
    for j in range(1, min(FAN, len(t) - 1) + 1):
        gap = np.minimum(t[j:] - t[:-j], 63)
        times.append(t[:-j])
        hashes.append((f[:-j] << 12) | (f[j:] << 6) | gap)
    if not times:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    t, h = np.concatenate(times), np.concatenate(hashes)
    order = np.lexsort((h, t))
    return t[order].astype(np.int32), h[order].astype(np.int32)


_SCHEMA = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fp_time array<int>, fp_hash array<int>"


def _columns(keep: bool):
    def make(batches):
        names = [c.split()[0] for c in _SCHEMA.split(", ")]
        for b in batches:
            out = {"doc_id": b["doc_id"]} | {c: [] for c in names} | ({"media": []} if keep else {})
            for text in b["text"]:
                stored = to_wav(payload(text))
                back = from_wav(stored)
                t, h = fingerprint(back)
                digest = hashlib.sha256(t.tobytes() + h.tobytes()).hexdigest()[:32]
                row = (len((text or "").encode("utf-8", "surrogatepass")), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{len(t)}:{digest}", t, h)
                for c, v in zip(names, row):
                    out[c].append(v)
                if keep:
                    out["media"].append(stored)
            yield out

    return make


def media_columns(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """The media columns of docs (doc_id, text); keep_media adds the WAV file itself as `media`."""
    docs = docs.select("doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    return map_rows(docs, _columns(keep_media), f"doc_id {id_type}, {_SCHEMA}" + ", media binary" * keep_media)
