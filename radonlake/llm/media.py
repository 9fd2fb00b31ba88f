"""Media columns (operator 8): WAV files, short-time Fourier transforms and fingerprints of pairs of spectral peaks."""

from __future__ import annotations

import io
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FRAME, RATE, PAD = 576, 8000, 255
#: Samples from one frame's start to the next; peaks of a frame; frames after a peak's own whose peaks it is paired with; frames transformed at once.
HOP, PEAKS, AHEAD, CHUNK = FRAME // 2, 2, 3, 1024
#: Squared sine between the samples, so that no sample of a frame has weight 0; at a hop of half a frame each sample weighs 1 in all.
#: A peak's magnitude at least: a constant stretch, such as padding, has none but those of rounding.
LEAST_POWER = 1e-3
_WINDOW = np.sin(np.pi * (np.arange(FRAME) + 0.5) / FRAME) ** 2


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // FRAME)) * FRAME, bytes([PAD]))


def to_wav(samples: bytes, rate: int = RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples."""
    with wave.open(out := io.BytesIO(), "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(rate)
        f.writeframes(samples)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    with wave.open(io.BytesIO(data), "rb") as f:
        return f.readframes(f.getnframes())


def peaks(samples: bytes, hop: int = FRAME) -> tuple[np.ndarray, np.ndarray]:
    """(time, frequency) of the strongest local maxima of each frame's spectrum, by time, then frequency.

    Frames begin every hop samples, the first one FRAME - hop before the samples, which lie in silence. Of equal maxima the lower frequency comes first.
    """
    times, bins = [], []
    wave_ = np.pad(np.frombuffer(samples, np.uint8)[: len(samples) // FRAME * FRAME].astype(np.float32) - 128, FRAME - hop)
    frames = np.lib.stride_tricks.sliding_window_view(wave_, FRAME)[::hop]
    for at in range(0, len(frames), CHUNK):
        power = np.abs(np.fft.rfft(frames[at : at + CHUNK] * _WINDOW))
        inner = power[:, 1:-1]
        top = np.where((inner > power[:, :-2]) & (inner >= power[:, 2:]), inner, -1.0)
        for _ in range(PEAKS):
            best = top.argmax(1)
            rows = np.flatnonzero(top[np.arange(len(top)), best] > LEAST_POWER)
            times.append(rows + at)
            bins.append(best[rows] + 1)
            top[np.arange(len(top)), best] = -1
    t, f = np.concatenate(times), np.concatenate(bins)
    order = np.lexsort((f, t))
    return t[order], f[order]


def pairs(t: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(time, code): each peak with every peak of the next AHEAD frames. A code is both frequencies and the frames between."""
    times, codes = [], []
    for d in range(1, PEAKS * (AHEAD + 1)):
        gap = t[d:] - t[:-d]
        near = (gap > 0) & (gap <= AHEAD)
        times.append(t[:-d][near])
        codes.append((f[:-d][near] << 12) | (f[d:][near] << 2) | gap[near])
    at, code = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((code, at))
    return at[order], code[order]


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, payload, times array<int>, codes array<int>): each text as a WAV file, and what its stored bytes give.

    The text's UTF-8 bytes, with bytes 255 up to a positive multiple of a frame, are the samples. payload is read back from
    media, times and codes are its fingerprint, by frames that overlap by half. Null texts count as empty: a frame of padding, in which only the steps from and to silence have peaks.
    Equal texts have equal values. A text of any length is stored whole, its spectra are made by blocks of frames.
    """
    source = common.as_bytes(common.texts(docs, id_col, text_col))

    def run(batches):
        ints = pa.list_(pa.int32())
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                media = to_wav(padded(data))
                payload = from_wav(media)
                t, c = pairs(*peaks(payload, HOP))
                rows.append((len(data), media, payload, t, c))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int64(), pa.binary(), pa.binary(), ints, ints)))], ["doc_id", "n_bytes", "media", "payload", "times", "codes"])

    return common.map_arrow(source, run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary, payload binary, times array<int>, codes array<int>")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.zip_with("times", "codes", lambda t, c: F.concat_ws(":", t.cast("string"), F.lower(F.hex(c))))
    return audio(common.documents(spark, sf_dir)).select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), -32, 32)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(coded, ",").alias("feature"),
    )
