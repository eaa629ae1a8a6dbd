"""WAV files as a source and a sink: binary files to packed channels, and channels to RIFF bytes.

Admission goes by extension or media type, as an allow-list. Decoding reads PCM of 16, 24 and
32 bits and 32-bit float; encoding writes a 44-byte header and clipped samples."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What may be read.
AUDIO_EXTENSIONS = ("wav", "mp3", "flac", "ogg", "m4a", "aac", "opus", "wma", "aiff", "aif")
VIDEO_EXTENSIONS = ("mp4", "mov", "mkv", "avi", "webm", "m4v")
MIDI_EXTENSIONS = ("mid", "midi")
AUDIO_TYPES = ("audio/wav", "audio/x-wav", "audio/mp3", "audio/mpeg", "audio/flac", "audio/x-flac", "audio/ogg", "audio/webm", "audio/mp4", "audio/m4a", "audio/x-m4a", "audio/aac", "audio/opus", "audio/x-aiff", "audio/aiff", "audio/aif", "audio/x-ms-wma")
VIDEO_TYPES = ("video/mp4", "video/webm", "video/quicktime", "video/x-matroska", "video/x-m4v", "video/ogg", "video/avi", "video/x-msvideo")
MIDI_TYPES = ("audio/midi", "audio/x-midi")


def media_kind(name: Column, mime: Column | None = None) -> Column:
    """'audio', 'video' or null for a file that isn't admitted (MIDI never is)."""
    ext = F.regexp_extract(F.lower(name), r"\.([a-z0-9]+)$", 1)
    mime = F.lower(F.coalesce(mime, F.lit(""))) if mime is not None else F.lit("")
    midi = ext.isin(*MIDI_EXTENSIONS) | mime.isin(*MIDI_TYPES)
    return F.when(midi, None).when(mime.isin(*VIDEO_TYPES) | ext.isin(*VIDEO_EXTENSIONS), "video").when(mime.isin(*AUDIO_TYPES) | ext.isin(*AUDIO_EXTENSIONS), "audio")


def layout(data: bytes) -> tuple[int, int, int, int, int, int]:
    """Kind of samples, bits, channels, rate, and where the samples begin and how many bytes they have, from a file's beginning."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a RIFF/WAVE file")
    at, spec = 12, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt ":
            spec = struct.unpack_from("<HHIIHH", data, at + 8)
        elif name == b"data" and spec is not None and size:
            kind, channels, rate, _, _, bits = spec
            return kind, bits, channels, rate, at + 8, size
        at += 8 + size + size % 2
    raise ValueError("no audio in file")


def samples(body: bytes, kind: int, bits: int) -> np.ndarray:
    if kind == 3 and bits == 32:
        return np.frombuffer(body, "<f4").astype(float)
    if bits == 24:
        raw = np.frombuffer(body[: len(body) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        return ((raw[:, 0] << 8 | raw[:, 1] << 16 | raw[:, 2] << 24) >> 8) / 2**23
    if bits in (16, 32):
        return np.frombuffer(body, f"<i{bits // 8}") / 2.0 ** (bits - 1)
    raise ValueError(f"{bits} bits of kind {kind} can't be read")


def decode(data: bytes) -> tuple[int, np.ndarray]:
    """Sample rate and samples (channels x length) in [-1, 1]."""
    kind, bits, channels, rate, at, size = layout(data)
    x = samples(data[at : at + size], kind, bits)
    return rate, x[: len(x) // channels * channels].reshape(-1, channels).T


def encode(channels: np.ndarray, rate: int, bits: int = 16, symmetric: bool = True) -> bytes:
    """symmetric: scale both signs by the same number and round; else negative samples reach one step further, and
    what lies between two steps is cut towards zero."""
    x = np.clip(np.atleast_2d(channels), -1, 1).T.ravel()
    if bits == 32:
        body, kind = x.astype("<f4").tobytes(), 3
    else:
        top = 2 ** (bits - 1)
        scaled = (np.floor(x * (top - 1) + 0.5) if symmetric else np.trunc(np.where(x < 0, x * top, x * (top - 1)))).astype(np.int32)
        wide = scaled.astype("<i4").view(np.uint8).reshape(-1, 4)
        body, kind = wide[:, : bits // 8].tobytes(), 1
    n = len(np.atleast_2d(channels))
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(body), b"WAVE", b"fmt ", 16, kind, n, rate, rate * n * bits // 8, n * bits // 8, bits, b"data", len(body))
    return head + body


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, ch, sr, samples (array of doubles), error: a row for each channel; files that can't be read give one row with an error."""
    files = spark.read.format("binaryFile").load(path).where(media_kind(F.col("path")) == "audio").select("path", "content")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    rate, x = decode(row["content"])
                    rows = [(row["path"], c, rate, s.tolist(), None) for c, s in enumerate(x)]
                except (ValueError, struct.error) as e:
                    rows = [(row["path"], None, None, None, str(e))]
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["path", "ch", "sr", "samples", "error"])

    return files.mapInArrow(run, "path string, ch int, sr int, samples array<double>, error string")


def to_wav(df: DataFrame, *, key="signal_id", channels="channels", sr="sr", bits: int = 16, symmetric: bool = True) -> DataFrame:
    """key and wav (binary), from channels: array of arrays of samples."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            out = [encode(np.array(c, float), r, bits, symmetric) for c, r in zip(batch.column("c").to_pylist(), batch.column("r").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array(out, pa.binary())], [key, "wav"])

    return df.select(F.col(key).alias("k"), F.col(channels).alias("c"), F.col(sr).cast("int").alias("r")).mapInArrow(run, f"{key} {kind}, wav binary")
