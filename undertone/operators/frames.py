"""Frames and spectra. A frame row holds arrays; bins are exploded only for aggregates.

Transforms of single frames run as narrow Arrow maps; what carries memory from frame to frame runs
once per signal over its frames in order."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import spectrum as K

KEY, FRAME = "signal_id", "f"


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.to_pylist(), float)


def per_frame(df: DataFrame, kernel, outputs: tuple[str, ...], *, column="samples") -> DataFrame:
    """Adds arrays made by kernel(frames) from an array column; frames in a batch have one length."""
    schema = df.select("*", *(F.array().cast("array<double>").alias(o) for o in outputs)).schema

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                found = kernel(_matrix(batch.column(column)))
                found = found if isinstance(found, tuple) else (found,)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(map(list, f)), pa.list_(pa.float64())) for f in found)], schema.names)

    return df.mapInArrow(run, schema)


def per_signal(df: DataFrame, kernel, output: str, *, key=KEY, order=FRAME, columns=("mag",)) -> DataFrame:
    """key, order and an array for each frame: kernel gets the frames of a signal in order, a matrix or vector for each column."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        found = kernel(*(_matrix(group.column(c)) for c in columns))
        return pa.table([group.column(key), group.column(order), pa.array(list(map(list, found)), pa.list_(pa.float64()))], [key, order, output])

    return df.select(key, order, *columns).groupBy(key).applyInArrow(run, f"{key} {kind[key]}, {order} {kind[order]}, {output} array<double>")


def summary(df: DataFrame, kernel, output: str, *, key=KEY, order=FRAME, column="mag") -> DataFrame:
    """key and one array for each signal, from its frames in order."""
    kind = df.schema[key].dataType.simpleString()

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        return pa.table([group.column(key).slice(0, 1), pa.array([list(kernel(_matrix(group.column(column))))], pa.list_(pa.float64()))], [key, output])

    return df.select(key, order, column).groupBy(key).applyInArrow(run, f"{key} {kind}, {output} array<double>")


def spectra(df: DataFrame, *, column="samples") -> DataFrame:
    """Adds mag and phase of each frame, without a window."""

    def kernel(x):
        s = np.fft.rfft(x, axis=1)
        K.check_size(x.shape[1])
        return np.abs(s), np.angle(s)

    return per_frame(df, kernel, ("mag", "phase"), column=column)


def stft(df: DataFrame, size: int, hop: int, *, key=KEY, order="idx", x="x") -> DataFrame:
    """key, f, mag, phase from long samples."""
    K.check_size(size)
    kind = df.schema[key].dataType.simpleString()
    arrays = pa.list_(pa.float64())

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        mag, phase = K.stft(group.column(x).to_numpy(), size, hop)
        name = group.column(key)[0].as_py()
        return pa.table([pa.array([name] * len(mag), group.schema.field(key).type), pa.array(np.arange(len(mag))), pa.array(list(map(list, mag)), arrays), pa.array(list(map(list, phase)), arrays)], [key, "f", "mag", "phase"])

    return df.select(key, order, x).groupBy(key).applyInArrow(run, f"{key} {kind}, f bigint, mag array<double>, phase array<double>")


def istft(df: DataFrame, hop: int, *, key=KEY) -> DataFrame:
    """key, idx, x: frames are turned back one by one; overlap-add is an aggregation by sample."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = K.inverse_frames(_matrix(batch.column("mag")), _matrix(batch.column("phase")))
                yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("f"), pa.array(list(map(list, x)), pa.list_(pa.float64()))], [key, "f", "v"])

    kind = df.schema[key].dataType.simpleString()
    back = df.select(key, "f", "mag", "phase").mapInArrow(run, f"{key} {kind}, f bigint, v array<double>")
    n = F.size("v")
    rows = back.select(key, "f", n.alias("n"), F.posexplode("v").alias("i", "v"))
    w = 0.5 - 0.5 * F.cos(2 * np.pi * F.col("i") / F.col("n"))
    added = rows.groupBy(key, (F.col("f") * hop + F.col("i")).alias("idx")).agg(F.sum("v").alias("s"), F.sum(w * w).alias("w2"))
    return added.select(key, "idx", F.when(F.col("w2") > 1e-8, F.col("s") / F.col("w2")).otherwise(0.0).alias("x"))


def bins(df: DataFrame, *, column="mag", name="m") -> DataFrame:
    """A row for each bin: k and its value."""
    return df.select("*", F.posexplode(column).alias("k", name))


def mean_spectrum(df: DataFrame, *, key=KEY, column="mag", where: Column | None = None) -> DataFrame:
    """key, k, mean over frames (those that meet a condition)."""
    rows = df.where(where) if where is not None else df
    return bins(rows, column=column).groupBy(key, "k").agg(F.avg("m").alias("mean"))


def banded(df: DataFrame, bands: DataFrame, *, keys=(KEY, FRAME), column="mag") -> DataFrame:
    """keys, band, energy: mean square over the bins lo..hi of bands(band, lo, hi). A bin may be in several bands. Bands
    are a small dimension: frames are not exploded against them but sliced."""
    table = [(r.band, r.lo, r.hi) for r in bands.orderBy("band").collect()]
    parts = F.array(*(F.struct(F.lit(b).alias("band"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")) for b, lo, hi in table))
    rows = df.select(*keys, column, F.explode(parts).alias("b"))
    part = F.slice(column, F.col("b.lo") + 1, F.col("b.hi") - F.col("b.lo") + 1)
    energy = F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v) / F.greatest(F.size(part), F.lit(1))
    return rows.select(*keys, F.col("b.band").alias("band"), energy.alias("energy"))


def flatness(column="mag", least: float = 1e-10) -> Column:
    """Geometric over arithmetic mean of an array."""
    logs = F.aggregate(column, F.lit(0.0), lambda a, v: a + F.ln(F.greatest(v, F.lit(least))))
    total = F.aggregate(column, F.lit(0.0), lambda a, v: a + F.greatest(v, F.lit(least)))
    return F.exp(logs / F.size(column)) / (total / F.size(column))


def centroid(sr: float, column="power", silent: float = 1000.0) -> Column:
    """Mean frequency of a power spectrum of n bins, bin k at k * sr / 2n."""
    step = F.lit(sr / 2) / F.size(column)
    pairs = F.zip_with(F.sequence(F.lit(0), F.size(column) - 1), column, lambda k, p: k * p)
    top = F.aggregate(pairs, F.lit(0.0), lambda a, v: a + v)
    total = F.aggregate(column, F.lit(0.0), lambda a, v: a + v)
    return F.when(total > 0, step * top / total).otherwise(F.lit(silent))


def adaptive_mask(df: DataFrame, aggressiveness: float, *, key=KEY, column="power") -> DataFrame:
    """key, k, mask: from a bin's mean against its least value over frames."""
    rows = bins(df, column=column).groupBy(key, "k").agg(F.avg("m").alias("mean"), F.min("m").alias("low"))
    snr = F.col("mean") / (F.col("low") + 1e-10)
    return rows.select(key, "k", F.when(snr > 0, F.pow(F.greatest(F.lit(0.0), 1 - 2 * aggressiveness / snr), F.lit(1.5))).otherwise(0.0).alias("mask"))


def pitch(sr: float, low: float, high: float, column="samples", longest: float = 1.0) -> Column:
    """Frequency of the lag with the highest autocorrelation, the shortest on ties; null for lags a frame doesn't hold.
    longest: the share of a frame that a lag may have."""
    first, last = int(sr / high), int(sr / low)
    lags = F.sequence(F.lit(first), F.least(F.lit(last), F.size(column) - 1, F.floor(F.size(column) * longest).cast("int")))
    score = F.transform(lags, lambda g: F.struct(F.round(F.aggregate(F.zip_with(F.slice(column, F.lit(1), F.size(column) - g), F.slice(column, g + 1, F.size(column) - g), lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v), 9).alias("s"), (-g).alias("minus")))
    return F.lit(float(sr)) / -F.array_max(score)["minus"]
