"""Chains of operators over one signal."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undertone.functions import pointwise as P
from undertone.functions import recurrences as R
from undertone.functions import systems
from undertone.operators import chunked
from undertone.operators import frames as O
from undertone.operators.sequences import KEY, ORDER, X


def channel_strip(df: DataFrame, sr: float, *, high: float, low: float, bands=(), threshold: float, ratio: float, knee: float, makeup: float, ceiling: float, gain: float, chunk: int = chunked.CHUNK, key=KEY, order=ORDER, x=X) -> DataFrame:
    """y: high-pass, low-pass, equaliser of (kind, hz, level, q), compressor with makeup, limiter, gain (dB).
    Filters at or over half the rate are left out."""
    filters = [R.biquad_design("highpass", high, 0.7071, 0.0, sr)]
    filters += [R.biquad_design("lowpass", low, 0.7071, 0.0, sr)] if low < sr / 2 else []
    filters += [R.biquad_design(kind, hz, q, level, sr) for kind, hz, level, q in bands if level and hz < sr / 2]

    filtered = chunked.linear(df, systems.cascade(filters), chunk=chunk, key=key, order=order, x=x)
    for stage in (systems.Compressor(threshold, ratio, knee, 0.9, 0.99, makeup), systems.Compressor(ceiling, 20.0, 0.0, 0.5, 0.99)):
        filtered, _ = chunked.speculative(filtered, stage, chunk=chunk, key=key, order=order, x="y")
    return filtered.withColumn("y", F.col("y") * 10 ** (gain / 20))


def live_strip(df: DataFrame, sr: float, *, high: float, low: float, bands=(), ess: tuple[float, float] = (6000.0, 0.0), tilt: float = 0.0, voice: tuple[float, float] | None = None, threshold: float, ratio: float, knee: float, attack: float, release: float, makeup: float, ceiling: float, limit_release: float, gain: float, width: float = 100.0, chunk: int = chunked.CHUNK, key=KEY, order=ORDER, x=X) -> DataFrame:
    """y: the chain of live playing. High-pass, low-pass, equaliser of (kind, hz, level, q), a peak at ess = (hz, amount of 100) that takes up
    to 10 dB, a shelf of `tilt` dB from 1 kHz, a voice band (a high-pass and a low-pass), compressor, makeup, limiter, gain (dB) and
    width (of 100). Filters at or over half the rate are left out; attack and release are seconds."""
    filters = [("highpass", high, 0.7071, 0.0), ("lowpass", low, 0.7071, 0.0), *((kind, hz, q, level) for kind, hz, level, q in bands if level)]
    filters += [("peaking", ess[0], 3.0, -ess[1] / 10), ("highshelf", 1000.0, 0.7071, tilt)]
    filters += [("highpass", voice[0], 0.5, 0.0), ("lowpass", voice[1], 0.5, 0.0)] if voice else []
    out = chunked.linear(df, systems.cascade([R.biquad_design(kind, hz, q, level, sr) for kind, hz, q, level in filters if hz < sr / 2]), chunk=chunk, key=key, order=order, x=x)
    keep = lambda seconds: float(np.exp(-1 / (seconds * sr)))
    for stage in (systems.Compressor(threshold, ratio, knee, keep(attack), keep(release), makeup), systems.Compressor(ceiling, 20.0, 0.0, keep(0.001), keep(limit_release))):
        out, _ = chunked.speculative(out, stage, chunk=chunk, key=key, order=order, x="y")
    return out.withColumn("y", F.col("y") * (10 ** (gain / 20) * width / 100))


def reduce_noise(df: DataFrame, size: int, hop: int, head: int, *, over: float = 2.0, least: float = 0.05, floor: float = 1e-6, voiced: Column | None = None, key=KEY) -> DataFrame:
    """key, idx, x: power subtraction against the mean power of the first `head` frames; voiced frames (a
    condition on the frame number f) lose a third as much. Samples stay in -1..1."""
    spectra = O.stft(df, size, hop, key=key)
    quiet = O.bins(spectra.where(F.col("f") < head)).groupBy(key, "k").agg(F.greatest(F.avg(F.col("m") * F.col("m")), F.lit(floor)).alias("n"))
    noise = quiet.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "n"))), lambda s: s["n"]).alias("noise"))
    weight = F.when(voiced, 0.3 * over).otherwise(over) if voiced is not None else F.lit(over)

    def reduced(m, n):
        p = m * m
        return m * F.when(p > 1e-12, F.greatest(F.sqrt(F.greatest(p - n * F.col("weight"), F.lit(0.0)) / p), F.lit(least))).otherwise(least)

    shaped = spectra.join(noise, key).withColumn("weight", weight).withColumn("mag", F.zip_with("mag", "noise", reduced))
    return O.istft(shaped, hop, key=key).withColumn("x", P.clamp("x", -1.0, 1.0))
