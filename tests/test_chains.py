"""Chains of operators against plain numpy."""

import numpy as np

from undertone.functions import recurrences as R
from undertone.operators import chains as C


def _signal(spark, n=200):
    x = np.random.default_rng(2).normal(size=n) * 0.3
    return x, spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(x)], "signal_id bigint, idx bigint, x double")


def _ordered(df, column):
    return np.array([r[column] for r in df.orderBy("idx").collect()])


def test_channel_strip(spark):
    x, df = _signal(spark)
    out = C.channel_strip(df, 1000, high=20.0, low=900.0, bands=[("peaking", 100, 3.0, 1.0), ("peaking", 700, 3.0, 1.0)], threshold=-18.0, ratio=3.0, knee=6.0, makeup=2.0, ceiling=-1.0, gain=-6.0)
    v = R.cascade(x, [R.biquad_design("highpass", 20.0, 0.7071, 0.0, 1000), R.biquad_design("peaking", 100, 1.0, 3.0, 1000)])
    v = R.compress(R.compress(v, -18.0, 3.0, 6.0, 0.9, 0.99, 2.0), -1.0, 20.0, 0.0, 0.5, 0.99)
    assert np.allclose(_ordered(out, "y"), v * 10**-0.3)


def test_noise_reduction(spark):
    x, df = _signal(spark)
    size, hop, head = 16, 4, 3
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    at = range(0, len(x) - size + 1, hop)
    spectra = [np.fft.rfft(x[a : a + size] * w) for a in at]
    noise = np.maximum(np.mean([np.abs(s) ** 2 for s in spectra[:head]], axis=0), 1e-6)
    y, weight = np.zeros(at[-1] + size), np.zeros(at[-1] + size)
    for a, s in zip(at, spectra, strict=True):
        p = np.abs(s) ** 2
        g = np.where(p > 1e-12, np.maximum(np.sqrt(np.maximum(p - 2.0 * noise, 0) / np.maximum(p, 1e-12)), 0.05), 0.05)
        y[a : a + size] += np.fft.irfft(s * g, size) * w
        weight[a : a + size] += w**2
    expected = np.where(weight > 1e-8, y / np.maximum(weight, 1e-8), 0.0).clip(-1, 1)
    assert np.allclose(_ordered(C.reduce_noise(df, size, hop, head), "x"), expected)
