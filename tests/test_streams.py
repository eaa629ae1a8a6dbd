"""Streams cut into many micro-batches give what one batch gives."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.functions import recurrences as R
from undertone.streaming import streams as S

SCHEMA = "k bigint, ts timestamp, x double, value double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stream")
    rng = np.random.default_rng(1)
    rows = [(int(i % 3), i, float(v)) for i, v in enumerate(rng.normal(size=120))]
    for part in range(4):
        df = spark.createDataFrame(rows[part * 30 : part * 30 + 30], "k bigint, i bigint, x double")
        df = df.select("k", F.timestamp_seconds(F.col("i") * 60).alias("ts"), "x", F.col("x").alias("value")).coalesce(1)
        df.write.mode("append").parquet(str(base / "in"))
    return str(base / "in"), rows


def test_ema_over_many_batches(spark, folder):
    path, rows = folder
    stream = S.read_stream(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    got = sorted((r.k, r.ts.timestamp(), round(r.y, 9)) for r in S.drained(S.ema(stream, 0.8, key="k", order=["ts"], x="x")).collect())
    y = {k: R.ema([v for a, _, v in rows if a == k], 0.8) for k in range(3)}
    assert [g[2] for g in got] == [round(v, 9) for k in range(3) for v in y[k]]


def test_frames_over_many_batches(spark, folder):
    path, rows = folder
    stream = S.read_stream(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    got = sorted((r.k, r.f, round(r.rms, 9)) for r in S.drained(S.hop_frames(stream, 8, 4, key="k", order=["ts"], x="x")).collect())
    expected = []
    for k in range(3):
        x = np.array([v for a, _, v in rows if a == k])
        expected += [(k, f, round(float(np.sqrt(np.mean(x[4 * f : 4 * f + 8] ** 2))), 9)) for f in range((len(x) - 8) // 4 + 1)]
    assert got == expected


def test_windows_and_dedup(spark, folder):
    path, rows = folder
    stream = S.read_stream(spark, path, "*.parquet", spark.read.parquet(path).schema, 1)
    got = S.drained_complete(S.windowed(stream, "ts", "1 hour", "20 minutes", "10 minutes", "k")).agg(F.sum("n")).first()[0]
    assert got == 2 * len(rows)
    assert S.drained(S.first_sights(stream, "ts", "10 days", "k").select("k")).count() == 3


def test_latest_side_over_many_batches(spark, folder):
    path, rows = folder
    stream = S.read_stream(spark, path, "*.parquet", spark.read.parquet(path).schema, 1).withColumn("mask", F.when(F.col("x") > 1, F.col("x")))
    got = [(r.k, r.ts.timestamp(), r.side) for r in S.drained(S.latest_side(stream, key="k", order=["ts"], x="x", side="mask")).collect()]
    for k in range(3):
        seen, expected = None, []
        for a, _, v in rows:
            if a == k:
                seen = v if v > 1 else seen
                expected.append(seen)
        assert [g[2] for g in sorted((g for g in got if g[0] == k), key=lambda g: g[1])] == expected
