"""The model store with damaged and missing chunks, and models run over frames."""

import hashlib
import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.functions import spectrum as K
from undertone.operators import frames as O
from undertone.sources import models as M


@pytest.fixture(scope="module")
def files():
    rng = np.random.default_rng(2)
    return {("a", 1): rng.bytes(1000), ("a", 2): rng.bytes(256), ("b", 1): b"", ("c", 1): rng.bytes(130)}


@pytest.fixture(scope="module")
def store(spark, files):
    blobs = spark.createDataFrame([(*k, bytearray(v)) for k, v in files.items()], "name string, version int, data binary")
    shapes = F.create_map(F.lit("input"), F.array(F.lit(1), F.lit(33)))
    return M.registry(blobs, 64, shapes).cache(), M.cut(blobs, 64).cache()


def test_round_trip(store, files):
    models, chunks = store
    got = {(r.name, r.version): bytes(r.data) for r in M.assembled(models, chunks.unionByName(chunks)).collect()}
    assert got == files
    row = models.where("name = 'a' AND version = 1").first()
    assert row.size == 1000 and row.sha256 == hashlib.sha256(files["a", 1]).hexdigest() and len(row.digests) == 16 and row.shapes == {"input": [1, 33]}
    for start, length in ((0, 1000), (63, 2), (64, 64), (990, 100), (500, 1)):
        assert M.read_range(chunks, "a", 1, start, length, 64) == files["a", 1][start : start + length]


def test_damage_is_reported_and_not_used(store, files):
    models, chunks = store
    bad = (F.col("name") == "a") & (F.col("version") == 1) & (F.col("part") == 3)
    damaged = chunks.withColumn("data", F.when(bad, F.lit(b"x" * 64)).otherwise(F.col("data"))).where("NOT (name = 'c' AND part > 0)")
    found = {(r.name, r.version): (r.status, r.missing, r.corrupt) for r in M.inspected(models, damaged).collect()}
    assert found == {("a", 1): ("corrupt", [], [3]), ("a", 2): ("ready", [], []), ("b", 1): ("ready", [], []), ("c", 1): ("missing", [1, 2], [])}
    assert {(r.name, r.version) for r in M.assembled(models, damaged).collect()} == {("a", 2), ("b", 1)}
    again = M.to_fetch(models, damaged)
    assert {tuple(r) for r in again.collect()} == {("a", 1, 3), ("c", 1, 1), ("c", 1, 2)}
    fetched = damaged.unionByName(chunks.join(again, ["name", "version", "part"], "left_semi"))  # resumed
    assert {(r.name, r.version): bytes(r.data) for r in M.assembled(models, fetched).collect()} == files


def test_a_model_is_loaded_once_a_worker_and_its_masks_reach_the_mask(spark):
    rng = np.random.default_rng(5)
    frames, weights = np.abs(rng.normal(size=(60, 9))), np.abs(rng.normal(size=9))
    data = io.BytesIO()
    np.save(data, weights)
    count = spark.sparkContext.accumulator(0)
    load = lambda path: np.load(path)
    run = lambda w, m: (m / (m + w), (m.mean(1, keepdims=True) > 0.8).astype(float))
    df = spark.createDataFrame([(i % 2, i, f.tolist()) for i, f in enumerate(frames)], "signal_id int, f int, mag array<double>").repartition(8)
    name = M.ship(spark, data.getvalue())
    out = M.apply_model(df, name, load, run, ("mask", "presence"), count=count)
    got = {r.f: r for r in out.collect()}
    want, voiced = run(weights, frames)
    assert all(np.allclose(got[i].mask, want[i]) and got[i].presence == voiced[i].tolist() for i in range(60))
    before = count.value
    assert 1 <= before <= 4 + 4  # local[4]: as many workers, whatever the number of batches
    out.collect()
    assert count.value <= before + 4
    built = O.per_signal(out, lambda m, s, p: K.build_mask(m, np.ones(len(m), bool), warm=3, separation=s, presence=p), "built", columns=("mag", "mask", "presence"))
    for r in built.collect():
        own = [i for i in range(60) if i % 2 == r.signal_id]
        local = K.build_mask(frames[own], np.ones(30, bool), warm=3, separation=want[own], presence=voiced[own])
        assert np.allclose(r.built, local[own.index(r.f)])


def test_presence_of_voice_decides():
    mag = np.full((6, 4), 2.0)
    one = K.build_mask(mag, np.zeros(6, bool), warm=6, presence=np.array([[1.0], [0.8], [0.5], [0.25], [0.1], [0.9]]))
    ramp = 0.05 + 0.95 * (np.arange(1, 7) / 6) ** 2
    assert np.allclose(one[:, 0], np.minimum(1, ramp * [1.5, 1.1, 0.5, 0.0, 0.0, 1.3]))
    bins = K.build_mask(mag, np.ones(6, bool), warm=6, presence=np.tile([0.2, 0.4, 0.1, 0.9], (6, 1)))
    assert np.allclose(bins, ramp[:, None] * [0.2, 0.4, 0.1, 0.9] / 2)  # 0.4 in the mean: no voice
