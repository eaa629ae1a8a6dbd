"""Long WAV files read by ranges, archives written by tasks, correlation by chunks, and profiles in cells."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.operators import matching as M
from undertone.operators import sequences as S
from undertone.sources import bundles, wav


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    bundles.register(spark)


@pytest.mark.parametrize("bits", [16, 24, 32])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, bits):
    x = np.random.default_rng(bits).uniform(-1, 1, (2, 5000))
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000, bits))
    (tmp_path / "notes.txt").write_text("not audio")
    df = spark.read.format("wav_ranges").option("path", str(tmp_path)).option("frames", 700).load()
    assert df.rdd.getNumPartitions() == 8 and df.select(F.spark_partition_id()).distinct().count() == 8
    want = wav.decode((tmp_path / "a.wav").read_bytes())[1]
    got = {(r.ch, r.idx): r.x for r in df.collect()}
    assert len(got) == 10_000 and all(got[c, i] == want[c, i] for c in (0, 1) for i in range(0, 5000, 37))
    assert {r.file for r in df.select("file").distinct().collect()} == {"a.wav"}


def files(spark, n, parts):
    rows = [(f"s{i}", bytearray(wav.encode(np.full((1, 40 + i), i / 100), 8000))) for i in range(n)]
    return spark.createDataFrame(rows, "name string, wav binary").repartition(parts)


def test_a_bundle_for_each_task(spark, tmp_path):
    path = str(tmp_path / "out")
    files(spark, 30, 3).write.format("wav_bundle").mode("append").option("path", path).save()
    assert len(os.listdir(path)) == 3 and all(f.startswith("bundle-") and f.endswith(".zip") for f in os.listdir(path))
    back = spark.read.format("wav_ranges").option("path", path).option("frames", 16).load().groupBy("file").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
    got = {r.file.split("!")[1]: (r.n, round(r.lo, 3), round(r.hi, 3)) for r in back.collect()}
    assert got == {f"s{i}.wav": (40 + i, i / 100, i / 100) for i in range(30)}


def test_tasks_do_not_grow_with_members_or_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    files(spark, 300, 2).write.format("wav_bundle").mode("append").option("path", path).save()
    df = spark.read.format("wav_ranges").option("path", path).option("frames", 16).load()
    assert df.rdd.getNumPartitions() == 2 and df.count() == sum(40 + i for i in range(300))
    # spans that cut members anywhere hold each range once
    reader = bundles.WavReader({"path": path, "frames": "16"})
    whole = sorted(r for p in reader.partitions() for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True))
    monkeypatch.setattr(bundles, "SPAN", 333)
    parts = reader.partitions()
    assert len(parts) > 200 and sorted(r for p in parts for b in reader.read(p) for r in zip(*b.to_pydict().values(), strict=True)) == whole
    (tmp_path / "long.wav").write_bytes(wav.encode(np.zeros((1, 500_000)), 8000))
    long = bundles.WavReader({"path": str(tmp_path / "long.wav"), "frames": "16"})
    assert len(long.partitions()) <= bundles.TASKS and sum(b.num_rows for p in long.partitions() for b in long.read(p)) == 500_000


def test_a_failed_task_leaves_no_archive(spark, tmp_path):
    path = str(tmp_path / "out")
    broken = files(spark, 12, 4).withColumn("wav", F.when(F.col("name") == "s7", F.raise_error(F.lit("broken")).cast("binary")).otherwise(F.col("wav")))
    with pytest.raises(Exception, match="broken"):
        broken.write.format("wav_bundle").mode("append").option("path", path).save()
    assert not os.path.exists(path) or os.listdir(path) == []


def test_nothing_to_read(spark, tmp_path):
    assert spark.read.format("wav_ranges").option("path", str(tmp_path)).load().count() == 0


@pytest.mark.parametrize(("chunk", "most"), [(1 << 16, 20), (64, 20), (16, 40), (7, 3)])
def test_correlation_by_chunks(spark, chunk, most):
    rng = np.random.default_rng(6)
    made = {"a": (rng.normal(size=300), 5), "b": (rng.normal(size=90), -3), "c": (np.ones(2), 0), None: (rng.normal(size=33), 2)}
    left, right, want = [], [], {}
    for k, (u, lag) in made.items():
        v = np.roll(u, lag)[: len(u) - (k == "b")]
        left += [(k, i, float(x)) for i, x in enumerate(u)]
        right += [(k, i, float(x)) for i, x in enumerate(v)]
        scores = {g: round(sum(u[i] * v[i + g] for i in range(len(u)) if 0 <= i + g < len(v)), 6) for g in range(-min(most, len(u) - 1), min(most, len(v) - 1) + 1)}
        want[k] = min(scores, key=lambda g: (-scores[g], g)), max(scores.values())
    schema = "signal_id string, idx bigint, x double"
    alone = [("d", 0, 1.0)]  # without another side
    got = {r.signal_id: (r.lag, pytest.approx(r.score, abs=2e-6)) for r in S.lagged_correlation(spark.createDataFrame(left + alone, schema), spark.createDataFrame(right, schema), most, chunk=chunk).collect()}
    assert got == want


def test_cells_give_what_comparing_all_gives(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(12, 16))
    library = np.concatenate([c + 0.15 * rng.normal(size=(25, 16)) for c in centres] + [np.zeros((2, 16)), centres[:3]])
    library = np.concatenate([library, library[:5]])  # ties go to the first name
    asked = np.concatenate([library[::7] + 0.05 * rng.normal(size=(len(library[::7]), 16)), rng.normal(size=(20, 16)), np.zeros((1, 16)), library[:9]])
    unit = lambda x: M._unit(x)
    s = np.round(unit(asked) @ unit(library).T, 12)
    profiles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(library)], "name int, v array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id int, v array<double>").repartition(3)
    count = spark.sparkContext.accumulator(0)
    got = {r.id: (r.name, r.score) for r in M.best_match(rows, profiles, count=count).collect()}
    for i in range(len(asked)):
        assert got[i][1] == pytest.approx(s[i].max(), abs=1e-12)
        assert got[i][0] == int(s[i].argmax()) or abs(s[i][got[i][0]] - s[i].max()) < 2e-12
    skipped = 1 - count.value / s.size
    assert skipped > 0.4, skipped


def test_a_library_of_many_blocks_is_one_pass(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 20)
    rng = np.random.default_rng(8)
    library = np.concatenate([rng.normal(size=(210, 8)), np.zeros((1, 8))])
    library = np.concatenate([library, library[:30]])
    asked = np.concatenate([rng.normal(size=(90, 8)), library[:9]])
    s = np.round(M._unit(asked) @ M._unit(library).T, 12)
    profiles = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(library)], "name int, v array<double>")
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)], "id int, v array<double>")
    out = M.best_match(rows, profiles)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    got = {r.id: (r.name, r.score) for r in out.collect()}
    assert len(got) == len(asked)
    for i in range(len(asked)):
        assert got[i][1] == pytest.approx(s[i].max(), abs=1e-12)
        assert got[i][0] == int(s[i].argmax()) or abs(s[i][got[i][0]] - s[i].max()) < 2e-12
