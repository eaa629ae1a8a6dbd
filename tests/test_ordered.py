"""Streams taken in event-time order: late rows, several micro-batches and an end give what the batch forms give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undertone.operators import levels as L
from undertone.operators import stores
from undertone.streaming import ordered as O


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    n = 160
    return pd.DataFrame({"k": rng.choice(["a", "b"], n), "i": np.arange(n), "s": np.cumsum(rng.integers(0, 50, n)), "x": rng.normal(size=n)})


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows).withColumn("ts", F.timestamp_seconds("s"))


def late(parts, per):
    """Rows come in files in order, but every seventh comes a file later."""
    return F.least(F.floor(F.col("i") / per) + F.when(F.col("i") % 7 == 0, 1).otherwise(0), F.lit(parts - 1))


def run(table, step, parts=3, per=50, wait="3 hours", progress=None):
    stream = O.replayed(table, parts, late(parts, per))
    out = O.run_to_end(stream, lambda s: O.in_order(s, step, key="k", at="ts", tie="i", late=wait), at="ts", progress=progress)
    return out.toPandas()


def whole(x, size, hop, shape):
    """Overlap-add of all of a signal at once."""
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)
    n = (len(x) - size) // hop + 1
    y, w = np.zeros((n - 1) * hop + size), np.zeros((n - 1) * hop + size)
    for f in range(n):
        y[f * hop : f * hop + size] += shape(x[f * hop : f * hop + size] * window) * window
        w[f * hop : f * hop + size] += window**2
    return np.where(w > 1e-8, y / np.maximum(w, 1e-8), 0.0)


def test_overlap_add_is_drained_at_the_end(spark, rows, table):
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")  # runs leave the session's own as it was
    progress = []
    got = run(table, O.OverlapAdd(8, 4, lambda f: f * 0.5), progress=progress)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider and len(progress) >= 4
    for k, part in rows.groupby("k"):
        y = got[got.k == k].sort_values("idx")
        expected = whole(part.x.to_numpy(), 8, 4, lambda f: f * 0.5)
        assert y.idx.tolist() == list(range(len(expected))) and np.allclose(y.y, expected)
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0  # nothing is left behind


@pytest.mark.parametrize("parts", [1, 4])
def test_a_pause_drains_too(spark, rows, parts):
    """Three pauses of an hour; each part of the signal ends as one of its own."""
    paused = rows.assign(s=rows.s + 3600 * (rows.i // 45))
    table = spark.createDataFrame(paused).withColumn("ts", F.timestamp_seconds("s"))
    got = run(table, O.OverlapAdd(8, 4, lambda f: f, idle=1800 * 1_000_000), parts=parts, per=40)
    for k, part in paused.sort_values(["s", "i"]).groupby("k"):
        base, expected = 0, {}
        for _, piece in part.groupby(part.i // 45):
            expected |= {base + j: y for j, y in enumerate(whole(piece.x.to_numpy(), 8, 4, lambda f: f))}
            base += len(piece)
        found = got[got.k == k].set_index("idx").y.to_dict()
        assert found.keys() == expected.keys() and all(abs(found[i] - expected[i]) < 1e-12 for i in found)


def test_trailing_features(spark, rows, table):
    got = run(table, O.Trailing(16), parts=4, per=40).sort_values("tie")
    ordered = rows.sort_values(["k", "s", "i"])
    ordered["idx"] = ordered.groupby("k").cumcount()
    batch = L.trailing_features(spark.createDataFrame(ordered[["k", "idx", "i", "x"]]), 16, key="k").toPandas().sort_values("i")
    assert got.tie.tolist() == batch.i.tolist()
    for c in ("rms", "zcr", "level"):
        assert np.allclose(got[c], batch[c])


def test_sides_from_another_stream(spark, rows, table):
    """Frames and side values are two streams; side values come a micro-batch later than their frames."""
    frames = table.withColumn("side", F.lit(None).cast("double"))
    sides = table.where("i % 5 = 0").withColumns({"side": F.col("x") * 2, "x": F.lit(None).cast("double")})
    a = O.replayed(frames, 3, F.least(F.floor(F.col("i") / 50), F.lit(2)))
    b = O.replayed(sides, 3, F.least(F.floor((F.col("i") + 40) / 50), F.lit(2)))
    got = O.run_to_end(a.unionByName(b), lambda s: O.in_order(s, O.NewestSide(), key="k", at="ts", tie="i", late="3 hours"), at="ts").toPandas().set_index("tie")
    assert len(got) == len(rows)
    for _, part in rows.sort_values(["s", "i"]).groupby("k"):
        side = np.nan
        for r in part.itertuples():
            side = r.x * 2 if r.i % 5 == 0 else side
            assert got.x[r.i] == r.x and (got.side[r.i] == side or np.isnan(side) and np.isnan(got.side[r.i]))


@pytest.mark.parametrize("kind", ["sights", "windows"])
def test_expiring_state(spark, rows, table, kind):
    """Each key is seen for a while and never again; its state goes."""
    keyed = rows.assign(k=(rows.i // 8).astype(str), s=rows.s * 10)
    df = spark.createDataFrame(keyed).withColumn("ts", F.timestamp_seconds("s"))
    progress = []
    step = O.FirstSights(600_000_000) if kind == "sights" else O.FixedWindows(600_000_000, 2)
    got = run(df, step, parts=4, per=40, wait="20 minutes", progress=progress)
    batch = spark.createDataFrame(keyed[["k", "i", "s"]])
    if kind == "sights":
        assert sorted(got.tie) == sorted(stores.dedup_ttl(batch, "k", "s", 600, "i").toPandas().i)
    else:
        expected = stores.rate_limited(batch, "k", "s", 600, 2, "i").toPandas().set_index("i").allowed
        assert got.set_index("tie").allowed.sort_index().equals(expected.sort_index().rename_axis("tie"))
    held = [p["stateOperators"][0]["numRowsTotal"] for p in progress]
    assert max(held) <= 8  # of 20 keys, those that still matter
    assert progress[-1]["stateOperators"][0]["numRowsTotal"] == 0


def test_state_is_a_row_for_each_shard(spark, monkeypatch):
    """Many keys, null among them: state has at most as many rows as shards, and all is as key by key."""
    monkeypatch.setattr(O, "SHARDS", 3)
    n = 400
    many = pd.DataFrame({"k": [None if i % 41 == 0 else i % 41 for i in range(n)], "i": np.arange(n), "s": 20 + np.arange(n) * 20, "x": np.sin(np.arange(n))}).astype({"k": "Int64"})
    df = spark.createDataFrame([tuple(None if pd.isna(v) else v for v in r) for r in many.astype(object).itertuples(index=False)], "k bigint, i bigint, s bigint, x double").withColumn("ts", F.timestamp_seconds("s"))
    progress = []
    got = run(df, O.Trailing(4), per=150, progress=progress).set_index("tie")
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in progress) <= 3 and progress[-1]["stateOperators"][0]["numRowsTotal"] == 0
    want = {}
    for k, part in many.groupby("k", dropna=False):
        for j in range(3, len(part)):
            want[part.i.iloc[j]] = k, np.sqrt(np.mean(part.x.iloc[j - 3 : j + 1] ** 2))
    assert len(got) == len(want)
    for i, (k, rms) in want.items():
        assert (pd.isna(got.k[i]) if pd.isna(k) else got.k[i] == k) and abs(got.rms[i] - rms) < 1e-9


def test_batches_of_several_files(spark, monkeypatch):
    monkeypatch.setattr(O, "FILE_ROWS", 100)
    df = spark.range(1000)
    stream = O.replayed(df, 2, F.when(F.col("id") < 400, 0).otherwise(1))
    seen = []
    q = stream.writeStream.foreachBatch(lambda rows, n: seen.append((rows.count(), rows.agg(F.max("id")).first()[0]))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert seen == [(400, 399), (600, 999)]
