"""Chunks of a signal give what one serial run gives, for any cut."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.functions import recurrences as R
from undertone.functions import systems as Y
from undertone.operators import chunked as C

SR = 1000
SIDE = R.biquad_design("peaking", 200.0, 2.0, 6.0, SR)
NOTCHES = R.hum_notches(SR)
LINEAR = {"average": (Y.average(0.97), lambda x: R.ema(x, 0.97)), "highpass": (Y.biquad(SIDE), lambda x: R.biquad(x, SIDE)), "cascade": (Y.cascade(NOTCHES), lambda x: R.cascade(x, NOTCHES)), "nothing": (Y.cascade([]), lambda x: x)}
DYNAMICS = {
    "gate": (Y.Gate(0.8, 0.1, 5, 7, 0.6, 0.95), lambda x: R.gate(x, 0.8, 0.1, 5, 7, 0.6, 0.95)),
    "compressor": (Y.Compressor(-20.0, 4.0, 6.0, 0.5, 0.9, 2.0), lambda x: R.compress(x, -20.0, 4.0, 6.0, 0.5, 0.9, 2.0)),
    "two speeds": (Y.TwoSpeed(0.9, 0.99), lambda x: R.two_speed(x, 0.9, 0.99)),
    "floor": (Y.LiveFloor(), R.live_floor),
    "de-esser": (Y.SideDeesser(SIDE, 0.3, 3.0, 0.5, 0.4, 0.9), lambda x: R.deess(x, R.biquad(x, SIDE), 0.3, 3.0, 0.5, 0.4, 0.9)),
    "live de-esser": (Y.LiveDeesser(SIDE, 0.8), lambda x: R.deess_live(x, SIDE, 0.8)),
    "follower": (Y.Follower(), R.follow),
}


def signal(n, seed):
    rng = np.random.default_rng(seed)
    return rng.normal(size=n) * np.repeat(rng.choice([0.0, 0.1, 1.0], n // 50 + 1), 50)[:n]


@pytest.fixture(scope="module")
def signals(spark):
    made = {"long": signal(3000, 1), "short": signal(7, 2), "one": np.array([0.5]), None: signal(130, 3)}
    rows = [(k, i, float(v)) for k, x in made.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "signal_id string, idx bigint, x double").withColumns({"chunk": F.lit("clash"), "v": F.lit(1), "start": F.lit(None).cast("int")})
    return made, df.repartition(5).cache()


def taken(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r[0], {})[r[1]] = r[2]
    assert sum(map(len, out.values())) == n
    return {k: np.array([v[i] for i in range(len(v))]) for k, v in out.items()}


@pytest.mark.parametrize("name", LINEAR)
@pytest.mark.parametrize("chunk", [1, 64, 700])
def test_linear(signals, name, chunk):
    made, df = signals
    if chunk == 1:
        made, df = {k: x for k, x in made.items() if k == "short"}, df.where("signal_id = 'short'")
    system, serial = LINEAR[name]
    found = taken(C.linear(df, system, chunk=chunk), sum(map(len, made.values())))
    for k, x in made.items():
        assert np.abs(found[k] - serial(x)).max() < 1e-9, k


@pytest.mark.parametrize("name", LINEAR)
def test_blocks_of_a_linear_run(name):
    system, serial = LINEAR[name]
    x = signal(1000, 5)
    y, state = system.run(x, system.start(x[0]))
    assert np.abs(y - serial(x)).max() < 1e-9
    a, middle = system.run(x[:333], system.start(x[0]))
    b, end = system.run(x[333:], middle)
    assert np.abs(np.concatenate([a, b]) - y).max() < 1e-9 and np.allclose(end, state)
    assert np.allclose(system.run(np.zeros(77), middle)[1], system.after(middle, 77))


@pytest.mark.parametrize("name", DYNAMICS)
def test_dynamics_taken_up_again(name):
    dynamics, serial = DYNAMICS[name]
    x = signal(900, 6)
    y, state = dynamics.run(dynamics.initial(), 0, 400, x)
    z, _ = dynamics.run(state, 400, 900, x)
    assert (np.concatenate([y, z]) == serial(x)).all() or np.abs(np.concatenate([y, z]) - serial(x)).max() < 1e-12


@pytest.mark.parametrize(("name", "chunk", "warm"), [("gate", 64, 64), ("gate", 300, 10), ("compressor", 500, 100), ("two speeds", 900, 5), ("floor", 200, 200), ("de-esser", 700, None), ("live de-esser", 1100, 0)])
def test_speculation(signals, name, chunk, warm):
    made, df = signals
    dynamics, serial = DYNAMICS[name]
    found, report = C.speculative(df, dynamics, chunk=chunk, warm=warm)
    found = taken(found, sum(map(len, made.values())))
    for k, x in made.items():
        assert np.abs(found[k] - serial(x)).max() < 1e-12, k
    assert report.chunks == sum(-(-len(x) // chunk) for x in made.values())
    assert (report.reruns > 0) == (report.rounds > 0)


def test_a_long_warm_up_leaves_nothing_to_refute(signals):
    _, df = signals
    quick = C.speculative(df, DYNAMICS["floor"][0], chunk=1500)[1]
    assert quick == C.Report(5, 0, 0, 0)


def test_what_never_forgets_runs_serially(signals, monkeypatch):
    made, df = signals
    monkeypatch.setattr(C, "MOST_ROUNDS", 2)
    found, report = C.speculative(df, DYNAMICS["follower"][0], chunk=40, warm=1)
    found = taken(found, sum(map(len, made.values())))
    assert report.rounds == 2 and report.serial >= 1
    for k, x in made.items():
        assert np.abs(found[k] - R.follow(x)).max() < 1e-12


def test_no_samples(signals):
    _, df = signals
    none = df.where("false")
    assert C.linear(none, Y.average(0.5)).count() == 0
    found, report = C.speculative(none, Y.LiveFloor())
    assert found.count() == 0 and report == C.Report(0, 0, 0, 0)
