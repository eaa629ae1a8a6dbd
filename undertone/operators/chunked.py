"""Recurrences over one signal in many tasks.

Samples are cut into chunks by their place in the order (from 0, without gaps), and a chunk is a task's unit of work.

`linear` is exact in three steps: each chunk tells where it takes the system from rest, a fold over one small row for each
chunk gives the state in which each starts, and chunks run from there. The samples are shuffled once.

`speculative` is for dynamics that can't be composed: each chunk starts from a state guessed by running over the end of the
chunk before it. Where that chunk in fact ended in another state, the guess is refuted and the chunk runs again from that
end, until nothing is refuted: then every start is the end before it, bit for bit, and the result is that of one serial run
for any cut. Dynamics forget, so few chunks run twice; signals that are still in dispute after `MOST_ROUNDS`
rounds are run serially."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.functions import systems
from undertone.functions.systems import Dynamics, Linear
from undertone.sources.work import stored

KEY, ORDER, X = "signal_id", "idx", "x"
CHUNK = 1 << 16
MOST_ROUNDS = 8
_FLOATS = pa.list_(pa.float64())


def _kinds(df: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)


def linear(df: DataFrame, system: Linear, *, chunk: int = CHUNK, key=KEY, order=ORDER, x=X, output="y") -> DataFrame:
    """key, order and the output of a linear system over each signal."""
    rows = df.select(key, order, F.floor(F.col(order) / chunk).alias("chunk"), F.col(x).cast("double").alias("v"))
    matrix, size = system.A.tobytes(), len(system.B)

    def ends(group: pa.Table) -> pa.Table:
        v = group.sort_by(order).column("v").to_numpy()
        start = system.start(v[0]) if group.column("chunk")[0].as_py() == 0 else np.zeros(size)
        return pa.table([group.column(key).slice(0, 1), group.column("chunk").slice(0, 1), pa.array([len(v)]), pa.array([system.run(v, start)[1].tolist()], _FLOATS)], [key, "chunk", "n", "end"])

    def fold(group: pa.Table) -> pa.Table:
        group, state, out = group.sort_by("chunk"), np.zeros(size), []
        for n, end in zip(group.column("n").to_pylist(), group.column("end").to_pylist(), strict=True):
            out.append(state.tolist())
            state = systems.power(matrix, size, n) @ state + np.array(end)
        return pa.table([group.column(key), group.column("chunk"), pa.array(out, _FLOATS)], [key, "chunk", "start"])

    def replay(group: pa.Table, start: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        v, state = group.column("v").to_numpy(), np.array(start.column("start")[0].as_py())
        if group.column("chunk")[0].as_py() == 0:
            state = system.start(v[0])
        return pa.table([group.column(key), group.column(order), pa.array(system.run(v, state)[0])], [key, order, output])

    told = rows.groupBy(key, "chunk").applyInArrow(ends, f"{_kinds(df, key)}, chunk bigint, n bigint, end array<double>")
    starts = told.groupBy(key).applyInArrow(fold, f"{_kinds(df, key)}, chunk bigint, start array<double>")
    return rows.groupBy(key, "chunk").cogroup(starts.groupBy(key, "chunk")).applyInArrow(replay, f"{_kinds(df, key, order)}, {output} double")


@dataclass(frozen=True)
class Report:
    """What speculation cost: chunks, runs of chunks beyond the first, rounds of them, and signals that were run serially."""

    chunks: int
    reruns: int
    rounds: int
    serial: int


def _same(a: Column, b: Column) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.equal_null(x, y)), lambda v: v)  # NaN equals NaN


def _matched(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """A join in which a null key is a key."""
    other = right.withColumnsRenamed({c: f"__{c}" for c in columns})
    condition = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in columns]
    return left.join(other, condition, how).drop(*(f"__{c}" for c in columns))


def speculative(df: DataFrame, dynamics: Dynamics, *, chunk: int = CHUNK, warm: int | None = None, key=KEY, order=ORDER, x=X, output="y") -> tuple[DataFrame, Report]:
    """key, order and the output of nonlinear dynamics over each signal, and a report. warm: samples of the chunk before over
    which a start is guessed (all of them if not given)."""
    warm = chunk if warm is None else min(warm, chunk)
    kind, pair = _kinds(df, key), [key, "chunk"]
    last = F.floor((F.col(order) + warm) / chunk)
    first = F.greatest(F.lit(0), F.floor((F.col(order) - dynamics.ahead) / chunk))
    rows = df.select(key, order, F.col(x).cast("double").alias("v"), F.explode(F.sequence(first, last)).alias("chunk"))
    names = [key, "chunk", "first", "own", "v", "y", "start", "end"]
    table = f"{kind}, chunk bigint, first bigint, own bigint, v array<double>, y array<double>, start array<double>, end array<double>"

    def attempt(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        at, v, c = group.column(order).to_numpy(), group.column("v").to_numpy(), group.column("chunk")[0].as_py()
        a, b = np.searchsorted(at, [c * chunk, (c + 1) * chunk])
        if a == b:  # behind the end of the signal
            return pa.table([pa.array([], t) for t in (group.schema.field(key).type, *[pa.int64()] * 3, *[_FLOATS] * 4)], names)
        state = dynamics.run(dynamics.initial(), 0, a, v)[1] if a else dynamics.initial()
        y, end = dynamics.run(state, a, b, v)
        return pa.table([group.column(key).slice(0, 1), *(pa.array([int(i)]) for i in (c, at[a], b - a)), *(pa.array([list(z)], _FLOATS) for z in (v[a:], y, state, end))], names)

    def again(batches):
        for batch in batches:
            runs = [dynamics.run(r["start"], 0, r["own"], np.array(r["v"])) for r in batch.select(["own", "v", "start"]).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (key, "chunk", "first", "start")), pa.array([list(y) for y, _ in runs], _FLOATS), pa.array([list(e) for _, e in runs], _FLOATS)], [key, "chunk", "first", "start", "y", "end"])

    def serial(group: pa.Table) -> pa.Table:
        group, state, ys = group.sort_by("chunk"), dynamics.initial(), []
        for v, own in zip(group.column("v").to_pylist(), group.column("own").to_pylist(), strict=True):
            y, state = dynamics.run(state, 0, own, np.array(v))
            ys.append(list(y))
        return pa.table([group.column(key), group.column("chunk"), group.column("first"), pa.array(ys, _FLOATS)], [key, "chunk", "first", "y"])

    tries = [stored(rows.groupBy(*pair).applyInArrow(attempt, table), "chunks")]
    states = tries[0].select(*pair, "start", "end", F.lit(0).alias("round"))
    reruns, lost = 0, None
    for turn in range(1, MOST_ROUNDS + 2):
        before = F.lag("end").over(Window.partitionBy(key).orderBy("chunk"))
        refuted = stored(states.withColumn("given", before).where(~_same(F.col("start"), F.col("given"))).select(*pair, F.col("given").alias("start")), "refuted")
        n = refuted.count()
        if not n:
            break
        if turn > MOST_ROUNDS:
            lost = refuted.select(key).distinct()
            break
        reruns += n
        tries.append(stored(_matched(tries[0].select(*pair, "first", "own", "v"), refuted, pair).mapInArrow(again, f"{kind}, chunk bigint, first bigint, start array<double>, y array<double>, end array<double>"), "chunks"))
        states = stored(_matched(states, refuted, pair, "left_anti").unionByName(tries[-1].select(*pair, "start", "end", F.lit(turn).alias("round"))), "states")
    pieces = [_matched(t, states.where(F.col("round") == i).select(*pair), pair, "left_semi").select(*pair, "first", "y") if len(tries) > 1 else t.select(*pair, "first", "y") for i, t in enumerate(tries)]
    out = pieces[0]
    for p in pieces[1:]:
        out = out.unionByName(p)
    if lost is not None:
        lost = stored(lost, "lost")
        out = _matched(out, lost, [key], "left_anti").unionByName(_matched(tries[0], lost, [key], "left_semi").groupBy(key).applyInArrow(serial, f"{kind}, chunk bigint, first bigint, y array<double>"))
    samples = out.select(key, "first", F.posexplode("y").alias("i", output))
    report = Report(tries[0].count(), reruns, len(tries) - 1, lost.count() if lost is not None else 0)
    place = (F.col("first") + F.col("i")).cast(df.schema[order].dataType)
    return samples.select(key, place.alias(order), output), report
