"""Streams taken in event-time order, with a defined end.

Rows of a key wait in a buffer until the watermark has passed them, and are then taken in order of time and tie, whatever the
cut into micro-batches and however late they came (within the watermark's delay). A step sees ordered rows only and keeps a
small memory between them. Timers wake a key without input: to release what waits, to drain a step after a pause, to
drop a memory that can't matter any more, and to flush at the end of the stream.

Keys are dealt over `SHARDS` shards by their hash. What keys hold lies together in their shard's one row of state, with one timer for the
first of them that has to wake, so a micro-batch costs a few calls for each shard, not for each key.

A stream ends when its source is closed: `run_to_end` reads all there is, then sends one row of the far future
through the same checkpoint, which moves the watermark past everything that waits."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from undertone.sources.work import work_folder

#: The time of the row that closes a stream, in microseconds: the year 2200. Timers of the end stand a month before, so delays are
#: shorter than that. (Times reach a processor in nanoseconds, which end in 2262.)
END = 7_258_118_400_000_000
_FLUSH = END - 30 * 86_400_000_000
_NEVER = 1 << 62
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Marks the closing row, whose key is null. (Names that begin with an underscore do not reach a processor.)
MARK = "closes_the_stream"
#: Groups of keys that share a row of state.
SHARDS = 1_024
#: Rows that a shard hands on together, and rows of a file of `replayed`.
ROWS, FILE_ROWS = 50_000, 250_000


class Step:
    """inputs: numeric columns it reads; output: its columns and their types, of which `at` and `tie` name a row.
    idle: microseconds without a row after which it is drained and starts afresh."""

    inputs: tuple[str, ...] = ()
    output = "at bigint, tie bigint"
    idle: int | None = None
    flushes = False

    def fresh(self) -> list[list[float]]:
        raise NotImplementedError

    def take(self, memory, at: np.ndarray, tie: np.ndarray, *inputs: np.ndarray) -> tuple[dict, list[list[float]]]:
        """Output columns of ordered rows, and the memory after them."""
        raise NotImplementedError

    def finish(self, memory) -> dict:
        """What is left when nothing follows."""
        return {}

    def resume(self, memory) -> list[list[float]]:
        """The memory after a pause, when all has been drained."""
        return self.fresh()

    def expires(self, memory) -> int | None:
        """When the memory no longer matters."""
        return None


@dataclass
class _Held:
    """What a key holds: the time of its last row taken, rows that wait (at, tie, inputs), and the step's memory."""

    last: int | None
    waiting: list[np.ndarray]
    memory: list[list[float]]
    kept: bool = True

    def wake(self, step: Step) -> int:
        waits = len(self.waiting[0]) > 0
        gone = step.expires(self.memory) if self.last is not None and not waits else None
        times = [int(self.waiting[0][0]) if waits else gone, self.last + step.idle if step.idle is not None and self.last is not None else None, _FLUSH if step.flushes else None]
        return min((int(t) for t in times if t is not None), default=_NEVER)


class _Ordered(StatefulProcessor):
    """Keys are text; None is one of them."""

    def __init__(self, step: Step, key: str):
        self.step, self.key = step, key
        self.names = [c.split()[0] for c in step.output.split(", ")]

    def init(self, handle) -> None:
        self.handle = handle
        columns = "".join(f", i{k} binary" for k in range(len(self.step.inputs)))
        self.state = handle.getValueState("held", f"timer bigint, key array<string>, last array<bigint>, waits array<int>, at binary, tie binary{columns}, memory array<array<array<double>>>")

    def _held(self) -> tuple[int | None, dict[str | None, _Held]]:
        if not self.state.exists():
            return None, {}
        timer, keys, last, waits, *rows, memory = self.state.get()
        cuts = np.cumsum(waits)[:-1]
        rows = [np.split(np.frombuffer(r, np.int64 if k < 2 else float), cuts) for k, r in enumerate(rows)]
        return timer, {k: _Held(last[i], [r[i] for r in rows], [list(m) for m in memory[i]]) for i, k in enumerate(keys)}

    def _keep(self, timer: int | None, held: dict[str | None, _Held]) -> None:
        held = {k: h for k, h in held.items() if h.kept}
        wake = min((h.wake(self.step) for h in held.values()), default=_NEVER)
        now = -(-wake // 1000) if wake != _NEVER else None
        if timer is not None and timer != now:
            self.handle.deleteTimer(timer)
        if not held:
            self.state.clear()
            return
        rows = [np.concatenate([h.waiting[k] for h in held.values()]).tobytes() for k in range(2 + len(self.step.inputs))]
        self.state.update((now, list(held), [h.last for h in held.values()], [len(h.waiting[0]) for h in held.values()], *rows, [h.memory for h in held.values()]))
        if now is not None and timer != now:
            self.handle.registerTimer(now)

    def _go(self, rows, watermark: int, fired: int | None = None):
        timer, held = self._held()
        kinds = [np.int64] * 2 + [float] * len(self.step.inputs)
        woken = {k for k, h in held.items() if h.wake(self.step) <= watermark}
        new: dict[str | None, list[list[np.ndarray]]] = {}
        for part in rows:
            if part.empty:  # of no columns
                continue
            part = part[~part[MARK].astype(bool)]
            code, names = pd.factorize(part["key"], use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            cuts = np.searchsorted(code[order], np.arange(1, len(names)))
            values = [np.split(np.asarray(part[c], t)[order], cuts) for c, t in zip(("at", "tie", *self.step.inputs), kinds, strict=True)]
            for i, k in enumerate(names):
                new.setdefault(None if pd.isna(k) else k, []).append([v[i] for v in values])
        found, n = {c: [] for c in (self.key, *self.names)}, 0
        for k in [*new, *(k for k in woken if k not in new)]:
            h = held.setdefault(k, _Held(None, [np.zeros(0, t) for t in kinds], self.step.fresh()))
            h.waiting = [np.concatenate([w, *v]) for w, *v in zip(h.waiting, *new.get(k, ()), strict=True)]
            for out in self._taken(h, watermark):
                size = len(next(iter(out.values()), ()))
                if size:
                    n += size
                    found[self.key].append((k, size))
                    for c in self.names:
                        found[c].append(np.asarray(out[c]))
            if n >= ROWS:
                yield self._rows(found)
                found, n = {c: [] for c in found}, 0
        if n:
            yield self._rows(found)
        self._keep(None if fired is not None and timer == fired else timer, held)

    def _rows(self, found: dict) -> pd.DataFrame:
        keys = np.repeat(np.array([k for k, _ in found[self.key]], object), [n for _, n in found[self.key]])
        return pd.DataFrame({self.key: keys, **{c: np.concatenate(found[c]) for c in self.names}})

    def _taken(self, h: _Held, watermark: int):
        """Output of a key's rows that the watermark has passed, and of what a pause or the end drains."""
        order = np.lexsort((h.waiting[1], h.waiting[0]))
        h.waiting = [w[order] for w in h.waiting]
        ready = int(np.searchsorted(h.waiting[0], watermark, "right"))
        while ready:
            n = ready
            if self.step.idle is not None:  # a pause drains what came before it
                jumps = np.flatnonzero(np.diff(h.waiting[0][:ready]) >= self.step.idle)
                n = int(jumps[0]) + 1 if len(jumps) else ready
                if h.last is not None and h.waiting[0][0] - h.last >= self.step.idle:
                    yield self.step.finish(h.memory)
                    h.memory = self.step.resume(h.memory)
            out, h.memory = self.step.take(h.memory, *(w[:n] for w in h.waiting))
            yield out
            h.last = int(h.waiting[0][n - 1])
            h.waiting, ready = [w[n:] for w in h.waiting], ready - n
        waits, ended = len(h.waiting[0]) > 0, watermark >= _FLUSH
        paused = self.step.idle is not None and h.last is not None and h.last + self.step.idle <= watermark  # what waits is later still
        if paused or (ended and h.last is not None):
            yield self.step.finish(h.memory)
            h.memory, h.last = self.step.resume(h.memory), None
        gone = self.step.expires(h.memory) if h.last is not None and not waits else None
        h.kept = not (ended or (gone is not None and gone <= watermark))

    def handleInputRows(self, key, rows, timerValues):
        yield from self._go(rows, 1000 * timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self._go((), 1000 * timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())


def in_order(stream: DataFrame, step: Step, *, key: str, at: str, tie: str, late: str) -> DataFrame:
    """key and the step's output; at: the event time. Rows that come later than `late` after a newer one may be lost."""
    closed = F.col(MARK) if MARK in stream.columns else F.lit(False)
    timed = stream.withWatermark(at, late)
    kind = stream.schema[key].dataType.simpleString()
    shard = F.pmod(F.xxhash64(key), F.lit(SHARDS)).alias("shard")
    rows = timed.select(shard, F.col(key).cast("string").alias("key"), at, F.unix_micros(at).alias("at"), F.col(tie).cast("bigint").alias("tie"), *(F.col(c).cast("double").alias(c) for c in step.inputs), closed.alias(MARK))
    out = rows.groupBy("shard").transformWithStateInPandas(_Ordered(step, key), f"{key} string, {step.output}", "Append", "EventTime")
    return out.withColumn(key, F.col(key).cast(kind))


def _run(stream: DataFrame, folder: str) -> list:
    spark = stream.sparkSession
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        q = stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return list(q.recentProgress)
    finally:
        spark.conf.set(_PROVIDER, before) if before is not None else spark.conf.unset(_PROVIDER)


def run_to_end(stream: DataFrame, build: Callable[[DataFrame], DataFrame], *, at: str, progress: list | None = None) -> DataFrame:
    """The rows of build(stream) once the stream has ended. progress: gets what Spark reports of each micro-batch."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    schema = stream.schema
    marks = f"{folder}/marks"
    empty = spark.createDataFrame([], schema)
    empty.write.parquet(marks)
    closing = spark.readStream.schema(schema).parquet(marks)
    both = stream.withColumn(MARK, F.lit(False)).unionByName(closing.withColumn(MARK, F.lit(True)))
    out = build(both)
    reports = _run(out, folder)
    end = spark.range(1).select(*((F.timestamp_micros(F.lit(END)) if f.name == at else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    end.write.mode("append").parquet(marks)
    reports += _run(out, folder)
    if progress is not None:
        progress += reports
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def replayed(df: DataFrame, parts: int, part, **options) -> DataFrame:
    """A table as a stream of several micro-batches: rows go to batches by the number 0..parts-1 that a column expression gives. A batch is
    a folder of as many files as any other, one for each FILE_ROWS rows of the smallest."""
    spark, folder = df.sparkSession, f"{work_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    sizes = {r.part: r["count"] for r in df.groupBy(part.alias("part")).count().collect()}
    files = max(1, min(sizes.get(i, 0) for i in range(parts)) // FILE_ROWS)
    for n in sorted({files, 1}, reverse=True):
        for i in range(parts):
            rows = df.where(part == i)
            (rows.coalesce(1) if n == 1 else rows.repartition(n)).write.mode("overwrite").parquet(f"{folder}/{n}/{i}")
        if n == 1 or all(len(spark.read.schema(df.schema).parquet(f"{folder}/{n}/{i}").inputFiles()) == n for i in range(parts)):
            break
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", n).options(**options).parquet(f"{folder}/{n}/*")


class OverlapAdd(Step):
    """idx and y: frames of `size` samples every `hop` are windowed, reshaped, windowed again and added. A sample goes out when no
    later frame reaches it; sums under way go out when the stream ends or pauses, as the batch form has them. idx counts the
    samples of a key, those before a pause included."""

    inputs = ("x",)
    output = "idx bigint, y double"
    flushes = True

    def __init__(self, size: int, hop: int, shape, idle: int | None = None):
        self.size, self.hop, self.shape, self.idle = size, hop, shape, idle
        self.window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / size)

    def fresh(self):
        return [[0.0, 0.0], [], [0.0] * self.size, [0.0] * self.size]  # frames done, samples before the last pause

    def _out(self, first: int, added, weight) -> dict:
        y = np.where(weight > 1e-8, added / np.maximum(weight, 1e-8), 0.0)
        return {"idx": np.arange(first, first + len(y)), "y": y}

    def take(self, memory, at, tie, x):
        (done, base), tail, added, weight = map(int, memory[0]), memory[1], np.array(memory[2]), np.array(memory[3])
        samples, first, sums, weights = np.concatenate([tail, x]), base + done * self.hop, [], []
        while len(samples) >= self.size:
            added += self.shape(samples[: self.size] * self.window) * self.window
            weight += self.window**2
            sums.append(added[: self.hop])
            weights.append(weight[: self.hop])
            added, weight = (np.concatenate([v[self.hop :], np.zeros(self.hop)]) for v in (added, weight))
            samples, done = samples[self.hop :], done + 1
        found = self._out(first, np.concatenate(sums), np.concatenate(weights)) if sums else {}
        return found, [[float(done), float(base)], samples.tolist(), added.tolist(), weight.tolist()]

    def finish(self, memory):
        (done, base), left = map(int, memory[0]), self.size - self.hop
        return self._out(base + done * self.hop, np.array(memory[2][:left]), np.array(memory[3][:left])) if done else {}

    def resume(self, memory):
        done, base = memory[0]
        return [[0.0, base + done * self.hop + len(memory[1])], *self.fresh()[1:]]


class NewestSide(Step):
    """Of frames (side null) and side values (x null) in one order: at and tie of each frame, its x, and the newest side value so far.
    A side value of the same time and tie comes first."""

    inputs = ("x", "side")
    output = "at bigint, tie bigint, x double, side double"

    def fresh(self):
        return [[np.nan]]

    def take(self, memory, at, tie, x, side):
        order = np.lexsort((np.isnan(side), tie, at))
        at, tie, x, side = (v[order] for v in (at, tie, x, side))
        newest = pd.Series(np.concatenate([memory[0], side])).ffill().to_numpy()[1:]
        frame = ~np.isnan(x)
        return {"at": at[frame], "tie": tie[frame], "x": x[frame], "side": newest[frame]}, [[float(newest[-1]) if len(newest) else memory[0][0]]]


class Trailing(Step):
    """rms, zcr and level of the newest `size` samples at every sample that has as many behind it. The memory is a ring of the last
    size - 1 samples; sums move along by what comes and goes."""

    inputs = ("x",)
    output = "at bigint, tie bigint, rms double, zcr double, level double"

    def __init__(self, size: int, silent: float = -100.0):
        self.size, self.silent = size, silent

    def fresh(self):
        return [[]]

    def take(self, memory, at, tie, x):
        ring = np.concatenate([memory[0], x])
        full = max(0, len(ring) - self.size + 1)
        power = np.concatenate([[0.0], np.cumsum(ring * ring)])
        flips = np.concatenate([[0, 0], np.cumsum(np.diff(ring >= 0))])  # up to and with each sample
        rms = np.sqrt(np.maximum(power[self.size :] - power[: -self.size], 0.0) / self.size) if full else np.zeros(0)
        zcr = (flips[self.size :] - flips[1 : full + 1]) / self.size if full else np.zeros(0)
        level = np.where(rms > 0, 20 * np.log10(np.maximum(rms, 1e-300)), self.silent)
        return {"at": at[len(at) - full :], "tie": tie[len(tie) - full :], "rms": rms, "zcr": zcr, "level": level}, [ring[-(self.size - 1) :].tolist() if self.size > 1 else []]


class FirstSights(Step):
    """Rows with no accepted row of their key within ttl (microseconds) before. The memory goes when it can refuse nothing any more."""

    def __init__(self, ttl: int):
        self.ttl = ttl

    def fresh(self):
        return [[]]

    def take(self, memory, at, tie):
        accepted, kept = memory[0][0] if memory[0] else None, []
        for i, now in enumerate(at.tolist()):
            if accepted is None or now - accepted >= self.ttl:
                accepted = now
                kept.append(i)
        return {"at": at[kept], "tie": tie[kept]}, [[float(accepted)]]

    def expires(self, memory):
        return int(memory[0][0]) + self.ttl if memory[0] else None


class FixedWindows(Step):
    """allowed: windows start at the first row after the one before has run out, and take `most` rows; a window that has run out is dropped."""

    output = "at bigint, tie bigint, allowed boolean"

    def __init__(self, window: int, most: int):
        self.window, self.most = window, most

    def fresh(self):
        return [[]]

    def take(self, memory, at, tie):
        (start, n), allowed = memory[0] or (None, 0), []
        for now in at.tolist():
            if start is None or now - start >= self.window:
                start, n = now, 0
            n += 1
            allowed.append(n <= self.most)
        return {"at": at, "tie": tie, "allowed": allowed}, [[float(start), float(n)]]

    def expires(self, memory):
        return int(memory[0][0]) + self.window if memory[0] else None
