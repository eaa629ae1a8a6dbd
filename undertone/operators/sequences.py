"""Sequence operators: windows over ordered samples, blocks, runs, and recurrences by key.

All take long rows (key, idx, x). Windows and blocks stay in built-in functions and need one
exchange on the key; recurrences run as Arrow kernels, by chunks of a sequence (`chunked`) or one sequence at a time (`scan`)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.functions import systems
from undertone.operators import chunked
from undertone.sources.work import stored

KEY, ORDER, X = "signal_id", "idx", "x"


def over(key: str = KEY, order: str = ORDER) -> Window:
    return Window.partitionBy(key).orderBy(order)


def scan(df: DataFrame, kernel, outputs: dict[str, str], *, key: str = KEY, order: str = ORDER, inputs: tuple[str, ...] = (X,)) -> DataFrame:
    """Runs kernel(arrays of the inputs in order) for each key; outputs names its arrays and their types."""
    schema = df.select(key, order).schema
    fields = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in schema), *(f"{n} {t}" for n, t in outputs.items())])

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        found = kernel(*(group.column(c).to_numpy() for c in inputs))
        found = found if isinstance(found, tuple) else (found,)
        return pa.table([group.column(key), group.column(order), *(pa.array(f) for f in found)], [key, order, *outputs])

    return df.select(key, order, *inputs).groupBy(key).applyInArrow(run, fields)


def ema(df: DataFrame, keep: float, **at) -> DataFrame:
    return chunked.linear(df, systems.average(keep), **at)


def ema_last(df: DataFrame, keep: float, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """The value an average ends at, as a fold inside one expression."""
    values = F.transform(F.array_sort(F.collect_list(F.struct(order, x))), lambda s: s[x])
    rows = df.groupBy(key).agg(values.alias("v"))
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return rows.select(key, F.aggregate(rest, F.element_at("v", 1), lambda a, v: a * keep + v * (1 - keep)).alias("ema"))


def blocks(df: DataFrame, size: int, *, key=KEY, order=ORDER) -> DataFrame:
    """Adds b, the tumbling block of a row."""
    return df.withColumn("b", F.floor(F.col(order) / size))


def hopping(df: DataFrame, size: int, hop: int, *, key=KEY, order=ORDER) -> DataFrame:
    """A row for each full frame that a row lies in: f, and i, the place within the frame."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    last = F.floor((F.col("__n") - size) / hop)
    low = F.greatest(F.lit(0), F.ceil((F.col(order) - size + 1) / hop))
    high = F.least(F.floor(F.col(order) / hop), last)
    out = df.withColumn("__n", n).where(f"__n >= {size}").where(low <= high)
    return out.withColumn("f", F.explode(F.sequence(low, high))).withColumn("i", F.col(order) - F.col("f") * hop).drop("__n")


def zero_crossings(df: DataFrame, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, crossings, n: changes of sign between neighbours, zero counting as positive."""
    sign = F.col(x) >= 0
    flips = df.select(key, (sign != F.lag(sign).over(over(key, order))).cast("int").alias("flip"))
    return flips.groupBy(key).agg(F.coalesce(F.sum("flip"), F.lit(0)).alias("crossings"), F.count("*").alias("n"))


def runs(df: DataFrame, flag: Column, *, key=KEY, order=ORDER) -> DataFrame:
    """Adds run, a number that grows when the value of an expression changes along the order (nulls are a value)."""
    at = over(key, order)
    new = F.when(F.row_number().over(at) == 1, 0).otherwise((~F.col("__v").eqNullSafe(F.lag("__v").over(at))).cast("int"))
    out = df.withColumn("__v", flag).withColumn("__new", new)
    return out.withColumn("run", F.sum("__new").over(at)).drop("__new", "__v")


def clicks(df: DataFrame, size: int, factor: float, least: float = 0.005, *, share: float = 0.5, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds click. Blocks overlap by half; a sample is a click if in one of its two blocks it is over a factor times the upper
    median of absolute values, and over a floor that follows the signal's level. Blocks of under four samples judge
    nothing. Single gaps between clicks are filled."""
    hop, whole = size // 2, Window.partitionBy(key)
    size_of = F.abs(F.col(x))
    level = df.withColumns({"__n": F.count("*").over(whole), "__floor": F.greatest(F.lit(least), F.avg(size_of).over(whole) * share)})
    own = F.floor(F.col(order) / hop)
    twice = level.withColumn("__b", F.explode(F.filter(F.array(own, own - 1), lambda b: (b >= 0) & (b * hop + 4 <= F.col("__n")))))
    block = Window.partitionBy(key, "__b")
    ranked = twice.withColumns({"__r": F.row_number().over(block.orderBy(size_of, order)), "__m": F.floor(F.count("*").over(block) / 2) + 1})
    median = F.max(F.when(F.col("__r") == F.col("__m"), size_of)).over(block)
    judged = ranked.withColumn("__c", size_of > F.greatest(median * factor, F.col("__floor"))).groupBy(key, order).agg(F.max("__c").alias("__c"))
    at = over(key, order)
    found = df.join(judged, [key, order], "left").withColumn("__c", F.coalesce("__c", F.lit(False)))
    gap = ~F.col("__c") & F.coalesce(F.lag("__c").over(at), F.lit(False)) & F.coalesce(F.lead("__c").over(at), F.lit(False))
    return found.withColumn("click", F.col("__c") | gap).drop("__c")


def repair(df: DataFrame, *, key=KEY, order=ORDER, x=X, flag="click") -> DataFrame:
    """Adds y: flagged runs become a cubic through the two samples on either side of the run (the nearer one
    twice at the ends; a run that touches an end takes the value of the other side)."""
    at = Window.partitionBy(key).orderBy(order)
    before = at.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(key).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    good = F.when(~F.col(flag), F.struct(F.col(order).alias("i"), F.col(x).alias("v"), F.lag(F.when(~F.col(flag), F.col(x))).over(at).alias("p"), F.lead(F.when(~F.col(flag), F.col(x))).over(at).alias("q")))
    out = df.withColumn("__g", good)
    out = out.withColumns({"__l": F.last("__g", ignorenulls=True).over(before), "__r": F.last("__g", ignorenulls=True).over(after)})
    t = (F.col(order) - F.col("__l.i")) / (F.col("__r.i") - F.col("__l.i"))
    p1, p2 = F.col("__l.v"), F.col("__r.v")
    p0, p3 = F.coalesce(F.col("__l.p"), p1), F.coalesce(F.col("__r.q"), p2)
    cubic = 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t)
    y = F.when(~F.col(flag), F.col(x)).when(F.col("__l").isNotNull() & F.col("__r").isNotNull(), cubic).otherwise(F.coalesce(p1, p2, F.lit(0.0)))
    return out.withColumn("y", y).drop("__g", "__l", "__r")


def deltas(df: DataFrame, *, key=KEY, order=ORDER, x=X, reach: int = 2) -> DataFrame:
    """Adds delta: the slope of a regression over neighbours, the ends repeated."""
    at, whole = over(key, order), Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(x).over(whole), F.last(x).over(whole)
    total = sum((n * (F.coalesce(F.lead(x, n).over(at), last) - F.coalesce(F.lag(x, n).over(at), first)) for n in range(1, reach + 1)), F.lit(0.0))
    return df.withColumn("delta", total / (2 * sum(n * n for n in range(1, reach + 1))))


def smooth3(df: DataFrame, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds y: the mean of three neighbours, the ends repeated."""
    at = over(key, order)
    return df.withColumn("y", (F.coalesce(F.lag(x).over(at), F.col(x)) + F.col(x) + F.coalesce(F.lead(x).over(at), F.col(x))) / 3)


def smooth(df: DataFrame, reach: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds y: the mean over a window that the ends cut short."""
    return df.withColumn("y", F.avg(x).over(over(key, order).rowsBetween(-reach, reach)))


def rolling_min(df: DataFrame, length: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    return df.withColumn("low", F.min(x).over(over(key, order).rowsBetween(-(length - 1), 0)))


def running_mean(df: DataFrame, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    return df.withColumn("mean", F.avg(x).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0)))


def dereverb(df: DataFrame, depth: int, amount: float, decay: float, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds y: a weighted mean of the past `depth` samples is taken out, by a gain of 0.1 at least, once the past
    is complete. The last weight falls on the current sample, as observed in practice."""
    at = over(key, order)
    weights = [float(np.exp(-d / (depth * decay))) for d in range(depth)]
    past = sum((F.coalesce(F.lag(x, d + 1).over(at) if d < depth - 1 else F.col(x), F.lit(0.0)) * w for d, w in enumerate(weights)), F.lit(0.0)) / sum(weights)
    gain = F.greatest(F.lit(0.1), 1 - amount * past / (F.col(x) + 1e-10))
    return df.withColumn("y", F.when(F.row_number().over(at) >= depth, F.col(x) * gain).otherwise(F.col(x)))


def hangover(df: DataFrame, voiced: Column, frames: int, *, key=KEY, order=ORDER) -> DataFrame:
    """Adds conf: 1 where voiced, 0.5 for some frames after, else 0; in closed form, without state."""
    last = F.last(F.when(voiced, F.col(order)), ignorenulls=True).over(over(key, order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("conf", F.when(voiced, 1.0).when(F.col(order) - last <= frames, 0.5).otherwise(0.0))


def gate_ahead(df: DataFrame, threshold: float, closed: float, *, look: int, hold: int, attack: float = 0.05, release: float = 0.0005, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds y: the sample `look` places before, as it was while the level is over a threshold or was at most `hold` samples
    ago, else times `closed`. The level is a recurrence; the rest are windows."""
    level, _ = chunked.speculative(df, systems.Follower(attack, release), key=key, order=order, x=x, output="__env")
    at = over(key, order)
    loud = F.max(F.when(F.round("__env", 9) > threshold, F.col(order))).over(at)
    late = F.coalesce(F.lag(x, look).over(at), F.lit(0.0))
    gain = F.when(F.col(order) - loud <= hold, 1.0).otherwise(closed)
    return df.join(level, [key, order]).withColumn("y", late * gain).drop("__env")


#: Lags up to which products are added one by one; beyond, Fourier transforms are cheaper.
FEW_LAGS = 64


def lagged_correlation(left: DataFrame, right: DataFrame, most: int, *, chunk: int = chunked.CHUNK, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, lag, score: the lag within +-most that correlates best, the smallest on ties; both signals from order 0 on, without
    gaps. A chunk of the left side meets the part of the right side that its lags reach; the chunks' products are added up by
    lag, so neither signal has to fit in a task. Chunks lie one after another in a task, so many short ones cost no more than a long one."""
    kind, at = left.schema[key].dataType.simpleString(), F.col(order)
    own = left.select(key, F.floor(at / chunk).alias("chunk"), F.lit(False).alias("other"), order, F.col(x).cast("double").alias("v"))
    reach = F.sequence(F.greatest(F.lit(0), F.floor((at - most) / chunk)), F.floor((at + most) / chunk))
    other = right.select(key, F.explode(reach).alias("chunk"), F.lit(True).alias("other"), order, F.col(x).cast("double").alias("v"))

    def whole(batches):
        """Runs of rows in which no chunk is cut, and where each of their chunks begins."""
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch]).combine_chunks()
            if not t.num_rows:
                continue
            new = np.zeros(t.num_rows, bool)
            new[0] = True
            for c in (key, "chunk"):
                v = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode")
                v = (v.combine_chunks() if isinstance(v, pa.ChunkedArray) else v).indices.to_numpy()
                new[1:] |= v[1:] != v[:-1]
            first = np.flatnonzero(new)
            if len(first) > 1:
                yield t.slice(0, first[-1]), first[:-1]
            rest = t.slice(first[-1])
        if rest is not None:
            yield rest, np.zeros(1, np.int64)

    def run(batches):
        for t, first in whole(batches):
            place, v = t.column(order).to_numpy(), t.column("v").to_numpy()
            end = np.append(first[1:], t.num_rows)
            middle = first + np.add.reduceat((~np.asarray(t.column("other"))).astype(np.int64), first)  # where a chunk's right side begins
            both = (middle > first) & (end > middle)
            a, m, b = first[both], middle[both], end[both]
            low, high = np.maximum(-most, place[m] - place[m - 1]), np.minimum(most, place[b - 1] - place[a])
            of, lags, scores = [], [], []
            if 2 * most < FEW_LAGS:
                n = m - a
                chunk_of = np.repeat(np.arange(len(a)), n)
                i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a[chunk_of]
                beside, u = m[chunk_of] + place[i] - place[m][chunk_of], v[i]  # the right sample at lag 0
                for lag in range(-most, most + 1):
                    j = beside + lag
                    there = (j >= m[chunk_of]) & (j < b[chunk_of])
                    score = np.bincount(chunk_of[there], u[there] * v[j[there]], len(a))
                    c = np.flatnonzero((low <= lag) & (lag <= high))
                    of.append(c)
                    lags.append(np.full(len(c), lag))
                    scores.append(score[c])
            else:
                for c in range(len(a)):
                    u, w = v[a[c] : m[c]], v[m[c] : b[c]]
                    g = np.arange(low[c], high[c] + 1)
                    size = 1 << (len(u) + len(w)).bit_length()
                    of.append(np.full(len(g), c))
                    lags.append(g)
                    scores.append(np.fft.irfft(np.conj(np.fft.rfft(u, size)) * np.fft.rfft(w, size), size)[g - int(place[m[c]] - place[a[c]])])
            if of:
                keys = t.column(key).take(pa.array(a[np.concatenate(of)])).combine_chunks()
                yield pa.RecordBatch.from_arrays([keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys, pa.array(np.concatenate(lags).astype(np.int64)), pa.array(np.concatenate(scores).astype(float))], [key, "lag", "score"])

    rows = own.unionByName(other).repartition(key, "chunk").sortWithinPartitions(key, "chunk", "other", order)
    parts = rows.mapInArrow(run, f"{key} {kind}, lag bigint, score double")
    scores = parts.groupBy(key, "lag").agg((F.round(F.sum("score"), 6) + 0.0).alias("score"))
    best = scores.groupBy(key).agg(F.max(F.struct("score", (-F.col("lag")).alias("minus"))).alias("b"))
    return best.select(key, (-F.col("b.minus")).alias("lag"), F.col("b.score").alias("score"))


def numbered(df: DataFrame, *by, name: str = "place") -> DataFrame:
    """Adds the place of each row in a total order, from 1. Ranges of the order are sorted apart and written once; only the
    sizes of the ranges meet in the driver."""
    rows = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("__at", 33)
    sizes, offsets, total = {r.p: r["count"] for r in rows.groupBy(part.alias("p")).count().collect()}, [F.lit(-1), F.lit(0)], 0
    for p in sorted(sizes):
        offsets += [F.lit(p), F.lit(total)]
        total += sizes[p]
    place = F.element_at(F.create_map(*offsets), part.cast("int")) + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.withColumn(name, place.cast("bigint")).drop("__at")
