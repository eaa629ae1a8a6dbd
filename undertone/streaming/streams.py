"""Structured Streaming forms: stateful recurrences and frames, windows, sessions and deduplication.

State is one small row for each key. Every form gives what its batch form gives once all input has been read, as long as
no row comes in a later micro-batch than a newer one of its key; `ordered` has forms for rows that come late."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from undertone.sources.work import work_folder


def read_stream(spark: SparkSession, folder: str, name: str, schema, files_at_once: int | None = None) -> DataFrame:
    """A table's files in a folder as a stream."""
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_at_once:
        reader = reader.option("maxFilesPerTrigger", files_at_once)
    return reader.parquet(folder)


def drained(stream: DataFrame) -> DataFrame:
    """Runs an append-only stream over all that is there, and returns its rows."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    stream.writeStream.format("parquet").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drained_complete(stream: DataFrame) -> DataFrame:
    """Runs an aggregation over all that is there, and returns its last result."""
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)
    stream.writeStream.foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{folder}/rows")).option("checkpointLocation", f"{folder}/state").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def _stateful(df: DataFrame, key: str, run, output: str, state: str) -> DataFrame:
    return df.groupBy(key).applyInPandasWithState(run, output, state, "append", GroupStateTimeout.NoTimeout)


def ema(df: DataFrame, keep: float, *, key: str, order: list[str], x: str) -> DataFrame:
    """key, order columns and y, the average so far; the state is its last value."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(name, parts, state):
        y = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(order)
        out = []
        for v in rows[x]:
            y = v if y is None else keep * y + (1 - keep) * v
            out.append(y)
        state.update((float(y),))
        yield rows[[key, *order]].assign(y=out)

    fields = ", ".join(f"{c} {kinds[c]}" for c in [key, *order])
    return _stateful(df.select(key, *order, x), key, run, f"{fields}, y double", "y double")


def hop_frames(df: DataFrame, size: int, hop: int, *, key: str, order: list[str], x: str) -> DataFrame:
    """key, f and rms of every full frame; the state is the tail that later frames still need."""
    kind = df.schema[key].dataType.simpleString()

    def run(name, parts, state):
        done, tail = (state.get[0], list(state.get[1])) if state.exists else (0, [])
        rows = pd.concat(list(parts)).sort_values(order)
        samples = tail + rows[x].tolist()
        out = []
        while len(samples) >= size:
            out.append((name[0], done, float(np.sqrt(np.mean(np.square(samples[:size]))))))
            samples, done = samples[hop:], done + 1
        state.update((done, samples))
        yield pd.DataFrame(out, columns=[key, "f", "rms"])

    return _stateful(df.select(key, *order, x), key, run, f"{key} {kind}, f bigint, rms double", "done bigint, tail array<double>")


def latest_side(df: DataFrame, *, key: str, order: list[str], x: str, side: str) -> DataFrame:
    """key, order columns, x, and the newest side value that is not null so far; the state is that value."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(name, parts, state):
        rows = pd.concat(list(parts)).sort_values(order)
        seen = rows[side].astype(float)
        if state.exists and len(seen) and np.isnan(seen.iloc[0]):
            seen.iloc[0] = state.get[0] if state.get[0] is not None else np.nan
        seen = seen.ffill()
        state.update((None if np.isnan(seen.iloc[-1]) else float(seen.iloc[-1]),))
        yield rows[[key, *order, x]].assign(side=seen)

    fields = ", ".join(f"{c} {kinds[c]}" for c in [key, *order, x])
    return _stateful(df.select(key, *order, x, side), key, run, f"{fields}, side double", "side double")


def throttled(df: DataFrame, every: int, frame: str = "f") -> DataFrame:
    """Every n-th frame."""
    return df.where(F.col(frame) % every == 0)


def windowed(df: DataFrame, at: str, late: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """Counts and sums by key and time window, late rows accepted for a while."""
    window = F.window(at, size, slide) if slide else F.window(at, size)
    return df.withWatermark(at, late).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(df: DataFrame, at: str, late: str, gap: str, key: str) -> DataFrame:
    out = df.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("start"), "n", "total")


def first_sights(df: DataFrame, at: str, within: str, *keys: str) -> DataFrame:
    """One row of each key within a time."""
    return df.withWatermark(at, within).dropDuplicatesWithinWatermark(list(keys))


def with_parameters(stream: DataFrame, parameters: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table of parameters; rows without one keep nulls."""
    return stream.join(parameters, key, "left")
