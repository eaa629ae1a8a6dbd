"""Segments: runs of labels, their summaries, and views over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.operators.sequences import numbered, runs


def label_runs(df: DataFrame, label: str, *, key: str, order: str, seconds: float, least: float = 0.0, energy: str | None = None) -> DataFrame:
    """key, label, start, end, confidence of each run of equal labels; null is silence and gives none. A run ends where the
    next one starts; its confidence comes from the frame that ends it, 0.72 for the last one."""
    marked = runs(df, F.col(label), key=key, order=order)
    level = F.col(energy) if energy else F.lit(0.0)
    found = marked.withColumn("__e", level).groupBy(key, "run").agg(F.first(label).alias("label"), F.min(order).alias("a"), F.max(order).alias("b"), F.min_by("__e", order).alias("__e"))
    w = Window.partitionBy(key).orderBy("run")
    closed = found.withColumns({"next": F.lead("a").over(w), "next_e": F.lead("__e").over(w)})
    rows = closed.where(F.col("label").isNotNull()).select(key, "label", (F.col("a") * seconds).alias("start"), (F.coalesce("next", F.col("b") + 1) * seconds).alias("end"), F.when(F.col("next").isNull(), 0.72).otherwise(F.least(F.lit(0.97), 0.68 + 0.29 * F.coalesce("next_e", F.lit(0.0)))).alias("confidence"))
    return rows.where(F.col("end") - F.col("start") >= least - 1e-9)


def clipped(df: DataFrame, lo, hi, *, start="start", end="end") -> DataFrame:
    """Segments that meet a window, cut to it."""
    return df.where((F.col(end) > lo) & (F.col(start) < hi)).withColumns({start: F.greatest(F.col(start), F.lit(lo)), end: F.least(F.col(end), F.lit(hi))})


def at_time(df: DataFrame, t, *, start="start", end="end") -> DataFrame:
    """The first segment that holds a time."""
    return df.where((F.col(start) <= t) & (F.col(end) >= t)).orderBy(start, end).limit(1)


def hit(df: DataFrame, t, name: str, *, key: str, start="start", end="end") -> DataFrame:
    """For each key, the name of the first segment that holds a time."""
    return df.where((F.col(start) <= t) & (F.col(end) >= t)).groupBy(key).agg(F.min_by(name, F.struct(start, end)).alias(name))


def first_seen(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Distinct names with their rank by first appearance, from 1."""
    first = df.groupBy(name).agg(F.min(F.struct(*order)).alias("__o"))
    return numbered(first, "__o", name).select(name, "place")


def with_volume(df: DataFrame, volumes: DataFrame, name: str) -> DataFrame:
    """Segments with their speaker's volume, 1 where there is none; volume zero silences x."""
    return df.join(volumes, name, "left").withColumn("volume", F.coalesce("volume", F.lit(1.0)))


def scale_to_range(x: str, *, key: str) -> Column:
    """0..1 between the least and the greatest value of the key, 0 where they are equal."""
    w = Window.partitionBy(key)
    lo, hi = F.min(x).over(w), F.max(x).over(w)
    return F.when(hi > lo, (F.col(x) - lo) / (hi - lo)).otherwise(0.0)
