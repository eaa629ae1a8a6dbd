"""Keyed stores over append-only logs: last write wins, merge, newest-N, expiry, quotas and limits.

Everything is an aggregation or a window by key. Combining happens before the shuffle where the
result is an aggregate, so a key with very many rows costs one row for each task."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.operators.sequences import numbered


def newest(df: DataFrame, n: int, *order: str, key: str | None = None) -> DataFrame:
    """The n newest rows by the order's columns (overall: a top-n; by key: ranked within it)."""
    down = [F.col(c).desc() for c in order]
    if key is None:
        return df.orderBy(*down).limit(n)
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*down))).where(F.col("__r") <= n).drop("__r")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__v")).select(key, "__v.*")


def latest_or_gone(df: DataFrame, key: str, gone: Column, *order: str) -> DataFrame:
    """As latest, without keys whose last row deletes them."""
    return latest(df.withColumn("__gone", gone), key, *order).where(~F.col("__gone")).drop("__gone")


def merged(df: DataFrame, key: str, fields: list[str], *order: str) -> DataFrame:
    """Each field's last value that isn't null, by key."""
    return df.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), F.struct(*order))).alias(f) for f in fields))


def dedup_ttl(df: DataFrame, key: str, at: str, ttl: float, *order: str) -> DataFrame:
    """First sights: rows with no accepted row of their key within ttl before. Whether a row is accepted depends on the
    one accepted before it, so rows of a key are walked in order."""
    return _walk(df, key, at, order, lambda start, now: start is None or now - start >= ttl, lambda new, start, now: new)


def rate_limited(df: DataFrame, key: str, at: str, window: float, most: int, *order: str) -> DataFrame:
    """Adds allowed: windows start at the first row after the one before has run out, and take `most` rows."""
    schema = df.select("*", F.lit(True).alias("allowed")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(at, "ascending"), *((o, "ascending") for o in order)])
        start, n, out = None, 0, []
        for now in group.column(at).to_pylist():
            if start is None or now - start >= window:
                start, n = now, 0
            n += 1
            out.append(n <= most)
        return group.append_column("allowed", pa.array(out, pa.bool_()))

    return df.groupBy(key).applyInArrow(run, schema)


def _walk(df, key, at, order, opens, keep) -> DataFrame:
    schema = df.schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([(at, "ascending"), *((o, "ascending") for o in order)])
        start, out = None, []
        for now in group.column(at).to_pylist():
            new = opens(start, now)
            out.append(keep(new, start, now))
            start = now if new else start
        return group.filter(pa.array(out, pa.bool_()))

    return df.groupBy(key).applyInArrow(run, schema)


def over_quota(df: DataFrame, key: str, size: Column, most: int) -> DataFrame:
    """key and bytes of those over a quota."""
    return df.groupBy(key).agg(F.sum(size).alias("bytes")).where(F.col("bytes") > most)


def tier_checks(df: DataFrame, tiers: DataFrame, tier: str, used: str) -> DataFrame:
    """Adds limit (null: none) and ok from a small table of tiers."""
    return df.join(tiers.select(tier, "limit"), tier, "left").withColumn("ok", F.col("limit").isNull() | (F.col(used) <= F.col("limit")))


def highest(df: DataFrame, key: str, rank: dict[str, int], name: str) -> DataFrame:
    """key and its highest-ranked value."""
    pairs = F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])
    return df.groupBy(key).agg(F.max_by(name, F.element_at(pairs, F.col(name))).alias(name))


def toggled(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that were toggled an odd number of times."""
    return df.groupBy(*keys).agg((F.count("*") % 2 == 1).alias("on")).where("on").drop("on")


def toggled_bands(clicks: DataFrame, key: str, hz: str, rate: float) -> DataFrame:
    """key, lo and hi of the bands that were clicked an odd number of times. A click at a frequency means the band around it, a
    twentieth of the rate wide; bands whose rounded ends agree are one."""
    half = rate / 40
    bands = clicks.select(key, F.greatest(F.lit(0.0), F.col(hz) - half).alias("lo"), (F.col(hz) + half).alias("hi"))
    ends = [F.floor(F.col(c) + 0.5).alias(f"__{c}") for c in ("lo", "hi")]
    on = bands.groupBy(key, *ends).agg(F.min("lo").alias("lo"), F.min("hi").alias("hi"), (F.count("*") % 2 == 1).alias("__on"))
    return on.where("__on").select(key, "lo", "hi")


def muted_bins(bands: DataFrame, key: str, bins: int, step: float) -> DataFrame:
    """key, k and how many muted bands bin k, at k * step Hz, lies in (lo included, hi not)."""
    first, last = F.greatest(F.lit(0), F.ceil(F.col("lo") / step)), F.least(F.lit(bins - 1), F.ceil(F.col("hi") / step) - 1)
    rows = bands.where(first <= last).select(key, F.explode(F.sequence(first, last)).alias("k"))
    return rows.groupBy(key, "k").agg(F.count("*").alias("bands"))


def cached(df: DataFrame, key: str, size: str, most: float, n: int, *order: str) -> DataFrame:
    """The n newest entries of each cache, of those that aren't too large to be kept."""
    return newest(df.where(F.col(size) <= most), n, *order, key=key)


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    return wanted.join(there, key, "left_anti")


def undo_depth(df: DataFrame, key: str, n: int, *order: str) -> DataFrame:
    """Versions with valid_to, newest n of each key: what undo can go back to."""
    w = Window.partitionBy(key).orderBy(*order)
    return newest(df.withColumn("valid_to", F.lead(order[0]).over(w)), n, *order, key=key)


def event_summary(df: DataFrame, *, done: Column, failed: Column, duration: Column, at: str) -> DataFrame:
    """total, done, mean_duration (rounded, 0 if none), error_rate, last: one row, also of no rows."""
    return df.agg(F.count("*").alias("total"), F.count_if(done).alias("done"), F.coalesce(F.floor(F.avg(F.when(done, duration)) + 0.5), F.lit(0)).cast("bigint").alias("mean_duration"), F.when(F.count("*") > 0, F.count_if(failed) / F.count("*")).otherwise(0.0).alias("error_rate"), F.max(at).alias("last"))


def progress(df: DataFrame, state: str, share: str) -> DataFrame:
    """percent: finished jobs and the part done of others over all; 100 of no jobs."""
    done = F.count_if(F.col(state).isin("done", "error"))
    part = F.coalesce(F.sum(F.when(~F.col(state).isin("done", "error"), F.col(share))), F.lit(0.0))
    return df.agg(F.when(F.count("*") == 0, F.lit(100)).otherwise(F.floor(100 * (done + part / 100) / F.count("*") + 0.5)).cast("bigint").alias("percent"))


def grouped(df: DataFrame, group: str, *fields: str) -> DataFrame:
    """group and its members as an array of structs in order of the fields."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("members"))


def grouped_pages(df: DataFrame, group: str, *fields: str, size: int = 1000) -> DataFrame:
    """`grouped` for groups of any size: group, page, n and at most size members in order of the fields. Rows are numbered in order
    of group and fields, and a page is a run of size numbers, so a group that holds most rows is many pages in many tasks. A
    group's pages follow each other without gaps, from any number on; its first and last may hold fewer members. Nulls are a
    group like any other and come first, equal rows all stay, and no rows give no pages."""
    if size < 1:
        raise ValueError("size must be 1 or more")
    placed = numbered(df.select(F.col(group).alias("__group"), F.struct(*fields).alias("__member")), "__group", "__member", name="__place")
    pages = placed.groupBy("__group", F.floor((F.col("__place") - 1) / size).alias("page")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("__member")).alias("members"))
    return pages.withColumnRenamed("__group", group)


def carried_over(new: DataFrame, previous: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """New rows with fields of the previous state of their key, or a default."""
    old = previous.select(key, *fields)
    return new.join(old, key, "left").withColumns({f: F.coalesce(F.col(f), d) for f, d in fields.items()})


def within_bounds(df: DataFrame, bounds: DataFrame, key: str, value: str) -> DataFrame:
    """Rows of known keys, values clamped to the key's lo and hi, the default where there is none. Bounds are a dimension."""
    v = F.when(F.col(value).isNull(), F.col("default")).otherwise(F.greatest(F.least(F.col(value), F.col("hi")), F.col("lo")))
    return df.join(bounds.select(key, "lo", "hi", "default"), key).withColumn(value, v).drop("lo", "hi", "default")


def trailing(df: DataFrame, at: Column, span: float) -> DataFrame:
    """Rows of the last `span` seconds before the newest one."""
    top = df.agg(F.max(at).alias("t")).first().t
    return df.where(at > F.lit(top) - span) if top is not None else df


def usable(registry: DataFrame, stored: DataFrame, model: str, least: str, size: str, version: str, *order: str) -> DataFrame:
    """Of each registered model: its newest stored version of a size that can be right (null if there is none), how many there
    are, and whether it is ready."""
    good = stored.join(registry.select(model, F.col(least).alias("__least")), model).where(F.col(size) >= F.col("__least"))
    newest = good.groupBy(model).agg(F.max_by(version, F.struct(*order)).alias(version), F.count("*").alias("stored"))
    return registry.select(model).join(newest, model, "left").select(model, version, F.coalesce("stored", F.lit(0)).cast("bigint").alias("stored"), F.col(version).isNotNull().alias("ready"))


def remaining(log: DataFrame, key: str, id: str, act: str, *order: str) -> DataFrame:
    """key and id whose last act is `add`, after the key's last `clear`."""
    at = F.struct(*order)
    last = log.where(F.col(act) != "clear").groupBy(key, id).agg(F.max_by(act, at).alias("__act"), F.max(at).alias("__at"))
    cleared = log.where(F.col(act) == "clear").groupBy(key).agg(F.max(at).alias("__clear"))
    return last.where("__act = 'add'").join(cleared, key, "left").where("__clear IS NULL OR __at > __clear").select(key, id)
