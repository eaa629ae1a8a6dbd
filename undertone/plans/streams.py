"""Queries run as streams over all that is there, and through the SQL surface."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from undertone.functions import sql as SQLF
from undertone.plans.registry import query
from undertone.plans.relational import _WALK
from undertone.plans.signals import UNIT, r
from undertone.sources.tables import table
from undertone.streaming import ordered as O
from undertone.streaming import streams as S


def _events(spark, d):
    rows = S.read_stream(spark, d, "events.parquet", table(spark, d, "events").schema)
    return rows.withColumns({"ts": F.col("ts").cast("timestamp"), "x": (F.col("value") - 100) / 397.3})


def _third(later) -> Column:
    """The file of three that a row comes in: by day of the month, some files later."""
    return F.least(F.floor((F.dayofmonth("ts") - 1) / 10) + later, F.lit(2))


def _late(spark, d):
    """The events in three micro-batches; every seventh comes one later than its time says."""
    rows = table(spark, d, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), ((F.col("value") - 100) / 397.3).alias("x"))
    return O.replayed(rows, 3, _third((F.col("event_id") % 7 == 0).cast("int")))


def _ordered(stream, step):
    return O.run_to_end(stream, lambda s: O.in_order(s, step, key="user_id", at="ts", tie="event_id", late="21 days"), at="ts")


@query("stream_ema", UNIT.replace("SELECT signal_id, idx,", "SELECT signal_id, event_id, idx,") + ", r AS (SELECT signal_id, event_id, idx, x AS y FROM u WHERE idx = 0 UNION ALL SELECT u.signal_id, u.event_id, u.idx, 0.7 * r.y + 0.3 * u.x FROM r JOIN u ON u.signal_id = r.signal_id AND u.idx = r.idx + 1) SELECT signal_id AS user_id, event_id, round(y, 6) + 0.0 AS y FROM r")
def stream_ema(spark, d):
    return S.drained(S.ema(_events(spark, d), 0.7, key="user_id", order=["ts", "event_id"], x="x")).select("user_id", "event_id", r("y", 6).alias("y"))


@query("stream_hop_frames", UNIT + ", n AS (SELECT signal_id, count(*) AS n FROM u GROUP BY signal_id HAVING count(*) >= 16), f AS (SELECT signal_id, unnest(range(0, (n - 16) // 8 + 1)) AS f FROM n) SELECT u.signal_id AS user_id, f, round(sqrt(avg(x * x)), 6) AS rms FROM f JOIN u ON u.signal_id = f.signal_id AND idx BETWEEN f * 8 AND f * 8 + 15 WHERE f % 4 = 0 GROUP BY ALL")
def stream_hop_frames(spark, d):
    frames = S.hop_frames(_events(spark, d), 16, 8, key="user_id", order=["ts", "event_id"], x="x")
    return S.drained(S.throttled(frames, 4)).select("user_id", "f", r("rms", 6).alias("rms"))


@query("stream_latest_side", "SELECT user_id, event_id, last_value(CASE WHEN event_type = 'error' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS side FROM events")
def stream_latest_side(spark, d):
    rows = _events(spark, d).withColumn("mask", F.when(F.col("event_type") == "error", F.col("value")))
    return S.drained(S.latest_side(rows, key="user_id", order=["ts", "event_id"], x="x", side="mask")).select("user_id", "event_id", "side")


def _halved(frame):
    """Frames of little power lose half."""
    return frame * (0.5 if (frame * frame).mean() < 0.03 else 1.0)


_W16 = "(0.5 - 0.5 * cos(2 * pi() * (idx - f * 8) / 16))"


@query(
    "stream_overlap_add",
    UNIT
    + f""", n AS (SELECT signal_id, (count(*) - 16) // 8 + 1 AS n FROM u GROUP BY signal_id HAVING count(*) >= 16), f AS (SELECT signal_id, unnest(range(0, n)) AS f FROM n),
w AS (SELECT u.signal_id, f, idx, x * {_W16} AS v, {_W16} AS w FROM f JOIN u ON u.signal_id = f.signal_id AND idx BETWEEN f * 8 AND f * 8 + 15),
g AS (SELECT signal_id, f, CASE WHEN avg(v * v) < 0.03 THEN 0.5 ELSE 1.0 END AS g FROM w GROUP BY ALL)
SELECT w.signal_id AS user_id, idx, round(CASE WHEN sum(w * w) > 1e-8 THEN sum(g * v * w) / sum(w * w) ELSE 0.0 END, 6) + 0.0 AS y FROM w JOIN g USING (signal_id, f) JOIN n ON n.signal_id = w.signal_id GROUP BY ALL""",
)
def stream_overlap_add(spark, d):
    return _ordered(_late(spark, d), O.OverlapAdd(16, 8, _halved)).select("user_id", "idx", r("y", 6).alias("y"))


_BY_TIME = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("stream_frames_and_masks", f"SELECT user_id, event_id, value AS x, last_value(CASE WHEN event_type = 'error' THEN value * 2 END IGNORE NULLS) {_BY_TIME}) AS side FROM events")
def stream_frames_and_masks(spark, d):
    """Two streams: all events, and masks made of some of them, which come a file later."""
    rows, none = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), F.lit(None).cast("double")
    frames = O.replayed(rows.select("user_id", "event_id", "ts", F.col("value").alias("x"), none.alias("side")), 3, _third(0))
    masks = O.replayed(rows.where("event_type = 'error'").select("user_id", "event_id", "ts", none.alias("x"), (F.col("value") * 2).alias("side")), 3, _third(1))
    return _ordered(frames.unionByName(masks), O.NewestSide()).select("user_id", F.col("tie").alias("event_id"), "x", "side")


@query("stream_trailing", UNIT.replace("SELECT signal_id, idx,", "SELECT signal_id, event_id, idx,") + ", f AS (SELECT *, CASE WHEN (x >= 0) <> lag(x >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip FROM u), t AS (SELECT signal_id, event_id, idx, sqrt(avg(x * x) OVER (PARTITION BY signal_id ORDER BY idx ROWS 15 PRECEDING)) AS rms, sum(flip) OVER (PARTITION BY signal_id ORDER BY idx ROWS 14 PRECEDING) / 16 AS zcr FROM f) SELECT signal_id AS user_id, event_id, round(rms, 6) AS rms, round(zcr, 6) AS zcr, round(CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -100 END, 4) AS level FROM t WHERE idx >= 15")
def stream_trailing(spark, d):
    rows = _ordered(_late(spark, d), O.Trailing(16))
    return rows.select("user_id", F.col("tie").alias("event_id"), r("rms", 6).alias("rms"), r("zcr", 6).alias("zcr"), r("level").alias("level"))


@query("stream_dedup_ttl", _WALK + "r AS (SELECT user_id, event_id, i, s AS start, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - r.start >= 86400 THEN e.s ELSE r.start END, e.s - r.start >= 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id FROM r WHERE kept")
def stream_dedup_ttl(spark, d):
    return _ordered(_late(spark, d), O.FirstSights(86_400_000_000)).select("user_id", F.col("tie").alias("event_id"))


@query("stream_rate_limit", _WALK + "r AS (SELECT user_id, event_id, i, s AS start, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - r.start >= 172800 THEN e.s ELSE r.start END, CASE WHEN e.s - r.start >= 172800 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, n <= 3 AS allowed FROM r")
def stream_rate_limit(spark, d):
    return _ordered(_late(spark, d), O.FixedWindows(172_800_000_000, 3)).select("user_id", F.col("tie").alias("event_id"), "allowed")


@query("stream_windows", "SELECT epoch(date_trunc('day', ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_windows(spark, d):
    rows = S.drained_complete(S.windowed(_events(spark, d), "ts", "1 hour", "1 day", None, "event_type"))
    return rows.select(F.unix_seconds("start").alias("start"), "event_type", "n", r("total", 2).alias("total"))


@query("stream_session", "WITH e AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM events), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e) SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n, round(sum(value), 2) AS total FROM s GROUP BY user_id, g")
def stream_session(spark, d):
    rows = S.drained_complete(S.sessions(_events(spark, d), "ts", "1 hour", "6 hours", "user_id"))
    return rows.select("user_id", F.unix_micros("start").alias("start"), "n", r("total", 2).alias("total"))


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup(spark, d):
    return S.drained(S.first_sights(_events(spark, d), "ts", "3650 days", "user_id", "event_type").select("user_id", "event_type"))


@query("stream_parameters", "SELECT event_id, c_mktsegment AS tier FROM events LEFT JOIN customer ON c_custkey = user_id")
def stream_parameters(spark, d):
    tiers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("tier"))
    return S.drained(S.with_parameters(_events(spark, d), tiers, "user_id").select("event_id", "tier"))


@query("sql_frames_of", "WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), f AS (SELECT range AS f FROM range(0, 7)) SELECT vec_id, f, round(sum(v), 5) + 0.0 AS total FROM e JOIN f ON i BETWEEN f * 8 AND f * 8 + 15 GROUP BY ALL")
def sql_frames_of(spark, d):
    SQLF.register(spark)
    table(spark, d, "embeddings").createOrReplaceTempView("undertone_embeddings")
    return spark.sql("SELECT vec_id, f, round(aggregate(frame, 0.0D, (a, v) -> a + v), 5) AS total FROM undertone_embeddings, LATERAL frames_of(embedding, 16, 8)")


@query("sql_scalars", "SELECT p_partkey, round(20 * log10(p_retailprice), 6) AS level, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g') AS name FROM part")
def sql_scalars(spark, d):
    SQLF.register(spark)
    table(spark, d, "part").createOrReplaceTempView("undertone_part")
    return spark.sql("SELECT p_partkey, round(db(p_retailprice), 6) AS level, round(hz_to_mel(p_retailprice), 6) AS mel, slug(p_name) AS name FROM undertone_part")
