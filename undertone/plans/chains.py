"""Queries that chain several operators, trailing features, exports and hit tests."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from undertone.functions import recurrences as R
from undertone.functions import text as T
from undertone.operators import chains as C
from undertone.operators import levels as L
from undertone.operators import segments as G
from undertone.operators import sequences as S
from undertone.plans.registry import query
from undertone.plans.relational import _RUNS, _turns
from undertone.plans.signals import CUT, SR, UNIT, _cascade_sql, _compress_sql, _recursive, r, unit
from undertone.sources import files
from undertone.sources.tables import table
from undertone.sources.work import work_folder

#: An approach with a constant of 20 ms, for settings that change while a signal runs.
_KEEP = math.exp(-1 / (0.02 * SR))


_BANDS = [("lowshelf", 40, 2.0, 0.7071), ("peaking", 100, -3.0, 1.2), ("peaking", 200, 1.5, 1.0), ("highshelf", 400, -2.0, 0.7071)]
_STRIP = [R.biquad_design("highpass", 20.0, 0.7071, 0.0, SR), R.biquad_design("lowpass", 450.0, 0.7071, 0.0, SR), *(R.biquad_design(kind, hz, q, level, SR) for kind, hz, level, q in _BANDS)]


@query("channel_strip", UNIT + _cascade_sql(_STRIP) + _compress_sql("pressed", "filtered", -18.0, 3.0, 6.0, 0.9, 0.99, 2.0) + _compress_sql("limited", "pressed", -1.0, 20.0, 0.0, 0.5, 0.99, 0.0) + f" SELECT signal_id, idx, round(x * {10 ** (-0.5 / 20)!r}::DOUBLE, 6) + 0.0 AS y FROM limited")
def channel_strip(spark, d):
    out = C.channel_strip(unit(spark, d), SR, high=20.0, low=450.0, bands=_BANDS, chunk=CUT, threshold=-18.0, ratio=3.0, knee=6.0, makeup=2.0, ceiling=-1.0, gain=-0.5)
    return out.select("signal_id", "idx", r("y", 6).alias("y"))


_LIVE = [R.biquad_design(kind, hz, q, level, 4000) for kind, hz, q, level in (("highpass", 80.0, 0.7071, 0.0), ("lowpass", 1900.0, 0.7071, 0.0), ("lowshelf", 40, 0.7071, 2.0), ("peaking", 800, 1.0, -3.0), ("peaking", 1500.0, 3.0, -4.0), ("highshelf", 1000.0, 0.7071, 1.5), ("highpass", 120.0, 0.5, 0.0), ("lowpass", 1700.0, 0.5, 0.0))]
_KEEPS = [math.exp(-1 / (s * 4000)) for s in (0.003, 0.05, 0.001, 0.02)]


@query("live_strip", UNIT + _cascade_sql(_LIVE) + _compress_sql("pressed", "filtered", -24.0, 3.0, 6.0, _KEEPS[0], _KEEPS[1], 4.0) + _compress_sql("limited", "pressed", -1.0, 20.0, 0.0, _KEEPS[2], _KEEPS[3], 0.0) + f" SELECT signal_id, idx, round(x * {10 ** (-2.0 / 20) * 0.8!r}::DOUBLE, 6) + 0.0 AS y FROM limited")
def live_strip(spark, d):
    bands = [("lowshelf", 40, 2.0, 0.7071), ("peaking", 800, -3.0, 1.0), ("peaking", 1500, 0.0, 1.2), ("highshelf", 10000, 2.0, 0.7071)]
    out = C.live_strip(unit(spark, d), 4000, high=80.0, low=1900.0, bands=bands, ess=(1500.0, 40.0), tilt=1.5, voice=(120.0, 1700.0), threshold=-24.0, ratio=3.0, knee=6.0, attack=0.003, release=0.05, makeup=4.0, ceiling=-1.0, limit_release=0.02, gain=-2.0, width=80.0, chunk=CUT)
    return out.select("signal_id", "idx", r("y", 6).alias("y"))


@query("noise_reduction")
def noise_reduction(spark, d):
    out = C.reduce_noise(unit(spark, d), 16, 4, 3, voiced=F.col("f") % 2 == 0)
    return out.select("signal_id", "idx", r("x", 6).alias("x"))


@query("trailing_features", UNIT + ", f AS (SELECT *, CASE WHEN (x >= 0) <> lag(x >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip FROM u), t AS (SELECT signal_id, idx, sqrt(avg(x * x) OVER (PARTITION BY signal_id ORDER BY idx ROWS 15 PRECEDING)) AS rms, sum(flip) OVER (PARTITION BY signal_id ORDER BY idx ROWS 14 PRECEDING) / 16 AS zcr FROM f) SELECT signal_id, idx, round(rms, 6) AS rms, round(zcr, 6) AS zcr, round(CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -100 END, 4) AS level FROM t WHERE idx >= 15")
def trailing_features(spark, d):
    return L.trailing_features(unit(spark, d), 16).select("signal_id", "idx", r("rms", 6).alias("rms"), r("zcr", 6).alias("zcr"), r("level").alias("level"))


@query("parameter_smoothing", _recursive("x AS y", f"{_KEEP!r} * r.y + {1 - _KEEP!r} * s.x", "y", "round(y, 6) + 0.0 AS y"))
def parameter_smoothing(spark, d):
    return S.ema(unit(spark, d), _KEEP, chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


@query("segment_at", _RUNS + " SELECT conv_id, min_by(label, a) AS label FROM n WHERE a * 0.5 <= 1.2 AND coalesce(nx, b + 1) * 0.5 >= 1.2 GROUP BY conv_id")
def segment_at(spark, d):
    return G.hit(_turns(spark, d), 1.2, "label", key="conv_id")


@query("safe_redirect", "WITH c AS (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN regexp_replace(url, '^https?://[^/]+', '') WHEN page_id % 3 = 1 THEN 'http://example.org/' || page_id ELSE url END AS u FROM pages) SELECT page_id, CASE WHEN u LIKE '/%' AND u NOT LIKE '//%' THEN 'http://example.org' || u WHEN lower(regexp_extract(u, '^[a-zA-Z]+://[^/?#]+')) = 'http://example.org' THEN u END AS target FROM c")
def safe_redirect(spark, d):
    m = F.col("page_id") % 3
    u = F.when(m == 0, F.regexp_replace("url", "^https?://[^/]+", "")).when(m == 1, F.concat(F.lit("http://example.org/"), F.col("page_id").cast("string"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", T.safe_redirect(u, "http://example.org").alias("target"))


@query("json_export", "SELECT event_id, event_type, value FROM events")
def json_export(spark, d):
    rows, folder = table(spark, d, "events").select("event_id", "event_type", "value"), work_folder(spark)
    files.export_json(rows, folder, "event_type")
    return files.import_json(spark, folder, rows.schema).select(rows.columns)
