"""Queries over settings, saved state, documents and tuning."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from undertone.functions import documents as D
from undertone.functions import recurrences as R
from undertone.functions import text as T
from undertone.operators import levels as L
from undertone.operators import matching as M
from undertone.operators import sequences as S
from undertone.operators import stores as O
from undertone.plans.registry import query
from undertone.plans.signals import _RANGE, _RANK, UNIT, _recursive, r, unit
from undertone.sources.tables import table


@query("carry_over_state", "WITH n AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY user_id), p AS (SELECT user_id, max(value) AS volume FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY user_id) SELECT user_id, n, coalesce(volume, 1.0) AS volume FROM n LEFT JOIN p USING (user_id)")
def carry_over_state(spark, d):
    cut, e = F.lit("2024-01-15").cast("timestamp_ntz"), table(spark, d, "events")
    new = e.where(F.col("ts") >= cut).groupBy("user_id").agg(F.count("*").alias("n"))
    old = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.max("value").alias("volume"))
    return O.carried_over(new, old, "user_id", {"volume": F.lit(1.0)}).select("user_id", "n", "volume")


@query("preset_bounds", "WITH b AS (SELECT * FROM (VALUES ('error', 20.0, 120.0, 50.0), ('signup', 0.0, 80.0, 10.0), ('purchase', 5.0, 400.0, 5.0)) t(event_type, lo, hi, d)) SELECT event_id, CASE WHEN event_id % 10 = 0 THEN d ELSE greatest(least(value, hi), lo) END::DOUBLE AS value FROM events JOIN b USING (event_type)")
def preset_bounds(spark, d):
    bounds = spark.createDataFrame([("error", 20.0, 120.0, 50.0), ("signup", 0.0, 80.0, 10.0), ("purchase", 5.0, 400.0, 5.0)], "event_type string, lo double, hi double, default double")
    rows = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 10 != 0, F.col("value")))
    return O.within_bounds(rows, bounds, "event_type", "value").select("event_id", "value")


@query("trailing_window", "SELECT event_id FROM events WHERE epoch(ts) > (SELECT max(epoch(ts)) FROM events) - 86400")
def trailing_window(spark, d):
    return O.trailing(table(spark, d, "events"), F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, 86400.0).select("event_id")


@query("saliency_ema", _recursive("0.0::DOUBLE AS y, x AS p", "0.7 * r.y + 0.9 * abs(s.x - r.p), s.x", "y, p", "round(y, 6) + 0.0 AS y"))
def saliency_ema(spark, d):
    change = unit(spark, d).withColumn("x", F.coalesce(F.abs(F.col("x") - F.lag("x").over(S.over())) * 3.0, F.lit(0.0)))
    return S.scan(change, lambda x: R.ema(x, 0.7), {"y": "double"}).select("signal_id", "idx", r("y", 6).alias("y"))


@query("cluster_trail", UNIT + " SELECT signal_id, idx, max(idx) OVER (PARTITION BY signal_id) - idx AS age FROM u QUALIFY row_number() OVER (PARTITION BY signal_id ORDER BY idx DESC) <= 20")
def cluster_trail(spark, d):
    age = F.max("idx").over(Window.partitionBy("signal_id")) - F.col("idx")
    return O.newest(unit(spark, d).withColumn("age", age), 20, "idx", key="signal_id").select("signal_id", "idx", "age")


@query("auto_tune", UNIT + _RANK + _RANGE + ", a AS (SELECT signal_id, sqrt(avg(x * x)) AS l, max(abs(x)) AS p, CASE WHEN count(*) % 2 = 0 THEN 'podcast' ELSE 'forensic' END AS s FROM u GROUP BY signal_id), b AS (SELECT *, 20 * log10(p / (l + 1e-10)) AS snr, 20 * log10(l + 1e-10) AS fl FROM a JOIN g USING (signal_id)) SELECT signal_id, round(CASE WHEN fl < -50 THEN greatest(-60.0, fl - 5) END, 4) AS gate_threshold, round(CASE WHEN snr < 15 THEN least(80.0, 30 + (15 - snr) * 2) WHEN snr > 30 THEN greatest(15.0, 30 - (snr - 30)) END, 4) AS noise_reduction, CASE s WHEN 'podcast' THEN 80 ELSE 50 END AS highpass_hz, CASE WHEN dynamic_range > 40 THEN 4 WHEN dynamic_range < 15 THEN 2 END AS ratio, CASE WHEN dynamic_range > 40 THEN -24 WHEN dynamic_range < 15 THEN -18 END AS threshold FROM b")
def auto_tune(spark, d):
    u = unit(spark, d)
    rows = u.groupBy("signal_id").agg(L.rms().alias("level"), F.max(F.abs("x")).alias("peak"), F.when(F.count("*") % 2 == 0, "podcast").otherwise("forensic").alias("scene")).join(L.dynamic_range(u), "signal_id")
    found = L.auto_tune("scene", "level", "peak", "dynamic_range")
    return rows.select("signal_id", *((r(c) if n in ("gate_threshold", "noise_reduction") else c).alias(n) for n, c in found.items()))


#: Every fourth document is wrapped in so many arrays that its values lie too deep.
_J = "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN repeat('[', 9) || j || repeat(']', 9) ELSE j END AS j FROM (SELECT event_id, '{\"a\":' || props || ',\"a\":[1]}' AS j FROM events)"


@query(
    "json_documents",
    f"""WITH j AS ({_J}), c AS (SELECT event_id, j, list_transform(range(1, length(j) + 1), lambda i: length(regexp_replace(j[1 : i], '[^\\[{{]', '', 'g')) - length(regexp_replace(j[1 : i], '[^\\]}}]', '', 'g'))) AS level FROM j),
k AS (SELECT event_id, j, list_max(level)::INT AS depth, regexp_extract_all(j, '\"([^\"]+)\":', 1) AS names FROM c)
SELECT event_id, depth, depth > 10 AS deep, CASE WHEN depth <= 10 THEN array_to_string(list_sort(list_distinct(list_filter(names, lambda x: len(list_filter(names, lambda y: y = x)) > 1))), ',') END AS repeated FROM k""",
)
def json_documents(spark, d):
    plain = F.concat(F.lit('{"a":'), F.col("props"), F.lit(',"a":[1]}'))
    j = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("[" * 9), plain, F.lit("]" * 9))).otherwise(plain)
    found = table(spark, d, "events").select("event_id", D.checked(j).alias("c"))
    return found.select("event_id", "c.depth", "c.deep", F.array_join("c.repeated", ",").alias("repeated"))


#: Saved sessions made of events: every fifth is cut off, every seventh has a number for its settings, every eleventh no meta.
_SAVED = "SELECT event_id, CASE WHEN event_id % 5 = 0 THEN left(j, length(j) - 1) ELSE j END AS j FROM (SELECT event_id, '{\"params\":' || CASE WHEN event_id % 7 = 0 THEN '3' ELSE '{\"gain\":' || event_id % 40 || ',\"mode\":' || user_id || '}' END || CASE WHEN event_id % 11 = 0 THEN '' ELSE ',\"meta\":{\"tab\":\"' || event_type || '\"}' END || ',\"savedAt\":' || event_id || '}' AS j FROM events)"


@query("saved_sessions", "SELECT event_id, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 THEN (event_id % 40)::DOUBLE END AS gain, CASE WHEN event_id % 5 > 0 AND event_id % 7 > 0 AND event_id % 11 > 0 THEN event_type END AS tab, event_id % 5 > 0 AND event_id % 7 > 0 AS loaded FROM events")
def saved_sessions(spark, d):
    table(spark, d, "events").createOrReplaceTempView("undertone_saved")
    rows = spark.sql(_SAVED.replace("FROM events", "FROM undertone_saved"))
    found = rows.select("event_id", T.saved_session("j").alias("s"))
    return found.select("event_id", F.col("s.params")["gain"].alias("gain"), F.col("s.meta")["tab"].alias("tab"), F.col("s").isNotNull().alias("loaded"))


@query("allow_listed", "SELECT event_id, CASE WHEN event_type IN ('error', 'signup') THEN event_type || '=' || event_id END AS kept FROM events")
def allow_listed(spark, d):
    m = T.allowed(F.create_map("event_type", F.concat_ws("=", "event_type", F.col("event_id").cast("string"))), ["error", "signup"])
    return table(spark, d, "events").select("event_id", F.get(F.map_values(m), F.lit(0)).alias("kept"))


@query("result_cache_key", "SELECT p_partkey, p_name || ':' || p_size || ':' || p_partkey || ':' || '{\"brand\":\"' || p_brand || '\",\"kind\":\"' || p_type || '\"}' AS key FROM part")
def result_cache_key(spark, d):
    params = F.create_map(F.lit("kind"), "p_type", F.lit("brand"), "p_brand")
    return table(spark, d, "part").select("p_partkey", T.cache_key("p_name", "p_size", "p_partkey", params).alias("key"))


@query("speaker_registry")
def speaker_registry(spark, d):
    rows = table(spark, d, "embeddings").select("vec_id", F.lit(1).alias("k"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    return M.enrolled(rows, key="label", order="vec_id", vector="v", least=0.65).select("label", "cluster", "n")
