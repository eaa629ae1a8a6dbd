"""Queries over stores, segments, similarity and scalars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from undertone.functions import pointwise as P
from undertone.functions import text as T
from undertone.operators import matching as M
from undertone.operators import segments as G
from undertone.operators import sequences as S
from undertone.operators import stores as O
from undertone.plans.registry import query
from undertone.plans.signals import SIG, UNIT, r, unit
from undertone.sources import bundles
from undertone.sources.tables import signals, table
from undertone.sources.wav import media_kind, to_wav
from undertone.sources.work import work_folder


def events(spark, d):
    return table(spark, d, "events")


def seconds(c="ts"):
    return F.unix_micros(F.col(c).cast("timestamp")) / 1e6


_SUM = "count(*) AS total, count_if(event_type = 'purchase') AS done, coalesce(floor(avg(value) FILTER (event_type = 'purchase') + 0.5), 0)::BIGINT AS mean_duration, round(count_if(event_type = 'error') / count(*), 6) AS error_rate, max(ts) AS last"


@query("event_summary", f"SELECT {_SUM} FROM events")
def event_summary(spark, d):
    e = F.col("event_type")
    return O.event_summary(events(spark, d), done=e == "purchase", failed=e == "error", duration=F.col("value"), at="ts").withColumn("error_rate", r("error_rate", 6))


@query("event_summary_by_type", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, max(ts) AS last FROM events GROUP BY event_type")
def event_summary_by_type(spark, d):
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), r(F.avg("value")).alias("mean"), F.max("ts").alias("last"))


@query("usage_totals", "SELECT user_id, count(*) AS total, count_if(ts >= TIMESTAMP '2024-01-15') AS recent, round(sum(value), 2) AS minutes FROM events GROUP BY user_id")
def usage_totals(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= F.lit("2024-01-15").cast("timestamp_ntz")).alias("recent"), r(F.sum("value"), 2).alias("minutes"))


@query("storage_bytes", "SELECT user_id, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY user_id")
def storage_bytes(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.sum(F.octet_length("props")).alias("bytes"))


@query("job_state_counts", "SELECT o_orderstatus AS state, count(*) AS n FROM orders GROUP BY o_orderstatus")
def job_state_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"))


@query("batch_progress", "SELECT floor(100 * (count_if(o_orderstatus = 'F') + coalesce(sum(o_orderkey % 100) FILTER (o_orderstatus <> 'F'), 0) / 100) / count(*) + 0.5)::BIGINT AS percent FROM orders")
def batch_progress(spark, d):
    jobs = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "done").otherwise("running").alias("state"), (F.col("o_orderkey") % 100).cast("double").alias("share"))
    return O.progress(jobs, "state", "share")


@query("newest_n_events", "SELECT event_id, user_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 500")
def newest_n_events(spark, d):
    return O.newest(events(spark, d).select("event_id", "user_id", "ts"), 500, "ts", "event_id")


@query("history_tail", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def history_tail(spark, d):
    return O.newest(events(spark, d), 20, "ts", "event_id", key="user_id").select("user_id", "event_id")


@query("undo_stack", "SELECT user_id, event_id, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS valid_to FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 50")
def undo_stack(spark, d):
    return O.undo_depth(events(spark, d), "user_id", 50, "ts", "event_id").select("user_id", "event_id", "valid_to")


@query("upsert_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return O.latest(events(spark, d).select("user_id", "ts", "event_id", "value"), "user_id", "ts", "event_id").select("user_id", "event_id", "value")


@query("upsert_with_delete", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id HAVING arg_max(event_type, (ts, event_id)) <> 'error'")
def upsert_with_delete(spark, d):
    return O.latest_or_gone(events(spark, d), "user_id", F.col("event_type") == "error", "ts", "event_id").select("user_id", "event_id")


@query("merge_fields", "WITH e AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'purchase' THEN value END AS spent, CASE WHEN event_type = 'error' THEN event_id END AS failed FROM events) SELECT user_id, arg_max(spent, (ts, event_id)) FILTER (spent IS NOT NULL) AS spent, arg_max(failed, (ts, event_id)) FILTER (failed IS NOT NULL) AS failed FROM e GROUP BY user_id")
def merge_fields(spark, d):
    e = events(spark, d).withColumns({"spent": F.when(F.col("event_type") == "purchase", F.col("value")), "failed": F.when(F.col("event_type") == "error", F.col("event_id"))})
    return O.merged(e, "user_id", ["spent", "failed"], "ts", "event_id")


_WALK = "WITH RECURSIVE e AS (SELECT user_id, event_id, epoch(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events), "


@query("dedup_ttl_24h", _WALK + "r AS (SELECT user_id, event_id, i, s AS start, true AS kept FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - r.start >= 86400 THEN e.s ELSE r.start END, e.s - r.start >= 86400 FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id FROM r WHERE kept")
def dedup_ttl_24h(spark, d):
    return O.dedup_ttl(events(spark, d).select("user_id", "event_id", seconds().alias("s")), "user_id", "s", 86400.0, "event_id").select("user_id", "event_id")


@query("rate_limit_fixed", _WALK + "r AS (SELECT user_id, event_id, i, s AS start, 1 AS n FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.event_id, e.i, CASE WHEN e.s - r.start >= 172800 THEN e.s ELSE r.start END, CASE WHEN e.s - r.start >= 172800 THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.i = r.i + 1) SELECT user_id, event_id, n <= 3 AS allowed FROM r")
def rate_limit_fixed(spark, d):
    return O.rate_limited(events(spark, d).select("user_id", "event_id", seconds().alias("s")), "user_id", "s", 172800.0, 3, "event_id").select("user_id", "event_id", "allowed")


@query("quota_violations", "SELECT user_id, sum(octet_length(encode(props)))::BIGINT AS bytes FROM events GROUP BY user_id HAVING sum(octet_length(encode(props))) > 600")
def quota_violations(spark, d):
    return O.over_quota(events(spark, d), "user_id", F.octet_length("props"), 600)


@query("tier_caps", "WITH t AS (SELECT * FROM (VALUES ('BUILDING', 40), ('MACHINERY', 60), ('FURNITURE', NULL)) t(tier, \"limit\")), u AS (SELECT user_id, count(*) AS used FROM events GROUP BY user_id) SELECT c.c_custkey, c.c_mktsegment AS tier, used, t.\"limit\" IS NULL OR used <= t.\"limit\" AS ok FROM customer c JOIN u ON u.user_id = c.c_custkey LEFT JOIN t ON t.tier = c.c_mktsegment")
def tier_caps(spark, d):
    tiers = spark.createDataFrame([("BUILDING", 40), ("MACHINERY", 60), ("FURNITURE", None)], "tier string, limit bigint")
    used = events(spark, d).groupBy("user_id").agg(F.count("*").alias("used"))
    rows = table(spark, d, "customer").join(used, F.col("user_id") == F.col("c_custkey")).select("c_custkey", F.col("c_mktsegment").alias("tier"), "used")
    return O.tier_checks(rows, tiers, "tier", "used").select("c_custkey", "tier", "used", "ok")


@query("highest_entitlement", "SELECT o_custkey, arg_max(o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END) AS o_orderpriority FROM orders GROUP BY o_custkey")
def highest_entitlement(spark, d):
    rank = {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1}
    return O.highest(table(spark, d, "orders"), "o_custkey", rank, "o_orderpriority")


@query("muted_toggles", "SELECT user_id, event_type FROM events GROUP BY ALL HAVING count(*) % 2 = 1")
def muted_toggles(spark, d):
    return O.toggled(events(spark, d), "user_id", "event_type")


@query("missing_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def missing_keys(spark, d):
    return O.missing(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("known_params_only", "SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def known_params_only(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return events(spark, d).join(known, "user_id", "left_semi").select("event_id")


@query("cache_inventory", "SELECT l_returnflag AS cache, count(*) AS entries, round(sum(l_extendedprice) / 1048576, 4) AS total_mb FROM lineitem GROUP BY l_returnflag")
def cache_inventory(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_returnflag").alias("cache")).agg(F.count("*").alias("entries"), r(F.sum("l_extendedprice") / 1048576).alias("total_mb"))


@query("result_cache", "SELECT user_id, event_id FROM events WHERE value <= 120 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 5")
def result_cache(spark, d):
    """The five newest entries of each cache that aren't too large (sizes are values here)."""
    return O.cached(events(spark, d), "user_id", "value", 120.0, 5, "ts", "event_id").select("user_id", "event_id")


@query("muted_bands", "WITH k AS (SELECT l_suppkey AS id, greatest(0.0, l_extendedprice % 8000 - 400) AS lo, l_extendedprice % 8000 + 400 AS hi FROM lineitem WHERE l_linenumber = 1), b AS (SELECT id, floor(lo + 0.5)::BIGINT || '-' || floor(hi + 0.5)::BIGINT AS key, min(lo) AS lo, min(hi) AS hi FROM k GROUP BY ALL HAVING count(*) % 2 = 1), f AS (SELECT range AS k, range * 250.0 AS hz FROM range(33)) SELECT id, k, count(*) AS bands FROM b JOIN f ON hz >= lo AND hz < hi GROUP BY ALL")
def muted_bands(spark, d):
    """Which of 33 bins (250 Hz each) are in a band that is muted after clicks at frequencies (prices modulo 8 kHz)."""
    clicks = table(spark, d, "lineitem").where("l_linenumber = 1").select(F.col("l_suppkey").alias("id"), (F.col("l_extendedprice") % 8000).alias("hz"))
    return O.muted_bins(O.toggled_bands(clicks, "id", "hz", 16_000.0), "id", 33, 250.0)


@query("grouped_params", "SELECT c_nationkey, len(list(c_custkey)) AS n, array_to_string(list(c_name ORDER BY c_name), ',') AS members FROM customer GROUP BY c_nationkey")
def grouped_params(spark, d):
    rows = O.grouped(table(spark, d, "customer"), "c_nationkey", "c_name")
    return rows.select("c_nationkey", F.size("members").cast("bigint").alias("n"), F.array_join(F.transform("members", lambda s: s["c_name"]), ",").alias("members"))


@query("grouped_pages", "WITH p AS (SELECT *, (row_number() OVER (ORDER BY l_returnflag, l_orderkey, l_linenumber) - 1) // 500 AS page FROM lineitem) SELECT l_returnflag, page, count(*) AS n, string_agg(l_orderkey || '-' || l_linenumber, ',' ORDER BY l_orderkey, l_linenumber) AS members FROM p GROUP BY ALL")
def grouped_pages(spark, d):
    """Order lines of three groups, in pages of 500."""
    rows = O.grouped_pages(table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", "l_linenumber", size=500)
    return rows.withColumn("members", F.array_join(F.transform("members", lambda s: F.concat_ws("-", s["l_orderkey"], s["l_linenumber"])), ","))


@query("priority_queue", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderpriority, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def priority_queue(spark, d):
    pending = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_orderpriority", "o_orderkey")
    return S.numbered(pending, "o_orderpriority", "o_orderkey").select("o_orderkey", "place")


@query("savings_percent", "SELECT p_partkey, least(100, floor(100 * (1 - p_retailprice / (p_retailprice * 1.2 + p_size)) + 0.5))::BIGINT AS saving FROM part")
def savings_percent(spark, d):
    c = F.col("p_retailprice")
    return table(spark, d, "part").select("p_partkey", F.least(F.lit(100), P.half_up(100 * (1 - c / (c * 1.2 + F.col("p_size"))))).cast("bigint").alias("saving"))


_RUNS = """WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS g FROM conversations),
s AS (SELECT conv_id, role AS label, min(turn) AS a, max(turn) AS b FROM c GROUP BY conv_id, role, g),
n AS (SELECT *, lead(a) OVER (PARTITION BY conv_id ORDER BY a) AS nx FROM s)"""


def _turns(spark, d):
    return G.label_runs(table(spark, d, "conversations").select("conv_id", "turn", "role"), "role", key="conv_id", order="turn", seconds=0.5)


@query("speaker_turns", _RUNS + ' SELECT conv_id, label, round(a * 0.5, 3) AS start, round(coalesce(nx, b + 1) * 0.5, 3) AS "end", CASE WHEN nx IS NULL THEN 0.72 ELSE 0.68 END AS confidence FROM n')
def speaker_turns(spark, d):
    return _turns(spark, d).select("conv_id", "label", r("start", 3).alias("start"), r("end", 3).alias("end"), "confidence")


@query("speaker_stats", _RUNS + " SELECT conv_id, count(DISTINCT label) AS speakers, round(avg(CASE WHEN nx IS NULL THEN 0.72 ELSE 0.68 END), 5) AS confidence, round(max(coalesce(nx, b + 1) * 0.5), 3) AS duration FROM n GROUP BY conv_id")
def speaker_stats(spark, d):
    conf = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(1.0))
    return _turns(spark, d).groupBy("conv_id").agg(F.count_distinct("label").alias("speakers"), r(F.avg(conf), 5).alias("confidence"), r(F.max("end"), 3).alias("duration"))


@query("segments_rle", SIG + ", c AS (SELECT signal_id, idx, CASE WHEN x > 150 THEN 'hi' WHEN x > 50 THEN 'lo' END AS l FROM sig), d AS (SELECT *, CASE WHEN idx > 0 AND l IS NOT DISTINCT FROM lag(l) OVER (PARTITION BY signal_id ORDER BY idx) THEN 0 ELSE 1 END AS n FROM c), g AS (SELECT *, sum(n) OVER (PARTITION BY signal_id ORDER BY idx) AS run FROM d), s AS (SELECT signal_id, run, any_value(l) AS label, min(idx) AS a, max(idx) AS b FROM g GROUP BY ALL), x AS (SELECT *, lead(a) OVER (PARTITION BY signal_id ORDER BY run) AS nx FROM s) SELECT signal_id, label, round(a * 0.1, 3) AS start, round(coalesce(nx, b + 1) * 0.1, 3) AS \"end\" FROM x WHERE label IS NOT NULL AND coalesce(nx, b + 1) - a >= 3")
def segments_rle(spark, d):
    rows = signals(spark, d).withColumn("l", F.when(F.col("x") > 150, "hi").when(F.col("x") > 50, "lo"))
    return G.label_runs(rows, "l", key="signal_id", order="idx", seconds=0.1, least=0.3).select("signal_id", "label", r("start", 3).alias("start"), r("end", 3).alias("end"))


@query("visible_window", _RUNS + ' SELECT conv_id, label, round(greatest(a * 0.5, 0.7), 3) AS start, round(least(coalesce(nx, b + 1) * 0.5, 1.8), 3) AS "end" FROM n WHERE coalesce(nx, b + 1) * 0.5 > 0.7 AND a * 0.5 < 1.8')
def visible_window(spark, d):
    return G.clipped(_turns(spark, d), 0.7, 1.8).select("conv_id", "label", r("start", 3).alias("start"), r("end", 3).alias("end"))


@query("lane_palette", "WITH f AS (SELECT event_type, min((ts, event_id)) AS o FROM events GROUP BY event_type) SELECT event_type, row_number() OVER (ORDER BY o, event_type) AS place, (row_number() OVER (ORDER BY o, event_type) - 1) % 8 AS slot FROM f")
def lane_palette(spark, d):
    return G.first_seen(events(spark, d), "event_type", "ts", "event_id").withColumn("slot", T.palette_slot(F.col("place")))


@query("speaker_volume", "WITH v AS (SELECT * FROM (VALUES ('user', 0.5), ('assistant', 0.0)) t(role, volume)) SELECT conv_id, turn, coalesce(volume, 1.0)::DOUBLE AS volume FROM conversations LEFT JOIN v USING (role)")
def speaker_volume(spark, d):
    volumes = spark.createDataFrame([("user", 0.5), ("assistant", 0.0)], "role string, volume double")
    return G.with_volume(table(spark, d, "conversations").select("conv_id", "turn", "role"), volumes, "role").select("conv_id", "turn", "volume")


@query("minmax_scaling", UNIT + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS v FROM u GROUP BY ALL), q AS (SELECT *, min(v) OVER w AS lo, max(v) OVER w AS hi FROM p WINDOW w AS (PARTITION BY signal_id)) SELECT signal_id, b, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0.0 END, 5) AS y FROM q")
def minmax_scaling(spark, d):
    from undertone.operators.levels import rms

    part = S.blocks(unit(spark, d), 8).groupBy("signal_id", "b").agg(rms().alias("v"))
    return part.select("signal_id", "b", r(G.scale_to_range("v", key="signal_id"), 5).alias("y"))


def _embeddings(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))


_CEN = "WITH e AS (SELECT vec_id, label::BIGINT AS label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM e GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id), cn AS (SELECT label, sqrt(sum(v * v)) AS n FROM c GROUP BY label), s AS (SELECT e.vec_id, c.label, round(sum(e.v * c.v) / any_value(n.n) / any_value(cn.n), 12) AS score FROM e JOIN c USING (i) JOIN n ON n.vec_id = e.vec_id JOIN cn ON cn.label = c.label GROUP BY e.vec_id, c.label), b AS (SELECT vec_id, arg_min(label, (-score, label)) AS name, max(score) AS score FROM s GROUP BY vec_id)"


@query("speaker_identify", _CEN + " SELECT vec_id AS id, CASE WHEN score >= 0.65 THEN name END AS name, round(score, 6) AS score FROM b")
def speaker_identify(spark, d):
    e = _embeddings(spark, d)
    profiles = M.centroids(e, "label", "v")
    return M.best_match(e, profiles, id="vec_id", name="label", least=0.65).withColumn("score", r("score", 6))


@query("noise_profile_match", "WITH e AS (SELECT vec_id, label::BIGINT AS label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, i, avg(v) AS v FROM e GROUP BY ALL), ez AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM e), cz AS (SELECT label, i, v - avg(v) OVER (PARTITION BY label) AS v FROM c), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM ez GROUP BY vec_id), cn AS (SELECT label, sqrt(sum(v * v)) AS n FROM cz GROUP BY label), s AS (SELECT ez.vec_id, cz.label, round(sum(ez.v * cz.v) / any_value(n.n) / any_value(cn.n), 12) AS score FROM ez JOIN cz USING (i) JOIN n ON n.vec_id = ez.vec_id JOIN cn ON cn.label = cz.label GROUP BY ez.vec_id, cz.label) SELECT vec_id AS id, arg_min(label, (-score, label)) AS name, round(max(score), 6) AS score FROM s GROUP BY vec_id")
def noise_profile_match(spark, d):
    e = _embeddings(spark, d)
    return M.best_match(e, M.centroids(e, "label", "v"), id="vec_id", name="label", centred=True).withColumn("score", r("score", 6))


@query("nearest_profile", "WITH e AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), q AS (SELECT vec_id AS id, 63 - i AS i, v FROM e), n AS (SELECT vec_id, sqrt(sum(v * v)) AS n FROM e GROUP BY vec_id), s AS (SELECT q.id, e.vec_id, round(sum(q.v * e.v) / any_value(a.n) / any_value(b.n), 12) AS score FROM q JOIN e USING (i) JOIN n a ON a.vec_id = q.id JOIN n b ON b.vec_id = e.vec_id GROUP BY ALL) SELECT id, arg_min(vec_id, (-score, vec_id)) AS name, round(max(score), 6) AS score FROM s GROUP BY id")
def nearest_profile(spark, d):
    """Of all embeddings as a library, the one most similar to each embedding read backwards."""
    e = _embeddings(spark, d)
    turned = e.select(F.col("vec_id").alias("id"), F.reverse("v").alias("v"))
    return M.best_match(turned, e.select(F.col("vec_id").alias("name"), "v")).withColumn("score", r("score", 6))


@query("wav_bundles", UNIT + " SELECT signal_id, idx, round(floor(greatest(-1.0, least(1.0, x)) * 32767 + 0.5) / 32768, 8) AS y FROM u")
def wav_bundles(spark, d):
    """Signals as WAV files in one archive for each task, read back by ranges of 64 samples."""
    packed = unit(spark, d).groupBy("signal_id").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"])).alias("channels"))
    folder = work_folder(spark)
    bundles.register(spark)
    to_wav(packed.withColumn("sr", F.lit(8000))).select(F.col("signal_id").cast("string").alias("name"), "wav").write.format("wav_bundle").mode("append").option("path", folder).save()
    rows = spark.read.format("wav_ranges").option("path", folder).option("frames", 64).load()
    return rows.select(F.regexp_extract("file", r"!(\d+)\.wav$", 1).cast("bigint").alias("signal_id"), "idx", r("x", 8).alias("y"))


@query("cosine_to_centroid", _CEN + " SELECT s.vec_id, round(s.score, 6) AS cosine FROM s JOIN embeddings m ON m.vec_id = s.vec_id AND m.label = s.label")
def cosine_to_centroid(spark, d):
    e = _embeddings(spark, d)
    c = M.centroids(e, "label", "v").withColumnRenamed("v", "c")
    return e.join(c, "label").select("vec_id", r(M.cosine("v", "c"), 6).alias("cosine"))


@query("frame_vad_join", UNIT + ", f AS (SELECT signal_id, idx // 8 AS f, round(avg(x), 6) AS m FROM u GROUP BY ALL), v AS (SELECT signal_id, idx // 16 AS vf, CASE WHEN max(x) > 0.2 THEN 1.0 ELSE 0.0 END AS conf FROM u GROUP BY ALL), l AS (SELECT signal_id, max(vf) AS last FROM v GROUP BY signal_id) SELECT f.signal_id, f.f, m, conf::DOUBLE AS conf FROM f JOIN l USING (signal_id) JOIN v ON v.signal_id = f.signal_id AND v.vf = least(f.f, last)")
def frame_vad_join(spark, d):
    u = unit(spark, d)
    frames = S.blocks(u, 8).groupBy("signal_id", F.col("b").alias("f")).agg(r(F.avg("x"), 6).alias("m"))
    vad = S.blocks(u, 16).groupBy("signal_id", F.col("b").alias("vf")).agg(F.when(F.max("x") > 0.2, 1.0).otherwise(0.0).alias("conf"))
    return M.by_position(frames, vad).select("signal_id", "f", "m", "conf")


@query("frame_as_of", "WITH a AS (SELECT user_id, event_id, epoch(ts) AS t FROM events WHERE event_type <> 'purchase'), b AS (SELECT user_id, epoch(ts) AS t, value FROM events WHERE event_type = 'purchase') SELECT a.user_id, event_id, value AS spent FROM a ASOF LEFT JOIN b ON a.user_id = b.user_id AND a.t >= b.t")
def frame_as_of(spark, d):
    e = events(spark, d).withColumn("t", seconds())
    left = e.where("event_type <> 'purchase'").select("user_id", "event_id", "t")
    right = e.where("event_type = 'purchase'").select("user_id", "t", F.col("value").alias("spent"))
    return M.as_of(left, right, key="user_id", at="t", values=["spent"]).select("user_id", "event_id", "spent")


@query("kmeans_fixed_iter")
def kmeans_fixed_iter(spark, d):
    return M.kmeans(_embeddings(spark, d), 4, id="vec_id", vector="v")


@query("greedy_clusters")
def greedy_clusters(spark, d):
    return M.greedy_clusters(_embeddings(spark, d), key="label", order="vec_id", vector="v", least=0.3).select("label", "vec_id", "cluster")


_FRAMES = UNIT + """, n AS (SELECT signal_id, count(*) AS n FROM u GROUP BY signal_id),
f AS (SELECT n.signal_id, unnest(range(((n - 8) // 4 + 1)::BIGINT)) AS f FROM n WHERE n >= 8),
x AS (SELECT f.signal_id, f.f, u.x, lag(u.x) OVER (PARTITION BY f.signal_id, f.f ORDER BY u.idx) AS p FROM f JOIN u ON u.signal_id = f.signal_id AND u.idx >= f.f * 4 AND u.idx < f.f * 4 + 8),
a AS (SELECT signal_id, f, sqrt(avg(x * x)) AS rms, sum(CASE WHEN (x >= 0) <> (p >= 0) THEN 1 ELSE 0 END) / 16.0 AS crossings, exp(avg(ln(abs(x) + 1e-9))) / avg(abs(x) + 1e-9) AS flatness FROM x GROUP BY ALL)"""


def _features(spark, d):
    """Frames of 8 samples, each half over the next, with the three features that tell speakers apart."""
    rows = S.hopping(unit(spark, d), 8, 4)
    w = Window.partitionBy("signal_id", "f").orderBy("i")
    flip = ((F.col("x") >= 0) != (F.lag("x").over(w) >= 0)).cast("int")
    size = F.abs(F.col("x")) + 1e-9
    return rows.withColumn("flip", flip).groupBy("signal_id", "f").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), (F.coalesce(F.sum("flip"), F.lit(0)) / 16.0).alias("crossings"), (F.exp(F.avg(F.ln(size))) / F.avg(size)).alias("flatness"))


@query("frame_features", _FRAMES + " SELECT signal_id, f, round(rms, 6) AS rms, crossings::DOUBLE AS crossings, round(flatness, 6) AS flatness FROM a")
def frame_features(spark, d):
    return _features(spark, d).select("signal_id", "f", r("rms", 6).alias("rms"), "crossings", r("flatness", 6).alias("flatness"))


def speakers(frames: int) -> int:
    """More speakers are looked for in longer recordings: under 10 s, under 30 s, and beyond, at half a second a frame's step."""
    return 2 if frames < 20 else 3 if frames < 60 else 4


@query("diarization")
def diarization(spark, d):
    """Features of overlapping frames, scaled and clustered within each recording, and run-length segments of the labels."""
    scaled = _features(spark, d).select("signal_id", "f", "rms", *(G.scale_to_range(c, key="signal_id").alias(f"s_{c}") for c in ("rms", "crossings", "flatness")))
    rows = scaled.withColumn("v", F.array(*(F.round(f"s_{c}", 9) for c in ("rms", "crossings", "flatness"))))
    named = M.clustered_frames(rows, speakers, key="signal_id", order="f", vector="v").withColumn("speaker", F.when(F.col("rms") >= 0.003, F.col("label")))
    return G.label_runs(named, "speaker", key="signal_id", order="f", seconds=0.5, least=0.3, energy="s_rms").select("signal_id", F.col("label").alias("speaker"), r("start", 3).alias("start"), r("end", 3).alias("end"), r("confidence", 5).alias("confidence"))


@query("scalar_slug", "SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]', '-', 'g') AS slug FROM part")
def scalar_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("scalar_id_valid", "SELECT c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_-]{1,128}') AS plain, regexp_full_match(replace(c_name, '#', '_'), '[A-Za-z0-9_-]{1,128}') AS fixed FROM customer")
def scalar_id_valid(spark, d):
    return table(spark, d, "customer").select("c_custkey", T.valid_id("c_name").alias("plain"), T.valid_id(F.replace("c_name", F.lit("#"), F.lit("_"))).alias("fixed"))


@query("scalar_email", r"WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN ' ' || upper(c_name) || '@Example.COM ' WHEN c_custkey % 3 = 1 THEN c_name || '@host' ELSE c_name END AS e FROM customer), t AS (SELECT c_custkey, lower(trim(e)) AS e FROM c) SELECT c_custkey, CASE WHEN length(e) BETWEEN 5 AND 254 AND regexp_full_match(e, '[^@ \t\r\n]+@[^@ \t\r\n.]+(\.[^@ \t\r\n.]+)+') THEN e END AS email FROM t")
def scalar_email(spark, d):
    c, n = F.col("c_name"), F.col("c_custkey") % 3
    raw = F.when(n == 0, F.concat(F.lit(" "), F.upper(c), F.lit("@Example.COM "))).when(n == 1, F.concat(c, F.lit("@host"))).otherwise(c)
    return table(spark, d, "customer").select("c_custkey", T.normal_email(raw).alias("email"))


@query("scalar_escape", "SELECT page_id, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS url, sha256(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')) AS html_sha FROM pages")
def scalar_escape(spark, d):
    return table(spark, d, "pages").select("page_id", T.escape_html("url").alias("url"), F.sha2(T.escape_html("html"), 256).alias("html_sha"))


@query("scalar_basename", r"SELECT page_id, regexp_replace(url, '\.[^./]+$', '') || '_processed.wav' AS name FROM pages")
def scalar_basename(spark, d):
    return table(spark, d, "pages").select("page_id", T.output_name("url").alias("name"))


@query("scalar_time_format", "SELECT event_id, format('{:d}:{:02d}', floor(value / 60)::BIGINT, (floor(value) % 60)::BIGINT) AS clock FROM events")
def scalar_time_format(spark, d):
    return events(spark, d).select("event_id", T.clock("value").alias("clock"))


@query("media_admission", r"SELECT page_id, CASE WHEN regexp_matches(lower(url), '\.(mid|midi)$') THEN NULL WHEN regexp_matches(lower(url), '\.(mp4|webm|mov|mkv|m4v|avi)$') THEN 'video' WHEN page_id % 3 = 0 THEN 'audio' END AS kind FROM pages")
def media_admission(spark, d):
    name = F.when(F.col("page_id") % 3 == 0, F.concat("url", F.lit(".WAV"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", media_kind(name).alias("kind"))


@query("json_props", "SELECT event_id, CAST(props->>'k' AS BIGINT) AS k, octet_length(encode(props))::BIGINT AS bytes FROM events")
def json_props(spark, d):
    return events(spark, d).select("event_id", F.from_json("props", "k bigint").getField("k").alias("k"), F.octet_length("props").cast("bigint").alias("bytes"))


@query("sha256_text", "SELECT doc_id, sha256(text) AS digest, left(text, 128) AS head FROM documents")
def sha256_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), T.truncated("text", 128).alias("head"))


@query("days_remaining", "SELECT o_orderkey, greatest(0, ceil((epoch(o_orderdate) + 86400 * 365 - epoch(TIMESTAMP '1998-01-01 12:00:00')) / 86400))::BIGINT AS days FROM orders")
def days_remaining(spark, d):
    now = 883656000.0
    return table(spark, d, "orders").select("o_orderkey", T.days_left(seconds("o_orderdate") + 86400 * 365, F.lit(now)).cast("bigint").alias("days"))


@query("scale_conversions", "SELECT p_partkey, round(2595 * log10(1 + p_retailprice / 700), 6) AS mel, round(21.4 * log10(1 + 0.00437 * p_retailprice), 6) AS erb, round(700 * (pow(10, (p_size * 20.0) / 2595) - 1), 5) AS hz FROM part")
def scale_conversions(spark, d):
    return table(spark, d, "part").select("p_partkey", r(P.hz_to_mel("p_retailprice"), 6).alias("mel"), r(P.hz_to_erb("p_retailprice"), 6).alias("erb"), r(P.mel_to_hz(F.col("p_size") * 20.0), 5).alias("hz"))


@query("nice_ticks", "WITH p AS (SELECT p_partkey, p_retailprice / 7 AS raw, pow(10, floor(log10(p_retailprice / 7))) AS b FROM part) SELECT p_partkey, CASE WHEN b >= raw THEN b WHEN 2 * b >= raw THEN 2 * b WHEN 5 * b >= raw THEN 5 * b ELSE 10 * b END AS tick FROM p")
def nice_ticks(spark, d):
    return table(spark, d, "part").select("p_partkey", P.nice_tick("p_retailprice", 7).alias("tick"))


@query("clamp_and_snap", "SELECT p_partkey, round(floor(greatest(5.0, least(40.0, p_size)) / 2.5 + 0.5) * 2.5, 3) AS snapped, round(0.001 + (greatest(-80.0, least(-20.0, -p_size * 2.0)) + 80) / 60 * (0.05 - 0.001), 7) AS floor_gain FROM part")
def clamp_and_snap(spark, d):
    size = F.col("p_size").cast("double")
    return table(spark, d, "part").select("p_partkey", r(P.snap(size, 5.0, 40.0, 2.5, 10.0), 3).alias("snapped"), r(P.floor_from_db(-size * 2.0), 7).alias("floor_gain"))


@query("key_aliases", "SELECT n_nationkey, CASE n_name WHEN 'dns' THEN 'x' ELSE n_name END AS name FROM nation")
def key_aliases(spark, d):
    return table(spark, d, "nation").select("n_nationkey", T.canonical("n_name").alias("name"))


@query("colormap", "SELECT event_id, round(CASE WHEN v * 2 < 1 THEN 0 + (v * 2) * 10 ELSE 10 + (v * 2 - 1) * 40 END, 4) AS colour FROM (SELECT event_id, greatest(0.0, least(1.0, value / 500)) AS v FROM events)")
def colormap(spark, d):
    return events(spark, d).select("event_id", r(P.colormap(F.col("value") / 500, [0, 10, 50])).alias("colour"))


@query("wav_round_trip", UNIT + " SELECT signal_id, idx, round(floor(greatest(-1.0, least(1.0, x)) * 32767 + 0.5) / 32768, 8) AS y FROM u")
def wav_round_trip(spark, d):
    """Signals as 16-bit WAV files and back."""
    return _through_wav(spark, d)


def _through_wav(spark, d, symmetric=True):
    import pyarrow as pa

    from undertone.sources.wav import decode

    packed = unit(spark, d).groupBy("signal_id").agg(F.array(F.transform(F.array_sort(F.collect_list(F.struct("idx", "x"))), lambda s: s["x"])).alias("channels"))

    def back(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(w)[1][0].tolist() for w in batch.column(1).to_pylist()], pa.list_(pa.float64()))], ["signal_id", "x"])

    files = to_wav(packed.withColumn("sr", F.lit(8000)), symmetric=symmetric)
    return files.mapInArrow(back, "signal_id bigint, x array<double>").select("signal_id", F.posexplode("x").alias("idx", "y")).select("signal_id", F.col("idx").cast("bigint").alias("idx"), r("y", 8).alias("y"))


@query("wav_asymmetric", UNIT + " SELECT signal_id, idx, round(trunc(greatest(-1.0, least(1.0, x)) * CASE WHEN x < 0 THEN 32768 ELSE 32767 END) / 32768, 8) + 0.0 AS y FROM u")
def wav_asymmetric(spark, d):
    """As wav_round_trip, with full scale at -32768 and 32767, and cut towards zero."""
    return _through_wav(spark, d, symmetric=False)


@query("truncated_names", "SELECT p_partkey, substr(p_name, 1, 8) AS name FROM part")
def truncated_names(spark, d):
    return table(spark, d, "part").select("p_partkey", T.truncated("p_name", 8).alias("name"))


@query("finite_guard", "SELECT event_id, CASE WHEN value > 90 OR event_id % 3 = 0 THEN 0.0 ELSE value END AS value FROM events")
def finite_guard(spark, d):
    """Magnitudes that are not a number, infinite, negative or missing become zero."""
    odd = F.when(F.col("event_id") % 3 == 0, F.lit(float("nan"))).when(F.col("value") > 200, F.lit(float("inf"))).when(F.col("value") > 120, -F.col("value")).when(F.col("value") > 90, F.lit(None).cast("double")).otherwise(F.col("value"))
    return events(spark, d).select("event_id", P.finite(odd).alias("value"))


@query("model_store", "WITH m AS (SELECT * FROM (VALUES ('signup', 60), ('error', 20), ('purchase', 150), ('absent', 1)) t(model, least)), s AS (SELECT event_type, arg_max(event_id, (ts, event_id)) AS version, count(*) AS stored FROM events JOIN m ON m.model = event_type WHERE value >= least GROUP BY event_type) SELECT model, version, coalesce(stored, 0) AS stored, version IS NOT NULL AS ready FROM m LEFT JOIN s ON s.event_type = m.model")
def model_store(spark, d):
    registry = spark.createDataFrame([("signup", 60.0), ("error", 20.0), ("purchase", 150.0), ("absent", 1.0)], "model string, least double")
    stored = events(spark, d).select(F.col("event_type").alias("model"), F.col("event_id").alias("version"), F.col("value").alias("size"), "ts")
    return O.usable(registry, stored, "model", "least", "size", "version", "ts", "version")


@query("registry_log", "WITH a AS (SELECT user_id, event_id, ts, event_id % 7 AS id, CASE event_type WHEN 'error' THEN 'remove' WHEN 'signup' THEN 'clear' ELSE 'add' END AS act FROM events), c AS (SELECT user_id, max((ts, event_id)) AS at FROM a WHERE act = 'clear' GROUP BY user_id), l AS (SELECT a.user_id, id, arg_max(act, (ts, event_id)) AS act, max((ts, event_id)) AS at FROM a WHERE act <> 'clear' GROUP BY ALL) SELECT l.user_id, l.id FROM l LEFT JOIN c ON c.user_id = l.user_id WHERE l.act = 'add' AND (c.at IS NULL OR l.at > c.at)")
def registry_log(spark, d):
    """Who is enrolled after a log of additions, removals and clearings."""
    act = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "clear").otherwise("add")
    log = events(spark, d).select("user_id", (F.col("event_id") % 7).alias("id"), act.alias("act"), "ts", "event_id")
    return O.remaining(log, "user_id", "id", "act", "ts", "event_id")
