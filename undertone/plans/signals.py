"""Queries over signals: levels, windows, blocks, runs and recurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertone.functions import pointwise as P
from undertone.functions import recurrences as R
from undertone.functions import systems as Y
from undertone.operators import chunked as C
from undertone.operators import levels as L
from undertone.operators import sequences as S
from undertone.plans.registry import query
from undertone.sources.tables import signals

SIG = "WITH RECURSIVE sig AS (SELECT user_id AS signal_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value AS x, event_id, event_type, ts FROM events)"
DB = "CASE WHEN {0} > 0 THEN 20 * log10({0}) ELSE -96.0 END"
PDB = "CASE WHEN {0} > 0 THEN 10 * log10({0}) ELSE -96.0 END"
SR = 1000
#: Samples in a chunk of these short signals, so that many have several.
CUT = 64


def unit(spark, d) -> DataFrame:
    """Samples scaled to about -1..1, centred on zero."""
    return signals(spark, d).withColumn("x", (F.col("x") - 100) / 397.3)


UNIT = SIG + ", u AS (SELECT signal_id, idx, (x - 100) / 397.3 AS x FROM sig)"


def r(c, n=4):
    return F.round(c, n)


@query(
    "signal_summary",
    SIG
    + f""", c AS (SELECT *, x - avg(x) OVER (PARTITION BY signal_id) AS z FROM sig),
f AS (SELECT *, CASE WHEN (z >= 0) <> lag(z >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip FROM c)
SELECT signal_id, count(*) AS n, round({PDB.format("avg(x * x)")}, 4) AS rms_db, round({DB.format("max(abs(x))")}, 4) AS peak_db,
 round(sum(flip)::DOUBLE / count(*), 6) AS zcr, round(list_reduce(list(x ORDER BY idx), lambda a, b: 0.8 * a + 0.2 * b), 4) AS ema, max(CASE WHEN x > 50 THEN 1 ELSE 0 END) = 1 AS active
FROM f GROUP BY signal_id""",
)
def signal_summary(spark, d):
    centred = signals(spark, d).withColumn("z", F.col("x") - F.avg("x").over(Window.partitionBy("signal_id")))
    flip = F.coalesce(((F.col("z") >= 0) != F.lag(F.col("z") >= 0).over(S.over())).cast("int"), F.lit(0))
    rows = centred.withColumn("flip", flip).groupBy("signal_id").agg(F.count("*").alias("n"), r(L.rms_db()).alias("rms_db"), r(L.peak_db()).alias("peak_db"), r(F.sum("flip") / F.count("*"), 6).alias("zcr"), F.array_sort(F.collect_list(F.struct("idx", "x"))).alias("v"), F.bool_or(F.col("x") > 50).alias("active"))
    rest = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    ema = F.aggregate(rest, F.element_at("v", 1)["x"], lambda a, s: a * 0.8 + s["x"] * 0.2)
    return rows.select("signal_id", "n", "rms_db", "peak_db", "zcr", r(ema).alias("ema"), "active")


@query("signal_rms_peak", SIG + f" SELECT signal_id, round({PDB.format('avg(x * x)')}, 4) AS rms_db, round({DB.format('max(abs(x))')}, 4) AS peak_db FROM sig GROUP BY signal_id")
def signal_rms_peak(spark, d):
    return signals(spark, d).groupBy("signal_id").agg(r(L.rms_db()).alias("rms_db"), r(L.peak_db()).alias("peak_db"))


@query("peak_normalize", SIG + " SELECT signal_id, idx, round(CASE WHEN max(abs(x)) OVER w < 1e-10 THEN x ELSE x * pow(10, -1.0 / 20) / max(abs(x)) OVER w END, 6) + 0.0 AS y FROM sig WINDOW w AS (PARTITION BY signal_id)")
def peak_normalize(spark, d):
    return L.normalise_peak(signals(spark, d), -1.0).select("signal_id", "idx", r("y", 6).alias("y"))


_BLOCKS = ", b AS (SELECT s.signal_id, f.f, sum(s.x * s.x) / 16 AS power FROM u s JOIN (SELECT range AS f FROM range(0, 100000)) f ON s.idx >= f.f * 4 AND s.idx < f.f * 4 + 16 GROUP BY ALL HAVING count(*) = 16 AND sum(s.x * s.x) / 16 > 1e-10), l AS (SELECT signal_id, -0.691 + 10 * log10(avg(power)) AS lufs FROM b GROUP BY signal_id)"


@query("block_loudness", UNIT + _BLOCKS.replace("100000", "(SELECT max(idx) // 4 + 1 FROM u)") + " SELECT signal_id, round(lufs, 4) AS lufs FROM l")
def block_loudness(spark, d):
    return L.loudness(unit(spark, d), 16, 4).select("signal_id", r("lufs").alias("lufs"))


@query("loudness_normalize", UNIT + _BLOCKS.replace("100000", "(SELECT max(idx) // 4 + 1 FROM u)") + " SELECT signal_id, idx, round(x * coalesce(CASE WHEN lufs < -70 THEN 1.0 ELSE pow(10, (-16 - lufs) / 20) END, 1.0), 5) + 0.0 AS y FROM u LEFT JOIN l USING (signal_id)")
def loudness_normalize(spark, d):
    return L.normalise_loudness(unit(spark, d), -16.0, 16, 4).select("signal_id", "idx", r("y", 5).alias("y"))


@query(
    "crest_running_meter",
    UNIT
    + """, p AS (SELECT signal_id, idx // 8 AS b, avg(x * x) AS p, max(abs(x)) AS top FROM u GROUP BY ALL), q AS (SELECT *, avg(p) OVER (PARTITION BY signal_id ORDER BY b) AS m FROM p)
SELECT signal_id, b, round(CASE WHEN p > 0 THEN 10 * log10(p) ELSE -60.0 END, 4) AS short, round(CASE WHEN m > 0 THEN 10 * log10(m) ELSE -60.0 END, 4) AS integrated,
 round(CASE WHEN top > 0 THEN 20 * log10(top) ELSE -60.0 END - CASE WHEN p > 0 THEN 10 * log10(p) ELSE -60.0 END, 4) AS crest FROM q""",
)
def crest_running_meter(spark, d):
    return L.meter(unit(spark, d), 8).select("signal_id", "b", *(r(c).alias(c) for c in ("short", "integrated", "crest")))


@query("active_blocks", UNIT + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS r FROM u GROUP BY ALL) SELECT signal_id, count_if(r > 0.25) AS active, CASE WHEN count_if(r > 0.25) = 0 THEN '0-1' WHEN count_if(r > 0.25) / count(*) < 0.5 THEN '1' ELSE '1-2+' END AS voices FROM p GROUP BY signal_id")
def active_blocks(spark, d):
    return L.active_blocks(unit(spark, d), 8, 0.25)


@query("zero_crossing_rate", UNIT + ", f AS (SELECT signal_id, CASE WHEN (x >= 0) <> lag(x >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip FROM u) SELECT signal_id, sum(flip)::BIGINT AS crossings, round(sum(flip) / count(*), 6) AS zcr, round(sum(flip) * 1000.0 / (2 * count(*)) / 1000.0, 6) AS zcr_hz FROM f GROUP BY signal_id")
def zero_crossing_rate(spark, d):
    z = S.zero_crossings(unit(spark, d))
    return z.select("signal_id", "crossings", r(F.col("crossings") / F.col("n"), 6).alias("zcr"), r(F.col("crossings") * SR / (2 * F.col("n")) / SR, 6).alias("zcr_hz"))


@query("rms_flux", UNIT + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS r FROM u WHERE idx // 8 < 20 GROUP BY ALL HAVING count(*) = 8), q AS (SELECT signal_id, abs(r - lag(r) OVER (PARTITION BY signal_id ORDER BY b)) AS d FROM p) SELECT signal_id, round(coalesce(avg(d), 0.0), 6) AS flux FROM q GROUP BY signal_id")
def rms_flux(spark, d):
    return L.flux(unit(spark, d), 8, 20).select("signal_id", r("flux", 6).alias("flux"))


_RANK = ", k AS (SELECT signal_id, abs(x) AS v, row_number() OVER (PARTITION BY signal_id ORDER BY abs(x)) AS r, count(*) OVER (PARTITION BY signal_id) AS n FROM u)"
_RANGE = ", g AS (SELECT signal_id, 20 * log10(max(v) FILTER (r = floor(n * 0.95) + 1) / (max(v) FILTER (r = floor(n * 0.05) + 1) + 1e-10)) AS dynamic_range FROM k GROUP BY signal_id)"


@query("dynamic_range", UNIT + _RANK + _RANGE + " SELECT signal_id, round(dynamic_range, 4) AS dynamic_range FROM g")
def dynamic_range(spark, d):
    return L.dynamic_range(unit(spark, d)).select("signal_id", r("dynamic_range").alias("dynamic_range"))


_QUIET = "p{0} AS (SELECT signal_id, idx // 8 AS b, sqrt(avg({1} * {1})) AS r FROM {2} GROUP BY ALL HAVING count(*) = 8), q{0} AS (SELECT signal_id, r, row_number() OVER (PARTITION BY signal_id ORDER BY r, b) AS k, count(*) OVER (PARTITION BY signal_id) AS m FROM p{0}), n{0} AS (SELECT signal_id, avg(r) AS noise FROM q{0} WHERE k <= greatest(1, floor(m * 0.1)) GROUP BY signal_id)"


@query("noise_floor_rms", UNIT + ", " + _QUIET.format("", "x", "u") + " SELECT signal_id, round(noise, 6) AS noise FROM n")
def noise_floor_rms(spark, d):
    return L.quiet_rms(unit(spark, d), 8).select("signal_id", r("noise", 6).alias("noise"))


@query(
    "snr_improvement",
    UNIT
    + ", v AS (SELECT signal_id, idx, CASE WHEN abs(x) < 0.1 THEN x * 0.25 ELSE x END AS y, x FROM u), "
    + _QUIET.format("a", "x", "v")
    + ", "
    + _QUIET.format("b", "y", "v")
    + ", m AS (SELECT signal_id, sqrt(avg(x * x)) AS rx, sqrt(avg(y * y)) AS ry FROM v GROUP BY signal_id) SELECT signal_id, round(20 * log10(ry / b.noise) - 20 * log10(rx / a.noise), 4) AS gain_db FROM m JOIN na a USING (signal_id) JOIN nb b USING (signal_id)",
)
def snr_improvement(spark, d):
    both = unit(spark, d).withColumn("y", F.when(F.abs("x") < 0.1, F.col("x") * 0.25).otherwise(F.col("x")))
    level = both.groupBy("signal_id").agg(L.rms("x").alias("rx"), L.rms("y").alias("ry"))
    a, b = (L.quiet_rms(both, 8, x=c).withColumnRenamed("noise", f"n{c}") for c in "xy")
    return level.join(a, "signal_id").join(b, "signal_id").select("signal_id", r(P.db(F.col("ry") / F.col("ny")) - P.db(F.col("rx") / F.col("nx"))).alias("gain_db"))


@query("waveform_minmax", SIG + " SELECT signal_id, idx // 10 AS px, min(x) AS lo, max(x) AS hi FROM sig GROUP BY ALL")
def waveform_minmax(spark, d):
    return L.waveform(signals(spark, d), 10)


@query("hop_frames", UNIT + ", n AS (SELECT signal_id, count(*) AS n FROM u GROUP BY signal_id HAVING count(*) >= 16), f AS (SELECT signal_id, unnest(range(0, (n - 16) // 8 + 1)) AS f FROM n) SELECT u.signal_id, f, count(*) AS n, round(sum(x), 6) + 0.0 AS total, round(sum(x * (idx - f * 8)), 5) AS weighted FROM f JOIN u ON u.signal_id = f.signal_id AND idx BETWEEN f * 8 AND f * 8 + 15 GROUP BY ALL")
def hop_frames(spark, d):
    return S.hopping(unit(spark, d), 16, 8).groupBy("signal_id", "f").agg(F.count("*").alias("n"), r(F.sum("x"), 6).alias("total"), r(F.sum(F.col("x") * F.col("i")), 5).alias("weighted"))


@query("tumble_frames", UNIT + " SELECT signal_id, idx // 16 AS f, round(sqrt(avg(x * x)), 6) AS rms FROM u GROUP BY ALL HAVING count(*) = 16")
def tumble_frames(spark, d):
    part = S.blocks(unit(spark, d), 16).groupBy("signal_id", F.col("b").alias("f")).agg(F.count("*").alias("n"), r(L.rms(), 6).alias("rms"))
    return part.where("n = 16").drop("n")


_CLICK = (
    UNIT
    + """, z AS (SELECT *, count(*) OVER (PARTITION BY signal_id) AS total, greatest(0.005, avg(abs(x)) OVER (PARTITION BY signal_id) * 0.5) AS least FROM u),
t AS (SELECT *, idx // 8 AS b FROM z UNION ALL SELECT *, idx // 8 - 1 FROM z WHERE idx >= 8),
k AS (SELECT *, row_number() OVER (PARTITION BY signal_id, b ORDER BY abs(x), idx) AS r, count(*) OVER (PARTITION BY signal_id, b) AS n FROM t WHERE b * 8 + 4 <= total),
m AS (SELECT *, max(CASE WHEN r = n // 2 + 1 THEN abs(x) END) OVER (PARTITION BY signal_id, b) AS median FROM k),
j AS (SELECT signal_id, idx, bool_or(abs(x) > greatest(median * 3.0, least)) AS c FROM m GROUP BY ALL),
c AS (SELECT u.signal_id, u.idx, u.x, coalesce(c, false) AS c FROM u LEFT JOIN j ON j.signal_id = u.signal_id AND j.idx = u.idx),
g AS (SELECT signal_id, idx, x, c OR (coalesce(lag(c) OVER w, false) AND coalesce(lead(c) OVER w, false)) AS click FROM c WINDOW w AS (PARTITION BY signal_id ORDER BY idx))"""
)


@query("click_flags", _CLICK + " SELECT signal_id, idx, click FROM g")
def click_flags(spark, d):
    return S.clicks(unit(spark, d), 16, 3.0).select("signal_id", "idx", "click")


@query(
    "click_repair",
    _CLICK
    + """, l AS (SELECT g.*, (SELECT max(h.idx) FROM g h WHERE h.signal_id = g.signal_id AND h.idx < g.idx AND NOT h.click) AS li, (SELECT min(h.idx) FROM g h WHERE h.signal_id = g.signal_id AND h.idx > g.idx AND NOT h.click) AS ri FROM g WHERE click),
p AS (SELECT l.signal_id, l.idx, (l.idx - li)::DOUBLE / (ri - li) AS t, a.x AS p1, b.x AS p2, coalesce(z.x, a.x) AS p0, coalesce(y.x, b.x) AS p3 FROM l LEFT JOIN g a ON a.signal_id = l.signal_id AND a.idx = li LEFT JOIN g b ON b.signal_id = l.signal_id AND b.idx = ri
 LEFT JOIN g z ON z.signal_id = l.signal_id AND z.idx = li - 1 AND NOT z.click LEFT JOIN g y ON y.signal_id = l.signal_id AND y.idx = ri + 1 AND NOT y.click)
SELECT signal_id, idx, round(x, 6) + 0.0 AS y FROM g WHERE NOT click UNION ALL
SELECT signal_id, idx, round(CASE WHEN p1 IS NOT NULL AND p2 IS NOT NULL THEN 0.5 * (2 * p1 + (p2 - p0) * t + (2 * p0 - 5 * p1 + 4 * p2 - p3) * t * t + (3 * p1 - p0 - 3 * p2 + p3) * t * t * t) ELSE coalesce(p1, p2, 0.0) END, 6) FROM p""",
)
def click_repair(spark, d):
    return S.repair(S.clicks(unit(spark, d), 16, 3.0)).select("signal_id", "idx", r("y", 6).alias("y"))


def _recursive(first: str, step: str, columns: str, out: str, source: str = "u") -> str:
    """SQL of a recurrence: columns of the state at idx 0, and after it from r (before) and s (sample)."""
    return UNIT + f", r AS (SELECT signal_id, idx, {first} FROM {source} s WHERE idx = 0 UNION ALL SELECT s.signal_id, s.idx, {step} FROM r JOIN {source} s ON s.signal_id = r.signal_id AND s.idx = r.idx + 1) SELECT signal_id, idx, {out} FROM r"


@query("ema_smooth", _recursive("x AS y", "0.7 * r.y + 0.3 * s.x", "y", "round(y, 6) + 0.0 AS y"))
def ema_smooth(spark, d):
    return S.ema(unit(spark, d), 0.7, chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


@query("asym_tracker", _recursive("abs(x) AS y", "CASE WHEN abs(s.x) > r.y THEN 0.9 * r.y + 0.1 * abs(s.x) ELSE 0.998 * r.y + 0.002 * abs(s.x) END", "y", "round(y, 6) + 0.0 AS y"))
def asym_tracker(spark, d):
    return C.speculative(unit(spark, d).withColumn("x", F.abs("x")), Y.TwoSpeed(0.9, 0.998))[0].select("signal_id", "idx", r("y", 6).alias("y"))


@query("live_noise_floor", _recursive("greatest(1e-6, least(0.95 * 1e-6 + 0.05 * abs(x), 1.05 * abs(x))) AS y", "greatest(1e-6, least(0.95 * r.y + 0.05 * abs(s.x), 1.05 * abs(s.x)))", "y", "round(y, 7) + 0.0 AS y"))
def live_noise_floor(spark, d):
    return C.speculative(unit(spark, d).withColumn("x", F.abs("x")), Y.LiveFloor())[0].select("signal_id", "idx", r("y", 7).alias("y"))


@query("warm_up_profile", _recursive("0.5 * (1.5 * abs(x) + 1e-6) + 0.5 * x AS y", "CASE WHEN s.idx < 5 THEN 0.5 * r.y + 0.5 * s.x ELSE 0.92 * r.y + 0.08 * s.x END", "y", "round(y, 6) + 0.0 AS profile, round(0.05 + 0.95 * pow(least(1.0, idx / 90.0), 2), 6) AS ramp"))
def warm_up_profile(spark, d):
    return S.scan(unit(spark, d), R.warm_up, {"profile": "double", "ramp": "double"}).select("signal_id", "idx", r("profile", 6).alias("profile"), r("ramp", 6).alias("ramp"))


@query("peak_hold", _recursive("greatest(x, -0.2) AS y, CASE WHEN x >= -0.2 THEN 5 ELSE 0 END AS h", "CASE WHEN s.x >= r.y THEN s.x WHEN r.h > 0 THEN r.y ELSE greatest(-0.2, r.y - 0.05) END, CASE WHEN s.x >= r.y THEN 5 WHEN r.h > 0 THEN r.h - 1 ELSE 0 END", "y, h", "round(y, 6) + 0.0 AS y"))
def peak_hold(spark, d):
    return S.scan(unit(spark, d), lambda x: R.peak_hold(x, 5, 0.05, -0.2), {"y": "double"}).select("signal_id", "idx", r("y", 6).alias("y"))


@query(
    "declip_neighbors",
    UNIT + ", n AS (SELECT *, lead(x) OVER (PARTITION BY signal_id ORDER BY idx) AS nx FROM u), r AS (SELECT signal_id, idx, x AS y FROM n s WHERE idx = 0 UNION ALL SELECT s.signal_id, s.idx, CASE WHEN abs(s.x) >= 0.5 AND s.nx IS NOT NULL THEN (r.y + s.nx) / 2 ELSE s.x END FROM r JOIN n s ON s.signal_id = r.signal_id AND s.idx = r.idx + 1) SELECT signal_id, idx, round(y, 6) + 0.0 AS y FROM r",
)
def declip_neighbors(spark, d):
    return S.scan(unit(spark, d), lambda x: R.declip(x, 0.5), {"y": "double"}).select("signal_id", "idx", r("y", 6).alias("y"))


@query("fallback_vad_streak", _recursive("0.15 * least(1.0, abs(x) * 8) AS y, CASE WHEN 0.15 * least(1.0, abs(x) * 8) > 0.6 THEN 1 ELSE 0 END AS n", "0.85 * r.y + 0.15 * least(1.0, abs(s.x) * 8), CASE WHEN 0.85 * r.y + 0.15 * least(1.0, abs(s.x) * 8) > 0.6 THEN r.n + 1 ELSE greatest(0, r.n - 1) END", "y, n", "round(y, 6) AS smooth, n >= 3 AS voiced"))
def fallback_vad_streak(spark, d):
    score = unit(spark, d).withColumn("x", F.least(F.lit(1.0), F.abs("x") * 8))
    return S.scan(score, R.streak, {"smooth": "double", "voiced": "boolean"}).select("signal_id", "idx", r("smooth", 6).alias("smooth"), "voiced")


_GATE_T = "CASE WHEN abs(s.ax) > 0.15 THEN 1.0::DOUBLE WHEN {0} > 0 THEN 1.0 ELSE 0.1 END"
_GATE_H = "CASE WHEN abs(s.ax) > 0.15 THEN 3 WHEN {0} > 0 THEN {0} - 1 ELSE 0 END"


@query(
    "noise_gate",
    UNIT
    + f""", a AS (SELECT *, coalesce(lead(x, 2) OVER w, last_value(x) OVER (PARTITION BY signal_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS ax FROM u WINDOW w AS (PARTITION BY signal_id ORDER BY idx)),
r AS (SELECT signal_id, idx, x, CASE WHEN {_GATE_T.format("0")} > 0 THEN 0.4 ELSE 0.05 END * {_GATE_T.format("0")} AS env, {_GATE_H.format("0")} AS h FROM a s WHERE idx = 0
 UNION ALL SELECT s.signal_id, s.idx, s.x, r.env + CASE WHEN {_GATE_T.format("r.h")} > r.env THEN 0.4 ELSE 0.05 END * ({_GATE_T.format("r.h")} - r.env), {_GATE_H.format("r.h")} FROM r JOIN a s ON s.signal_id = r.signal_id AND s.idx = r.idx + 1)
SELECT signal_id, idx, round(x * env, 6) + 0.0 AS y FROM r""",
)
def noise_gate(spark, d):
    return C.speculative(unit(spark, d), Y.Gate(0.15, 0.1, 2, 3, 0.6, 0.95), chunk=CUT)[0].select("signal_id", "idx", r("y", 6).alias("y"))


_LV = "CASE WHEN s.x <> 0 THEN 20 * log10(abs(s.x)) ELSE -96.0 END"


@query(
    "compressor",
    _recursive(
        f"CASE WHEN {_LV} > -96.0 THEN 0.5 ELSE 0.9 END * -96.0 + CASE WHEN {_LV} > -96.0 THEN 0.5 ELSE 0.1 END * {_LV} AS e, x",
        f"CASE WHEN {_LV} > r.e THEN 0.5 * r.e + 0.5 * {_LV} ELSE 0.9 * r.e + 0.1 * {_LV} END, s.x",
        "e, x",
        "round(x * pow(10, (CASE WHEN e + 20 > 3 THEN (e + 20) / 4 - (e + 20) WHEN e + 20 > -3 THEN (1.0 / 4 - 1) * pow(e + 20 + 3, 2) / 12 ELSE 0 END + 2.0) / 20), 6) + 0.0 AS y",
    ),
)
def compressor(spark, d):
    return C.speculative(unit(spark, d), Y.Compressor(-20.0, 4.0, 6.0, 0.5, 0.9, 2.0), chunk=CUT)[0].select("signal_id", "idx", r("y", 6).alias("y"))


_BQ = R.biquad_design("highpass", 80.0, 0.707, 0.0, SR)


def _biquad_sql(c, source="u", r="r") -> str:
    b0, b1, b2, a1, a2 = (f"({v!r}::DOUBLE)" for v in c)
    return f"SELECT signal_id, idx, {b0} * x AS y, {b1} * x - {a1} * ({b0} * x) AS s1, {b2} * x - {a2} * ({b0} * x) AS s2 FROM {source} s WHERE idx = 0 UNION ALL SELECT s.signal_id, s.idx, {b0} * s.x + {r}.s1, {b1} * s.x - {a1} * ({b0} * s.x + {r}.s1) + {r}.s2, {b2} * s.x - {a2} * ({b0} * s.x + {r}.s1) FROM {r} JOIN {source} s ON s.signal_id = {r}.signal_id AND s.idx = {r}.idx + 1"


def _cascade_sql(filters) -> str:
    """Filters one behind the other; the last one's output is x of filtered."""
    out, source = "", "u"
    for i, c in enumerate(filters):
        out += f", r{i} AS ({_biquad_sql(c, source, f'r{i}')}), z{i} AS (SELECT signal_id, idx, y AS x FROM r{i})"
        source = f"z{i}"
    return out + f", filtered AS (SELECT * FROM {source})"


def _compress_sql(name: str, source: str, threshold: float, ratio: float, knee: float, attack: float, release: float, makeup: float) -> str:
    level = "CASE WHEN s.x <> 0 THEN 20 * log10(abs(s.x)) ELSE -96.0 END"
    moved = f"CASE WHEN {level} > {{0}} THEN {attack} * {{0}} + {1 - attack!r}::DOUBLE * {level} ELSE {release} * {{0}} + {1 - release!r}::DOUBLE * {level} END"
    over = f"(e - ({threshold}))"
    cut = f"CASE WHEN {over} > {knee / 2} THEN {over} / {ratio} - {over} WHEN {over} > {-knee / 2} THEN (1 / {ratio} - 1) * pow({over} + {knee / 2}, 2) / (2 * {knee or 1.0}) ELSE 0 END"
    return f", {name}_e AS (SELECT signal_id, idx, x, {moved.format('(-96.0::DOUBLE)')} AS e FROM {source} s WHERE idx = 0 UNION ALL SELECT s.signal_id, s.idx, s.x, {moved.format('p.e')} FROM {name}_e p JOIN {source} s ON s.signal_id = p.signal_id AND s.idx = p.idx + 1), {name} AS (SELECT signal_id, idx, x * pow(10, ({cut} + {makeup}) / 20) AS x FROM {name}_e)"


@query("biquad_highpass", UNIT + f", r AS ({_biquad_sql(_BQ)}) SELECT signal_id, idx, round(y, 6) + 0.0 AS y FROM r")
def biquad_highpass(spark, d):
    return C.linear(unit(spark, d), Y.biquad(_BQ), chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


_SIDE = R.biquad_design("peaking", 200.0, 2.0, 6.0, SR)
_DT = "CASE WHEN abs(s.side) > 0.3 THEN (0.3 + (abs(s.side) - 0.3) / 3.0) / abs(s.side) ELSE 1.0 END"


@query(
    "deesser",
    UNIT
    + f""", r AS ({_biquad_sql(_SIDE)}), z AS (SELECT u.signal_id, u.idx, u.x, r.y AS side FROM u JOIN r ON r.signal_id = u.signal_id AND r.idx = u.idx),
e AS (SELECT signal_id, idx, x, CASE WHEN {_DT} < 1.0 THEN 0.4 + 0.6 * {_DT} ELSE 0.9 + 0.1 * {_DT} END AS g FROM z s WHERE idx = 0
 UNION ALL SELECT s.signal_id, s.idx, s.x, CASE WHEN {_DT} < e.g THEN 0.4 * e.g + 0.6 * {_DT} ELSE 0.9 * e.g + 0.1 * {_DT} END FROM e JOIN z s ON s.signal_id = e.signal_id AND s.idx = e.idx + 1)
SELECT signal_id, idx, round(x * (0.5 + 0.5 * g), 6) + 0.0 AS y FROM e""",
)
def deesser(spark, d):
    return C.speculative(unit(spark, d), Y.SideDeesser(_SIDE, 0.3, 3.0, 0.5, 0.4, 0.9), chunk=CUT)[0].select("signal_id", "idx", r("y", 6).alias("y"))


@query("hum_notch_cascade", UNIT + _cascade_sql(R.hum_notches(SR)) + " SELECT signal_id, idx, round(x, 6) + 0.0 AS y FROM filtered")
def hum_notch_cascade(spark, d):
    return C.linear(unit(spark, d), Y.cascade(R.hum_notches(SR)), chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


@query("dc_removal", UNIT + f", r AS ({_biquad_sql(R.biquad_design('highpass', 5.0, 0.7071, 0.0, SR))}) SELECT signal_id, idx, round(y, 6) + 0.0 AS y FROM r")
def dc_removal(spark, d):
    return C.linear(unit(spark, d), Y.biquad(R.biquad_design("highpass", 5.0, 0.7071, 0.0, SR)), chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


_EQ = R.equaliser([(60, 3.0, 1.0), (120, 0.05, 1.0), (250, -4.0, 1.4)], SR)


@query("parametric_eq", UNIT + _cascade_sql(_EQ) + " SELECT signal_id, idx, round(x, 6) + 0.0 AS y FROM filtered")
def parametric_eq(spark, d):
    return C.linear(unit(spark, d), Y.cascade(_EQ), chunk=CUT).select("signal_id", "idx", r("y", 6).alias("y"))


@query(
    "live_gate",
    UNIT
    + """, r AS (SELECT signal_id, idx, 0.05 * abs(x) AS env FROM u WHERE idx = 0 UNION ALL SELECT s.signal_id, s.idx, r.env + CASE WHEN abs(s.x) > r.env THEN 0.05 ELSE 0.0005 END * (abs(s.x) - r.env) FROM r JOIN u s ON s.signal_id = r.signal_id AND s.idx = r.idx + 1),
l AS (SELECT u.signal_id, u.idx, coalesce(lag(x, 4) OVER w, 0.0) AS late, max(CASE WHEN round(env, 9) > 0.05 THEN u.idx END) OVER w AS loud FROM u JOIN r ON r.signal_id = u.signal_id AND r.idx = u.idx WINDOW w AS (PARTITION BY u.signal_id ORDER BY u.idx))
SELECT signal_id, idx, round(CASE WHEN loud IS NOT NULL AND idx - loud <= 6 THEN late ELSE late * 0.1 END, 6) + 0.0 AS y FROM l""",
)
def live_gate(spark, d):
    return S.gate_ahead(unit(spark, d), 0.05, 0.1, look=4, hold=6).select("signal_id", "idx", r("y", 6).alias("y"))


_BAND = R.biquad_design("peaking", 300.0, 3.0, -12.0, SR)


def _live_sql(c) -> str:
    b0, b1, b2, a1, a2 = (f"({v!r}::DOUBLE)" for v in c)
    side = f"SELECT s.signal_id, s.idx, s.x, {{env}} AS before, {{on}} AS was, {b0} * s.x + {{s1}} AS side, {{s2}} AS s2_ FROM {{rows}}"
    env = f"SELECT *, {b1} * x - {a1} * side + s2_ AS s1, {b2} * x - {a2} * side AS s2, before + CASE WHEN abs(side) > before THEN 0.05 ELSE 0.0005 END * (abs(side) - before) AS env FROM ({side})"
    share = f"SELECT *, least(1.0, env / (abs(x) + 1e-9)) AS share FROM ({env})"
    row = f"SELECT signal_id, idx, x, side, s1, s2, env, share, CASE WHEN was THEN share >= 0.35 - 0.02 ELSE share > 0.35 + 0.02 END AS open FROM ({share})"
    first = row.format(env="0.0::DOUBLE", on="false", s1="0.0", s2="0.0::DOUBLE", rows="u s WHERE idx = 0")
    return first + " UNION ALL " + row.format(env="r.env", on="r.open", s1="r.s1", s2="r.s2", rows="r JOIN u s ON s.signal_id = r.signal_id AND s.idx = r.idx + 1")


@query("live_deesser", UNIT + f", r AS ({_live_sql(_BAND)}) SELECT signal_id, idx, round(CASE WHEN open THEN x - side * least(greatest((share - 0.35) / 0.65 * 0.8 * 0.85, 0.0), 0.85) ELSE x END, 6) + 0.0 AS y FROM r")
def live_deesser(spark, d):
    return C.speculative(unit(spark, d), Y.LiveDeesser(_BAND, 0.8), chunk=CUT)[0].select("signal_id", "idx", r("y", 6).alias("y"))


_EDGE = "first_value(x) OVER a AS f, last_value(x) OVER a AS l"


@query(
    "delta_features",
    UNIT + ", e AS (SELECT *, first_value(x) OVER a AS f, last_value(x) OVER a AS l FROM u WINDOW a AS (PARTITION BY signal_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT signal_id, idx, round((coalesce(lead(x) OVER w, l) - coalesce(lag(x) OVER w, f) + 2 * (coalesce(lead(x, 2) OVER w, l) - coalesce(lag(x, 2) OVER w, f))) / 10, 6) + 0.0 AS delta FROM e WINDOW w AS (PARTITION BY signal_id ORDER BY idx)",
)
def delta_features(spark, d):
    return S.deltas(unit(spark, d)).select("signal_id", "idx", r("delta", 6).alias("delta"))


@query("three_bin_smooth", UNIT + " SELECT signal_id, idx, round((coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3, 6) + 0.0 AS y FROM u WINDOW w AS (PARTITION BY signal_id ORDER BY idx)")
def three_bin_smooth(spark, d):
    return S.smooth3(unit(spark, d)).select("signal_id", "idx", r("y", 6).alias("y"))


@query("envelope_smooth", UNIT + " SELECT signal_id, idx, round(avg(x) OVER (PARTITION BY signal_id ORDER BY idx ROWS BETWEEN 20 PRECEDING AND 20 FOLLOWING), 6) + 0.0 AS y FROM u")
def envelope_smooth(spark, d):
    return S.smooth(unit(spark, d), 20).select("signal_id", "idx", r("y", 6).alias("y"))


@query("rolling_min_floor", SIG + " SELECT signal_id, idx, min(x) OVER (PARTITION BY signal_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS low FROM sig")
def rolling_min_floor(spark, d):
    return S.rolling_min(signals(spark, d), 5).select("signal_id", "idx", "low")


_W = [2.718281828459045 ** (-k / (4 * 0.8)) for k in range(4)]


@query(
    "dereverb_weighted",
    SIG
    + f" SELECT signal_id, idx, round(CASE WHEN row_number() OVER w >= 4 THEN x * greatest(0.1, 1 - 0.3 * ((coalesce(lag(x, 1) OVER w, 0) * {_W[0]} + coalesce(lag(x, 2) OVER w, 0) * {_W[1]} + coalesce(lag(x, 3) OVER w, 0) * {_W[2]} + x * {_W[3]}) / {sum(_W)}) / (x + 1e-10)) ELSE x END, 4) + 0.0 AS y FROM sig WINDOW w AS (PARTITION BY signal_id ORDER BY idx)",
)
def dereverb_weighted(spark, d):
    return S.dereverb(signals(spark, d), 4, 0.3, 0.8).select("signal_id", "idx", r("y").alias("y"))


@query("vad_hangover", SIG + " SELECT signal_id, idx, CASE WHEN x > 150 THEN 1.0 WHEN idx - max(CASE WHEN x > 150 THEN idx END) OVER (PARTITION BY signal_id ORDER BY idx) <= 3 THEN 0.5 ELSE 0.0 END::DOUBLE AS conf FROM sig")
def vad_hangover(spark, d):
    return S.hangover(signals(spark, d), F.col("x") > 150, 3).select("signal_id", "idx", "conf")


@query("live_vad_blocks", UNIT + " SELECT signal_id, idx // 8 AS b FROM u GROUP BY ALL HAVING sqrt(avg(x * x)) > 0.3")
def live_vad_blocks(spark, d):
    return S.blocks(unit(spark, d), 8).groupBy("signal_id", "b").agg(L.rms().alias("level")).where("level > 0.3").select("signal_id", "b")


@query(
    "xcorr_lag",
    SIG
    + """, z AS (SELECT l_partkey AS signal_id, row_number() OVER (PARTITION BY l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx, l_quantity AS a, l_discount * 100 AS b FROM lineitem),
j AS (SELECT l.signal_id, r.idx - l.idx AS lag, sum(l.a * r.b) AS score FROM z l JOIN z r ON r.signal_id = l.signal_id AND r.idx - l.idx BETWEEN -3 AND 3 GROUP BY ALL)
SELECT signal_id, arg_min(lag, (-round(score, 6), lag)) AS lag, max(round(score, 6)) AS score FROM j GROUP BY signal_id""",
)
def xcorr_lag(spark, d):
    from undertone.sources.tables import ordered, table

    rows = ordered(table(spark, d, "lineitem").withColumnRenamed("l_partkey", "signal_id"), "signal_id", "l_shipdate", "l_orderkey", "l_linenumber")
    a, b = rows.select("signal_id", "idx", F.col("l_quantity").alias("x")), rows.select("signal_id", "idx", (F.col("l_discount") * 100).alias("x"))
    return S.lagged_correlation(a, b, 3, chunk=CUT)


@query("feature_mean_std", UNIT + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS r FROM u GROUP BY ALL) SELECT signal_id, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS std FROM p GROUP BY signal_id")
def feature_mean_std(spark, d):
    part = S.blocks(unit(spark, d), 8).groupBy("signal_id", "b").agg(L.rms().alias("v"))
    return part.groupBy("signal_id").agg(r(F.avg("v"), 6).alias("mean"), r(F.stddev_pop("v"), 6).alias("std"))


@query("soft_limiter", UNIT + f", p AS (SELECT signal_id, idx, x, {10 ** (-6 / 20)!r}::DOUBLE AS c FROM u) SELECT signal_id, idx, round(CASE WHEN abs(x) <= 0.7079 * c THEN x ELSE sign(x) * (0.7079 * c + (c - 0.7079 * c) * tanh((abs(x) - 0.7079 * c) / (c - 0.7079 * c))) END, 6) + 0.0 AS y FROM p")
def soft_limiter(spark, d):
    return unit(spark, d).select("signal_id", "idx", r(P.soft_limit("x", -6.0), 6).alias("y"))


@query("downward_expander", UNIT + " SELECT signal_id, idx, round(CASE WHEN x <> 0 AND -12 - 20 * log10(abs(x)) > 0 THEN x * pow(10, -(-12 - 20 * log10(abs(x))) * 1.0 / 20) ELSE x END, 6) + 0.0 AS y FROM u")
def downward_expander(spark, d):
    return unit(spark, d).select("signal_id", "idx", r(P.expand_down("x", -12.0, 2.0), 6).alias("y"))


@query("gain_and_clamp", UNIT + " SELECT signal_id, idx, round(greatest(-1.0, least(1.0, x * pow(10, 6.0 / 20))), 6) + 0.0 AS y FROM u")
def gain_and_clamp(spark, d):
    return unit(spark, d).select("signal_id", "idx", r(P.clamp(P.gain("x", 6.0), -1.0, 1.0), 6).alias("y"))


@query("watermark", UNIT + " SELECT signal_id, idx, round(x + 0.01 * sin(idx * (2 * pi() * 19000.0 / 48000)), 6) + 0.0 AS y FROM u")
def watermark(spark, d):
    return unit(spark, d).select("signal_id", "idx", r(P.watermark("x", "idx", 48000), 6).alias("y"))


@query("tanh_shaper", UNIT + " SELECT signal_id, idx, round(tanh(x * 3.0) / tanh(3.0), 6) + 0.0 AS y FROM u")
def tanh_shaper(spark, d):
    return unit(spark, d).select("signal_id", "idx", r(P.shaper("x", 3.0), 6).alias("y"))


@query("meter_percent", UNIT + ", p AS (SELECT signal_id, sqrt(avg(x * x)) AS r FROM u GROUP BY signal_id) SELECT signal_id, round(greatest(0.0, least(100.0, (CASE WHEN r > 0 THEN 20 * log10(r) ELSE -60.0 END + 60) / 60 * 100)), 4) AS pct FROM p")
def meter_percent(spark, d):
    return unit(spark, d).groupBy("signal_id").agg(L.rms().alias("v")).select("signal_id", r(P.meter_percent("v")).alias("pct"))


@query("dither_tpdf")
def dither_tpdf(spark, d):
    return unit(spark, d).select("signal_id", "idx", P.dither("x", 16, 7).alias("y"))


_TWO = "SELECT l_orderkey, l_linenumber, l_quantity / 50.7 AS l, l_discount * 9.7 AS rr FROM lineitem"


def _stereo(spark, d):
    from undertone.sources.tables import table

    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") / 50.7).alias("l"), (F.col("l_discount") * 9.7).alias("r"))


def _pair(name, sql, f):
    def run(spark, d):
        left, right = f(F.col("l"), F.col("r"))
        return _stereo(spark, d).groupBy("l_orderkey", "l_linenumber").agg(F.round(F.sum(left), 4).alias("left_out"), F.round(F.sum(right), 4).alias("right_out"))

    query(name, f"SELECT l_orderkey, l_linenumber, round(sum({sql[0]}), 4) + 0.0 AS left_out, round(sum({sql[1]}), 4) + 0.0 AS right_out FROM ({_TWO}) GROUP BY ALL")(run)


_pair("mid_side", ("(l + rr) / 2 + (l - rr) / 2 * 1.5", "(l + rr) / 2 - (l - rr) / 2 * 1.5"), lambda a, b: P.widen(a, b, 150.0))
_pair("crosstalk", ("l - 0.2 * rr", "rr - 0.2 * l"), lambda a, b: P.crosstalk(a, b, 40.0))


@query("dry_wet", UNIT + ", w AS (SELECT signal_id, idx, CASE WHEN abs(x) < 0.1 THEN 0.0 ELSE x END AS y FROM u) SELECT u.signal_id, u.idx, round(u.x * 0.3 + w.y * 0.7, 6) + 0.0 AS y FROM u JOIN w ON w.signal_id = u.signal_id AND w.idx = u.idx")
def dry_wet(spark, d):
    dry = unit(spark, d).select("signal_id", "idx", "x")
    wet = dry.select("signal_id", "idx", F.when(F.abs("x") < 0.1, 0.0).otherwise(F.col("x")).alias("y"))
    return dry.join(wet, ["signal_id", "idx"]).select("signal_id", "idx", r(P.mix("x", "y", 0.7), 6).alias("y"))


@query(
    "scene_scores",
    UNIT
    + _RANK
    + _RANGE
    + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS r FROM u WHERE idx // 8 < 20 GROUP BY ALL HAVING count(*) = 8), q AS (SELECT signal_id, abs(r - lag(r) OVER (PARTITION BY signal_id ORDER BY b)) AS d FROM p), fl AS (SELECT signal_id, coalesce(avg(d), 0.0) AS flux FROM q GROUP BY signal_id), fp AS (SELECT signal_id, CASE WHEN (x >= 0) <> lag(x >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip, x FROM u), st AS (SELECT signal_id, sum(flip) / count(*) AS zcr, max(abs(x)) / (sqrt(avg(x * x)) + 1e-10) AS crest, 1000 + 50.0 * sum(flip) AS centroid FROM fp GROUP BY signal_id), z AS (SELECT signal_id, zcr, crest, centroid, flux, dynamic_range AS rng FROM st JOIN fl USING (signal_id) JOIN g USING (signal_id)), s AS (SELECT signal_id, "
    + ", ".join(
        "("
        + " + ".join(f"CASE WHEN {('rng' if f == 'range' else f)} BETWEEN {lo} AND {hi} THEN {w} ELSE {w} * greatest(0, 1 - (abs({('rng' if f == 'range' else f)} - ({lo} + {hi}) / 2.0) - ({hi} - {lo}) / 2.0) / (({hi} - {lo}) / 2.0)) END" for f, lo, hi, w in parts)
        + f") / {sum(p[3] for p in parts)} AS {name}"
        for name, parts in L.SCENES.items()
    )
    + " FROM z) SELECT signal_id, "
    + ", ".join(f"round({n}, 4) AS {n}" for n in L.SCENES)
    + ", CASE "
    + " ".join(f"WHEN round({n}, 9) = greatest({', '.join(f'round({m}, 9)' for m in L.SCENES)}) THEN '{n}'" for n in L.SCENES)
    + " END AS scene FROM s",
)
def scene_scores(spark, d):
    u = unit(spark, d)
    base = u.groupBy("signal_id").agg((F.max(F.abs("x")) / (L.rms() + 1e-10)).alias("crest"))
    z = S.zero_crossings(u).select("signal_id", (F.col("crossings") / F.col("n")).alias("zcr"), (1000 + 50.0 * F.col("crossings")).alias("centroid"))
    rows = base.join(z, "signal_id").join(L.flux(u, 8, 20), "signal_id").join(L.dynamic_range(u).withColumnRenamed("dynamic_range", "range"), "signal_id")
    scores = L.scene_scores()
    return rows.select("signal_id", *(r(s).alias(n) for n, s in scores.items()), L.best_of(scores).alias("scene"))


@query(
    "quality_mos",
    UNIT
    + ", p AS (SELECT signal_id, idx // 8 AS b, sqrt(avg(x * x)) AS r FROM u WHERE idx // 8 < 20 GROUP BY ALL HAVING count(*) = 8), q AS (SELECT signal_id, abs(r - lag(r) OVER (PARTITION BY signal_id ORDER BY b)) AS d FROM p), fl AS (SELECT signal_id, coalesce(avg(d), 0.0) AS flux FROM q GROUP BY signal_id), fp AS (SELECT signal_id, CASE WHEN (x >= 0) <> lag(x >= 0) OVER (PARTITION BY signal_id ORDER BY idx) THEN 1 ELSE 0 END AS flip FROM u), st AS (SELECT signal_id, sum(flip) / count(*) AS zcr, 1000 + 50.0 * sum(flip) AS centroid FROM fp GROUP BY signal_id) SELECT signal_id, round(greatest(1.0, least(5.0, 3.0 + CASE WHEN centroid BETWEEN 1000 AND 3500 THEN 0.5 WHEN centroid < 500 OR centroid > 6000 THEN -0.5 ELSE 0 END + CASE WHEN flux > 0.1 AND flux < 0.5 THEN 0.2 WHEN flux > 0.8 THEN -0.3 ELSE 0 END + CASE WHEN zcr BETWEEN 0.05 AND 0.25 THEN 0.3 ELSE 0 END)), 1) AS mos, least(100, floor(centroid / 40 + 0.5))::BIGINT AS clarity, floor((1 - least(1.0, flux)) * 100 + 0.5)::BIGINT AS naturalness FROM st JOIN fl USING (signal_id)",
)
def quality_mos(spark, d):
    u = unit(spark, d)
    z = S.zero_crossings(u).select("signal_id", (F.col("crossings") / F.col("n")).alias("zcr"), (1000 + 50.0 * F.col("crossings")).alias("centroid"))
    rows = z.join(L.flux(u, 8, 20), "signal_id")
    return rows.select("signal_id", r(L.voice_quality("centroid", "zcr", "flux"), 1).alias("mos"), F.least(F.lit(100), P.half_up(F.col("centroid") / 40)).cast("bigint").alias("clarity"), P.half_up((1 - F.least(F.lit(1.0), F.col("flux"))) * 100).cast("bigint").alias("naturalness"))
