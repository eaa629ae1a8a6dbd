"""Queries over frames of 64 samples: transforms, bands, masks and features."""

from __future__ import annotations

from pyspark.sql import functions as F

from undertone.functions import pointwise as P
from undertone.functions import spectrum as K
from undertone.operators import frames as O
from undertone.operators import levels as L
from undertone.plans.registry import query
from undertone.plans.signals import UNIT, r, unit
from undertone.sources.tables import frames

SR, N, BINS = 16_000.0, 64, 33
BIN_HZ = SR / N

S = """WITH e AS (SELECT label::BIGINT AS signal_id, vec_id AS f, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
k AS (SELECT range AS k FROM range(33)),
d AS (SELECT signal_id, f, k, sum(v * cos(2 * pi() * k * i / 64)) AS re, -sum(v * sin(2 * pi() * k * i / 64)) AS im FROM e, k GROUP BY ALL),
m AS (SELECT signal_id, f, k, sqrt(re * re + im * im) AS m FROM d),
w AS (SELECT signal_id, f, k, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * cos(2 * pi() * k * i / 64)) AS re, sum(v * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * k * i / 64)) AS im FROM e, k GROUP BY ALL),
p AS (SELECT signal_id, f, k, re * re + im * im AS p FROM w)"""


def mags(spark, d):
    return O.spectra(frames(spark, d))


def powers(spark, d):
    return O.per_frame(frames(spark, d), K.power, ("power",))


def values(df, column, digits, name="y"):
    """A row for each element of an array column."""
    return df.select("signal_id", "f", F.posexplode(column).alias("k", name)).withColumns({"k": F.col("k").cast("bigint"), name: F.round(name, digits)})


@query("dft_magnitude", S + " SELECT signal_id, f, k, round(m, 5) AS y FROM m")
def dft_magnitude(spark, d):
    return values(mags(spark, d), "mag", 5)


@query("power_spectrum", S + " SELECT signal_id, f, k, round(p, 5) AS y FROM p")
def power_spectrum(spark, d):
    return values(powers(spark, d), "power", 5)


@query("mean_spectrum", S + " SELECT signal_id, k, round(avg(m), 5) AS mean FROM m GROUP BY ALL")
def mean_spectrum(spark, d):
    return O.mean_spectrum(mags(spark, d)).select("signal_id", F.col("k").cast("bigint").alias("k"), r("mean", 5).alias("mean"))


@query("gated_noise_profile", S + ", t AS (SELECT signal_id, f, sqrt(avg(v * v)) AS level FROM e GROUP BY ALL) SELECT m.signal_id, k, round(avg(m), 5) AS mean FROM m JOIN t ON t.f = m.f AND t.signal_id = m.signal_id WHERE level <= 1.0 GROUP BY ALL")
def gated_noise_profile(spark, d):
    level = F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples"))
    return O.mean_spectrum(mags(spark, d), where=level <= 1.0).select("signal_id", F.col("k").cast("bigint").alias("k"), r("mean", 5).alias("mean"))


@query("head_noise_psd", S + ", n AS (SELECT *, dense_rank() OVER (PARTITION BY signal_id ORDER BY f) AS place FROM m) SELECT signal_id, k, round(greatest(avg(m * m), 1e-6), 5) AS psd FROM n WHERE place <= 5 GROUP BY ALL")
def head_noise_psd(spark, d):
    from pyspark.sql import Window

    head = mags(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("signal_id").orderBy("f"))).where("place <= 5")
    rows = O.bins(head).groupBy("signal_id", "k").agg(F.avg(F.col("m") * F.col("m")).alias("v"))
    return rows.select("signal_id", F.col("k").cast("bigint").alias("k"), r(F.greatest(F.col("v"), F.lit(1e-6)), 5).alias("psd"))


@query("bin_minimum", S + " SELECT signal_id, k, round(min(p), 6) AS low FROM p GROUP BY ALL")
def bin_minimum(spark, d):
    return O.bins(powers(spark, d), column="power").groupBy("signal_id", F.col("k").cast("bigint").alias("k")).agg(r(F.min("m"), 6).alias("low"))


_BANDS = [("sub", 0, 1), ("bass", 1, 3), ("mid", 3, 8), ("high", 8, 24), ("air", 24, 32)]
_BAND_SQL = ", ".join(f"('{b}', {lo}, {hi})" for b, lo, hi in _BANDS)


def _bands(spark):
    return spark.createDataFrame(_BANDS, "band string, lo int, hi int")


@query("band_energy", S + f", b AS (SELECT * FROM (VALUES {_BAND_SQL}) t(band, lo, hi)) SELECT signal_id, f, band, round(avg(m * m), 4) AS energy FROM m JOIN b ON k BETWEEN lo AND hi GROUP BY ALL")
def band_energy(spark, d):
    return O.banded(mags(spark, d), _bands(spark)).select("signal_id", "f", "band", r("energy").alias("energy"))


@query("erb_bands", "SELECT i::BIGINT AS band, floor(greatest(0, (pow(10, e / 21.4) - 1) / 0.00437 / 8000 * 32))::BIGINT AS lo, least(32, ceil((pow(10, e2 / 21.4) - 1) / 0.00437 / 8000 * 32))::BIGINT AS hi FROM (SELECT range AS i, lo + (top - lo) * range / 8 AS e, lo + (top - lo) * (range + 1) / 8 - CASE WHEN range = 7 THEN 1e-9 ELSE 0 END AS e2 FROM range(8), (SELECT 21.4 * log10(1 + 0.00437 * 20) AS lo, 21.4 * log10(1 + 0.00437 * 8000) AS top))")
def erb_bands(spark, d):
    low, top = P.hz_to_erb(F.lit(20.0)), P.hz_to_erb(F.lit(8000.0))
    rows = spark.range(8).withColumns({"e": low + (top - low) * F.col("id") / 8, "e2": low + (top - low) * (F.col("id") + 1) / 8})
    at = lambda e: P.erb_to_hz(F.col(e)) / 8000 * (BINS - 1)
    return rows.select(F.col("id").alias("band"), F.floor(at("e")).alias("lo"), F.least(F.lit(BINS - 1), F.ceil(at("e2") - 1e-9)).cast("bigint").alias("hi"))


@query("spectral_flatness", S + " SELECT signal_id, f, round(exp(avg(ln(greatest(p, 1e-10)))) / avg(greatest(p, 1e-10)), 6) AS flatness FROM p GROUP BY ALL")
def spectral_flatness(spark, d):
    return powers(spark, d).select("signal_id", "f", r(O.flatness("power"), 6).alias("flatness"))


@query("spectral_centroid", S + " SELECT signal_id, f, round(CASE WHEN sum(p) > 0 THEN 8000.0 / 33 * sum(k * p) / sum(p) ELSE 1000.0 END, 3) AS centroid FROM p GROUP BY ALL")
def spectral_centroid(spark, d):
    return powers(spark, d).select("signal_id", "f", r(O.centroid(SR, "power"), 3).alias("centroid"))


@query("adaptive_mask", S + ", a AS (SELECT signal_id, k, avg(p) / (min(p) + 1e-10) AS snr FROM p GROUP BY ALL) SELECT signal_id, k, round(pow(greatest(0, 1 - 1.2 / snr), 1.5), 5) AS mask FROM a")
def adaptive_mask(spark, d):
    return O.adaptive_mask(powers(spark, d), 0.6).select("signal_id", F.col("k").cast("bigint").alias("k"), r("mask", 5).alias("mask"))


def _cos_edge(lo, hi, lw, hw):
    return f"CASE WHEN k <= {lo - lw} THEN 0.0 WHEN k < {lo} THEN 0.5 - 0.5 * cos(pi() * (k - {lo - lw}) / {lw}) WHEN k <= {hi} THEN 1.0 WHEN k < {hi + hw} THEN 0.5 + 0.5 * cos(pi() * (k - {hi}) / {hw}) ELSE 0.0 END"


def _gain(spark, d, name, column, digits=5):
    """Frames times a gain by bin."""
    return O.bins(mags(spark, d)).select("signal_id", "f", F.col("k").cast("bigint").alias("k"), r(F.col("m") * column, digits).alias(name))


@query("band_mask", S + f" SELECT signal_id, f, k, round(m * (0.2 + (1.4 - 0.2) * ({_cos_edge(2, 14, 4, 4)})), 5) AS y FROM m")
def band_mask(spark, d):
    return _gain(spark, d, "y", P.band_mask("k", 2, 14, 0.2, 1.4))


def _notch_sql(sounds):
    out = ["1.0"]
    for s in sounds:
        for a, b in P.SOUNDS[s]:
            lo, hi = (min(BINS - 1, max(0, int(h / BIN_HZ + 0.5))) for h in (a, b))
            w = max(4, int(((hi - lo) or 4) * 0.26 + 0.5))
            out.append(f"1 + (0.04 - 1) * ({_cos_edge(lo, hi, w, w)})")
    return "least(" + ", ".join(out) + ")"


@query("category_notch", S + f" SELECT signal_id, f, k, round(m * ({_notch_sql(['traffic', 'bird'])} + 0.5 * (1 - {_notch_sql(['traffic', 'bird'])}) * 0.85), 5) AS y FROM m")
def category_notch(spark, d):
    mask = P.notch_mask("k", ["traffic", "bird"], BINS, BIN_HZ)
    return _gain(spark, d, "y", mask + 0.5 * (1 - mask) * 0.85)


@query("spectral_tilt", S + " SELECT signal_id, f, k, round(m * greatest(0.01, least(10.0, pow(10, CASE WHEN k > 0 THEN log2(k * 250.0 / 1000) ELSE 0 END * 3.0 / 20))), 5) AS y FROM m")
def spectral_tilt(spark, d):
    return _gain(spark, d, "y", P.tilt(F.col("k") * BIN_HZ, 3.0))


@query("voice_weight", S + " SELECT signal_id, f, k, round(m * CASE WHEN k * 250 < 40 THEN 0.3 WHEN k * 250 < 80 THEN 0.6 WHEN k * 250 < 200 THEN 0.9 WHEN k * 250 <= 4000 THEN 1.0 WHEN k * 250 <= 6000 THEN 0.9 WHEN k * 250 <= 9000 THEN 0.75 WHEN k * 250 <= 12000 THEN 0.55 ELSE 0.4 END, 5) AS y FROM m")
def voice_weight(spark, d):
    return _gain(spark, d, "y", P.voice_weight(F.col("k") * BIN_HZ))


@query("live_band_focus", S + " SELECT signal_id, f, k, round(m * CASE WHEN k BETWEEN 2 AND 14 THEN 1 + 0.5 * 0.8 ELSE 1 - 0.95 * 0.6 END, 5) AS y FROM m")
def live_band_focus(spark, d):
    return _gain(spark, d, "y", P.focus("k", 2, 14, 0.8, 0.6))


@query("hard_band_suppress", S + " SELECT signal_id, f, k, round(CASE WHEN k BETWEEN 2 AND 14 THEN m ELSE m * 0.3 END, 5) AS y FROM m")
def hard_band_suppress(spark, d):
    return _gain(spark, d, "y", F.when(F.col("k").between(2, 14), 1.0).otherwise(0.3))


_PROFILE = ", n AS (SELECT k, avg(m) AS n FROM m GROUP BY k)"


def _with_profile(spark, d):
    m = mags(spark, d)
    profile = O.bins(m).groupBy("k").agg(F.avg("m").alias("n"))
    return O.bins(m).join(F.broadcast(profile), "k")  # one row a bin: 33 of them


@query("wiener_gain", S + _PROFILE + " SELECT signal_id, f, k, round(greatest(0.008, least(1.0, (m * m / greatest(1.5 * n * n, 1e-12)) / (m * m / greatest(1.5 * n * n, 1e-12) + 1))), 5) AS gain FROM m JOIN n USING (k)")
def wiener_gain(spark, d):
    return _with_profile(spark, d).select("signal_id", "f", F.col("k").cast("bigint").alias("k"), r(P.wiener_gain("m", "n"), 5).alias("gain"))


@query("wiener_mmse", S + _PROFILE + " SELECT signal_id, f, k, round(m * greatest(0.01, 1 - 0.5 * n * n / (m * m + 1e-10)), 5) AS y FROM m JOIN n USING (k)")
def wiener_mmse(spark, d):
    return _with_profile(spark, d).select("signal_id", "f", F.col("k").cast("bigint").alias("k"), r(F.col("m") * P.mmse_gain("m", "n", 0.5), 5).alias("y"))


@query("vad_attenuation", S + ", t AS (SELECT signal_id, f, least(1.0, sqrt(avg(v * v))) AS c FROM e GROUP BY ALL) SELECT m.signal_id, m.f, k, round(m * (1 - 0.7 * 0.8 * (1 - c)), 5) AS y FROM m JOIN t ON t.signal_id = m.signal_id AND t.f = m.f")
def vad_attenuation(spark, d):
    conf = F.least(F.lit(1.0), F.sqrt(F.aggregate("samples", F.lit(0.0), lambda a, v: a + v * v) / F.size("samples")))
    rows = O.bins(mags(spark, d).withColumn("c", conf))
    return rows.select("signal_id", "f", F.col("k").cast("bigint").alias("k"), r(F.col("m") * P.vad_attenuation("c", 0.7), 5).alias("y"))


@query("harmonic_peaks", S.replace("WITH e", "WITH RECURSIVE e", 1) + ", n AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS c, lead(m, 2) OVER w AS d FROM m WINDOW w AS (PARTITION BY signal_id, f ORDER BY k)), r AS (SELECT signal_id, f, k, m AS y, a AS before FROM n WHERE k = 1 UNION ALL SELECT n.signal_id, n.f, n.k, CASE WHEN n.m > r.y AND n.m > r.before AND n.m > n.c AND n.m > n.d THEN n.m * 1.3 ELSE n.m END, r.y FROM r JOIN n ON n.signal_id = r.signal_id AND n.f = r.f AND n.k = r.k + 1) SELECT signal_id, f, k, round(y, 5) AS y FROM r UNION ALL SELECT signal_id, f, k, round(m, 5) FROM m WHERE k = 0")
def harmonic_peaks(spark, d):
    return values(O.per_frame(mags(spark, d), lambda m: K.boost_peaks(m, 1.3), ("y",), column="mag"), "y", 5)


@query(
    "noise_class_scores",
    S
    + f", b AS (SELECT * FROM (VALUES {_BAND_SQL}) t(band, lo, hi)), g AS (SELECT signal_id, f, band, avg(m * m) AS e FROM m JOIN b ON k BETWEEN lo AND hi GROUP BY ALL), h AS (SELECT signal_id, f, max(e) FILTER (band = 'sub') AS sub, max(e) FILTER (band = 'bass') AS bass, max(e) FILTER (band = 'mid') AS mid, max(e) FILTER (band = 'high') AS high, max(e) FILTER (band = 'air') AS air FROM g GROUP BY ALL), q AS (SELECT signal_id, f, exp(avg(ln(greatest(m, 1e-10)))) / avg(greatest(m, 1e-10)) AS flat FROM m GROUP BY ALL), s AS (SELECT h.signal_id, h.f, sub + bass + mid + high + air + 1e-20 AS t, h.*, flat FROM h JOIN q ON q.f = h.f AND q.signal_id = h.signal_id), z AS (SELECT signal_id, f, (bass + mid) / t * 2 * (1 - flat) + CASE WHEN bass / t > 0.35 AND flat < 0.25 THEN 1.5 ELSE 0 END AS music, flat * 3 AS white_noise, mid / t * 2 * CASE WHEN flat > 0.3 THEN 1.0 ELSE 0.5 END AS crowd, (sub + bass) / t * 2 * (1 - flat * 0.5) AS HVAC, (high + air) / t * 2 * (1 - flat) AS keyboard, (sub + bass * 0.5) / t * 1.5 AS traffic FROM s) SELECT signal_id, f, round(white_noise, 4) AS white_noise, round(music, 4) AS music, CASE WHEN round(music, 9) = g THEN 'music' WHEN round(white_noise, 9) = g THEN 'white_noise' WHEN round(crowd, 9) = g THEN 'crowd' WHEN round(HVAC, 9) = g THEN 'HVAC' WHEN round(keyboard, 9) = g THEN 'keyboard' ELSE 'traffic' END AS kind FROM (SELECT *, greatest(round(music, 9), round(white_noise, 9), round(crowd, 9), round(HVAC, 9), round(keyboard, 9), round(traffic, 9)) AS g FROM z)",
)
def noise_class_scores(spark, d):
    m = mags(spark, d).withColumn("flat", O.flatness("mag"))
    e = O.banded(m.withColumn("g", F.struct("f", "flat")), _bands(spark), keys=("signal_id", "g")).groupBy("signal_id", "g").pivot("band", [b for b, _, _ in _BANDS]).agg(F.max("energy"))
    s = L.noise_scores("sub", "bass", "mid", "high", "air", F.col("g.flat"))
    return e.select("signal_id", F.col("g.f").alias("f"), r(s["white_noise"]).alias("white_noise"), r(s["music"]).alias("music"), L.best_of(s).alias("kind"))


@query("noise_strategy", "SELECT * FROM (VALUES ('HVAC', 'smoothing_ms=80'), ('crowd', 'multi_speaker,target-only'), ('keyboard', 'none'), ('music', 'over_subtraction=1.6')) t(kind, strategy)")
def noise_strategy(spark, d):
    return spark.createDataFrame([("HVAC",), ("crowd",), ("keyboard",), ("music",)], "kind string").withColumn("strategy", L.noise_strategy(F.col("kind")))


@query("autocorr_pitch", S + ", a AS (SELECT x.signal_id, x.f, y.i - x.i AS lag, round(sum(x.v * y.v), 9) AS s FROM e x JOIN e y ON y.f = x.f AND y.signal_id = x.signal_id AND y.i - x.i BETWEEN 32 AND 63 GROUP BY ALL) SELECT signal_id, f, round(16000.0 / arg_min(lag, (-s, lag)), 4) AS pitch FROM a GROUP BY ALL")
def autocorr_pitch(spark, d):
    return frames(spark, d).select("signal_id", "f", r(O.pitch(SR, 80.0, 500.0)).alias("pitch"))


@query(
    "perceptual_quality",
    S
    + """, c AS (SELECT f, i, v, CASE WHEN abs(v) < 0.05 THEN 0.0 ELSE v END AS u, signal_id FROM e), n AS (SELECT signal_id, f, 10 * log10(sum(v * v) / (sum((v - u) * (v - u)) + 1e-10)) AS snr FROM c GROUP BY ALL),
w2 AS (SELECT signal_id, f, k, sum(u * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * cos(2 * pi() * k * i / 64)) AS re, sum(u * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * k * i / 64)) AS im FROM c, k GROUP BY ALL),
t AS (SELECT w2.signal_id, w2.f, sqrt(avg((ln(greatest(p.p, 1e-6)) - ln(greatest(re * re + im * im, 1e-6))) ** 2)) AS distance FROM w2 JOIN p ON p.signal_id = w2.signal_id AND p.f = w2.f AND p.k = w2.k GROUP BY ALL),
o AS (SELECT signal_id, f, snr, distance, least(5.0, greatest(1.0, 1 + snr / 10)) AS a, least(5.0, greatest(1.0, 5 - 2 * distance)) AS b FROM n JOIN t USING (signal_id, f))
SELECT signal_id, f, round(snr, 4) + 0.0 AS snr_db, round(distance, 4) AS distance, round(0.6 * a + 0.4 * b, 4) AS mos, round((0.6 * a + 0.4 * b - 1) / 4 * 5 - 0.5, 4) + 0.0 AS pesq_like FROM o""",
)
def perceptual_quality(spark, d):
    """Frames against themselves without their quiet samples; powers under 1e-6 are silence."""
    kept = F.transform("samples", lambda v: F.when(F.abs(v) < 0.05, 0.0).otherwise(v))
    fold = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v * v)
    rows = frames(spark, d).withColumn("u", kept).withColumn("e", F.zip_with("samples", "u", lambda a, b: a - b))
    rows = O.per_frame(O.per_frame(rows, K.power, ("power",)), K.power, ("shaped",), column="u")
    snr = 10 * F.log10(fold("samples") / (fold("e") + 1e-10))
    found = L.perceptual(snr, L.log_distance("power", "shaped", 1e-6))
    return rows.select("signal_id", "f", *(r(c).alias(n) for n, c in found.items()))


@query("bucket_mean_pool", "WITH e AS (SELECT label::BIGINT AS signal_id, vec_id AS f, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), p AS (SELECT signal_id, f, i // 2 AS b, avg(v) AS m FROM e GROUP BY ALL), n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY signal_id, f)) AS norm FROM p) SELECT signal_id, f, b, round(m / norm, 5) + 0.0 AS y FROM n")
def bucket_mean_pool(spark, d):
    pooled = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: (F.get("samples", b * 2) + F.get("samples", b * 2 + 1)) / 2)
    norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, v: a + v * v))
    rows = frames(spark, d).withColumn("p", pooled).withColumn("n", norm)
    return rows.select("signal_id", "f", F.posexplode("p").alias("b", "v"), "n").select("signal_id", "f", F.col("b").cast("bigint").alias("b"), r(F.col("v") / F.col("n"), 5).alias("y"))


@query("hann_windows", "SELECT range AS i, round(0.5 - 0.5 * cos(2 * pi() * range / 64), 9) AS periodic, round(0.5 - 0.5 * cos(2 * pi() * range / 63), 9) AS symmetric FROM range(64)")
def hann_windows(spark, d):
    w = lambda n: r(0.5 - 0.5 * F.cos(2 * F.pi() * F.col("id") / n), 9)
    return spark.range(64).select(F.col("id").alias("i"), w(64).alias("periodic"), w(63).alias("symmetric"))


@query("istft_overlap_add", UNIT + ", n AS (SELECT signal_id, 32 + (count(*) - 32) // 8 * 8 AS n FROM u GROUP BY signal_id HAVING count(*) >= 32) SELECT u.signal_id, u.idx, round(CASE WHEN idx > 0 THEN x ELSE 0.0 END, 6) + 0.0 AS x FROM u JOIN n USING (signal_id) WHERE idx < n")
def istft_overlap_add(spark, d):
    """A round trip: what comes back is the signal, as far as full frames reach (the first sample meets no window)."""
    return O.istft(O.stft(unit(spark, d), 32, 8), 8).select("signal_id", "idx", r("x", 6).alias("x"))


def _kernel(name, kernel, source="mag"):
    def run(spark, d):
        base = powers(spark, d) if source == "power" else mags(spark, d)
        return values(O.per_signal(base, kernel, "y", columns=(source,)), "y", 5)

    query(name)(run)


def _frame_kernel(name, kernel, source="mag"):
    """Frames one by one: no frame needs another one, so nothing is shuffled."""

    def run(spark, d):
        base = powers(spark, d) if source == "power" else mags(spark, d)
        return values(O.per_frame(base, kernel, ("y",), column=source), "y", 5)

    query(name)(run)


_kernel("erb_gate", lambda m: K.erb_gate(m, -10.0, SR, 64, 8))


@query("log_band_wiener")
def log_band_wiener(spark, d):
    """The noise is a quarter of the power of the mean magnitudes, which are aggregated apart and joined back, one array for each signal."""
    m = mags(spark, d)
    means = O.mean_spectrum(m).groupBy("signal_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "mean"))), lambda s: F.pow(s["mean"] * 0.5, F.lit(2.0))).alias("noise"))
    return values(O.per_signal(m.join(means, "signal_id"), lambda m, n: K.band_wiener(m, n[0], SR, 6), "y", columns=("mag", "noise")), "y", 5)


_kernel("min_stat_floor", lambda m: K.minimum_floor(m, np_level(m) < 8, 10))
_kernel("adaptive_wiener", lambda m: K.adaptive_wiener(m, (np_level(m) > 8).astype(float)))
_frame_kernel("harmonic_v2", lambda m: K.enhance_harmonics(m, 50.0, 32_000.0))
_frame_kernel("formant_shift", lambda m: K.shift_formants(m, 3.0, 4))
_kernel("wiener_mask_build", lambda m: K.build_mask(m, np_level(m) > 8, warm=20))
_frame_kernel("mfcc", lambda p: K.mfcc(p, SR), "power")


_OWN = ", o AS (SELECT signal_id, k, avg(m) * 0.5 AS n FROM m GROUP BY ALL)"


def _with_own_noise(spark, d):
    """Bins with half their mean over the signal's frames; the means are one aggregation, joined back by signal and bin."""
    m = O.bins(mags(spark, d))
    return m.join(m.groupBy("signal_id", "k").agg((F.avg("m") * 0.5).alias("n")), ["signal_id", "k"])


@query("over_subtract", S + _OWN + " SELECT m.signal_id, f, m.k, round(0.5 * m + 0.5 * greatest(m - 2.5 * n, greatest(0.1 * m, 1e-7)), 5) AS y FROM m JOIN o ON o.signal_id = m.signal_id AND o.k = m.k")
def over_subtract(spark, d):
    left = F.greatest(F.col("m") - 2.5 * F.col("n"), F.greatest(0.1 * F.col("m"), F.lit(1e-7)))
    return _with_own_noise(spark, d).select("signal_id", "f", F.col("k").cast("bigint").alias("k"), r(0.5 * F.col("m") + 0.5 * left, 5).alias("y"))


@query("poly_harmonics", S + " SELECT signal_id, f, k, round(CASE WHEN k < 28 THEN least(m + 0.3 * least(m, 1.0) ** 2 + 0.15 * least(m, 1.0) ** 3 + 0.1 * least(m, 1.0) ** 4, 2 * m) ELSE m END, 5) AS y FROM m")
def poly_harmonics(spark, d):
    rows = O.per_frame(mags(spark, d), lambda m: K.poly_harmonics(m, 0.3), ("y",), column="mag")
    return values(rows, "y", 5)


@query("log_spectral_distance", S + ", b AS (SELECT p.signal_id, p.f, avg((10 * log10(greatest(p, 1e-10)) - 10 * log10(greatest(p * 0.25 + 0.01, 1e-10))) ** 2) AS d FROM p GROUP BY ALL) SELECT signal_id, f, round(sqrt(d), 5) AS distance FROM b")
def log_spectral_distance(spark, d):
    rows = O.per_frame(powers(spark, d), lambda p: K.log_spectral_distance(p, p * 0.25 + 0.01)[:, None], ("d",), column="power")
    return rows.select("signal_id", "f", r(F.col("d")[0], 5).alias("distance"))


@query(
    "running_dereverb",
    S.replace("WITH e", "WITH RECURSIVE e", 1)
    + """, o AS (SELECT *, row_number() OVER (PARTITION BY signal_id, k ORDER BY f) AS j FROM m),
r AS (SELECT signal_id, k, f, j, m, m AS mean FROM o WHERE j = 1 UNION ALL SELECT o.signal_id, o.k, o.f, o.j, o.m, 0.8 * r.mean + 0.2 * o.m FROM r JOIN o ON o.signal_id = r.signal_id AND o.k = r.k AND o.j = r.j + 1)
SELECT signal_id, f, k, round(CASE WHEN m < 0.75 * mean THEN m * 0.4 ELSE m END, 5) AS y FROM r""",
)
def running_dereverb(spark, d):
    return values(O.per_signal(mags(spark, d), lambda m: K.running_dereverb(m, 0.6), "y", columns=("mag",)), "y", 5)


def np_level(m):
    import numpy as np

    return np.sqrt((m**2).mean(1))


@query("mcra_floor")
def mcra_floor(spark, d):
    return O.summary(mags(spark, d), K.mcra, "v").select("signal_id", F.posexplode("v").alias("k", "v")).select("signal_id", F.col("k").cast("bigint").alias("k"), r("v", 5).alias("noise"))


@query("fingerprint")
def fingerprint(spark, d):
    return O.summary(powers(spark, d), lambda p: K.fingerprint(p, SR), "v", column="power").select("signal_id", F.posexplode("v").alias("k", "v")).select("signal_id", F.col("k").cast("bigint").alias("k"), r("v", 5).alias("v"))


_TUNE_SR = 4000


@query(
    "auto_tune_features",
    S
    + """, t AS (SELECT signal_id, f, sqrt(avg(v * v)) AS rms FROM e GROUP BY ALL),
z AS (SELECT signal_id, f, sum(CASE WHEN (v >= 0) <> (b >= 0) THEN 1 ELSE 0 END) / 64.0 AS crossings FROM (SELECT *, lag(v) OVER (PARTITION BY signal_id, f ORDER BY i) AS b FROM e) GROUP BY ALL),
c AS (SELECT signal_id, f, CASE WHEN sum(p) > 0 THEN sum(k * 4000.0 / 66 * p) / sum(p) ELSE 0 END AS centre, exp(avg(ln(greatest(p, 1e-10)))) / (avg(p) + 1e-10) AS flat FROM p GROUP BY ALL),
q AS (SELECT a.signal_id, a.f, b.i - a.i AS lag, round(sum(a.v * b.v), 9) AS s FROM e a JOIN e b ON a.signal_id = b.signal_id AND a.f = b.f AND b.i - a.i BETWEEN 8 AND 32 GROUP BY ALL),
h AS (SELECT signal_id, f, CASE WHEN max(s) > 0 THEN 4000.0 / arg_min(lag, (-s, lag)) END AS pitch FROM q GROUP BY ALL),
g AS (SELECT t.signal_id, avg(rms) AS rms, min(rms) AS lo, max(rms) AS hi, avg(crossings) AS crossings, avg(centre) AS centre, avg(flat) AS flat, coalesce(avg(pitch), 0) AS pitch, count(*) AS n FROM t JOIN z USING (signal_id, f) JOIN c USING (signal_id, f) JOIN h USING (signal_id, f) GROUP BY t.signal_id),
o AS (SELECT *, crossings < 0.15 AND pitch > 80 AND pitch < 400 AS speech, flat < 0.2 AND centre > 2000 AS music, flat > 0.6 AS noisy, CASE WHEN hi > 0 THEN 20 * log10(hi / (lo + 1e-10)) ELSE 0 END AS span FROM g)
SELECT * EXCLUDE (eq), array_to_string(eq, ',') AS eq FROM (SELECT signal_id, CASE WHEN noisy THEN 0.75 WHEN speech THEN 0.55 ELSE 0.35 END::DOUBLE AS noise_reduction, round(greatest(-60.0, -40 - 0.3 * span), 4)::DOUBLE AS gate_threshold, CASE WHEN span > 20 THEN 4.0 WHEN span > 12 THEN 3.0 ELSE 2.0 END::DOUBLE AS ratio, CASE WHEN speech THEN [-3, -2, 0, 1, 2, 3, 2, 1, 0, -2] ELSE [0, 2, 1, 0, 0, 1, 0, -1, -2, -2] END AS eq, CASE WHEN speech THEN 0.8 WHEN music THEN 0.4 ELSE 0.6 END::DOUBLE AS voice_isolation, CASE WHEN centre > 5000 THEN 0.6 WHEN centre > 3000 THEN 0.3 ELSE 0.1 END::DOUBLE AS de_ess, CASE WHEN flat > 0.4 THEN 0.5 ELSE 0.2 END::DOUBLE AS dereverb, CASE WHEN speech THEN 0.4 ELSE 0.1 END::DOUBLE AS harmonics, round(least(6.0, -20 - 20 * log10(rms + 1e-10)), 4)::DOUBLE AS gain_db, round(least(0.95, 0.5 + n / 100.0 * 0.3 + CASE WHEN speech THEN 0.15 ELSE 0 END), 4)::DOUBLE AS confidence FROM o)""",
)
def auto_tune_features(spark, d):
    """Settings from features of all frames of a recording."""
    x = F.col("samples")
    n = F.size(x)
    flips = F.aggregate(F.zip_with(F.slice(x, F.lit(1), n - 1), F.slice(x, F.lit(2), n - 1), lambda a, b: ((a >= 0) != (b >= 0)).cast("double")), F.lit(0.0), lambda a, v: a + v)
    rows = powers(spark, d).withColumns({"rms": F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / n), "crossings": flips / n, "centre": O.centroid(_TUNE_SR, silent=0.0), "pitch": O.pitch(_TUNE_SR, 80.0, 500.0, longest=0.5)})
    logs = F.exp(F.aggregate("power", F.lit(0.0), lambda a, v: a + F.ln(F.greatest(v, F.lit(1e-10)))) / F.size("power"))
    rows = rows.withColumn("flat", logs / (F.aggregate("power", F.lit(0.0), lambda a, v: a + v) / F.size("power") + 1e-10))
    means = rows.groupBy("signal_id").agg(*(F.avg(c).alias(c) for c in ("rms", "crossings", "centre", "flat")), F.coalesce(F.avg("pitch"), F.lit(0.0)).alias("pitch"), F.min("rms").alias("lo"), F.max("rms").alias("hi"), F.count("*").alias("n"))
    found = L.recommended("rms", "crossings", "centre", "flat", "pitch", "lo", "hi", "n")
    found["eq"] = F.array_join(F.transform(found["eq"], lambda v: v.cast("string")), ",")
    return means.select("signal_id", *((r(c) if k in ("gate_threshold", "gain_db", "confidence") else c).alias(k) for k, c in found.items()))


@query(
    "stft_frames",
    UNIT
    + """, n AS (SELECT signal_id, count(*) AS n FROM u GROUP BY signal_id), f AS (SELECT signal_id, unnest(range(((n - 16) // 8 + 1)::BIGINT)) AS f FROM n WHERE n >= 16),
x AS (SELECT f.signal_id, f.f, u.idx - f.f * 8 AS i, u.x * (0.5 - 0.5 * cos(2 * pi() * (u.idx - f.f * 8) / 16)) AS v FROM f JOIN u ON u.signal_id = f.signal_id AND u.idx >= f.f * 8 AND u.idx < f.f * 8 + 16),
k AS (SELECT range AS k FROM range(9))
SELECT signal_id, f, k, round(sqrt(sum(v * cos(2 * pi() * k * i / 16)) ** 2 + sum(v * sin(2 * pi() * k * i / 16)) ** 2), 5) AS y FROM x, k GROUP BY ALL""",
)
def stft_frames(spark, d):
    return values(O.stft(unit(spark, d), 16, 8), "mag", 5)
