"""Levels, loudness and simple features of signals, as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undertone.functions.pointwise import clamp, db, power_db, range_score
from undertone.operators.sequences import KEY, ORDER, X, blocks, over

GATE_POWER = 1e-10


def rms_db(x=X) -> Column:
    return power_db(F.avg(F.col(x) * F.col(x)))


def peak_db(x=X) -> Column:
    return db(F.max(F.abs(F.col(x))))


def rms(x=X) -> Column:
    return F.sqrt(F.avg(F.col(x) * F.col(x)))


def normalise_peak(df: DataFrame, target_db: float, *, key=KEY, x=X) -> DataFrame:
    """Adds y: scaled so that the signal's peak meets the target; silence stays."""
    top = F.max(F.abs(F.col(x))).over(Window.partitionBy(key))
    return df.withColumn("y", F.when(top < 1e-10, F.col(x)).otherwise(F.col(x) * (10 ** (target_db / 20)) / top))


def block_powers(df: DataFrame, size: int, step: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, f, power: mean square of overlapping full blocks, without the silent ones. Built from sums over steps, so a
    sample is read once however much blocks overlap (size is a multiple of step)."""
    part = df.groupBy(key, F.floor(F.col(order) / step).alias("f")).agg(F.sum(F.col(x) * F.col(x)).alias("s"), F.count("*").alias("n"))
    k = size // step
    w = over(key, "f").rowsBetween(0, k - 1)
    whole = part.select(key, "f", F.sum("s").over(w).alias("s"), F.sum("n").over(w).alias("n"))
    return whole.where(F.col("n") == size).select(key, "f", (F.col("s") / size).alias("power")).where(F.col("power") > GATE_POWER)


def loudness(df: DataFrame, size: int, step: int, **at) -> DataFrame:
    key = at.get("key", KEY)
    return block_powers(df, size, step, **at).groupBy(key).agg((-0.691 + 10 * F.log10(F.avg("power"))).alias("lufs"))


def normalise_loudness(df: DataFrame, target: float, size: int, step: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """Adds y: scaled to a loudness; signals below -70, or without a block, stay."""
    level = loudness(df, size, step, key=key, order=order, x=x)
    factor = F.when(F.col("lufs") < -70, 1.0).otherwise(F.pow(F.lit(10.0), (target - F.col("lufs")) / 20))
    return df.join(level, key, "left").withColumn("y", F.col(x) * F.coalesce(factor, F.lit(1.0))).drop("lufs")


def meter(df: DataFrame, size: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, b, short, integrated, crest: a block's level, the level of the mean power so far, and peak over short."""
    part = blocks(df, size, order=order).groupBy(key, "b").agg(F.avg(F.col(x) * F.col(x)).alias("p"), F.max(F.abs(F.col(x))).alias("top"))
    so_far = F.avg("p").over(over(key, "b").rowsBetween(Window.unboundedPreceding, 0))
    return part.select(key, "b", power_db("p", -60.0).alias("short"), power_db(so_far, -60.0).alias("integrated"), (db("top", -60.0) - power_db("p", -60.0)).alias("crest"))


def active_blocks(df: DataFrame, size: int, least_rms: float, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, active, voices: blocks over a level, and what that says about voices."""
    part = blocks(df, size, order=order).groupBy(key, "b").agg(rms(x).alias("r"))
    counted = part.groupBy(key).agg(F.count_if(F.col("r") > least_rms).alias("active"), F.count("*").alias("n"))
    share = F.col("active") / F.col("n")
    return counted.select(key, "active", F.when(F.col("active") == 0, "0-1").when(share < 0.5, "1").otherwise("1-2+").alias("voices"))


def flux(df: DataFrame, size: int, most: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, flux: mean absolute change of RMS between the first blocks."""
    part = blocks(df, size, order=order).groupBy(key, "b").agg(rms(x).alias("r"), F.count("*").alias("n")).where((F.col("n") == size) & (F.col("b") < most))
    change = part.select(key, F.abs(F.col("r") - F.lag("r").over(over(key, "b"))).alias("d"))
    return change.groupBy(key).agg(F.coalesce(F.avg("d"), F.lit(0.0)).alias("flux"))


def order_statistic(df: DataFrame, share: float, value: Column, name: str, *, key=KEY) -> DataFrame:
    """key and the value at place floor(share * n) in ascending order, without interpolation."""
    w = Window.partitionBy(key)
    ranked = df.select(key, value.alias("v")).withColumns({"r": F.row_number().over(w.orderBy("v")), "n": F.count("*").over(w)})
    return ranked.where(F.col("r") == F.least(F.floor(F.col("n") * share), F.col("n") - 1) + 1).select(key, F.col("v").alias(name))


def dynamic_range(df: DataFrame, *, key=KEY, x=X) -> DataFrame:
    """key, dynamic_range: 95th over 5th percentile of absolute values, in dB."""
    w = Window.partitionBy(key)
    ranked = df.select(key, F.abs(F.col(x)).alias("v")).withColumns({"r": F.row_number().over(w.orderBy("v")), "n": F.count("*").over(w)})
    at = lambda p: F.max(F.when(F.col("r") == F.floor(F.col("n") * p) + 1, F.col("v")))
    return ranked.groupBy(key).agg(at(0.95).alias("hi"), at(0.05).alias("lo")).select(key, db(F.col("hi") / (F.col("lo") + 1e-10)).alias("dynamic_range"))


def quiet_rms(df: DataFrame, size: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """key, noise: mean RMS of the quietest tenth of full blocks, one at least."""
    part = blocks(df, size, order=order).groupBy(key, "b").agg(rms(x).alias("r"), F.count("*").alias("n")).where(F.col("n") == size)
    w = Window.partitionBy(key)
    ranked = part.withColumns({"place": F.row_number().over(w.orderBy("r", "b")), "m": F.count("*").over(w)})
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(F.col("m") * 0.1))).groupBy(key).agg(F.avg("r").alias("noise"))


def trailing_features(df: DataFrame, size: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    """rms, zcr and level of the newest `size` samples at every sample that has as many behind it."""
    at = Window.partitionBy(key).orderBy(order)
    flip = ((F.col(x) >= 0) != F.lag(F.col(x) >= 0).over(at)).cast("int")
    level = F.sqrt(F.avg(F.col(x) * F.col(x)).over(at.rowsBetween(1 - size, 0)))
    out = df.withColumn("__flip", flip).withColumns({"rms": level, "zcr": F.sum("__flip").over(at.rowsBetween(2 - size, 0)) / size})
    return out.where(F.col(order) >= size - 1).withColumn("level", db(F.col("rms"), -100.0)).drop("__flip")


def waveform(df: DataFrame, step: int, *, key=KEY, order=ORDER, x=X) -> DataFrame:
    return df.groupBy(key, F.floor(F.col(order) / step).alias("px")).agg(F.min(x).alias("lo"), F.max(x).alias("hi"))


def voice_quality(centroid, zcr, flux_) -> Column:
    """A score from 1 to 5 by rules on features."""
    c, z, f = (F.col(v) if isinstance(v, str) else v for v in (centroid, zcr, flux_))
    by_centroid = F.when(c.between(1000, 3500), 0.5).when((c < 500) | (c > 6000), -0.5).otherwise(0.0)
    by_flux = F.when((f > 0.1) & (f < 0.5), 0.2).when(f > 0.8, -0.3).otherwise(0.0)
    return clamp(3.0 + by_centroid + F.when(z.between(0.05, 0.25), 0.3).otherwise(0.0) + by_flux, 1.0, 5.0)


#: For each scene, features with the range they score in and a weight.
SCENES = {
    "podcast": (("centroid", 800, 3000, 1.0), ("crest", 3, 12, 0.8), ("range", 15, 35, 0.6), ("zcr", 0.05, 0.25, 0.5)),
    "interview": (("centroid", 600, 2500, 1.0), ("crest", 4, 15, 0.8), ("range", 20, 45, 0.7), ("zcr", 0.04, 0.20, 0.5)),
    "music": (("centroid", 1000, 8000, 1.0), ("flux", 0.3, 1.0, 0.9), ("range", 30, 70, 0.8), ("crest", 6, 20, 0.6)),
    "broadcast": (("centroid", 1000, 4000, 1.0), ("range", 8, 20, 0.9), ("crest", 2, 8, 0.8), ("zcr", 0.06, 0.30, 0.5)),
    "forensic": (("crest", 10, 30, 1.0), ("range", 40, 80, 0.9), ("flux", 0.1, 0.5, 0.7)),
    "film": (("range", 40, 80, 1.0), ("flux", 0.2, 0.8, 0.8), ("centroid", 500, 6000, 0.6)),
}


def scene_scores() -> dict[str, Column]:
    return {name: sum((range_score(f, lo, hi, w) for f, lo, hi, w in parts), F.lit(0.0)) / sum(p[3] for p in parts) for name, parts in SCENES.items()}


def best_of(scores: dict[str, Column], digits: int = 9) -> Column:
    """The name of the highest score, the first one on ties."""
    top = F.greatest(*(F.round(s, digits) for s in scores.values()))
    out = None
    for name, s in scores.items():
        hit = F.round(s, digits) == top
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def noise_scores(sub, bass, mid, high, air, flat) -> dict[str, Column]:
    """Scores of kinds of noise from band energies and flatness."""
    sub, bass, mid, high, air, flat = (F.col(c) if isinstance(c, str) else c for c in (sub, bass, mid, high, air, flat))
    total = sub + bass + mid + high + air + 1e-20
    return {
        "music": (bass + mid) / total * 2 * (1 - flat) + F.when((bass / total > 0.35) & (flat < 0.25), 1.5).otherwise(0.0),
        "white_noise": flat * 3,
        "crowd": mid / total * 2 * F.when(flat > 0.3, 1.0).otherwise(0.5),
        "HVAC": (sub + bass) / total * 2 * (1 - flat * 0.5),
        "keyboard": (high + air) / total * 2 * (1 - flat),
        "traffic": (sub + bass * 0.5) / total * 1.5,
    }


#: What a kind of noise changes.
STRATEGIES = {"music": "over_subtraction=1.6", "white_noise": "over_subtraction=1.2", "crowd": "multi_speaker,target-only", "HVAC": "smoothing_ms=80", "traffic": "smoothing_ms=80"}


def noise_strategy(kind) -> Column:
    pairs = [F.lit(v) for kv in STRATEGIES.items() for v in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), kind), F.lit("none"))


def auto_tune(scene, rms_, peak, dynamic) -> dict[str, Column]:
    """Suggested settings from features, null where there is nothing to suggest."""
    floor, snr = 20 * F.log10(F.col(rms_) + 1e-10), 20 * F.log10(F.col(peak) / (F.col(rms_) + 1e-10))
    d = F.col(dynamic)
    return {
        "gate_threshold": F.when(floor < -50, F.greatest(F.lit(-60.0), floor - 5)),
        "noise_reduction": F.when(snr < 15, F.least(F.lit(80.0), 30 + (15 - snr) * 2)).when(snr > 30, F.greatest(F.lit(15.0), 30 - (snr - 30))),
        "highpass_hz": F.when(F.col(scene).isin("podcast", "broadcast"), 80).when(F.col(scene) == "forensic", 50),
        "ratio": F.when(d > 40, 4).when(d < 15, 2),
        "threshold": F.when(d > 40, -24).when(d < 15, -18),
    }


#: Suggested levels in dB at EQ_HZ.
EQ_HZ = (40, 80, 200, 500, 1000, 2000, 4000, 8000, 12000, 16000)
SPEECH_EQ = (-3, -2, 0, 1, 2, 3, 2, 1, 0, -2)
OTHER_EQ = (0, 2, 1, 0, 0, 1, 0, -1, -2, -2)


def log_distance(a: str, b: str, least: float = 1e-10) -> Column:
    """The root mean square difference of the natural logarithms of two arrays."""
    steps = F.zip_with(a, b, lambda x, y: F.ln(F.greatest(x, F.lit(least))) - F.ln(F.greatest(y, F.lit(least))))
    return F.sqrt(F.aggregate(steps, F.lit(0.0), lambda s, v: s + v * v) / F.size(a))


def perceptual(snr: Column, distance: Column) -> dict[str, Column]:
    """Opinion scores from 1 to 5 of the ratio of signal to noise (dB) and of a log-spectral distance, mixed 6 to 4, and the same on a
    scale from -0.5 to 4.5."""
    mos = 0.6 * clamp(1 + snr / 10, 1.0, 5.0) + 0.4 * clamp(5 - 2 * distance, 1.0, 5.0)
    return {"snr_db": snr, "distance": distance, "mos": mos, "pesq_like": (mos - 1) / 4 * 5 - 0.5}


def recommended(rms_, crossings, centre, flatness_, pitch_, quietest, loudest, frames) -> dict[str, Column]:
    """Suggested settings from a recording's mean features, its quietest and loudest frame, and how many frames it has."""
    speech = (F.col(crossings) < 0.15) & (F.col(pitch_) > 80) & (F.col(pitch_) < 400)
    music, noisy = (F.col(flatness_) < 0.2) & (F.col(centre) > 2000), F.col(flatness_) > 0.6
    span = F.when(F.col(loudest) > 0, 20 * F.log10(F.col(loudest) / (F.col(quietest) + 1e-10))).otherwise(0.0)
    return {
        "noise_reduction": F.when(noisy, 0.75).when(speech, 0.55).otherwise(0.35),
        "gate_threshold": F.greatest(F.lit(-60.0), -40 - 0.3 * span),
        "ratio": F.when(span > 20, 4.0).when(span > 12, 3.0).otherwise(2.0),
        "eq": F.when(speech, F.array(*map(F.lit, SPEECH_EQ))).otherwise(F.array(*map(F.lit, OTHER_EQ))),
        "voice_isolation": F.when(speech, 0.8).when(music, 0.4).otherwise(0.6),
        "de_ess": F.when(F.col(centre) > 5000, 0.6).when(F.col(centre) > 3000, 0.3).otherwise(0.1),
        "dereverb": F.when(F.col(flatness_) > 0.4, 0.5).otherwise(0.2),
        "harmonics": F.when(speech, 0.4).otherwise(0.1),
        "gain_db": F.when(F.col(rms_) > 0, F.least(F.lit(6.0), -20 - 20 * F.log10(F.col(rms_) + 1e-10))).otherwise(0.0),
        "confidence": F.least(F.lit(0.95), 0.5 + F.col(frames) / 100 * 0.3 + F.when(speech, 0.15).otherwise(0.0)),
    }
