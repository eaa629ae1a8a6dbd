"""Row-local functions over columns; everything stays inside generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE_DB = -96.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x, lo, hi) -> Column:
    return F.greatest(F.least(_c(x), _c(hi)), _c(lo))


def half_up(x) -> Column:
    """Rounds to the nearest integer, halves towards plus infinity."""
    return F.floor(_c(x) + 0.5)


def db(ratio, silence: float = SILENCE_DB) -> Column:
    """Decibels of an amplitude."""
    return F.when(_c(ratio) > 0, 20 * F.log10(_c(ratio))).otherwise(F.lit(silence))


def power_db(power, silence: float = SILENCE_DB) -> Column:
    return F.when(_c(power) > 0, 10 * F.log10(_c(power))).otherwise(F.lit(silence))


def from_db(level) -> Column:
    return F.pow(F.lit(10.0), _c(level) / 20)


def gain(x, level) -> Column:
    return _c(x) * from_db(level)


def soft_limit(x, ceiling_db: float) -> Column:
    """Linear to 3 dB below the ceiling, then a hyperbolic tangent that never passes it."""
    top = 10 ** (ceiling_db / 20)
    knee = 0.7079 * top
    over = (F.abs(_c(x)) - knee) / (top - knee)
    return F.when(F.abs(_c(x)) <= knee, _c(x)).otherwise(F.signum(_c(x)) * (knee + (top - knee) * F.tanh(over)))


def expand_down(x, threshold_db: float, ratio: float) -> Column:
    """Samples below the threshold fall by the ratio."""
    below = threshold_db - db(F.abs(_c(x)))
    return F.when((_c(x) != 0) & (below > 0), _c(x) * F.pow(F.lit(10.0), -below * (ratio - 1) / 20)).otherwise(_c(x))


def widen(left, right, width: float) -> tuple[Column, Column]:
    """Mid and side with the side scaled by width / 100; untouched within one of 100."""
    if abs(width - 100) < 1:
        return _c(left), _c(right)
    mid, side = (_c(left) + _c(right)) / 2, (_c(left) - _c(right)) / 2 * (width / 100)
    return mid + side, mid - side


def crosstalk(left, right, amount: float) -> tuple[Column, Column]:
    g = amount / 200
    return _c(left) - g * _c(right), _c(right) - g * _c(left)


def mix(dry, wet, share: float) -> Column:
    return _c(dry) * (1 - share) + _c(wet) * share


def dither(x, bits: int, seed: int) -> Column:
    """Triangular noise of one step; none at 32 bits."""
    return _c(x) if bits >= 32 else _c(x) + (F.rand(seed) - F.rand(seed + 1)) / 2 ** (bits - 1)


def watermark(x, idx, sr: int, level: float = 0.01, hz: float = 19_000.0) -> Column:
    return _c(x) + level * F.sin(_c(idx) * (2 * math.pi * hz / sr))


def shaper(x, k: float) -> Column:
    return F.tanh(_c(x) * k) / math.tanh(k)


def wiener_gain(signal, noise, alpha: float = 1.5, floor: float = 0.008) -> Column:
    snr = _c(signal) * _c(signal) / F.greatest(alpha * _c(noise) * _c(noise), F.lit(1e-12))
    return clamp(snr / (snr + 1), floor, 1.0)


#: Weight of a bin by its frequency, below each bound (the last one beyond all).
VOICE_WEIGHTS = ((40, 0.30), (80, 0.60), (200, 0.90), (4000, 1.0), (6000, 0.90), (9000, 0.75), (12000, 0.55))
VOICE_WEIGHT_ABOVE = 0.40


def voice_weight(hz) -> Column:
    """Bounds up to 200 Hz are exclusive, the others inclusive."""
    out = None
    for bound, weight in VOICE_WEIGHTS:
        inside = _c(hz) < bound if bound <= 200 else _c(hz) <= bound
        out = F.when(inside, F.lit(weight)) if out is None else out.when(inside, F.lit(weight))
    return out.otherwise(F.lit(VOICE_WEIGHT_ABOVE))


def raised_edge(k, lo: int, hi: int, lo_width: int, hi_width: int) -> Column:
    """1 from lo to hi, 0 beyond the widths, half a cosine in between."""
    k = _c(k)
    return (
        F.when(k <= lo - lo_width, 0.0)
        .when(k < lo, 0.5 - 0.5 * F.cos((k - (lo - lo_width)) * (math.pi / lo_width)))
        .when(k <= hi, 1.0)
        .when(k < hi + hi_width, 0.5 + 0.5 * F.cos((k - hi) * (math.pi / hi_width)))
        .otherwise(0.0)
    )


def band_mask(k, lo: int, hi: int, suppress: float, boost: float) -> Column:
    """Gain of bin k: boosted inside a band, suppressed outside, smooth at the edges."""
    edge = raised_edge(k, lo, hi, max(4, math.floor(lo * 0.26 + 0.5)), max(4, math.floor(hi * 0.26 + 0.5)))
    return suppress + (boost - suppress) * edge


#: Sounds that a notch takes out, and their ranges in Hz.
SOUNDS = {"appliance": ((20, 500),), "music": ((80, 300), (1000, 8000)), "dog": ((300, 1200), (1200, 3000)), "bird": ((2000, 5000), (5000, 10000)), "traffic": ((20, 150), (150, 600)), "crowd": ((120, 300), (300, 800), (800, 2000))}


def notch_mask(k, sounds, bins: int, bin_hz: float, floor: float = 0.04) -> Column:
    """The lowest gain that the notches of the given sounds leave a bin."""
    out = F.lit(1.0)
    for sound in sounds:
        for lo_hz, hi_hz in SOUNDS[sound]:
            lo, hi = (min(bins - 1, max(0, math.floor(h / bin_hz + 0.5))) for h in (lo_hz, hi_hz))
            width = max(4, math.floor(((hi - lo) or 4) * 0.26 + 0.5))
            out = F.least(out, 1 + (floor - 1) * raised_edge(k, lo, hi, width, width))
    return out


def tilt(hz, db_per_octave: float) -> Column:
    octaves = F.when(_c(hz) > 0, F.log2(_c(hz) / 1000)).otherwise(0.0)
    return clamp(F.pow(F.lit(10.0), octaves * db_per_octave / 20), 0.01, 10.0)


def focus(k, lo: int, hi: int, isolation: float, background: float) -> Column:
    return F.when(_c(k).between(lo, hi), F.lit(1 + 0.5 * isolation)).otherwise(F.lit(1 - 0.95 * background))


def vad_attenuation(confidence, amount: float) -> Column:
    return 1 - amount * 0.8 * (1 - _c(confidence))


def mmse_gain(signal, noise, alpha: float) -> Column:
    return F.greatest(F.lit(0.01), 1 - alpha * _c(noise) * _c(noise) / (_c(signal) * _c(signal) + 1e-10))


def finite(x, otherwise: float = 0.0) -> Column:
    """A magnitude, or the other value where it is null, not finite or negative."""
    x = _c(x)
    return F.when(x.isNull() | F.isnan(x) | (x < 0) | (x == F.lit(math.inf)), F.lit(otherwise)).otherwise(x)


def snap(x, lo, hi, step, default) -> Column:
    """Clamped and set to the nearest step; the default where it isn't a finite number."""
    bad = _c(x).isNull() | F.isnan(_c(x)) | (F.abs(_c(x)) == F.lit(math.inf))
    return F.when(bad, _c(default)).otherwise(half_up(clamp(x, lo, hi) / _c(step)) * _c(step))


def meter_percent(rms) -> Column:
    return clamp((db(rms, -60.0) + 60) / 60 * 100, 0.0, 100.0)


def floor_from_db(level) -> Column:
    """-80..-20 dB onto 0.001..0.05, linearly."""
    return 0.001 + (clamp(level, -80.0, -20.0) + 80) / 60 * (0.05 - 0.001)


def speaker_volume(volume, muted, solo, any_solo) -> Column:
    return F.when(_c(muted), 0.0).when(_c(any_solo) & ~_c(solo), 0.0).otherwise(F.coalesce(_c(volume), F.lit(1.0)))


def range_score(x, lo: float, hi: float, weight: float) -> Column:
    """The weight inside a range, less with distance outside, none beyond half its width."""
    half = (hi - lo) / 2
    away = F.abs(_c(x) - (lo + hi) / 2) - half
    return F.when(_c(x).between(lo, hi), F.lit(float(weight))).otherwise(weight * F.greatest(F.lit(0.0), 1 - away / half))


def hz_to_mel(hz) -> Column:
    return 2595 * F.log10(1 + _c(hz) / 700)


def mel_to_hz(mel) -> Column:
    return 700 * (F.pow(F.lit(10.0), _c(mel) / 2595) - 1)


def hz_to_erb(hz) -> Column:
    return 21.4 * F.log10(1 + 0.00437 * _c(hz))


def erb_to_hz(erb) -> Column:
    return (F.pow(F.lit(10.0), _c(erb) / 21.4) - 1) / 0.00437


def nice_tick(span, most: int) -> Column:
    """The least of 1, 2, 5 and 10 times a power of ten that cuts a span into at most so many parts."""
    raw = _c(span) / most
    base = F.pow(F.lit(10.0), F.floor(F.log10(raw)))
    return F.when(base >= raw, base).when(2 * base >= raw, 2 * base).when(5 * base >= raw, 5 * base).otherwise(10 * base)


def colormap(v, stops, gamma: float = 1.0) -> Column:
    """Piecewise linear value at v in 0..1 over evenly spaced stops."""
    at = F.pow(clamp(v, 0.0, 1.0), F.lit(gamma)) * (len(stops) - 1)
    low = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    table = F.array(*[F.lit(float(s)) for s in stops])
    return F.element_at(table, low + 1) + (at - low) * (F.element_at(table, low + 2) - F.element_at(table, low + 1))
