"""Recurrences over one sequence: each takes an array of samples in order and returns arrays of the
same length. They are serial within a sequence; Spark runs many sequences at once. Those that are also in `systems` can be
cut into chunks (operators.chunked)."""

from __future__ import annotations

import math

import numpy as np

from undertone.functions import systems


def ema(x, keep: float):
    """y = keep * previous y + (1 - keep) * x, from the first sample on."""
    out, y = np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        y = v if i == 0 else keep * y + (1 - keep) * v
        out[i] = y
    return out


def two_speed(x, rise: float, fall: float):
    return systems.TwoSpeed(rise, fall).whole(x)


def live_floor(x, start: float = 1e-6):
    return systems.LiveFloor(start).whole(x)


def warm_up(x):
    """Profile seeded by the first value, quick for five frames, then slow; and the ramp's gain over 90 frames."""
    profile, ramp, y = np.empty(len(x)), np.empty(len(x)), 0.0
    for i, v in enumerate(x):
        keep = 0.5 if i < 5 else 0.92
        y = keep * (1.5 * abs(v) + 1e-6 if i == 0 else y) + (1 - keep) * v
        profile[i] = y
        ramp[i] = 0.05 + 0.95 * min(1.0, i / 90) ** 2
    return profile, ramp


def declip(x, level: float):
    """Samples at or over the level become the mean of their neighbours, the left one already repaired."""
    y = np.array(x, float)
    for i in range(1, len(y) - 1):
        if abs(y[i]) >= level:
            y[i] = (y[i - 1] + y[i + 1]) / 2
    return y


def streak(score, keep: float = 0.85, over: float = 0.6, needed: int = 3):
    """Smoothed score, and whether it has been over the mark often enough of late."""
    smooth, voiced, y, n = np.empty(len(score)), np.empty(len(score), bool), 0.0, 0
    for i, v in enumerate(score):
        y = y * keep + v * (1 - keep)
        n = n + 1 if y > over else max(0, n - 1)
        smooth[i], voiced[i] = y, n >= needed
    return smooth, voiced


def peak_hold(x, hold: int, fall: float, floor: float):
    """The highest level, held for some ticks, then falling to a floor."""
    out, top, left = np.empty(len(x)), floor, 0
    for i, v in enumerate(x):
        if v >= top:
            top, left = v, hold
        elif left > 0:
            left -= 1
        else:
            top = max(floor, top - fall)
        out[i] = top
    return out


def gate(x, threshold: float, floor: float, ahead: int, hold: int, attack: float, release: float):
    return systems.Gate(threshold, floor, ahead, hold, attack, release).whole(x)


def compress(x, threshold: float, ratio: float, knee: float, attack: float, release: float, makeup: float = 0.0):
    return systems.Compressor(threshold, ratio, knee, attack, release, makeup).whole(x)


def deess(x, side, threshold: float, ratio: float, wet: float, attack: float, release: float):
    """Gain that follows the excess of a side signal over a threshold."""
    out, env = np.empty(len(x)), 1.0
    for i, (v, s) in enumerate(zip(x, side, strict=True)):
        a = abs(s)
        target = (threshold + (a - threshold) / ratio) / a if a > threshold else 1.0
        keep = attack if target < env else release
        env = keep * env + (1 - keep) * target
        out[i] = v * (1 - wet + wet * env)
    return out


def biquad_design(kind: str, hz: float, q: float, level: float, sr: float) -> tuple[float, ...]:
    """(b0, b1, b2, a1, a2) of the usual second-order filters."""
    w, a = 2 * math.pi * hz / sr, 10 ** (level / 40)
    c, al = math.cos(w), math.sin(w) / (2 * q)
    if kind in ("highpass", "lowpass"):
        s = 1 if kind == "highpass" else -1
        b, d = ((1 + s * c) / 2, -s * (1 + s * c), (1 + s * c) / 2), (1 + al, -2 * c, 1 - al)
    elif kind == "notch":
        b, d = (1.0, -2 * c, 1.0), (1 + al, -2 * c, 1 - al)
    elif kind == "peaking":
        b, d = (1 + al * a, -2 * c, 1 - al * a), (1 + al / a, -2 * c, 1 - al / a)
    elif kind in ("highshelf", "lowshelf"):
        s, r = (1 if kind == "highshelf" else -1), 2 * math.sqrt(a) * al
        b = (a * (a + 1 + s * (a - 1) * c + r), -2 * s * a * (a - 1 + s * (a + 1) * c), a * (a + 1 + s * (a - 1) * c - r))
        d = (a + 1 - s * (a - 1) * c + r, 2 * s * (a - 1 - s * (a + 1) * c), a + 1 - s * (a - 1) * c - r)
    else:
        raise ValueError(f"no filter called {kind}")
    return b[0] / d[0], b[1] / d[0], b[2] / d[0], d[1] / d[0], d[2] / d[0]


def biquad(x, coefficients):
    """Second-order filter in transposed direct form, from rest."""
    b0, b1, b2, a1, a2 = coefficients
    out, s1, s2 = np.empty(len(x)), 0.0, 0.0
    for i, v in enumerate(x):
        y = b0 * v + s1
        s1, s2 = b1 * v - a1 * y + s2, b2 * v - a2 * y
        out[i] = y
    return out


def cascade(x, filters):
    for f in filters:
        x = biquad(x, f)
    return x


def hum_notches(sr: float, q: float = 5.0, base: float = 60.0, last: float = 360.0) -> list[tuple[float, ...]]:
    return [biquad_design("notch", base * k, q, 0.0, sr) for k in range(1, int(last / base) + 1) if base * k < sr / 2]


def equaliser(bands, sr: float) -> list[tuple[float, ...]]:
    """Peaking filters of (hz, level, q), without those under a tenth of a dB."""
    return [biquad_design("peaking", hz, q, level, sr) for hz, level, q in bands if abs(level) >= 0.1]


def follow(x, attack: float = 0.05, release: float = 0.0005):
    return systems.Follower(attack, release).whole(x)


def deess_live(x, band, amount: float, **at):
    return systems.LiveDeesser(tuple(band), amount, **at).whole(x)
