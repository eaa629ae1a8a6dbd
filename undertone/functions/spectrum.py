"""Numpy kernels over frames: transforms, bands, masks and features. Frames are rows of an array."""

from __future__ import annotations

import numpy as np


def check_size(n: int) -> int:
    if n < 2 or n & (n - 1):
        raise ValueError(f"frame size must be a power of two, not {n}")
    return n


def hann(n: int, periodic: bool = True) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n if periodic else n - 1))


def cut(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    """Full frames of a signal; none if it is shorter than one."""
    n = (len(x) - size) // hop + 1 if len(x) >= size else 0
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop][:n] if n else np.zeros((0, size))


def stft(x: np.ndarray, size: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    s = np.fft.rfft(cut(np.asarray(x, float), check_size(size), hop) * hann(size), axis=1)
    return np.abs(s), np.angle(s)


def inverse_frames(mag: np.ndarray, phase: np.ndarray) -> np.ndarray:
    """Windowed time frames of guarded spectra."""
    mag = np.where(np.isfinite(mag) & (mag >= 0), mag, 0.0)
    phase = np.where(np.isfinite(phase), phase, 0.0)
    x = np.fft.irfft(mag * np.exp(1j * phase), axis=1)
    return x * hann(x.shape[1])


def power(x: np.ndarray) -> np.ndarray:
    """Power of frames under a symmetric window, unscaled."""
    return np.abs(np.fft.rfft(x * hann(x.shape[1], False), axis=1)) ** 2


def erb_bands(count: int, sr: float, bins: int) -> list[tuple[int, int]]:
    """First and last bin of bands evenly spaced in ERB from 20 Hz up; neighbours share their edge bins."""
    e = lambda hz: 21.4 * np.log10(1 + 0.00437 * hz)
    edges = (10 ** (np.linspace(e(20.0), e(sr / 2), count + 1) / 21.4) - 1) / 0.00437 / (sr / 2) * (bins - 1)
    return [(max(0, int(np.floor(a))), min(bins - 1, int(np.ceil(b)))) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def log_bands(count: int, sr: float, bins: int, low: float = 20.0) -> list[tuple[int, int]]:
    """First and last bin of bands evenly spaced in the logarithm of frequency, from `low` up to half the rate, where a
    bin stands for the rate over twice the number of bins."""
    edges = low * (sr / 2 / low) ** (np.arange(count + 1) / count) / (sr / 2) * bins
    first = np.maximum(0, np.floor(edges[:-1])).astype(int)
    last = np.maximum(first, np.minimum(bins - 1, np.ceil(edges[1:]).astype(int)))
    return [*zip(first.tolist(), last.tolist(), strict=True)]


def erb_gate(mag: np.ndarray, floor_db: float, sr: float, hop: int, bands: int = 32) -> np.ndarray:
    """Bands under a floor are turned down with a smooth knee and 60 ms of memory, one band after the other: a bin two
    bands share is scaled twice."""
    m, floor = mag.copy(), 10 ** (floor_db / 20)
    keep = np.exp(-hop / (sr * 0.06))
    edges, before = erb_bands(bands, sr, mag.shape[1]), np.ones(bands)
    for row in m:
        for b, (lo, hi) in enumerate(edges):
            ratio = np.sqrt(np.mean(row[lo : hi + 1] ** 2)) / (floor + 1e-10)
            if ratio >= 2:
                g = 1.0
            elif ratio <= 0.5:
                g = ratio
            else:
                t = (np.log2(ratio) + 1) / 2
                s = t * t * (3 - 2 * t)
                g = ratio * (1 - s) + s
            before[b] = keep * before[b] + (1 - keep) * g
            row[lo : hi + 1] *= before[b]
    return m


def band_wiener(mag: np.ndarray, noise: np.ndarray, sr: float, bands: int = 16, strength: float = 1.0, keep: float = 0.85, floor: float = 0.01) -> np.ndarray:
    """Per band the root of the share of power that is left when the noise's power is taken out, smoothed over frames from 1;
    noise: power of each bin. A silent band falls to the floor. Bands go one after the other: a bin two bands share is
    scaled twice, and the later band hears it scaled."""
    m, edges = mag.copy(), log_bands(bands, sr, mag.shape[1])
    hum, gains = [strength * noise[lo : hi + 1].mean() for lo, hi in edges], np.ones(bands)
    for row in m:
        for b, (lo, hi) in enumerate(edges):
            heard = np.mean(row[lo : hi + 1] ** 2)
            wanted = max(floor, np.sqrt(max(0.0, heard - hum[b]) / heard)) if heard > 1e-10 else floor
            gains[b] += (1 - keep) * (wanted - gains[b])
            row[lo : hi + 1] *= gains[b]
    return m


def minimum_floor(mag: np.ndarray, quiet: np.ndarray, window: int, parts: int = 5) -> np.ndarray:
    """Per frame the noise floor: an average of quiet frames, and its least value over rotating sub-windows."""
    keep, length = np.exp(-1 / max(1, window)), max(1, round(window / parts))
    out, now, store, low, step, slot = np.zeros_like(mag), None, None, None, 0, 0
    for f, row in enumerate(mag):
        if quiet[f]:
            if now is None:
                now, store, low = row.copy(), np.tile(row, (parts, 1)), row.copy()
            else:
                now = keep * now + (1 - keep) * row
                low = np.minimum(low, now)
                step += 1
                if step >= length:
                    store[slot], slot, low, step = low, (slot + 1) % parts, now.copy(), 0
        if store is not None:
            out[f] = store.min(0)
    return out


def mcra(mag: np.ndarray, keep: float = 0.92, smooth: float = 0.9, over: float = 5.0, window: int = 125) -> np.ndarray:
    """Noise magnitude after all frames: power averaged where speech is unlikely, judged against a moving minimum."""
    if not len(mag):
        return np.zeros(0)
    p = mag**2
    noise, level, presence, history = p[0].copy(), p[0].copy(), np.zeros(mag.shape[1]), []
    for row in p:
        level = smooth * level + (1 - smooth) * row
        history = (history + [level])[-window:]
        presence = smooth * presence + (1 - smooth) * (level / (np.min(history, axis=0) + 1e-10) > over)
        k = keep + (1 - keep) * presence
        noise = k * noise + (1 - k) * row
    return np.sqrt(np.maximum(noise, 0))


def adaptive_wiener(mag: np.ndarray, confidence: np.ndarray, alpha: float = 1.2, floor: float = 0.02, window: int = 10) -> np.ndarray:
    """Wiener gain against a floor that learns on quiet frames, eased by the confidence of speech."""
    conf = confidence[np.minimum(np.arange(len(mag)), len(confidence) - 1)]
    noise = minimum_floor(mag, conf < 0.3, window)
    snr = mag**2 / np.maximum(alpha * noise**2, 1e-12)
    gain = np.clip(snr / (snr + 1), floor, 1)
    return mag * (conf[:, None] + (1 - conf[:, None]) * gain)


def over_subtract(mag: np.ndarray, noise: np.ndarray, beta: float, floor: float = 0.1, blend: float = 0.5, least: float = 1e-7) -> np.ndarray:
    """`beta` times the noise is taken out, down to a share of the bin at most, then part of the bin as it was is mixed back."""
    left = np.maximum(mag - beta * noise, np.maximum(floor * mag, least))
    return blend * mag + (1 - blend) * left


def running_dereverb(mag: np.ndarray, amount: float, keep: float = 0.8) -> np.ndarray:
    """Bins well under their running mean are turned down."""
    out, mean = mag.copy(), None
    for f, row in enumerate(mag):
        mean = row.copy() if mean is None else keep * mean + (1 - keep) * row
        out[f] = np.where(row < 0.75 * mean, row * max(1 - amount, 0.05), row)
    return out


def mel_filters(count: int, size: int, sr: float) -> np.ndarray:
    """Triangles evenly spaced in mel; one without width weighs nothing."""
    mel = np.linspace(0, 2595 * np.log10(1 + sr / 2 / 700), count + 2)
    edges = np.floor((size + 1) * 700 * (10 ** (mel / 2595) - 1) / sr).astype(int)
    k, out = np.arange(size // 2 + 1), np.zeros((count, size // 2 + 1))
    for i, (a, b, c) in enumerate(zip(edges, edges[1:], edges[2:], strict=False)):
        if b > a:
            out[i] += np.where((k >= a) & (k < b), (k - a) / (b - a), 0)
        if c > b:
            out[i] += np.where((k >= b) & (k < c), (c - k) / (c - b), 0)
    return out


def mfcc(p: np.ndarray, sr: float, filters: int = 40, count: int = 13) -> np.ndarray:
    """Cosine coefficients of log mel energies of power spectra, unscaled."""
    size = 2 * (p.shape[1] - 1)
    e = np.log(np.maximum(p @ mel_filters(filters, size, sr).T, 1e-10))
    n, j = np.arange(count)[:, None], np.arange(filters)[None]
    return e @ np.cos(np.pi * n * (j + 0.5) / filters).T


def deltas(x: np.ndarray, reach: int = 2) -> np.ndarray:
    t = np.arange(len(x))
    at = lambda i: x[np.clip(i, 0, len(x) - 1)]
    return sum(n * (at(t + n) - at(t - n)) for n in range(1, reach + 1)) / (2 * sum(n * n for n in range(1, reach + 1)))


def fingerprint(p: np.ndarray, sr: float, size: int = 64) -> np.ndarray:
    """Means and deviations of MFCCs, deltas and second deltas over frames, pooled to a fixed length, of unit norm."""
    c = mfcc(p, sr)
    d = deltas(c)
    both = np.concatenate([c, d, deltas(d)], axis=1)
    v = np.concatenate([both.mean(0), both.std(0)])
    bucket = max(1, -(-len(v) // size))
    pooled = np.zeros(size)
    means = [v[i : i + bucket].mean() for i in range(0, len(v), bucket)][:size]
    pooled[: len(means)] = means
    norm = np.linalg.norm(pooled)
    return pooled / norm if norm else pooled


def enhance_harmonics(mag: np.ndarray, amount: float, sr: float, *, breath: float = 0.8, most: float = 1.5, fill: bool = True) -> np.ndarray:
    """Per frame, amount in percent, all peaks judged on the frame as it came:
      formants  the strongest bin of 200..1000 Hz and that of the bins above up to 3500 Hz, each only if it stands 1.5 times
                over its range's mean, go up by a tenth with two bins on either side;
      breath    80..3000 Hz goes down towards `breath`, the more the flatter that range is;
      peaks     below 8 kHz, bins 1.3 times over two neighbours on either side go up by half the amount;
      fill      above 8 kHz the octave below is mirrored over and over, falling off by e per octave, at 0.3 of the amount,
                where that is more than what is there.
    Formants and peaks leave no bin at more than `most` times what it was."""
    if amount <= 0 or not mag.size:
        return mag
    bins = mag.shape[1]
    at = lambda hz: int(np.floor(hz * 2 * (bins - 1) / sr + 0.5))
    out, cap, top = mag.copy(), mag * most, at(8000)

    def lift(chosen: np.ndarray, gain: float) -> None:
        out[:] = np.where(chosen, np.minimum(out * gain, cap), out)

    for lo, hi in ((at(200), at(1000)), (at(1000) + 1, at(3500))):
        part = mag[:, lo : hi + 1]
        if at(200) < at(1000) and at(1000) + 1 < at(3500) and part.shape[1]:
            peak = part.argmax(1)
            clear = part.max(1) > 1.5 * part.mean(1)
            lift(clear[:, None] & (np.abs(np.arange(bins)[None] - lo - peak[:, None]) <= 2), 1.10)
    lo, hi = at(80), min(bins - 1, at(3000))
    if hi > lo + 1:
        voiced = out[:, lo : hi + 1] + 1e-10
        flat = np.minimum(1.0, 4 * np.exp(np.log(voiced).mean(1)) / voiced.mean(1))
        out[:, lo : hi + 1] *= (1 - flat * (1 - breath))[:, None]
    peaks = np.zeros(mag.shape, bool)
    end = min(top, bins - 2)
    if end > 2:
        peaks[:, 2:end] = np.all([mag[:, 2:end] > 1.3 * mag[:, 2 + j : end + j] for j in (-2, -1, 1, 2)], axis=0)
    lift(peaks, 1 + amount / 200)
    if fill and 4 < top < bins - 1:
        span = top - at(4000)
        away = np.arange(bins - top)
        if span > 0:
            out[:, top:] = np.maximum(out[:, top:], mag[:, top - 1 - away % span] * np.exp(-away / span) * (0.3 * amount / 100))
    return np.where(np.isfinite(out) & (out >= 0), out, 0.0)


def boost_peaks(mag: np.ndarray, boost: float) -> np.ndarray:
    """Bins over two neighbours on either side are boosted, from the low bins up; those below have been boosted already. The first and
    the last two bins stay."""
    out = mag.copy()
    for k in range(2, mag.shape[1] - 2):
        top = np.all([out[:, k] > out[:, k + j] for j in (-2, -1, 1, 2)], axis=0)
        out[:, k] = np.where(top, out[:, k] * boost, out[:, k])
    return out


def poly_harmonics(mag: np.ndarray, amount: float, orders: int = 4) -> np.ndarray:
    """Powers of a bin added to it, to twice the bin at most, below 85 % of the bins."""
    m = np.minimum(mag, 1)
    extra = sum(amount / (o - 1) * m**o for o in range(2, orders + 1))
    out = np.minimum(mag + extra, 2 * mag)
    top = int(0.85 * mag.shape[1])
    out[:, top:] = mag[:, top:]
    return out


def shift_formants(mag: np.ndarray, semitones: float, reach: int = 20) -> np.ndarray:
    """The smooth envelope of log magnitudes is stretched, the detail stays."""
    logs = np.log(np.maximum(mag, 1e-10))
    k = np.arange(mag.shape[1])
    lo, hi = np.maximum(k - reach, 0), np.minimum(k + reach, len(k) - 1) + 1
    sums = np.concatenate([np.zeros((len(mag), 1)), np.cumsum(logs, axis=1)], axis=1)
    env = (sums[:, hi] - sums[:, lo]) / (hi - lo)
    source = np.clip(k / 2 ** (semitones / 12), 0, len(k) - 1)
    warped = np.stack([np.interp(source, k, e) for e in env]) if len(env) else env
    return np.exp(warped + logs - env)


def build_mask(mag: np.ndarray, voice: np.ndarray, *, warm: int = 90, keep: float = 0.95, alpha: float = 1.7, floor: float = 0.005, quiet: float = 2.0, separation: np.ndarray | None = None, residual: np.ndarray | None = None, restoration: np.ndarray | None = None, presence: np.ndarray | None = None) -> np.ndarray:
    """Mask of each frame in order. Frames without voice start from 1 / quiet. Where a model tells the presence of voice, it decides
    instead (0.5 at least, in the mean): of each bin, the mask starts from its probability; of the frame, from 2 p - 0.5. For the first `warm` frames a profile of the
    noise is averaged, and the mask rises from 0.05 with the square of the part that is done. After that a Wiener gain
    against the profile, smoothed over three bins and kept over a floor, multiplies it. Masks of models, where there are
    any: separation bounds it, residual (0.01 at least) multiplies it, restoration (up to 2) pulls it by half."""
    out, profile = np.ones_like(mag), np.zeros(mag.shape[1])
    told, gates = np.ones(len(mag)), voice
    if presence is not None:
        p = presence.reshape(len(mag), -1)
        gates, told = p.mean(1) >= 0.5, np.maximum(0.0, 2 * p - 0.5) if p.shape[1] == 1 else p
    for f, row in enumerate(mag):
        start = told[f] * (1.0 if gates[f] else 1 / max(1.0, quiet))
        if f < warm:
            profile = row.copy() if f == 0 else keep * profile + (1 - keep) * row
            out[f] = start * (0.05 + 0.95 * ((f + 1) / warm) ** 2)
            continue
        snr = np.minimum(1e6, row**2 / np.maximum(1e-12, alpha * profile**2))
        gain = np.pad(np.clip(snr / (snr + 1), floor, 1), 1, "edge")
        m = start * np.maximum(floor if gates[f] else floor / max(1.0, quiet), (gain[:-2] + gain[1:-1] + gain[2:]) / 3)
        if separation is not None:
            m = np.minimum(m, np.maximum(0, separation[f]))
        if residual is not None:
            m = m * np.maximum(0.01, residual[f])
        if restoration is not None:
            m = m * (0.5 + 0.5 * np.minimum(2, restoration[f]))
        out[f] = m
    return np.where(np.isfinite(out) & (out >= 0), np.minimum(out, 1), 1.0)


def log_spectral_distance(a: np.ndarray, b: np.ndarray, least: float = 1e-10) -> np.ndarray:
    """Per frame, in dB: the root mean square difference of two log power spectra."""
    d = 10 * np.log10(np.maximum(a, least)) - 10 * np.log10(np.maximum(b, least))
    return np.sqrt((d**2).mean(1))
