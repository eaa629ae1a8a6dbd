"""Numpy kernels and operators against identities and plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.functions import recurrences as R
from undertone.functions import spectrum as K
from undertone.operators import frames as O
from undertone.operators import matching as M
from undertone.operators import sequences as S
from undertone.operators import stores
from undertone.sources import wav

SR = 48_000
SINE = np.sin(2 * np.pi * 440 * np.arange(SR // 4) / SR)


@pytest.mark.parametrize(("size", "hop", "most"), [(1024, 256, 1e-3), (4096, 1024, 0.02)])
def test_stft_round_trip(spark, size, hop, most):
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(SINE)], "signal_id string, idx bigint, x double")
    back = {r.idx: r.x for r in O.istft(O.stft(df, size, hop), hop).collect()}
    inner = range(size, max(back) - size)
    assert max(abs(back[i] - SINE[i]) for i in inner) < most


def test_frame_size_is_checked(spark):
    with pytest.raises(ValueError):
        O.stft(spark.createDataFrame([("a", 0, 1.0)], "signal_id string, idx bigint, x double"), 1000, 250)
    assert K.cut(np.zeros(10), 16, 8).shape == (0, 16)


def test_parseval_and_guards():
    x = np.random.default_rng(1).normal(size=(3, 64))
    p = np.abs(np.fft.fft(x, axis=1)) ** 2
    assert np.allclose(p.sum(1) / 64, (x**2).sum(1))
    mag = np.array([[np.nan, np.inf, -1.0, 0.5, 1.0]])
    assert np.isfinite(K.inverse_frames(mag, np.zeros((1, 5)))).all()


def test_filters():
    x = np.random.default_rng(2).normal(size=4000)
    low = R.biquad(np.ones(4000), R.biquad_design("highpass", 100, 0.707, 0, SR / 10))
    assert abs(low[-1]) < 1e-3
    assert abs(R.biquad(np.ones(4000), R.biquad_design("lowpass", 100, 0.707, 0, SR / 10))[-1] - 1) < 1e-6
    for kind in ("peaking", "highshelf", "lowshelf"):
        assert np.allclose(R.biquad(x, R.biquad_design(kind, 500, 1, 0.0, SR)), x)
    hum = np.sin(2 * np.pi * 60 * np.arange(20000) / 1000)
    assert np.abs(R.cascade(hum, R.hum_notches(1000))[-500:]).max() < 0.01
    with pytest.raises(ValueError):
        R.biquad_design("comb", 1, 1, 1, SR)


def test_dynamics():
    quiet, loud = np.full(500, 0.001), np.full(500, 0.8)
    g = R.gate(np.concatenate([quiet, loud, quiet]), 0.01, 0.1, 2, 5, 0.2, 0.5)
    assert abs(g[999]) > 0.79 and abs(g[1400]) < 0.00011
    c = R.compress(loud, -20, 4, 6, 0.5, 0.9)
    assert math.isclose(20 * math.log10(c[-1] / 0.8), (20 * math.log10(0.8) + 20) * (1 / 4 - 1), rel_tol=1e-6)
    assert (R.deess(loud, loud, 0.3, 3, 0.0, 0.5, 0.9) == loud).all()
    assert R.declip(np.array([0.0, 1.0, 1.0, 0.0]), 0.99).tolist() == [0.0, 0.5, 0.25, 0.0]


def test_floors_stay_low():
    mag = np.concatenate([np.full((1, 4), 0.03), np.full((5, 4), 0.9)])
    assert K.minimum_floor(mag, np.ones(6, bool), 100)[-1].max() < 0.1
    steady = np.full((200, 6), 0.5)
    assert np.allclose(K.mcra(steady), 0.5)
    assert (K.running_dereverb(steady, 0.8) == steady).all()


def test_gates_and_masks_are_bounded():
    m = np.abs(np.random.default_rng(3).normal(size=(20, 33)))
    assert (K.erb_gate(m, -200, SR, 64, 8) <= m + 1e-12).all()
    mask = K.build_mask(m, np.arange(20) % 2 == 0, warm=5, separation=np.full((20, 33), 0.9), residual=m, restoration=m)
    assert mask.min() >= 0 and mask.max() <= 1
    assert (K.enhance_harmonics(m, 3.0, SR, fill=False) <= 1.5 * m + 1e-12).all()
    assert np.allclose(K.shift_formants(m, 0.0), m)
    assert np.isfinite(K.mfcc(m**2, SR)).all()
    assert math.isclose(np.linalg.norm(K.fingerprint(m**2, 16000)), 1.0)
    bands = K.erb_bands(32, SR, 2049)
    assert all(b[0] <= a[1] for a, b in zip(bands, bands[1:]))


def test_wav_files(spark, tmp_path):
    x = np.stack([SINE[:1000], -SINE[:1000]])
    for bits, most in ((16, 1.5 / 2**15), (24, 1.5 / 2**23), (32, 1e-7)):
        rate, back = wav.decode(wav.encode(x, 8000, bits))
        assert rate == 8000 and np.abs(back - x).max() < most
    assert len(wav.encode(np.zeros(10), 8000)) == 44 + 20
    (tmp_path / "a.wav").write_bytes(wav.encode(x, 8000))
    (tmp_path / "b.WAV").write_bytes(b"RIFFxxxx")
    (tmp_path / "c.mid").write_bytes(b"MThd")
    rows = wav.read_wav(spark, str(tmp_path)).collect()
    assert sorted((r.path[-5:], r.ch, r.error is None) for r in rows) == [("a.wav", 0, True), ("a.wav", 1, True), ("b.WAV", None, False)]


def test_kmeans_like_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 0.2, size=(30, 2)) for c in (0, 3, 6)])
    rows = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "id bigint, v array<double>")
    got = {r.id: r.label for r in M.kmeans(rows, 3, id="id", vector="v").collect()}
    assert len({tuple(sorted(i for i in got if got[i] == k)) for k in set(got.values())}) == 3
    assert all(len({got[i] for i in range(30 * k, 30 * k + 30)}) == 1 for k in range(3))
    assert M.kmeans(rows.limit(0), 3, id="id", vector="v").count() == 0


def test_similarity(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [0.0, 0.0])], "id bigint, v array<double>")
    assert [r.c for r in rows.orderBy("id").select(M.cosine("v", F.array(F.lit(1.0), F.lit(0.0))).alias("c")).collect()] == [1.0, -1.0, 0.0]
    profiles = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0])], "name string, v array<double>")
    got = {r.id: (r.name, r.score) for r in M.best_match(rows, profiles, least=0.65).collect()}
    assert got == {1: ("a", 1.0), 2: (None, -1.0), 3: (None, 0.0)}
    assert {r.name for r in M.best_match(rows, profiles.limit(0)).collect()} == {None}


def test_order_and_partitions_do_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(i), float(v)) for s in range(3) for i, v in enumerate(rng.normal(size=60))]
    schema = "signal_id bigint, idx bigint, x double"

    def found(data, n):
        df = spark.createDataFrame(data, schema).repartition(n)
        return sorted((r.signal_id, r.idx, round(r.y, 9)) for r in S.ema(df, 0.8).collect())

    assert found(rows, 1) == found(rows[::-1], 7)
    ends = {r.signal_id: r.ema for r in S.ema_last(spark.createDataFrame(rows, schema), 0.8).collect()}
    assert all(abs(ends[s] - y) < 1e-8 for s, i, y in found(rows, 2) if i == 59)


def test_stores(spark):
    log = spark.createDataFrame([(1, 1, "a", False), (1, 2, "b", False), (2, 1, "c", False), (2, 3, None, True)], "k bigint, t bigint, v string, gone boolean")
    assert {r.k: r.v for r in stores.latest(log, "k", "t").collect()} == {1: "b", 2: None}
    assert [r.k for r in stores.latest_or_gone(log, "k", F.col("gone"), "t").collect()] == [1]
    assert {r.k: r.v for r in stores.merged(log, "k", ["v"], "t").collect()} == {1: "b", 2: "c"}
    empty = stores.event_summary(log.limit(0), done=F.col("gone"), failed=F.col("gone"), duration=F.col("t"), at="t").first()
    assert (empty.total, empty.mean_duration, empty.error_rate, empty["last"]) == (0, 0, 0.0, None)
    assert stores.progress(spark.createDataFrame([], "state string, share double"), "state", "share").first().percent == 100


def test_pages_of_groups(spark):
    rows = [("hot", i % 40, "x") for i in range(100)] + [("b", 1, None), (None, 7, "y"), (None, None, "z")]
    df = spark.createDataFrame(rows, "g string, page int, members string").repartition(5)
    found = stores.grouped_pages(df, "g", "page", "members", size=16).orderBy("page").collect()
    assert sum(r.n for r in found) == len(rows) and all(r.n == len(r.members) <= 16 for r in found)
    key = lambda r: tuple((v is not None, v) for v in r)
    for g in ("hot", "b", None):
        own = [r for r in found if r.g == g]
        assert [tuple(m) for r in own for m in r.members] == sorted((r[1:] for r in rows if r[0] == g), key=key)
        assert [r.page for r in own] == list(range(own[0].page, own[0].page + len(own)))
        assert all(r.n == 16 for r in own[1:-1])
    assert len([r for r in found if r.g == "hot"]) >= 7
    assert stores.grouped_pages(df.limit(0), "g", "page").count() == 0
    with pytest.raises(ValueError):
        stores.grouped_pages(df, "g", "page", size=0)


def test_repair_of_a_run(spark):
    x = [0.0, 1.0, 9.0, 9.0, 4.0, 5.0]
    rows = spark.createDataFrame([("a", i, v, i in (2, 3)) for i, v in enumerate(x)], "signal_id string, idx bigint, x double, click boolean")
    y = [r.y for r in S.repair(rows).orderBy("idx").collect()]
    assert y[0:2] == x[0:2] and y[4:] == x[4:] and 1 < y[2] < y[3] < 4


def test_subtraction_by_hand():
    mag, noise = np.array([[1.0, 0.5, 0.2]]), np.array([0.1, 0.4, 0.0])
    assert K.over_subtract(mag, noise, 2.0, floor=0.1, blend=0.25)[0] == pytest.approx([0.25 + 0.75 * 0.8, 0.125 + 0.75 * 0.05, 0.2])
    assert K.over_subtract(np.zeros((1, 1)), np.zeros(1), 1.0, blend=0.0)[0, 0] == 1e-7


def test_band_wiener_like_a_plain_loop():
    rng = np.random.default_rng(6)
    mag, noise, sr, bands = rng.random((5, 40)), rng.random(40) * 0.1, 8000.0, 4
    mag[3] = 0
    want, gains = mag.copy(), [1.0] * bands
    for row in want:
        for b in range(bands):
            f0, f1 = (20 * (sr / 2 / 20) ** (t / bands) for t in (b, b + 1))
            lo = max(0, math.floor(f0 * 40 / (sr / 2)))
            hi = max(lo, min(39, math.ceil(f1 * 40 / (sr / 2))))
            heard, hum = sum(v * v for v in row[lo : hi + 1]) / (hi - lo + 1), sum(noise[lo : hi + 1]) / (hi - lo + 1)
            g = max(0.01, math.sqrt(max(0, heard - hum) / heard)) if heard > 1e-10 else 0.01
            gains[b] = 0.85 * gains[b] + 0.15 * g
            row[lo : hi + 1] *= gains[b]
    assert np.allclose(K.band_wiener(mag, noise, sr, bands), want)


def test_live_deesser_like_a_plain_loop():
    x = np.sin(np.arange(3000) * 1.9) * np.repeat([0.05, 0.9, 0.2], 1000) + 0.1 * np.sin(np.arange(3000) * 0.05)
    band = R.biquad_design("peaking", 6000, 3, -6, 16000)
    side, env, on, want = R.biquad(x, band), 0.0, False, []
    for v, s in zip(x, side):
        a = abs(s)
        env = 0.05 * a + 0.95 * env if a > env else 0.0005 * a + 0.9995 * env
        ratio = min(1, env / (abs(v) + 1e-9))
        if on and ratio < 0.33:
            on = False
        elif not on and ratio > 0.37:
            on = True
        want.append(v - s * (max(0, min(0.85, (ratio - 0.35) / 0.65 * 0.7 * 0.85)) if on else 0))
    assert np.allclose(R.deess_live(x, band, 0.7), want) and not np.allclose(want, x)


def test_harmonics_by_hand():
    """2049 bins at 48 kHz: one peak in the second formant's range, one at 5 kHz, silence above 8 kHz."""
    mag = np.full((1, 2049), 0.01)
    mag[0, [200, 427]] = 1.0
    mag[0, 683:] = 0
    out = K.enhance_harmonics(mag, 50.0, 48_000.0)
    assert out[0, 427] == pytest.approx(1.25)
    flat = min(1, 4 * np.exp(np.mean(np.log(np.where(np.abs(np.arange(7, 257) - 200) <= 2, mag[0, 7:257] * 1.1, mag[0, 7:257]) + 1e-10))) / np.mean(np.where(np.abs(np.arange(7, 257) - 200) <= 2, mag[0, 7:257] * 1.1, mag[0, 7:257]) + 1e-10))
    assert out[0, 200] == pytest.approx(min(1.5, 1.1 * (1 - 0.2 * flat) * 1.25))
    assert out[0, 683] == pytest.approx(0.01 * 0.15) and out[0, 683 + 255] == pytest.approx(math.exp(-255 / 342) * 0.15)
    assert (K.enhance_harmonics(mag, 0.0, 48_000.0) == mag).all()


def test_mask_ramp_and_models():
    mag = np.ones((12, 3))
    mask = K.build_mask(mag, np.ones(12, bool), warm=10, alpha=1.0)
    assert mask[0, 0] == pytest.approx(0.05 + 0.95 * 0.01) and mask[9, 0] == pytest.approx(1.0) and mask[11, 0] == pytest.approx(0.5)
    assert K.build_mask(mag, np.zeros(12, bool), warm=10)[9, 0] == pytest.approx(0.5)
    bounded = K.build_mask(mag, np.ones(12, bool), warm=1, alpha=1.0, separation=np.full((12, 3), 0.2), residual=np.zeros((12, 3)), restoration=np.full((12, 3), 3.0))
    assert bounded[5, 0] == pytest.approx(0.2 * 0.01 * 1.5)


def test_clicks_overlap_and_follow_the_level(spark):
    """A click that one block hides behind a loud half is seen by the block that starts half a block later."""
    x = [0.9] * 9 + [0.01] * 7 + [0.5] + [0.01] * 15
    rows = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "signal_id string, idx bigint, x double")
    flags = [r.click for r in S.clicks(rows, 16, 3.0).orderBy("idx").collect()]
    level = max(0.005, sum(x) / len(x) * 0.5)
    want = [False] * len(x)
    for b in range(0, len(x), 8):
        block = x[b : b + 16]
        if len(block) >= 4:
            m = sorted(map(abs, block))[len(block) // 2]
            for i, v in enumerate(block):
                want[b + i] |= abs(v) > max(3 * m, level)
    assert flags == want and flags[16]


def test_places_in_a_total_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v")).repartition(5)
    assert sorted((r.v, r.place) for r in S.numbered(df, F.desc("v")).collect()) == [(v, 1000 - v) for v in range(1000)]
    assert S.numbered(df.limit(0), "v").count() == 0


def test_profiles_in_blocks_keep_ties_and_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0])], "id bigint, v array<double>")
    profiles = spark.createDataFrame([(n, [1.0, 0.0]) for n in "fedcb"] + [("z", [0.0, 1.0])], "name string, v array<double>")
    assert sorted((r.id, r.name) for r in M.best_match(rows, profiles).collect()) == [(1, "b"), (1, "z")]


def test_unequal_lengths_and_missing_state(spark):
    dry = spark.createDataFrame([("a", i, 1.0) for i in range(5)], "signal_id string, idx bigint, x double")
    wet = dry.where("idx < 3").select("signal_id", "idx", F.lit(0.0).alias("y"))
    assert dry.join(wet, ["signal_id", "idx"]).count() == 3
    new, old = spark.createDataFrame([(1, 5), (2, 6)], "u bigint, n bigint"), spark.createDataFrame([(1, 0.5)], "u bigint, volume double")
    assert {r.u: r.volume for r in stores.carried_over(new, old, "u", {"volume": F.lit(1.0)}).collect()} == {1: 0.5, 2: 1.0}


def test_recordings_are_clustered_apart(spark):
    rng = np.random.default_rng(8)
    rows = [(s, f, [float(v) for v in rng.normal((f // 10) % k * 3, 0.1, 3)]) for s, k in ((1, 2), (2, 3)) for f in range(60)]
    got = M.clustered_frames(spark.createDataFrame(rows, "signal_id bigint, f bigint, v array<double>"), lambda n: 3, key="signal_id", order="f", vector="v").collect()
    for s, k in ((1, 2), (2, 3)):
        of = {r.f: r.label for r in got if r.signal_id == s}
        assert all(len({of[f] for f in range(a, a + 10)}) == 1 for a in range(0, 60, 10)) or k == 2


def _frames(seed, n=14, bins=33):
    rng = np.random.default_rng(seed)
    return np.abs(rng.normal(size=(n, bins))) * rng.choice([0.02, 1.0], (n, 1))


def test_erb_gate_against_loops():
    mag, sr, hop = _frames(1), 16_000.0, 64
    want, floor, keep = mag.tolist(), 10 ** (-6 / 20), math.exp(-hop / (sr * 0.06))
    bands, before = K.erb_bands(32, sr, 33), [1.0] * 32
    for row in want:
        for b, (lo, hi) in enumerate(bands):
            level = math.sqrt(sum(v * v for v in row[lo : hi + 1]) / (hi - lo + 1))
            ratio = level / (floor + 1e-10)
            knee = min(1.0, max(0.0, (math.log2(ratio) + 1) / 2)) if ratio > 0 else 0.0
            smooth = knee * knee * (3 - 2 * knee)
            gain = 1.0 if ratio >= 2 else ratio * (1 - smooth) + smooth if ratio > 0.5 else ratio
            before[b] = keep * before[b] + (1 - keep) * gain
            for k in range(lo, hi + 1):
                row[k] *= before[b]
    assert np.allclose(K.erb_gate(mag, -6, sr, hop), want) and not np.allclose(mag, want)


def test_minimum_floor_and_adaptive_wiener_against_loops():
    mag, quiet = _frames(2, 30, 5), [i % 4 != 1 for i in range(30)]
    keep, length = math.exp(-1 / 10), 2
    got = K.minimum_floor(mag, np.array(quiet), 10)
    for k in range(5):
        average = low = None
        held, at, age = [], 0, 0
        for f in range(30):
            v = float(mag[f, k])
            if quiet[f] and average is None:
                average, low, held = v, v, [v] * 5
            elif quiet[f]:
                average = keep * average + (1 - keep) * v
                low, age = min(low, average), age + 1
                if age >= length:
                    held[at % 5], at, low, age = low, at + 1, average, 0
            assert got[f, k] == pytest.approx(min(held) if held else 0.0)
    conf = np.array([0.0 if q else 0.9 for q in quiet])
    out = K.adaptive_wiener(mag, conf, 1.2, 0.02, 10)
    for f in range(30):
        for k in range(5):
            snr = mag[f, k] ** 2 / max(1.2 * got[f, k] ** 2, 1e-12)
            gain = min(1.0, max(0.02, snr / (snr + 1)))
            assert out[f, k] == pytest.approx(mag[f, k] * (conf[f] + (1 - conf[f]) * gain))


def test_mcra_against_loops():
    mag = _frames(3, 200, 4)
    got = K.mcra(mag, window=20)
    for k in range(4):
        p = [float(v) ** 2 for v in mag[:, k]]
        noise = level = p[0]
        presence, levels = 0.0, []
        for v in p:
            level = 0.9 * level + 0.1 * v
            levels.append(level)
            presence = 0.9 * presence + 0.1 * (level / (min(levels[-20:]) + 1e-10) > 5.0)
            k_ = 0.92 + 0.08 * presence
            noise = k_ * noise + (1 - k_) * v
        assert got[k] == pytest.approx(math.sqrt(noise))


def test_shifted_formants_against_loops():
    mag = _frames(4, 3, 40) + 0.01
    got, factor = K.shift_formants(mag, 3.0, 4), 2 ** (3 / 12)
    for f in range(3):
        logs = [math.log(v) for v in mag[f]]
        env = [sum(logs[max(0, k - 4) : k + 5]) / len(logs[max(0, k - 4) : k + 5]) for k in range(40)]
        for k in range(40):
            at = k / factor
            lo = int(at)
            warped = env[lo] + (at - lo) * (env[min(lo + 1, 39)] - env[lo])
            assert got[f, k] == pytest.approx(math.exp(warped + logs[k] - env[k]))


def test_mfcc_and_fingerprint_against_loops():
    p, sr = _frames(5, 9, 33) ** 2, 16_000.0
    mel = lambda hz: 2595 * math.log10(1 + hz / 700)
    hz = lambda m: 700 * (10 ** (m / 2595) - 1)
    edges = [math.floor(65 * hz(mel(sr / 2) * i / 41) / sr) for i in range(42)]
    rows = []
    for frame in p:
        energies = []
        for a, b, c in zip(edges, edges[1:], edges[2:]):
            total = sum(frame[k] * (k - a) / (b - a) for k in range(a, b)) + sum(frame[k] * (c - k) / (c - b) for k in range(b, c) if k < 33)
            energies.append(math.log(max(total, 1e-10)))
        rows.append([sum(e * math.cos(math.pi * n * (j + 0.5) / 40) for j, e in enumerate(energies)) for n in range(13)])
    assert np.allclose(K.mfcc(p, sr), rows)
    slope = lambda x: [[sum(n * (x[min(t + n, len(x) - 1)][i] - x[max(t - n, 0)][i]) for n in (1, 2)) / 10 for i in range(13)] for t in range(len(x))]
    first = slope(rows)
    joined = [a + b + c for a, b, c in zip(rows, first, slope(first))]
    mean = [sum(r[i] for r in joined) / 9 for i in range(39)]
    spread = [math.sqrt(sum((r[i] - mean[i]) ** 2 for r in joined) / 9) for i in range(39)]
    values = mean + spread
    pooled = [(values[2 * i] + values[2 * i + 1]) / 2 for i in range(39)] + [0.0] * 25
    norm = math.sqrt(sum(v * v for v in pooled))
    assert np.allclose(K.fingerprint(p, sr), [v / norm for v in pooled])


def test_boosted_peaks_against_a_loop():
    mag = _frames(6, 20, 33)
    want = mag.tolist()
    for row in want:
        for k in range(2, 31):
            if all(row[k] > row[k + j] for j in (-2, -1, 1, 2)):
                row[k] *= 1.3
    assert np.allclose(K.boost_peaks(mag, 1.3), want) and not np.allclose(mag, want)


def test_saved_sessions(spark):
    from undertone.functions import text as T

    texts = ['{"params":{"a":1,"b":"x","c":2.5},"meta":{"tab":"t"},"savedAt":1}', '{"params":{}}', '{"params":[1]}', '{"params":3}', '{"meta":{}}', "{", "", None, '{"params":{"a":1}'. strip()]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, j string").select("i", T.saved_session("j").alias("s")).orderBy("i").collect()
    assert rows[0].s.params == {"a": 1.0, "b": None, "c": 2.5} and rows[0].s.meta == {"tab": "t"}
    assert rows[1].s.params == {} and rows[1].s.meta == {} and all(r.s is None for r in rows[2:])
