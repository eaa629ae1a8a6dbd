import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from undertone.llm import pitman_yor as py
from undertone.llm.shared import fold
from undertone.llm.words import words_of


def data():
    rng = random.Random(8)
    nouns, verbs = ([("".join(rng.choices("abcdefghé", k=rng.randint(2, 6))) + end) for _ in range(60)] for end in ("n", "v"))
    texts = [" ".join(w for _ in range(rng.randint(0, 60)) for w in (rng.choice(nouns).title(), rng.choice(verbs))) for _ in range(150)]
    return list(enumerate(texts)) + [(500, None), (501, ""), (502, " \n "), (503, "never seen words"), (504, "aan " * 30000), (None, texts[1]), (3, texts[3])]


def tokens(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split() + [None]


def test_base_against_brute_force_and_gain(spark):
    rows = data()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"word": F.lit("clash"), "piece": F.lit(1), "score": F.lit(0.5)})
    out = py.score(docs, trains=lambda d: fold(d, 10) != 0).collect()
    assert len(out) == len(rows)
    learns = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 10 != 0
    count = Counter(w for i, t in rows if learns(i) for w in tokens(t))
    n, v = sum(count.values()), len(count)
    expected = sorted((str(i), not learns(i), len(tokens(t)), sum(count[w] > 0 for w in tokens(t)), n, sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tokens(t))) for i, t in rows)
    got = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in out)
    for g, e in zip(got, expected):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], rel=1e-9)
    short = [r for r in out if r.held_out and r.n_tokens < 1000]
    assert sum(r.score for r in short) > sum(r.base_score for r in short)
    assert all(r.score < 0 for r in out)


def hash_of(word):
    return py.END if word is None else int(words_of(pa.array([word.decode()])).hashes()[0])


def one(x):
    return np.array([x])


def slow_seat(customers, j, t, weight, slope, d, key):
    """Customers from j on sit down one by one."""
    opened, step = [], 0
    while j < customers:
        draw, log_p, before = math.log(py._uniform(py._salted(key, step))[0]), 0.0, t
        while j < customers and t == before:
            a = weight + slope * t
            log_p += math.log((j - d * t) / (j - d * t + a))
            if log_p <= draw:
                opened.append(j)
                t += 1
            j += 1
        step += 1
    return opened


def slow_importance(opened, customers, weight, slope, d):
    return sum(math.log(j - d * t + weight + slope * t) for j in range(1, customers) for t in [1 + sum(o < j for o in opened)])


def slow_seated(old, customers, weight, slope, d, key, first):
    new = slow_seat(customers, 1, 1, weight, slope, d, key)
    if first:
        return new
    gain = slow_importance(new, customers, weight, slope, d) - slow_importance(old, customers, weight, slope, d)
    return new if math.log(py._uniform(py._salted(key, 1 << 40))[0]) < gain else old


def slow_scores(rows, learns):
    """The whole model in dictionaries, one restaurant after the other, with the same draws."""
    pairs = Counter()
    for i, t in rows:
        u = py.START
        for w in map(hash_of, tokens(t)):
            pairs[w, u] += learns(i)
            u = w
    pairs = {p: n for p, n in pairs.items() if n}
    eaten, served = Counter(), Counter()
    for (w, u), n in pairs.items():
        eaten[w] += n
        served[u] += n
    base = 1 / (len(eaten) + 1)
    seats, parent, guests, samples = {p: [] for p in pairs}, {w: [] for w in eaten}, Counter(), []
    key_of = {p: py.pair_key(one(np.uint64(p[0])), one(np.uint64(p[1]))) for p in pairs}
    for s in range(py.BURN_IN + py.SAMPLES + 1):
        if s:
            all_guests, all_parent = sum(guests.values()), sum(len(o) + 1 for o in parent.values())
            tables = Counter()
            for (_, u), o in seats.items():
                tables[u] += len(o) + 1
            now = {}
            for (w, u), n in pairs.items():
                if n == 1:
                    now[w, u] = []
                    continue
                own = len(seats[w, u]) + 1
                left = guests[w] - own
                p = (left - py.PARENT_DISCOUNT * min(len(parent[w]) + 1, left) + (py.PARENT_STRENGTH + py.PARENT_DISCOUNT * all_parent) * base) / (py.PARENT_STRENGTH + all_guests - own)
                now[w, u] = slow_seated(seats[w, u], n, (py.STRENGTH + py.DISCOUNT * (tables[u] - own)) * p, py.DISCOUNT * p, py.DISCOUNT, py._salted(key_of[w, u], s), s == 1)
            seats = now
        before, guests = guests, Counter()
        for (w, _), o in seats.items():
            guests[w] += len(o) + 1
        if s:
            slope = py.PARENT_DISCOUNT * base
            for w, old in parent.items():
                key, weight = py._salted(one(np.uint64(w)), 1000 + s), (py.PARENT_STRENGTH + py.PARENT_DISCOUNT * (all_parent - len(old) - 1)) * base
                kept = [o for o in old if o < guests[w]]
                kept = kept + slow_seat(guests[w], min(before[w], guests[w]), len(kept) + 1, weight, slope, py.PARENT_DISCOUNT, py._salted(key, 7))
                parent[w] = slow_seated(kept, guests[w], weight, slope, py.PARENT_DISCOUNT, key, s == 1)
        if s > py.BURN_IN:
            tables = Counter()
            for (_, u), o in seats.items():
                tables[u] += len(o) + 1
            samples.append((dict(seats), tables, Counter(guests), {w: len(o) + 1 for w, o in parent.items()}))

    def probability(w, u):
        total = 0
        for seats, tables, guests, above in samples:
            t0 = sum(above.values())
            p0 = (guests[w] - py.PARENT_DISCOUNT * above.get(w, 0) + (py.PARENT_STRENGTH + py.PARENT_DISCOUNT * t0) * base) / (py.PARENT_STRENGTH + sum(guests.values()))
            own = pairs[w, u] - py.DISCOUNT * (len(seats[w, u]) + 1) if (w, u) in pairs else 0
            total += (own + (py.STRENGTH + py.DISCOUNT * tables[u]) * p0) / (py.STRENGTH + served[u])
        return total / len(samples)

    out = []
    for _, t in rows:
        h = [hash_of(w) for w in tokens(t)]
        out.append(sum(math.log10(probability(w, u)) for u, w in zip([py.START, *h], h, strict=False)))
    return out, probability, eaten


def test_score_against_a_slow_sampler(spark):
    rows = [r for r in data() if r[0] != 504 and r[0] is not None][:60] + [(504, "aan " * 300), (505, "aan bbv " * 40)]
    learns = lambda i: zlib.crc32(str(i).encode()) % 10 != 0
    want, probability, eaten = slow_scores(rows, learns)
    docs = spark.createDataFrame([(k, i, t) for k, (i, t) in enumerate(rows)], "k bigint, doc_id bigint, text string")
    got = {r.doc_id: r.score for r in py.score(docs, doc_id="k", trains=lambda d: d.isin([k for k, (i, _) in enumerate(rows) if learns(i)])).collect()}
    for k in range(len(rows)):
        assert got[k] == pytest.approx(want[k], rel=1e-9), rows[k]
    for u in (py.START, hash_of(b"aan"), 12345):
        assert sum(probability(w, u) for w in [*eaten, 99]) == pytest.approx(1.0)


def test_packing():
    for kind in (np.uint16, np.int32, np.uint64):
        x = np.array([0, 5, 300, 65535], kind)
        assert (py.unpack(py.pack(x, kind), kind) == x).all() and len(py.unpack(py.pack(x[:0], kind), kind)) == 0
    for x in (np.array([0, -1, 1, 2**62, -(2**63), 2**63 - 1]), np.array([-3, 4]), np.zeros(5, np.int64)):
        assert (py.unpack(py.pack(x, np.int64), np.int64) == x).all()
    assert len(py.pack(np.array([1, 2, 3]), np.int64)) == 9 + 3 and len(py.unpack(b"", np.uint64)) == 0


@pytest.mark.parametrize("weight, slope, d", [(0.3, 0.0, 0.5), (2.0, 0.1, 0.75), (0.05, 0.02, 0.75), (9.0, 0.5, 0.2)])
def test_sweeps_sample_the_posterior(weight, slope, d):
    """The number of tables after some sweeps against its exact distribution."""
    n, dishes = 7, 20_000
    ways = {1: 1.0}
    for j in range(1, n):
        ways = {t: ways.get(t - 1, 0) + (j - d * t) * ways.get(t, 0) for t in range(1, j + 2)}
    exact = np.array([ways[t] * math.prod(weight + slope * i for i in range(1, t)) for t in range(1, n + 1)])
    now, customers, key = py.Seating.least(dishes), np.full(dishes, n), np.random.default_rng(5).integers(0, 2**63, dishes).astype(np.uint64)
    for s in range(40):
        now = py.seated(now, customers, np.full(dishes, weight), np.full(dishes, slope), d, py._salted(key, s), s == 0)
    assert (np.bincount(now.tables, minlength=n + 1)[1:] / dishes) == pytest.approx(exact / exact.sum(), abs=0.012)


def test_very_many_customers_cost_few_steps():
    n = 10**12
    now = py.seated(py.Seating.least(3), np.full(3, n), np.array([0.1, 1.0, 5.0]), np.full(3, 0.01), 0.5, np.arange(3).astype(np.uint64))
    assert (now.tables >= 1).all() and (now.opened < n).all()


@pytest.mark.parametrize("few", [0, 10**9])
def test_dishes_by_themselves_and_together_draw_the_same(few, monkeypatch):
    rng = np.random.default_rng(4)
    n, weight, slope, key = rng.integers(2, 3000, 300), rng.random(300) * 20, rng.random(300), rng.integers(0, 2**63, 300).astype(np.uint64)
    monkeypatch.setattr(py, "FEW", few)
    now = py.seat(py.Seating.least(300), np.ones(300, np.int64), n, weight, slope, 0.75, key)
    for i in range(0, 300, 17):
        assert now.opened[now.owner == i].tolist() == slow_seat(int(n[i]), 1, 1, weight[i], slope[i], 0.75, key[i : i + 1])
    assert now.tables.max() > 100


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 12, 500), 10.0 ** np.arange(2, 12)])
    assert py.log_gamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-12, abs=1e-11)


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id bigint, text string")
    out = py.score(docs, trains=lambda d: F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.held_out and r.base_score == pytest.approx(0) for r in out)
    assert py.score(docs.limit(0)).count() == 0
