import hashlib
import random

import pytest
from pyspark.sql import functions as F

from undertone.llm import repeats


def slow(rows, length=100):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0))
    seen, out = set(), {}
    for i in order:
        data = (rows[i][1] or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - length + 1):
            w = data[s : s + length]
            if w in seen:
                gone[s : s + length] = [True] * length
            seen.add(w)
        n = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[rows[i][0]] = (len(data), sum(gone), n, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out


def rows():
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdeé日", k=rng.randint(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(60)]
    made = list(texts)
    for _ in range(80):
        a, b = rng.choice(texts), rng.choice(texts)
        i, j = rng.randrange(len(a)), rng.randrange(len(b))
        made.append(a[:i] + b[j : j + rng.randint(20, 400)] + a[i + rng.randint(0, 40) :])
    made += [None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 500, "xy" * 300, "ab" * 60 + "x" * 300 + "ab" * 70, texts[3] * 3, texts[4], texts[4]]
    rng.shuffle(made)
    return [(3 * i - 50, t) for i, t in enumerate(made)] + [(None, texts[5])]


@pytest.mark.parametrize("spans_of", [repeats.repeated_spans, repeats.doubled_spans])
def test_against_brute_force(spark, spans_of):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"rank": F.lit("clash"), "n": F.lit(1), "doc": F.lit(2)})
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.digest_repeats(docs, spans_of=spans_of).collect()}
    assert got == slow(data)


def test_long_texts_are_cut_without_loss(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(2)
    data = rng.integers(97, 105, 5000).astype(np.uint8)
    data[3000:3400] = data[500:900]
    whole = repeats.runs(data, np.array([0, 5000]))
    monkeypatch.setattr(repeats, "CHUNK", 700)
    cut = repeats.runs(data, np.array([0, 5000]))

    def starts(r):
        return sorted((int(lo) + i, int(k)) for k, _, lo, n, _ in zip(*r) for i in range(n))

    assert starts(whole) == starts(cut)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert repeats.digest_repeats(empty).count() == 0
    t = "word " * 9 + "other text that is long enough to be over one hundred bytes in all, surely"
    same = spark.createDataFrame([(1, t), (1, t), (2, t)], "doc_id bigint, text string")
    out = repeats.remove_repeats(same).collect()
    assert sorted((r.doc_id, bytes(r.kept).decode()) for r in out) == [(1, t), (1, t), (2, "")]


def test_many_texts_share_an_id(spark):
    """Texts without an id are told apart; equal ones among them don't multiply."""
    rng = random.Random(9)
    long = ["".join(rng.choices("abcdefgh ", k=300)) for _ in range(40)]
    data = [(None, t) for t in long] + [(None, long[0])] * 20 + [(7, long[1] + long[2])]
    out = repeats.digest_repeats(spark.createDataFrame(data, "doc_id bigint, text string")).collect()
    assert len(out) == len(data)
    assert all(r.n_removed == (600 if r.doc_id else 0) for r in out)
