"""The pipeline against a brute-force version of each stage, on a small fixture."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_near_copies import slow_components
from undertone.llm import bpe, decontamination, secrets, toxicity

BAD = ("grumblefoo", "snarlbar", "vexquux")


def fixture(spark, folder):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n)) + "."
    items = [(i, text(20 + i)) for i in range(6)]
    docs, labels = [], []
    for i in range(240):
        t = text(rng.randint(20, 60))
        if i % 6 == 0:
            t += " " + " ".join(rng.sample(BAD, 2))
        if i % 7 == 1:
            t += " " + items[i % 6][1] + " " + text(5)
        if i % 11 == 2:
            t += ' token = "' + hashlib.sha1(str(i).encode()).hexdigest() + '" end.'
        if i % 13 == 3 and i > 20:
            t = docs[i - 13][1]
        docs.append((i, t, "en", "s", len(t)))
        if i % 2 == 0:
            labels.append((i, 1, int(any(b in t for b in BAD))))
    docs.append((900, "", "en", "s", 0))
    docs.append((901, None, None, None, None))
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    docs, items = fixture(spark, folder)
    return docs, items, folder, corpus_pipeline.run(spark, folder).collect()


def test_against_brute_force(spark, run):
    docs, items, folder, rows = run
    kept = [(d[0], d[1]) for d in docs if not any(b in (d[1] or "") for b in BAD)]
    groups = slow_components(kept)
    kept = [(i, t) for i, t in kept if groups[i] == i]
    kept = [(i, t) for i, t in kept if not any(len(shingles(t) & shingles(s)) >= 0.8 * len(shingles(s)) for _, s in items)]
    pattern = re.compile(secrets.ASSIGN.replace("(?i:", "(?:"), re.I | re.A)
    kept = [(i, pattern.sub(secrets.MARK, t or "")) for i, t in kept]
    public = Tokenizer.from_file(bpe.default_path())
    expected = sorted((i, public.encode(t, add_special_tokens=False).ids, hashlib.sha256(t.encode()).hexdigest()) for i, t in kept)
    assert sorted((r.doc_id, list(r.ids), r.decoded_sha256) for r in rows) == expected
    assert all(r.n_tokens == len(r.ids) for r in rows)


def test_stages_keep_the_columns_and_take_clashing_ones(spark, run):
    _, _, folder, _ = run
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumns({"fp": F.lit(1), "spans": F.lit("x"), "score": F.lit(0), "d": F.lit(2), "t": F.lit(3), "component_id": F.lit(5)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_toxicity_scores(spark, run):
    docs, _, folder, _ = run
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"), may_learn=toxicity.may_learn)
    got = {r.doc_id: r.score for r in toxicity.scores(table, scorer).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(docs)
    assert all((got[d[0]] >= 0.7) == any(b in (d[1] or "") for b in BAD) for d in docs)
    nothing = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet").limit(0))
    assert {r.score for r in toxicity.scores(table, nothing).collect()} == {0.0}


def test_nnpu_uses_the_prior():
    import numpy as np

    rng = np.random.default_rng(1)
    toxic = np.concatenate([rng.random((200, 1)) < 0.9, rng.random((200, 1)) < 0.5], axis=1).astype(np.float32)
    clean = np.concatenate([rng.random((1800, 1)) < 0.01, rng.random((1800, 1)) < 0.5], axis=1).astype(np.float32)
    w, b = toxicity.fit_nnpu(toxic[:100], np.concatenate([toxic[100:], clean]), 100 / 1900)
    assert w[0] > 1 and abs(w[1]) < 0.7 * w[0] and w[0] + b > -1 > b


def test_decontamination_edges(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, None), (3, ""), (4, "one two three four five six seven eight nine ten eleven twelve"), (None, "q w e r t y")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "x A b C y"), (2, None), (3, ""), (4, "zero one two three four five six seven eight nine ten eleven twelve x"), (4, "again q w e r t y"), (None, "a b x c"), (5, "one two three four five six seven x nine ten eleven twelve")], "doc_id bigint, text string").withColumns({"item_id": F.lit("clash"), "n_item": F.lit(0)})
    got = decontamination.containment_pairs(docs, items).collect()
    assert Counter((r.doc_id, r.item_id) for r in got) == Counter([(1, 1), (4, 4), (4, None)])
    small = decontamination.containment_pairs(docs, items, block_bytes=16).collect()
    assert Counter((r.doc_id, r.item_id) for r in small) == Counter((r.doc_id, r.item_id) for r in got)
    assert decontamination.containment_pairs(docs.limit(0), items).count() == 0
    assert decontamination.containment_pairs(docs, items.limit(0)).count() == 0
    assert decontamination.remove_contaminated(docs, items.limit(0)).count() == 7


def test_decontamination_of_very_long_and_repeated_rows(spark):
    item = "one two three four five six seven eight nine ten eleven twelve"
    filler = "plain " * 500_000
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(1, filler + item), (1, filler + item), (2, filler), (3, item + " " + filler), (4, filler + item.replace("six", "6"))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert Counter((r.doc_id, r.item_id) for r in decontamination.containment_pairs(docs, items).collect()) == Counter([(1, 1), (1, 1), (3, 1)])
    assert sorted(r.doc_id for r in decontamination.remove_contaminated(docs, items).collect()) == [2, 4]


def slow_nnpu(positive, unlabelled, prior, steps, rate, decay):
    """The same fit with numbers one by one."""
    n = len(positive[0]) + 1
    p, u = [[*x, 1.0] for x in positive], [[*x, 1.0] for x in unlabelled]
    w, m, v = [0.0] * n, [0.0] * n, [0.0] * n
    rise = lambda z: 1 / (1 + math.exp(-z))
    soft = lambda z: math.log(1 + math.exp(z))
    for t in range(1, steps + 1):
        gp, gu = ([sum(a * b for a, b in zip(x, w)) for x in side] for side in (p, u))
        negative = sum(map(soft, gu)) / len(u) - prior * sum(map(soft, gp)) / len(p)
        for k in range(n):
            of_negative = sum(x[k] * rise(g) for x, g in zip(u, gu)) / len(u) - prior * sum(x[k] * rise(g) for x, g in zip(p, gp)) / len(p)
            of_positive = -prior * sum(x[k] * rise(-g) for x, g in zip(p, gp)) / len(p)
            grad = (of_positive + of_negative if negative >= 0 else -of_negative) + (decay * w[k] if k < n - 1 else 0)
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
        for k in range(n):
            w[k] -= rate * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def test_nnpu_against_numbers_one_by_one():
    import numpy as np

    rng = np.random.default_rng(6)
    positive, unlabelled = (rng.random((12, 3)) < 0.6).astype(float), (rng.random((40, 3)) < 0.3).astype(float)
    for prior in (0.1, 0.6):  # the second one makes the risk on negatives fall below zero
        w, b = toxicity.fit_nnpu(positive, unlabelled, prior, steps=80)
        slow_w, slow_b = slow_nnpu(positive.tolist(), unlabelled.tolist(), prior, 80, toxicity.RATE, toxicity.WEIGHT_DECAY)
        assert list(w) == pytest.approx(slow_w, abs=1e-9) and b == pytest.approx(slow_b, abs=1e-9)


def test_scores_against_words_one_by_one(spark, run):
    """Ties, repeated rows, nulls and a long text: every score is the map of the sum over the text's distinct words."""
    import numpy as np
    import pyarrow as pa

    from undertone.llm.words import NOT_LETTER, words_of

    _, _, folder, _ = run
    table = spark.read.parquet(f"{folder}/documents.parquet")
    scorer = toxicity.fit(table, spark.read.parquet(f"{folder}/labels.parquet"), may_learn=toxicity.may_learn)
    texts = [None, "", "snarlbar", "SNARLBAR snarlbar", "snarlbar vexquux", "snarlbar vexquux", "plain " * 600_000 + "grumblefoo", "né snarlbar's"]
    found = toxicity.scores(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), scorer).collect()
    weight = dict(zip(scorer.keys.tolist(), scorer.weights.tolist(), strict=True))
    for r in found:
        words = {w for w in re.split(r"[^A-Za-z\\u0080-\\U0010ffff]+", (texts[r.doc_id] or "").lower()) if w}
        g = scorer.bias + sum(weight.get(int(words_of(pa.array([w]), breaks=NOT_LETTER).hashes()[0]), 0) for w in words)
        assert r.score == pytest.approx(1 / (1 + np.exp(-(scorer.scale * g + scorer.shift))), rel=1e-5)
