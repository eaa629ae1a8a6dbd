"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a usable label; everything else is unlabelled. A linear
scorer g over the presence of words is fitted by numpy to the risk

    R(g) = prior * E_pos[loss(g)] + max(0, E_unl[loss(-g)] - prior * E_pos[loss(-g)])

with the logistic loss, whose second term estimates the risk on true negatives and is kept
from going below zero (when it does, a step against it is taken). The class prior is the
share of toxic rows among the labelled ones that may be used. A one-dimensional logistic fit on
the same labelled rows maps g to a probability.

What is learnt comes from a bounded, documented sample: at most about MOST_POSITIVE toxic
documents, MOST_UNLABELLED unlabelled and MOST_CHECKED labelled documents, chosen by a hash of
the id. Words are runs of letters, A-Z lower-cased, hashed to 64 bits; the model keeps at most
MOST_WORDS words, those whose share among the toxic examples most exceeds their share
among the unlabelled. Scoring reads every word of every text.

Defined results: null and empty texts are scored from the intercept alone; labels of null or
unknown ids are ignored; a doc_id with several labels counts as toxic if one of them is; with
no toxic example every score is 0; repeated rows are scored one by one; other columns are
ignored by the scorer and passed through by `remove_toxic`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import fold, pieces, read_table, stored
from undertone.llm.words import NOT_LETTER, U64, Lookup, words_of

THRESHOLD = 0.7
MOST_POSITIVE, MOST_UNLABELLED, MOST_CHECKED = 4_000, 8_000, 4_000
MOST_WORDS = 2_000
#: A word must be in this many toxic examples, in this share of them, and stand this many standard
#: deviations above what its share among the unlabelled leads to expect.
LEAST_DOCS, LEAST_SHARE, LEAST_DEVIATIONS = 4, 0.004, 5.0
WEIGHT_DECAY, STEPS, RATE = 1e-3, 600, 0.1


@dataclass
class Scorer:
    """Sorted word hashes, their weights, intercept, and the map from g to a probability."""

    keys: np.ndarray
    weights: np.ndarray
    bias: float
    scale: float
    shift: float

    def probability(self, g: np.ndarray) -> np.ndarray:
        if self.shift == -np.inf:
            return np.zeros(len(g))
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * g + self.shift, -500, 500)))

    def score(self, column: pa.Array, lookup: Lookup) -> np.ndarray:
        words = words_of(column, breaks=NOT_LETTER)
        at = lookup.find(words.hashes())
        hit = at >= 0
        seen = np.unique(words.row[hit] * len(self.keys) + at[hit]) if hit.any() else np.zeros(0, np.int64)
        g = np.bincount(seen // max(1, len(self.keys)), self.weights[seen % max(1, len(self.keys))], len(column))
        return self.probability(g + self.bias)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, rate: float = RATE, decay: float = WEIGHT_DECAY) -> tuple[np.ndarray, float]:
    """Weights and intercept by full-batch Adam on the non-negative risk."""
    n = positive.shape[1] + 1
    p, u = (np.hstack([x, np.ones((len(x), 1), x.dtype)]) for x in (positive, unlabelled))
    w, m, v = (np.zeros(n, p.dtype) for _ in range(3))
    rise = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
    for t in range(1, steps + 1):
        gp, gu = p @ w, u @ w
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        of_negative = u.T @ rise(gu) / len(u) - prior * (p.T @ rise(gp)) / len(p)
        of_positive = -prior * (p.T @ rise(-gp)) / len(p)
        grad = of_positive + of_negative if negative >= 0 else -of_negative
        grad[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_probability(g: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through labelled scores, by damped Newton steps."""
    mean, spread = g.mean(), g.std() or 1.0
    x = np.stack([(g - mean) / spread, np.ones(len(g))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(hessian, x.T @ (y - p) - 1e-2 * w), -2, 2)
    return w[0] / spread, w[1] - w[0] * mean / spread


def _sampled(df: DataFrame, n: int, most: int, salt: str) -> DataFrame:
    """About `most` of n rows, by a hash of the id."""
    return df if n <= most else df.filter(F.pmod(F.xxhash64(F.lit(salt), "d"), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def fit(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", label="toxic", may_learn=None) -> Scorer:
    """may_learn: a condition on doc_id for the rows whose labels may be used."""
    marks = labels.select(F.col("doc_id").alias("d"), F.col(label).cast("int").alias("y")).where("d IS NOT NULL AND y IS NOT NULL")
    if may_learn is not None:
        marks = marks.where(may_learn(F.col("d")))
    marks = marks.groupBy("d").agg(F.max("y").alias("y"))
    count = marks.groupBy("y").count().collect()
    n = {int(r.y > 0): r["count"] for r in count}
    pool = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    size = pool.count()
    none = Scorer(np.zeros(0, U64), np.zeros(0), 0.0, 0.0, -np.inf)
    if not n.get(1) or not size:
        return none
    chosen = _sampled(marks.where("y > 0"), n[1], MOST_POSITIVE, "toxic").select("d", F.lit(True).alias("positive"))
    checked = _sampled(marks, n[1] + n.get(0, 0), MOST_CHECKED, "checked").select("d", "y")
    known = stored(chosen.join(checked, "d", "full"), "labelled")
    rows = pool.join(known, "d", "left").where(F.col("positive") | F.col("y").isNotNull() | _in_sample(size)).withColumn("unlabelled", _in_sample(size))

    def distinct_words(batches):
        for piece in pieces(batches, "t"):
            words = words_of(piece.column("t"), breaks=NOT_LETTER)
            h = words.hashes()
            parts = [np.unique(h[a:b]).tobytes() for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column(c) for c in ("d", "positive", "unlabelled", "y")] + [pa.array(parts, pa.binary())], ["d", "positive", "unlabelled", "y", "words"])

    kind = docs.schema[doc_id].dataType.simpleString()
    held = stored(rows.mapInArrow(distinct_words, f"d {kind}, positive boolean, unlabelled boolean, y int, words binary"), "toxicity-sample")

    def counts(batches):
        for batch in batches:
            of = batch.column("words").to_pylist()
            for flag in ("positive", "unlabelled"):
                on = [np.frombuffer(w, U64) for w, f in zip(of, batch.column(flag).to_pylist(), strict=True) if f]
                keys, n = np.unique(np.concatenate(on), return_counts=True) if on else (np.zeros(0, U64), np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n if flag == "positive" else 0 * n), pa.array(n if flag == "unlabelled" else 0 * n)], ["word", "p", "u"])

    sizes = held.agg(F.count_if("positive").alias("p"), F.count_if("unlabelled").alias("u")).first()
    if not sizes.p or not sizes.u:
        return none
    share = held.mapInArrow(counts, "word bigint, p bigint, u bigint").groupBy("word").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))
    expected = (F.col("u") + 1) * (sizes.p / sizes.u)
    above = (F.col("p") - expected) / F.sqrt(expected)
    best = share.where((F.col("p") >= max(min(LEAST_DOCS, sizes.p), LEAST_SHARE * sizes.p)) & (above >= LEAST_DEVIATIONS)).orderBy(above.desc(), "word").limit(MOST_WORDS).collect()
    keys = np.sort(np.array([r.word for r in best], np.int64).view(U64))
    if not len(keys):
        return none
    shipped = docs.sparkSession.sparkContext.broadcast(keys)

    def matrix(batches):
        lookup = Lookup(shipped.value)
        for batch in batches:
            found = [[int(i) for i in lookup.find(np.frombuffer(w, U64)) if i >= 0] for w in batch.column("words").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("positive", "unlabelled", "y")] + [pa.array(found, pa.list_(pa.int32()))], ["positive", "unlabelled", "y", "at"])

    sample = held.mapInArrow(matrix, "positive boolean, unlabelled boolean, y int, at array<int>").collect()
    sample.sort(key=lambda r: (bool(r.positive), bool(r.unlabelled), -1 if r.y is None else r.y, r["at"]))

    def dense(rows):
        x = np.zeros((len(rows), len(keys)), np.float32)
        for i, r in enumerate(rows):
            x[i, r["at"]] = 1
        return x

    prior = n[1] / (n[1] + n.get(0, 0))
    weights, bias = fit_nnpu(dense([r for r in sample if r.positive]), dense([r for r in sample if r.unlabelled]), prior)
    marked = [r for r in sample if r.y is not None]
    scale, shift = fit_probability(dense(marked) @ weights + bias, np.array([float(r.y > 0) for r in marked])) if marked else (1.0, 0.0)
    return Scorer(keys, weights, bias, scale, shift)


def _in_sample(size: int):
    return F.pmod(F.xxhash64(F.lit("unlabelled"), "d"), F.lit(1 << 30)) < int(min(1.0, MOST_UNLABELLED / size) * (1 << 30))


def scores(docs: DataFrame, scorer: Scorer, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and score."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        lookup = Lookup(shipped.value.keys)
        for piece in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([piece.column("d"), pa.array(shipped.value.score(piece.column("t"), lookup))], ["doc_id", "score"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, score double")


def remove_toxic(docs: DataFrame, scorer: Scorer, *, text="text", threshold=THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, all columns as they were."""
    shipped = docs.sparkSession.sparkContext.broadcast(scorer)

    def clean(batches):
        lookup = Lookup(shipped.value.keys)
        for piece in pieces(batches, text):
            yield piece.filter(pa.array(shipped.value.score(piece.column(text), lookup) < threshold))

    return docs.mapInArrow(clean, docs.schema)


def may_learn(doc_id):
    return fold(doc_id, 3) != 1


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    scorer = fit(docs, read_table(spark, sf_dir, "labels"), may_learn=may_learn)
    out = scores(docs, scorer)
    return out.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
