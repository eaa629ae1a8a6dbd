"""Language identification by interpolated Kneser-Ney character models, one per language.

Texts are lower-cased; a run of anything but letters is one space. Each language has a model
of order ORDER: raw counts at the top, continuation counts below, one absolute discount per
order from the counts of counts, interpolated down to a uniform share. Models are compiled
into arrays sorted by 64-bit hash, one per order: the n-gram's log-probability and its backoff
weight in every language, so a position usually costs one search for all languages. The
predicted language has the lowest cross-entropy per character over the whole text.

Fitting uses a bounded sample: about SAMPLE_DOCS documents of each language, chosen by a hash
of the id, a fifth of them for calibration only: the temperature that turns cross-entropies
into a score, and for each language the cross-entropy above which a prediction is rejected
(mean plus REJECT_DEVIATIONS standard deviations). Rejection is a flag; the best language is
still named.

Defined results: null texts and texts without a letter are `und` with score 0, not rejected;
with nothing to learn from, every text is `und`; ties go to the language first by name; ids
may be null or repeated, each row is judged alone; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import fold, pieces, read_table
from undertone.llm.words import BASE, U64, Lookup, mix

ORDER = 4
SAMPLE_DOCS = 1_500
REJECT_DEVIATIONS = 4.0
UNIFORM = 1.0 / 4096
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, each after ORDER - 1 spaces and with one at its end; where each begins."""
    coded = [(t or "").lower().encode("utf-32-le", "replace") for t in texts]
    pad = (" " * (ORDER - 1)).encode("utf-32-le")
    size = np.array([len(c) // 4 + ORDER for c in coded], np.int64)
    codes = np.frombuffer(b"".join(x for c in coded for x in (pad, c, pad[:4])), "<u4")
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    at = np.concatenate([[0], np.cumsum(size)])
    for i in range(ORDER - 1):
        keep[at[:-1] + i] = True
    row = np.repeat(np.arange(len(texts)), size)[keep]
    return np.where(letter, codes, 32)[keep], np.searchsorted(row, np.arange(len(texts) + 1))


def gram_hashes(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the n-grams that end at each position, n from 1 to ORDER (the first ones wrap)."""
    own = codes.astype(U64) + U64(1)
    out = [mix(own)]
    for _ in range(ORDER - 1):
        out.append(mix(np.roll(out[-1], 1) * U64(BASE) + own))
    return out


def _one_hash(gram: str) -> int:
    h = mix(np.array([ord(gram[0]) + 1], U64))
    for c in gram[1:]:
        h = mix(h * U64(BASE) + U64(ord(c) + 1))
    return int(h[0])


@dataclass
class Model:
    """Per order: sorted hashes, log-probabilities and log backoff weights (rows: n-grams,
    columns: languages); temperature and rejection thresholds."""

    languages: list[str]
    keys: list[np.ndarray]
    log_p: list[np.ndarray]
    log_b: list[np.ndarray]
    floor: float = float(np.log(UNIFORM))
    temperature: float = 20.0
    reject: np.ndarray | None = None

    def lookups(self) -> list[Lookup]:
        return [Lookup(k) for k in self.keys]

    def cross_entropy(self, texts: list[str | None], lookups: list[Lookup]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character, a row for each text and a column for each language; whether a text has a letter."""
        codes, at = characters(texts)
        grams = gram_hashes(codes)
        total = np.zeros((len(codes), len(self.languages)), np.float32)
        left = np.ones(len(codes), bool)
        for i in range(ORDER - 1):
            left[at[:-1] + i] = False
        left = np.flatnonzero(left)
        for n in range(ORDER - 1, -1, -1):
            found = lookups[n].find(grams[n][left])
            hit = found >= 0
            total[left[hit]] += self.log_p[n][found[hit]]
            left = left[~hit]
            if not len(left):
                break
            if n:
                context = lookups[n - 1].find(grams[n - 1][left - 1])
                on = context >= 0
                total[left[on]] += self.log_b[n - 1][context[on]]
            else:
                total[left] += self.floor
        n = np.diff(at) - (ORDER - 1)
        sums = np.add.reduceat(total.astype(np.float64), at[:-1]) if len(texts) else total
        has = np.add.reduceat((codes != 32).astype(np.int64), at[:-1]) > 0 if len(texts) else np.zeros(0, bool)
        return -sums / np.maximum(n, 1)[:, None], has

    def predict(self, texts: list[str | None], lookups: list[Lookup]):
        """(language, score, rejected, nats per character) of each text."""
        if not self.languages:
            return [(UNKNOWN, 0.0, False, None)] * len(texts)
        ce, has = self.cross_entropy(texts, lookups)
        best = ce.argmin(1)
        z = -self.temperature * (ce - ce.min(1, keepdims=True))
        score = 1.0 / np.exp(z).sum(1)
        out = []
        for i, b in enumerate(best.tolist()):
            if not has[i]:
                out.append((UNKNOWN, 0.0, False, None))
            else:
                c = float(ce[i, b])
                out.append((self.languages[b], float(score[i]), bool(self.reject is not None and c > self.reject[b]), c))
        return out


def compile_models(counts: dict[str, dict[str, int]]) -> Model:
    """From counts of ORDER-grams by language."""
    languages = sorted(counts)
    tables: list[dict[str, dict[str, int]]] = [{} for _ in range(ORDER)]
    for lang in languages:
        level = dict(counts[lang])
        for n in range(ORDER - 1, -1, -1):
            tables[n][lang] = level
            lower: dict[str, int] = defaultdict(int)
            for g in level:
                lower[g[1:]] += 1
            level = lower
    log_p, log_b, keys = [], [], []
    p_below: dict[str, np.ndarray] = {}
    b_last: dict[str, np.ndarray] = {}
    for n in range(ORDER):
        every = sorted(set().union(*(tables[n][lang] for lang in languages)) | (set().union(*({g[:-1] for g in tables[n + 1][lang]} for lang in languages)) if n + 1 < ORDER else set()))
        index = {g: i for i, g in enumerate(every)}
        p = np.zeros((len(every), len(languages)))
        b_here: dict[str, np.ndarray] = {}
        for k, lang in enumerate(languages):
            table = tables[n][lang]
            of = list(table.values())
            n1, n2 = of.count(1), of.count(2)
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total: dict[str, int] = defaultdict(int)
            kinds: dict[str, int] = defaultdict(int)
            for g, c in table.items():
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
            for ctx in total:
                b_here.setdefault(ctx, np.zeros(len(languages)))[k] = np.log(d * kinds[ctx] / total[ctx])
            for g, i in index.items():
                ctx = g[:-1]
                lower = p_below[g[1:]][k] if n else UNIFORM
                c = total.get(ctx, 0)
                p[i, k] = max(table.get(g, 0) - d, 0) / c + d * kinds[ctx] / c * lower if c else lower
        if n:
            log_b.append(np.array([b_here.get(g, np.zeros(len(languages))) for g in b_last], np.float32))
            order = np.argsort(keys[-1], kind="stable")
            log_b[-1] = log_b[-1][order]
            keys[-1], log_p[-1] = keys[-1][order], log_p[-1][order]
        keys.append(np.array([_one_hash(g) for g in every], U64))
        log_p.append(np.log(p).astype(np.float32))
        p_below, b_last = {g: p[i] for g, i in index.items()}, index
    order = np.argsort(keys[-1], kind="stable")
    keys[-1], log_p[-1] = keys[-1][order], log_p[-1][order]
    log_b.append(np.zeros_like(log_p[-1]))
    return Model(languages, keys, log_p, log_b)


def fit(docs: DataFrame, *, doc_id="doc_id", text="text", lang="lang", may_learn=None, sample_docs=SAMPLE_DOCS) -> Model:
    """may_learn: a condition on doc_id for the rows to learn from."""
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")).where("t IS NOT NULL AND l IS NOT NULL")
    if may_learn is not None:
        rows = rows.where(may_learn(F.col("d")))
    sizes = {r.l: r["count"] for r in rows.groupBy("l").count().collect()}
    if not sizes:
        return Model([], [], [], [])
    rate = F.element_at(F.create_map(*[F.lit(x) for k, n in sorted(sizes.items()) for x in (k, min(1.0, sample_docs / n))]), F.col("l"))
    spot = F.pmod(F.xxhash64(F.lit("language"), "d"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(spot < rate).withColumn("check", F.pmod(F.xxhash64(F.lit("calibrate"), "d"), F.lit(5)) == 0)
    taught = [r.l for r in chosen.where("NOT check").select("l").distinct().collect()]
    chosen = chosen.withColumn("check", F.col("check") & F.col("l").isin(taught))  # else a language of few documents could be lost

    def count(batches):
        for piece in pieces(batches, "t"):
            names = np.array(piece.column("l").to_pylist())
            for name in sorted(set(names.tolist())):
                codes, at = characters([t for t, n in zip(piece.column("t").to_pylist(), names, strict=True) if n == name])
                used, small = np.unique(codes, return_inverse=True)
                key = np.zeros(len(codes), U64)
                for i in range(ORDER):
                    key = key * U64(len(used)) + np.roll(small, ORDER - 1 - i).astype(U64)
                whole = np.ones(len(codes), bool)
                for i in range(ORDER - 1):
                    whole[at[:-1] + i] = False
                grams, n = np.unique(key[whole], return_counts=True)
                parts = []
                for _ in range(ORDER):
                    parts.append(used[(grams % U64(len(used))).astype(np.int64)])
                    grams = grams // U64(len(used))
                texts = np.stack(parts[::-1], 1).astype("<u4").view(f"<U{ORDER}").ravel()
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(texts.tolist(), pa.string()), pa.array(n, pa.int64())], ["l", "gram", "n"])

    counts: dict[str, dict[str, int]] = defaultdict(dict)
    for r in chosen.where("NOT check").mapInArrow(count, "l string, gram string, n bigint").groupBy("l", "gram").agg(F.sum("n").alias("n")).collect():
        counts[r.l][r.gram] = r.n
    if not counts:
        return Model([], [], [], [])
    model = compile_models({k: dict(sorted(v.items())) for k, v in counts.items()})
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def check(batches):
        lookups = shipped.value.lookups()
        for piece in pieces(batches, "t"):
            ce, has = shipped.value.cross_entropy(piece.column("t").to_pylist(), lookups)
            yield pa.RecordBatch.from_arrays([piece.column("l").filter(pa.array(has)), pa.array(ce[has].tolist(), pa.list_(pa.float64()))], ["l", "ce"])

    checked = [(model.languages.index(r.l), r.ce) for r in chosen.where("check").select("t", "l").mapInArrow(check, "l string, ce array<double>").collect() if r.l in model.languages]
    if checked:
        checked.sort()
        truth, ce = np.array([c[0] for c in checked]), np.array([c[1] for c in checked])

        def loss(t):
            z = -t * (ce - ce.min(1, keepdims=True))
            return (np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]).mean()

        model.temperature = float(min((2.0**i for i in range(8)), key=loss))
        model.reject = np.full(len(model.languages), np.inf)
        for k in range(len(model.languages)):
            own = ce[truth == k, k]
            if len(own) > 1:
                model.reject[k] = own.mean() + REJECT_DEVIATIONS * own.std()
    return model


def predict(docs: DataFrame, model: Model, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, lang_pred, score, rejected, cross_entropy."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        lookups = shipped.value.lookups()
        for piece in pieces(batches, "t"):
            out = shipped.value.predict(piece.column("t").to_pylist(), lookups)
            yield pa.RecordBatch.from_arrays([piece.column("d"), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_(), pa.float64())))], ["doc_id", "lang_pred", "score", "rejected", "cross_entropy"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean, cross_entropy double")


def op4_language(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = fit(docs, may_learn=lambda d: fold(d, 4) != 2)
    out = predict(docs, model)
    return out.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy")
