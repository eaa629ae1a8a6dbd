import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from undertone.llm import language
from undertone.llm.shared import fold

STEMS = {"aa": "bado kila mena soru tivo".split(), "bb": "schlen grund wasser tzung keit".split(), "cc": "eau ceux mentre oille çan".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(STEMS[lang], k=rng.randint(1, 3))) for _ in range(n))


def data(n=240):
    rng = random.Random(4)
    return [(i, text(rng, (lang := rng.choice("aa bb cc".split())), rng.randint(5, 40)), lang) for i in range(n)]


def slow_logp(counts, gram):
    """log P(last character | the ones before) by the textbook recursion."""
    levels = [dict(counts)]
    while len(next(iter(levels[0]))) > 1:
        lower = Counter()
        for g in levels[0]:
            lower[g[1:]] += 1
        levels.insert(0, dict(lower))

    def p(g):
        if not g:
            return language.UNIFORM
        table = levels[len(g) - 1]
        n1, n2 = (list(table.values()).count(k) for k in (1, 2))
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total = sum(c for h, c in table.items() if h[:-1] == g[:-1])
        kinds = sum(h[:-1] == g[:-1] for h in table)
        return max(table.get(g, 0) - d, 0) / total + d * kinds / total * p(g[1:]) if total else p(g[1:])

    return math.log(p(gram))


def test_model_against_the_textbook_recursion():
    counts = defaultdict(Counter)
    for _, t, lang in data(12):
        padded = "   " + t + " "
        counts[lang].update(padded[i : i + 4] for i in range(len(padded) - 3))
    model = language.compile_models({k: dict(v) for k, v in counts.items()})
    for t in ("kilamena wasser", "zzz", "eau 12 x"):
        ce, has = model.cross_entropy([t], model.lookups())
        shown = "   " + "".join(c if c.isalpha() else " " for c in t).replace("  ", " ").replace("  ", " ") + " "
        grams = [shown[i : i + 4] for i in range(len(shown) - 3)]
        for k, lang in enumerate(model.languages):
            assert ce[0, k] == pytest.approx(-sum(slow_logp(counts[lang], g) for g in grams) / len(grams), rel=1e-4)
    assert has[0]


def test_held_out_accuracy_and_edges(spark):
    rows = data() + [(900, None, "aa"), (901, "", None), (902, "123 !?", "bb"), (None, "wasser grundkeit", None), (903, "schlen " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumns({"score": F.lit("clash"), "l": F.lit(1), "lang_pred": F.lit("zz")})
    model = language.fit(docs, may_learn=lambda d: fold(d, 4) != 2)
    out = {r.doc_id: r for r in language.predict(docs, model).collect()}
    assert all(out[i].lang_pred == lang and 0 <= out[i].score <= 1 for i, _, lang in rows[:240])
    assert [out[i].lang_pred for i in (900, 901, 902, None, 903)] == ["und", "und", "und", "bb", "bb"]
    empty = language.predict(docs, language.fit(docs.limit(0))).collect()
    assert {r.lang_pred for r in empty} == {"und"} and language.predict(docs.limit(0), model).count() == 0


def test_strange_texts_are_rejected(spark):
    docs = spark.createDataFrame(data(), "doc_id bigint, text string, lang string")
    model = language.fit(docs)
    odd = spark.createDataFrame([(1, "xqzv jwkx qqxz vvkj"), (2, data()[0][1])], "doc_id bigint, text string")
    assert {r.doc_id: r.rejected for r in language.predict(odd, model).collect()} == {1: True, 2: False}


def test_a_language_whose_documents_all_calibrate_is_learnt(spark):
    ids = [r.id for r in spark.range(3000).where(F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(5)) == 0).limit(2).collect()]
    rows = [(ids[0], "zoqu zoqu xaxa zoqu", "few"), (ids[1], "xaxa zoqu xaxa", "few")] + [(5000 + i, "plain words of the other one", "many") for i in range(30)]
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    assert model.languages == ["few", "many"]
