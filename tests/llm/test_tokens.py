import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from undertone.llm import tokens

TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb\n\nc", "\nlead", "trail\n\n", "日本語😀\nñandú 😀\n\n\nend", "x" * 20000 + "\n" + "y" * 50, "same\ntext", "same\ntext"]


def slow(encoder, text, rule):
    """Sections as lists of byte owners, each token judged byte by byte."""
    data = (text or "").encode()
    owner, section = [], 0
    for i in range(len(data)):
        if i and data[i - 1] == 10 and data[i] != 10:
            section += 1
        owner.append(section)
    out, at = defaultdict(float), 0
    for i in encoder.encode_ordinary(text or ""):
        span = owner[at : at + len(encoder.decode_single_token_bytes(i))]
        at += len(span)
        if rule == "start":
            out[span[0]] += 1
        elif rule == "most":
            out[max(sorted(set(span)), key=span.count)] += 1
        else:
            for s in span:
                out[s] += 1 / len(span)
    return [out[s] for s in range(section + 1)]


@pytest.mark.parametrize("rule", tokens.RULES)
def test_against_bytes_one_by_one(spark, rule):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choices("ab é日\n\n.", k=rng.randint(1, 200))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, "x\ny")], "doc_id bigint, text string").withColumns({"section": F.lit("clash"), "start": F.lit(0)})
    tokenizer = tokens.Tokenizer()
    encoder = tokenizer.open().whole
    found = defaultdict(list)
    for r in tokens.count_tokens(docs, tokenizer, rule=rule).collect():
        found[r.doc_id].append((r.section, r.n_tokens, r.start, r.end, r.doc_tokens))
    for i, t in [*enumerate(texts), (None, "x\ny")]:
        rows = sorted(found[i])
        assert [r[1] for r in rows] == pytest.approx(slow(encoder, t, rule))
        assert sum(r[1] for r in rows) == pytest.approx(len(encoder.encode_ordinary(t or "")))
        assert "".join((t or "")[a:b] for _, _, a, b, _ in rows) == (t or "")


def test_tokens_that_cross_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b\nc")], "doc_id bigint, text string")
    cut = lambda data: np.array([0, 2])
    rows = sorted(tokens.count_tokens(docs, tokens.Tokenizer(), rule="split", sections=cut).collect(), key=lambda r: r.section)
    assert [(r.section, r.n_tokens, r.crossing) for r in rows] == [(0, 1.5, 1), (1, 2.5, 0)]
    assert tokens.count_tokens(docs.limit(0), tokens.Tokenizer()).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(docs, tokens.Tokenizer(), rule="none")


@pytest.mark.parametrize("one", [" ", "\n", "x", "\u3000", "\t", "7", "."])
def test_very_long_runs_of_one_character(one):
    """The library can't split very long white space, so short runs are compared with it and long ones with their parts."""
    encoder = tokens.Tokenizer().open()
    for n in (255, 256, 257, 1000, 20_000):
        for text in (one * n, one * n + "word", "a" + one * n + " b", "a" + one * n + "\n", one * n + "é" + one * n):
            assert encoder.ids(text).tolist() == encoder.whole.encode_ordinary(text)
    ids = encoder.ids("a" + one * 5_000_000 + "b")
    assert encoder.size[ids].sum() == 2 + 5_000_000 * len(one.encode())
    assert encoder.whole.decode(ids.tolist()) == "a" + one * 5_000_000 + "b"
    if one.isspace():
        assert ids.tolist() == encoder.ids("a").tolist() + encoder.run.encode_ordinary(one * 4_999_999) + encoder.ids(one + "b").tolist()


def test_long_white_space_in_a_table(spark):
    texts = ["a" + " " * 3_000_000 + "b", "\n" * 3_000_000, " \n\t" * 1_000_000 + "end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = tokens.count_tokens(docs, tokens.Tokenizer()).groupBy("doc_id").agg(F.sum("n_tokens").alias("n"), F.max("doc_tokens").alias("d"), F.max("end").alias("e")).collect()
    assert len(got) == 3 and all(r.n == r.d for r in got) and {r.doc_id: r.e for r in got} == dict(enumerate(map(len, texts)))


def test_the_sampled_look_misses_no_long_run():
    for n in (255, 256, 257, 300, 1000):
        for before in range(70):
            text = "x" * before + " \t\n　" * (n // 4) + " " * (n % 4) + "y z"
            assert not tokens.LONG_RUN.search(text) or tokens.SAMPLED_RUN.search(text[:: tokens.EVERY])
    assert not tokens.SAMPLED_RUN.search(("word " * 5000)[:: tokens.EVERY])
