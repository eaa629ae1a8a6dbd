import random
import re

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from undertone.llm import quality

TEXTS = [None, "", " \n\t\n", "one", "a b c d e f g h i j.", "a b c d e f g h i j. " * 5, "Home | About | Contact | Help\nA real line of text that goes on for a while, to its end.\nA real line of text that goes on for a while, to its end.", "LOUD!! WORDS!! EVERY!! TIME!! AND!! MORE!! WORDS!! TO!! COME!! HERE!!", "x*** y$$$ z%%% and so on and on and on and on.", "This site uses our Cookie Policy.\nBut this is a line of honest text with enough words in it.", "\r\nline one of text.\r\nline one of text.\r\nthe rest of it, quite long enough to be kept here.", "word " * 40000, "é日 " * 12 + "."]


def slow(text):
    t = text or ""
    words = [w for w in re.split("[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    from collections import Counter

    count = Counter(grams)
    again = {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(again)


def rows():
    rng = random.Random(2)
    made = []
    for _ in range(120):
        lines = [" ".join(rng.choices(["alpha", "beta", "|", "gam", "x!!", "of", "é.", "***"], k=rng.randint(0, 12))) + rng.choice([".", "", "\r"]) for _ in range(rng.randint(1, 8))]
        made.append("\n".join(lines + rng.choices(lines, k=rng.randint(0, 2))))
    return [(i, t) for i, t in enumerate(TEXTS + made)]


def test_figures_and_sql(spark):
    data = rows()
    docs = spark.createDataFrame(data, "doc_id bigint, text string").withColumns({"kept": F.lit("clash"), "n_words": F.lit(None)})
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for i, t in data:
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == slow(t), t
    con = duckdb.connect()
    documents = pd.DataFrame(data, columns=["doc_id", "text"])  # noqa: F841
    con.register("documents", documents)
    expected = con.execute(quality.SQL).df().sort_values("doc_id").reset_index(drop=True)
    found = quality.judge(docs).toPandas().sort_values("doc_id").reset_index(drop=True)[list(expected.columns)]
    for c in expected.columns:
        assert (expected[c].to_numpy() == found[c].to_numpy()).all(), c


def test_clean_and_edges(spark):
    docs = spark.createDataFrame([(6, TEXTS[6]), (None, TEXTS[6]), (7, TEXTS[7]), (1, None)], "doc_id bigint, text string").withColumn("kept", F.lit(1))
    out = quality.clean(docs).collect()
    assert [(r.doc_id, r.text, r.kept) for r in out] == [(i, "A real line of text that goes on for a while, to its end.", 1) for i in (6, None)] or not out
    assert quality.judge(docs.limit(0)).count() == 0 and quality.clean(docs.limit(0)).count() == 0


def test_stock_lines(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    line = lambda n: " ".join(rng.choices(words, k=n)) + "."
    stock, copied, rare = "Todos los  derechos RESERVADOS.", line(9), line(8)
    base = [line(12) for _ in range(30)]
    texts = ["\n".join([line(12), line(14), stock, line(10)]) for _ in range(25)]
    for _ in range(200):  # near copies: one line in thirty is another one
        own = [*base, copied]
        own[rng.randrange(30)] = line(12)
        texts.append("\n".join(own))
    texts += ["\n".join([line(12), line(12), rare]) for _ in range(9)] + ["\n".join([line(20), line(31)[:-1] + " " + stock])] + [None, "", "\n \n", texts[0], texts[0]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({"line": F.lit(1), "low": F.lit("clash")})
    found = quality.stock_lines(docs)
    assert found == {quality.digest(stock.lower().encode().split())}
    got = {r.doc_id: r for r in quality.judge(docs, stock=found).collect()}
    assert [got[i].n_failed_lines for i in range(25)] == [1] * 25 and all(got[i].kept for i in range(25))
    assert stock not in quality.clean(docs.where("doc_id = 0"), stock=found).first().text
    assert quality.stock_lines(docs.limit(0)) == frozenset() == quality.stock_lines(docs.where("text is null"))


def test_extremes_in_blocks():
    words = [str(i * i % 101).encode() for i in range(1000)]
    assert quality.extremes(words) == quality.extremes(words, block=7)
    import hashlib

    ends = sorted(hashlib.md5(b" ".join(words[i : i + 5])).digest() for i in range(996))
    assert quality.extremes(words) == tuple(int.from_bytes(e[:8], signed=True) for e in (ends[0], ends[-1]))
    assert quality.extremes([b"a", b"b"])[0] == quality.extremes([b"a", b"b"])[1] == quality.digest([b"a", b"b"])
