import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from undertone.llm import interaction, words

TEXTS = [None, "", " \t\n\x0b\r ", "one", "Aa aA aa " * 70, "word " * 400, " ".join(f"w{i}" for i in range(200)), " ".join(f"w{i}" for i in range(199)), "é" * 98 + "AB", "é" * 97 + "ABC", "a|b", "100 %", "x y" * 50_000, " nbsp\xa0is one word"]


def base(t):
    t = t or ""
    w = [x for x in re.split("[ \t-\r]+", t) if x]
    return len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search("[#$%&*|]", t))


def slow(rows, labels):
    """Every filter is applied in every order, one document at a time."""
    low = {}
    for i, t, _ in rows:
        if i is not None:
            low[t or ""] = min(i, low.get(t or "", i))
    fails = [{c for c, f in zip("ABCDE", (*base(t), i is not None and i > low[t or ""]), strict=True) if f} for i, t, _ in rows]
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    for part in {p or "" for _, _, p in rows}:
        mine = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        for order in permutations("ABCDE"):
            left, gone = mine, []
            for step, c in enumerate(order, 1):
                hit = [x for x in left if c in x[1]]
                left = [x for x in left if c not in x[1]]
                out[part, "".join(order), step] = [len(left), len(hit), sum(c in f for _, f in gone), sum(f == {c} for _, f in mine), sum(i in good for i, _ in hit), sum(i in toxic for i, _ in hit)]
                shapley[part, c] += len(hit)
                gone += hit
    return sorted((p, o, s, *v, shapley[p, o[s - 1]]) for (p, o, s), v in out.items())


def made():
    rng = random.Random(3)
    pool = TEXTS + [" ".join(rng.choices(["alpha", "Beta", "GAMMA", "d#", "e", "é"] + [f"v{j}" for j in range(300)], k=rng.choice([150, 250, 400]))) for _ in range(40)]
    rows = [(i, rng.choice(pool), rng.choice(["s", "t", None, ""])) for i in rng.sample(range(1000), 300)]
    rows += rows[:15] + [(rows[0][0], "other text", "s"), (None, "alone", "s"), (None, TEXTS[5], "t"), (None, TEXTS[5], "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in rng.sample(range(1000), 500)] + [(rows[1][0], 1, 1), (None, 1, 1)]
    return rows, labels


def run(spark, tmp_path, rows, labels):
    spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"mask": F.lit("clash"), "part": F.lit(1), "good": F.lit(5), "digest": F.lit(None).cast("int")}).repartition(6).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").withColumns({"salt": F.lit("clash"), "text": F.lit(0)}).write.parquet(f"{tmp_path}/labels.parquet")
    got = interaction.op12_interaction(spark, str(tmp_path))
    assert got.columns == ["part", "filter_order", "step", *interaction.FIGURES]
    return sorted(tuple(r) for r in got.collect())


def test_against_every_order_and_sql(spark, tmp_path):
    rows, labels = made()
    expected = slow(rows, labels)
    assert run(spark, tmp_path, rows, labels) == expected and len(expected) == 3 * 600
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "source"]).astype({"doc_id": "Int64"}))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]).astype("Int64"))
    assert sorted(con.execute(interaction.SQL).fetchall()) == expected


def test_empty_tables(spark, tmp_path):
    assert run(spark, tmp_path, [], []) == []


def test_no_labels(spark, tmp_path):
    rows = [(1, "a b", "s"), (2, "a b", "s")]
    assert run(spark, tmp_path, rows, []) == slow(rows, [])


def test_masks_of_each_text():
    found = interaction.failures(pa.array(TEXTS, pa.string()))
    assert found.tolist() == [sum(f << i for i, f in enumerate(base(t))) for t in TEXTS]


def test_words_that_share_a_hash_are_told_apart(monkeypatch):
    texts = ["ab cd ab ef", "a bb a a", "", "same same", "xy yx"]
    expected = [len(set(t.split())) for t in texts]
    monkeypatch.setattr(words.Words, "hashes", lambda self, seed=1: np.zeros(len(self.starts), np.uint64))
    assert interaction.distinct_words(pa.array(texts))[1].tolist() == expected


def test_a_text_over_a_piece_and_a_block():
    text = "Word" + " wörd" * 600_000
    assert interaction.failures(pa.array([text])).tolist() == [sum(f << i for i, f in enumerate(base(text)))]
