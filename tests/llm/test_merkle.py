import hashlib
import random
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from undertone.llm import merkle

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes, place):
    """The steps (left, right) of one place, and the top."""
    steps = []
    while len(nodes) > 1:
        start = place // 8 * 8
        run = nodes[start : start + 8]
        steps.append(("".join(run[: place - start]), "".join(run[place - start + 1 :])))
        nodes = [h(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)]
        place //= 8
    return steps, nodes[0]


def slow(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf(row), row))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
    tops = [climb([x[2] for x in groups[g]], 0)[1] for g in names]
    root = climb(tops, 0)[1] if tops else None
    out = []
    for at, g in enumerate(names):
        nodes = [x[2] for x in groups[g]]
        for i, (_, _, own, row) in enumerate(groups[g]):
            steps = climb(nodes, i)[0] + climb(tops, at)[0]
            node = own
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0:
                text = row[1] and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[1])
                node = leaf((row[0], text, *row[2:]))
            for a, b in steps:
                node = h(a, node, b)
            out.append((row[0], own, tops[at], root, h(*(a + b for a, b in steps)), node, node == root))
    return out


def key(x):
    return tuple((v is not None, v if v is not None else 0) for v in x)


def run(spark, tmp_path, rows, extra=True):
    docs = spark.createDataFrame(rows, SCHEMA)
    if extra:
        docs = docs.withColumns({"g": F.lit("clash"), "idx": F.lit(1), "n": F.lit(0), "root": F.lit(None).cast("string"), "path": F.lit(2)})
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = merkle.op11_merkle(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted((tuple(r) for r in got.collect()), key=key)


def made(n, seed=1):
    rng = random.Random(seed)
    langs = [None, "en", "de", "é", "z", ""] + [f"x{i}" for i in range(9)]
    rows = [(i, rng.choice(["Text", "no capital", "", None, "É Ä", "A" * 3000]) , rng.choices(langs, [5, 60, 20, 4, 1, 1] + [1] * 9)[0], rng.choice(["a", None, ""]), rng.choice([None, 1, 22])) for i in rng.sample(range(-5, 5 * n), n)]
    return rows + rows[:20] + [(None, "Nul", "en", "s", 3), (None, "nul", "en", "s", 3)] + [(7, f"Same id {i}", "en", "s", 1) for i in range(9)]


def test_against_brute_force_and_sql(spark, tmp_path):
    rows = made(700)
    expected = sorted(slow(rows), key=key)
    assert run(spark, tmp_path, rows) == expected
    assert any(not r[-1] for r in expected) and any(r[-1] for r in expected)
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).astype({"doc_id": "Int64", "n_chars": "Int64"})
    con = duckdb.connect()
    con.register("documents", documents)
    assert sorted(con.execute(merkle.SQL).fetchall(), key=key) == expected


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65])
def test_small_trees(spark, tmp_path, n):
    rows = [(i, f"T{i}", "en", "s", 2) for i in range(n)]
    assert run(spark, tmp_path, rows, extra=False) == sorted(slow(rows), key=key)


def test_other_fan_and_fields(spark):
    rows = spark.createDataFrame([(i, f"v{i}") for i in range(7)], "k int, v string").withColumn("part", F.lit(None).cast("int"))
    found = merkle.manifest(rows, fields=("v",), order="k", group="part", fan=2)
    assert found.columns == ["k", "leaf", "subroot", "root", "path"]
    for r in found.collect():
        node = r.leaf
        for s in r.path:
            node = h(s.before, node, s.after)
        assert len(r.path) == 3 and node == r.root == r.subroot and r.leaf == h(f"2:v{r.k}")
