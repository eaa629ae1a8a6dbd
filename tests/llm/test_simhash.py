import random
import re
import string

import numpy as np
import xxhash
from pyspark.sql import functions as F

from undertone.llm import simhash
from undertone.llm.shared import PIECE_BYTES


def slow_print(text):
    words = [w for w in re.split("[ \t-\r]+", "".join(c.lower() if c in string.ascii_uppercase else c for c in text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(rows):
    prints = {i: slow_print(t) for i, t in rows}
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for i in ids:
        for j in ids:
            if i < j and bin(prints[i] ^ prints[j]).count("1") <= 2:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (f"{prints[i]:016x}", find(i)) for i in ids}


def run(spark, rows, extra=False):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        df = df.withColumns({"fp": F.lit("x"), "component_id": F.lit(1), "node": F.lit(2)})
    out = simhash.near_duplicates(df).collect()
    return {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out}, out


def test_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices(string.ascii_letters + "é", k=rng.randint(1, 8))) for _ in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b"), (6, "x " * 30000)]
    while len(rows) < 160:
        words = rng.choices(vocabulary, k=rng.randint(1, 120))
        for _ in range(rng.choice([1, 1, 4])):
            rows.append((len(rows), " ".join(words)))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    got, _ = run(spark, rows, extra=True)
    assert got == slow_components(rows)


def test_empty_table_repeated_and_null_ids(spark):
    assert run(spark, [])[1] == []
    got = run(spark, [(5, "a b c"), (5, "a b c"), (None, "a b c"), (None, "zz yy xx ww")])[1]
    assert sorted([(r.doc_id or -1, r.component_id) for r in got], key=str) == sorted([(5, 5), (5, 5), (-1, 5), (-1, None)], key=str)


def test_very_long_texts(spark):
    rng = random.Random(4)
    for k in (0, 1, 2, 3, 4, 50):
        text = " \n".join(rng.choice(["Ab", "c", "é", "x" * 90]) for _ in range(k)) + " \t"
        assert {simhash.fingerprint(text, size=size) for size in (1, 2, 7, 64, 1 << 20)} == {slow_print(text)}
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    assert len(long) > max(2 * simhash.TEXT_BLOCK, PIECE_BYTES)
    rows = [(1, long), (2, long + " and a few more"), (3, "x" * 3_000_000), (4, " " * 3_000_000), (5, None)]
    got, _ = run(spark, rows)
    assert got == slow_components(rows) and got[2][1] == 1 and got[5][1] == 4


def test_block_links_find_every_link():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 3), dtype=np.uint64)
    fps = np.unique((base[:, None] ^ flips[:, :, 0] ^ flips[:, :, 1]).ravel())
    rank = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    fps = fps[np.argsort(rank)]
    for x, y in ((fps, None), (fps[::2].copy(), fps[1::2].copy())):
        a, b = simhash.block_links(x, y)
        other = x if y is None else y
        i, j = np.nonzero(np.bitwise_count(x[:, None] ^ other[None]) <= 2)
        values = np.concatenate([x, other])
        root = {int(v): int(v) for v in values}

        def find(root, v):
            while root[v] != v:
                v = root[v]
            return v

        for p, q in zip(x[i].tolist(), other[j].tolist()):
            root[max(find(root, p), find(root, q))] = min(find(root, p), find(root, q))
        got = {int(v): int(v) for v in values}
        for p, q in zip(a.tolist(), b.tolist()):
            u, w = find(got, p), find(got, q)
            got[max(u, w)] = min(u, w)
        assert all(find(root, v) == find(got, v) for v in root)


def test_one_document_of_each_group_stays(spark):
    rows = [(1, "a b c d"), (2, "a b c d"), (3, "p q r s t u v w x y z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(r.doc_id for r in simhash.one_per_group(df).collect()) == [1, 3]
