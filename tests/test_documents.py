"""Checks of JSON documents, however deep and however many keys."""

import json
import random

import pytest

from undertone.functions import documents as D


def depth_of(value):
    """The most containers that a value lies in, by a loop over what is still to be seen."""
    most, left = 0, [(value, 0)]
    while left:
        v, level = left.pop()
        most = max(most, level)
        inner = v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()
        left += [(x, level + 1) for x in inner]
    return most


def made(rng, level=0):
    kind = rng.choice("odls" if level < 14 else "s")
    if kind == "s":
        return rng.choice([1, "a]}", 'q"[{', None, True, -2.5, "\\"])
    if kind == "d":
        return {f"k{i}": made(rng, level + 1) for i in range(rng.randint(0, 3))}
    return [made(rng, level + 1) for _ in range(rng.randint(0, 3))]


def test_depth_against_a_loop():
    rng = random.Random(1)
    seen = set()
    for _ in range(400):
        value = made(rng)
        levels, deep, repeated = D.checked_text(json.dumps(value, ensure_ascii=False))
        assert deep == (depth_of(value) > 10) and (deep or repeated == [])
        seen.add(deep)
    assert seen == {True, False}


@pytest.mark.parametrize("n", [9, 10, 11, 500, 100_000])
def test_nesting_of_any_depth(n):
    levels, deep, _ = D.checked_text("[" * n + "1" + "]" * n)
    assert levels == n and deep == (n > 10)
    assert D.checked_text('{"a":' * n + "1" + "}" * n)[1] == (n > 10)


def test_very_many_keys():
    text = "{" + ",".join(f'"k{i}": {i}' for i in range(100_000)) + ', "k5": 1, "b": {"x": 1, "x": 2}}'
    assert D.checked_text(text) == (2, False, ["k5", "x"])


def test_what_is_not_json(spark):
    texts = [None, "", "{", "]", '{"a": 1', "nul", '{"a": 1}', "3", '"[[["', "[" * 100_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", D.checked("t").alias("c")).orderBy("i").collect()
    assert [r.c.depth for r in got] == [None, None, None, None, None, None, 1, 0, 0, 100_000]
    assert [r.c.deep for r in got] == [None] * 6 + [False, False, False, True]
