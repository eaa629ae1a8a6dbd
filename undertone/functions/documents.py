"""Checks of JSON documents that built-in functions can't make: how deep values lie, and repeated keys.

Nesting is read from the text by a scan that keeps a counter, so a document nested a hundred thousand deep costs its length
and nothing else. Only documents that aren't too deep are parsed, once."""

from __future__ import annotations

import json
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf

#: Containers that a value may lie in.
MOST_DEPTH = 10
_TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[\[\]{}]|[^\s,:"\[\]{}]+', re.DOTALL)


def nesting(text: str) -> tuple[int, int]:
    """Levels of containers, and the most containers that a value (a scalar, a container or a key's text) lies in."""
    level = levels = deepest = 0
    for token in _TOKEN.finditer(text):
        c = text[token.start()]
        if c in "]}":
            level -= 1
            continue
        deepest = max(deepest, level)
        if c in "[{":
            level += 1
            levels = max(levels, level)
    return levels, deepest


def checked_text(text: str | None) -> tuple[int | None, bool | None, list[str] | None]:
    """Levels of nesting, whether a value lies too deep, and keys that an object holds twice (sorted). A document that is too
    deep is not parsed and has no keys; nulls for what isn't JSON."""
    if text is None:
        return None, None, None
    levels, deepest = nesting(text)
    if deepest > MOST_DEPTH:
        return levels, True, None
    found: set[str] = set()

    def pairs(items):
        if len(items) > len(out := dict(items)):
            found.update(k for k, n in Counter(k for k, _ in items).items() if n > 1)
        return out

    try:
        json.loads(text, object_pairs_hook=pairs)
    except (ValueError, RecursionError):  # containers without any value between them may still be too many for a parser
        return None, None, None
    return levels, False, sorted(found)


def checked(column) -> Column:
    """A struct of depth, deep and repeated for each document."""

    def run(text: pd.Series) -> pd.DataFrame:
        found = pd.DataFrame([checked_text(t) for t in text], columns=["depth", "deep", "repeated"])
        return found.astype({"depth": "Int32", "deep": "boolean"})

    return pandas_udf(run, "depth int, deep boolean, repeated array<string>")(column)
