"""Benchmark decontamination: size-partitioned MinHash containment search.

A document holds a test item if it contains at least `threshold` of the item's distinct word
shingles (five words, A-Z lower-cased; an item of fewer words is one shingle of its whole
word sequence). Containment is one-sided, so the length of the document does not matter.

Items are partitioned by their number of shingles. In a partition whose largest item has q
shingles, each item is represented by its k smallest shingles under one random permutation
(a bottom-k MinHash sketch) with k = q - ceil(threshold * q) + 1. An item contained in a
document to the threshold has at most k - 1 shingles missing, so at least one of the k is
there: the search misses nothing. Documents that meet a sketch are verified by the exact
shingles, compared as text.

The query set is the benchmark, taken in blocks of bounded size; each block is broadcast and
meets every document in one narrow pass, with no shuffle of documents.

Defined results: null or empty texts, on either side, match nothing; a null id is returned as
null; repeated rows are judged row by row; columns other than id and text are ignored by the
search and passed through by `remove_contaminated`.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import pieces, read_table
from undertone.llm.words import SPACE, U64, Lookup, mix, shingles, words_of

SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 16 << 20
_BREAKS = bytes(np.flatnonzero(SPACE))


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> set[tuple[bytes, ...]]:
    words = (text or "").encode().lower().split()
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(n)), strict=False))


def needed(n: int, threshold: float) -> int:
    """The least number of n shingles that reaches the threshold."""
    return max(1, math.ceil(n * threshold - 1e-9))


class ItemIndex:
    """Sketches of one block of items, by size partition, and the items' exact shingles."""

    def __init__(self, texts: list[str | None], n: int = SHINGLE_WORDS, threshold: float = THRESHOLD):
        self.n, self.threshold = n, threshold
        self.sets = [shingle_set(t, n) for t in texts]
        partitions = defaultdict(list)
        for i, s in enumerate(self.sets):
            if s:
                partitions[len(s).bit_length()].append(i)
        by_width = defaultdict(list)
        for members in partitions.values():
            q = max(len(self.sets[i]) for i in members)
            k = q - needed(q, threshold) + 1
            for i in members:
                own = list(self.sets[i])
                width = len(own[0])
                w = words_of(pa.array([b" ".join(s).decode("utf-8", "replace") for s in own]), lower=False)
                h, _ = shingles(w, w.hashes(), width)
                sketch = h[np.argsort(mix(h ^ U64(0xA5A5A5A5A5A5A5A5)), kind="stable")[:k]]
                by_width[width] += [(int(x), i) for x in sketch]
        self.tables = {}
        for width, pairs in by_width.items():
            pairs.sort()
            keys, at = np.unique(np.array([p[0] for p in pairs], U64), return_index=True)
            self.tables[width] = (Lookup(keys), np.append(at, len(pairs)), np.array([p[1] for p in pairs]))

    def matches(self, column: pa.Array) -> list[tuple[int, int, int]]:
        """(row, item, shared shingles) of every verified match in a column of texts."""
        if not self.tables:
            return []
        words = words_of(column)
        hashes = words.hashes()
        candidates = set()
        for width, (lookup, at, items) in self.tables.items():
            h, row = shingles(words, hashes, width)
            found = lookup.find(h)
            for r, k in zip(row[found >= 0].tolist(), found[found >= 0].tolist(), strict=True):
                candidates.update((r, i) for i in items[at[k] : at[k + 1]].tolist())
        out, held, held_row = [], {}, -1
        for r, i in sorted(candidates):
            if r != held_row:
                tokens, held, held_row = column[r].as_py().encode().lower().split(), {}, r
            width = len(next(iter(self.sets[i])))
            if width not in held:
                held[width] = set(zip(*(tokens[j:] for j in range(width)), strict=False))
            shared = len(self.sets[i] & held[width])
            if shared >= needed(len(self.sets[i]), self.threshold):
                out.append((r, i, shared))
        return out


def _blocks(items: DataFrame, item_id: str, text: str, block_bytes: int):
    total = items.agg(F.sum(F.octet_length(text) + 16)).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t"))
    for b in range(n):
        yield rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).collect()


def containment_pairs(docs: DataFrame, items: DataFrame, *, doc_id="doc_id", text="text", item_id="item_id", item_text="text", n=SHINGLE_WORDS, threshold=THRESHOLD, block_bytes=BLOCK_BYTES) -> DataFrame:
    """doc_id, item_id, n_item (the item's distinct shingles), n_shared, containment."""
    doc_type, item_type = docs.schema[doc_id].dataType, items.schema[item_id].dataType
    schema = f"doc_id {doc_type.simpleString()}, item_id {item_type.simpleString()}, n_item bigint, n_shared bigint, containment double"
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(items, item_id, item_text, block_bytes):
        if not block:
            continue
        shipped = sc.broadcast(([r.i for r in block], ItemIndex([r.t for r in block], n, threshold)))

        def search(batches, shipped=shipped):
            ids, index = shipped.value
            for piece in pieces(batches, "t"):
                found = index.matches(piece.column("t"))
                if found:
                    sizes = [len(index.sets[i]) for _, i, _ in found]
                    shared = [s for _, _, s in found]
                    yield pa.RecordBatch.from_arrays(
                        [piece.column("d").take(pa.array([r for r, _, _ in found])), pa.array([ids[i] for _, i, _ in found]), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()), pa.array([s / z for s, z in zip(shared, sizes, strict=True)])],
                        ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                    )

        out = out.unionByName(rows.mapInArrow(search, schema))
    return out


def remove_contaminated(docs: DataFrame, items: DataFrame, *, text="text", item_id="item_id", item_text="text", n=SHINGLE_WORDS, threshold=THRESHOLD, block_bytes=BLOCK_BYTES) -> DataFrame:
    """The documents that hold no item, all columns as they were."""
    sc, schema = docs.sparkSession.sparkContext, docs.schema
    for block in _blocks(items, item_id, item_text, block_bytes):
        shipped = sc.broadcast(ItemIndex([r.t for r in block], n, threshold))

        def clean(batches, shipped=shipped):
            for piece in pieces(batches, text):
                keep = np.ones(piece.num_rows, bool)
                keep[[r for r, _, _ in shipped.value.matches(piece.column(text))]] = False
                yield piece.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, schema)
    return docs


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    return containment_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM documents),
b AS (SELECT item_id, list_filter(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w FROM benchmark),
k AS (SELECT DISTINCT least(len(w), 5) k FROM b WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, least(len(w), 5) k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i : i + least(len(w), 5) - 1], ' '))) s FROM b WHERE len(w) > 0),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i : i + k - 1], ' '))) s FROM d, k WHERE len(w) >= k),
q AS (SELECT item_id, count(*) n_item FROM bs GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM ds JOIN bs USING (k, s) JOIN q USING (item_id) GROUP BY doc_id, item_id, n_item
HAVING count(*) >= ceil(n_item * 0.8 - 1e-9)
"""
