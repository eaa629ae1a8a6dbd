"""How filters interact: what each filter removes in every order of all of them, and what it costs.

Five filters judge a whole text (null: empty; words are `[^\\x20\\x09-\\x0D]+`, case-sensitive). A text fails
  A  with fewer than 200 words;
  B  if under 50 % of its words are distinct;
  C  if over 2 % of its code points are `[A-Z]`;
  D  if it holds any of `#$%&*|`;
  E  if it is identical to the text of a smaller doc_id, table-wide, removed or not.

A to D come from one pass over the bytes of an Arrow buffer: byte classes are looked up for all bytes at once and counted
for each document by prefix sums; word hashes are sorted within their document, and words that share a hash are compared
byte by byte, so distinct words are exact (a document where two words share a hash is counted as a set). E compares SHA-256
digests: rows are counted by digest before any meet, so a text that a third of all rows share costs a row a task. Rows
then are counts by part and mask of failures, 32 at most, and the orders are worked out from these by masks alone: a
document is removed at the first filter of the order that is in its mask.

Defined results: a null id is in no order, so it neither fails E nor makes others fail; equal ids don't fail each other;
a document with several labels is lost if any of them says so; a null part is the empty one; an empty table has no parts
and gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import pieces, read_table
from undertone.llm.words import flat, words_of

FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
SYMBOLS = b"#$%&*|"
#: Rows without an id are dealt out by a number below this one.
SALTS = 1024
_CAPITAL, _SYMBOL, _LEAD = np.zeros(256, bool), np.zeros(256, bool), np.ones(256, bool)
_CAPITAL[65:91] = True
_SYMBOL[list(SYMBOLS)] = True
_LEAD[0x80:0xC0] = False  # all but the bytes that continue a code point
FIGURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def counted(data: np.ndarray, at: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """How many bytes of a class each row has."""
    sums = np.zeros(len(data) + 1, np.int64)
    np.cumsum(kind[data], out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]]


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether spans of equal size that begin at a and b hold the same bytes."""
    if not len(sizes):
        return np.zeros(0, bool)
    heads = np.cumsum(sizes) - sizes
    inside = np.arange(int(sizes.sum())) - np.repeat(heads, sizes)
    return np.logical_and.reduceat(data[np.repeat(a, sizes) + inside] == data[np.repeat(b, sizes) + inside], heads)


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Words and distinct words of each text."""
    words = words_of(column, lower=False)
    total = np.diff(words.first)
    hashes = words.hashes()
    order = np.lexsort((hashes, words.row))
    starts, sizes, row = words.starts[order], (words.ends - words.starts)[order], words.row[order]
    pair = np.flatnonzero((hashes[order][1:] == hashes[order][:-1]) & (row[1:] == row[:-1]))
    fits = sizes[pair] == sizes[pair + 1]
    same = np.zeros(len(pair), bool)
    same[fits] = same_bytes(words.data, starts[pair[fits]], starts[pair[fits] + 1], sizes[pair[fits]])
    distinct = total - np.bincount(row[pair], minlength=len(total))
    for r in np.unique(row[pair[~same]]):
        own = slice(words.first[r], words.first[r + 1])
        distinct[r] = len({words.data[a:b].tobytes() for a, b in zip(words.starts[own], words.ends[own], strict=True)})
    return total, distinct


def failures(column: pa.Array) -> np.ndarray:
    """The mask of the filters A to D that each text fails."""
    data, at = flat(column)
    words, distinct = distinct_words(column)
    fails = (words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * counted(data, at, _CAPITAL) > MOST_CAPITALS * counted(data, at, _LEAD), counted(data, at, _SYMBOL) > 0)
    return sum((f.astype(np.int32) << i for i, f in enumerate(fails)), np.zeros(len(column), np.int32))


def scanned(docs: DataFrame, *, doc_id="doc_id", text="text", part="source") -> DataFrame:
    """doc_id, part, mask of A to D and the text's digest."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([piece.column("d"), piece.column("p"), pa.array(failures(piece.column("t"))), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])

    rows = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("p"))
    return rows.mapInArrow(run, f"doc_id {kind}, part string, mask int, digest binary")


def masks(docs: DataFrame, labels: DataFrame, *, doc_id="doc_id", text="text", part="source", good="quality", toxic="toxic") -> DataFrame:
    """part, mask of all five filters, and how many documents, good and toxic ones have that mask."""
    flag = labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id"))
    flags = flag.agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(n) for c, n in ((good, "good"), (toxic, "toxic")))).withColumn("salt", F.lit(0))
    salt = F.when(F.col("doc_id").isNull(), (F.monotonically_increasing_id() % SALTS).cast("int")).otherwise(0)
    rows = scanned(docs, doc_id=doc_id, text=text, part=part).withColumn("salt", salt).join(flags, ["doc_id", "salt"], "left").na.fill(0, ["good", "toxic"])
    alike = ["digest", "part", "mask", "good", "toxic"]
    by_id = rows.groupBy("doc_id", "salt", *alike).agg(F.count("*").alias("n"))
    no_id = F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)
    by_text = by_id.groupBy(*alike).agg(F.sum("n").alias("n"), F.sum(no_id).alias("unplaced"), F.min("doc_id").alias("low"), F.min_by("n", "doc_id").alias("lowest"))
    least = by_text.groupBy("digest").agg(F.min("low").alias("first"))
    both = by_text.join(least, "digest")
    stays = F.col("unplaced") + F.when(F.col("low") == F.col("first"), F.col("lowest")).otherwise(0)
    parts = both.withColumn("e", F.explode(F.array(F.struct(F.lit(0).alias("bit"), stays.alias("n")), F.struct(F.lit(1 << FILTERS.index("E")).alias("bit"), (F.col("n") - stays).alias("n")))))
    count = F.col("e.n")
    return parts.groupBy("part", F.col("mask").bitwiseOR(F.col("e.bit")).alias("mask")).agg(F.sum(count).alias("n"), F.sum(count * F.col("good")).alias("good"), F.sum(count * F.col("toxic")).alias("toxic"))


def orders() -> tuple[list[str], np.ndarray, np.ndarray]:
    """All orders of the filters; for each and each step, the filter's bit and those of the filters before it."""
    names = ["".join(p) for p in permutations(FILTERS)]
    bit = np.array([[1 << FILTERS.index(c) for c in name] for name in names])
    return names, bit, np.cumsum(bit, axis=1) - bit


def effects(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """Each figure for all orders and steps, from the numbers of documents by mask."""
    _, bit, before = orders()
    mask = np.arange(1 << len(FILTERS))
    reached, fails = (mask & before[..., None]) == 0, (mask & bit[..., None]) > 0
    out = reached & fails
    removed = out @ n
    by_filter = np.array([removed[bit == 1 << i].sum() for i in range(len(FILTERS))])
    found = (reached & ~fails) @ n, removed, (~reached & fails) @ n, n[bit], out @ good, out @ toxic, by_filter[np.log2(bit).astype(int)]
    return dict(zip(FIGURES, found, strict=True))


def audit(found: DataFrame) -> DataFrame:
    """part, filter_order, step and the figures, from the counts of `masks`."""
    every = range(1 << len(FILTERS))
    whole = found.groupBy("part").agg(*(F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in every)).alias(c) for c in ("n", "good", "toxic")))
    names, steps = orders()[0], len(FILTERS)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                figures = effects(*(np.array(row[c], np.int64) for c in ("n", "good", "toxic")))
                size = len(names) * steps
                columns = [pa.array([row["part"]] * size, pa.string()), pa.array(np.repeat(names, steps).tolist()), pa.array(np.tile(np.arange(1, steps + 1, dtype=np.int32), len(names)))]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(figures[f].ravel().astype(np.int64)) for f in FIGURES], ["part", "filter_order", "step", *FIGURES])

    return whole.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{f} bigint" for f in FIGURES))


def op12_interaction(spark, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return audit(masks(docs, labels))


SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT doc_id, max(coalesce((quality = 1)::INT, 0)) AS good, max(coalesce((toxic = 1)::INT, 0)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT doc_id, part, len(w) < {LEAST_WORDS} AS a, 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) AS b, 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(t) AS c,
  regexp_matches(t, '[{SYMBOLS.decode()}]') AS d, coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false) AS e FROM w),
f AS (SELECT part, a::INT + 2 * b::INT + 4 * c::INT + 8 * d::INT + 16 * e::INT AS mask, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM m LEFT JOIN l USING (doc_id)),
g AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY ALL),
x(c, b) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o AS (SELECT p.c || q.c || r.c || s.c || t.c AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bits FROM x p, x q, x r, x s, x t WHERE p.b + q.b + r.b + s.b + t.b = 31 AND len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
s AS (SELECT filter_order, step::INT AS step, bits[step] AS bit, coalesce(list_sum(bits[1 : step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
z AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (mask & before > 0 AND mask & bit > 0), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (mask = bit), 0)::BIGINT AS unique_fails, coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit > 0), 0)::BIGINT AS toxic_lost FROM g, s GROUP BY ALL)
SELECT * EXCLUDE (bit), (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM z
"""
