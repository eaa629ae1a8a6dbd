"""Document fingerprints: a quartile bucket digest of byte triplets, and how alike two digests are.

A text's UTF-8 bytes are read in windows of four; three triplets of each window (bytes 1 2 3, 1 2 4, 1 3 4) are hashed
into `BUCKETS` buckets. The quartiles of the counts cut the buckets into four classes of two bits. A digest is hex:
16 bits of CRC-32 over the whole text, 8 of its length in bytes on a logarithmic scale (steps of a tenth), 8 for the
first and second quartile in relation to the third, then the classes. Two digests differ by the steps between
their classes (a step of three counts six), by their lengths' and quartiles' steps, and by one for other checksums; the
likeness is 1 minus that difference over `BOUND`, the difference expected of unrelated texts, and never under 0. Equal texts
have equal digests; a single changed word moves few buckets over a quartile.

Neighbours in the order of ids meet by one shuffle of the texts: ranges of the whole order are sorted apart, each task
walks its rows once, and keeps only the row before. The last row of a range and the first of the next, one
text of each range, are paired afterwards.

Defined results: a null text is the empty one, whose digest has no counts; the single row of a table is its own next; null
ids come first, rows of equal ids are ordered by their text's hash, so equal rows are interchangeable; an empty table
gives no rows; texts are hashed block by block, so a very long one costs little more than its bytes; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from undertone.llm.shared import pieces, read_table, small_batches, stored

BUCKETS = 128
BLOCK = 1 << 20
#: Differences are bounded by that which unrelated classes have on average: 1.625 for each bucket.
BOUND = 1.625 * BUCKETS
#: One random table for each byte of a triplet.
_TABLES = np.random.default_rng(13).integers(0, BUCKETS, (3, 3, 256), dtype=np.uint8)
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_STEPS = np.array([0, 1, 2, 6])
_WIDTH = 8 + BUCKETS // 2


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit; a window that would pass the end has only the triplets that fit."""
    out = np.zeros(BUCKETS, np.int64)
    for begin in range(0, len(data), BLOCK):
        block = np.frombuffer(data, np.uint8, min(BLOCK + 3, len(data) - begin), begin)
        for triplet, (p, q, r) in zip(_TRIPLETS, _TABLES, strict=True):
            n = min(BLOCK, len(block) - triplet[2])
            if n > 0:
                a, b, c = (block[i : i + n] for i in triplet)
                out += np.bincount(p[a] ^ q[b] ^ r[c], minlength=BUCKETS)
    return out


def fingerprint(text: str | None) -> str:
    data = (text or "").encode()
    counts = bucket_counts(data)
    q1, q2, q3 = (int(x) for x in np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]])
    classes = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = min(255, round(10 * math.log(len(data) + 1)))
    ratios = (16 * q1 // max(1, q3)) % 16 << 4 | (16 * q2 // max(1, q3)) % 16
    packed = np.bitwise_or.reduce(classes.reshape(-1, 4) << np.array([6, 4, 2, 0], np.uint8), axis=1).astype(np.uint8)
    return f"{zlib.crc32(data) & 0xFFFF:04x}{length:02x}{ratios:02x}{packed.tobytes().hex()}"


def _parts(digest: str) -> tuple[str, int, int, int, np.ndarray]:
    packed = np.frombuffer(bytes.fromhex(digest[8:]), np.uint8)
    return digest[:4], int(digest[4:6], 16), int(digest[6], 16), int(digest[7], 16), (packed[:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).ravel().astype(np.int8)


def difference(a: str, b: str) -> int:
    """0 for equal digests; `BOUND` on average for unrelated ones."""
    if a == b:
        return 0
    (sum_a, *scales_a, classes_a), (sum_b, *scales_b, classes_b) = _parts(a), _parts(b)
    around = [abs(x - y) if i == 0 else min(abs(x - y), 16 - abs(x - y)) for i, (x, y) in enumerate(zip(scales_a, scales_b, strict=True))]
    return int(_STEPS[np.abs(classes_a - classes_b)].sum()) + sum(around) + (sum_a != sum_b)


def likeness(a: str, b: str) -> float:
    return max(0.0, 1.0 - difference(a, b) / BOUND)


def edited(text: str, following: str) -> str:
    """The last quarter of a text replaced by as much of the beginning of another one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def digests(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and fingerprint of each document, in one narrow pass."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([piece.column("d"), pa.array([fingerprint(t.as_py()) for t in piece.column("t")], pa.string())], ["doc_id", "fingerprint"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, fingerprint string")


def _compared(own: str, digest: str, following: str, next_digest: str) -> tuple:
    """n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    changed = edited(own, following)
    again = fingerprint(changed)
    return len(own), hashlib.sha256(changed.encode()).hexdigest(), digest, again, likeness(digest, again), likeness(digest, next_digest)


RESULT = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def neighbours(docs: DataFrame, *, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of each document."""
    with small_batches(docs.sparkSession, 1_000):
        return _neighbours(docs, doc_id, text)


def _neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    kind = docs.schema[doc_id].dataType
    whole = f"doc_id {kind.simpleString()}, {RESULT}"
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("t"), F.xxhash64(body).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = ("doc_id", "h", "row")
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "t")
    edges = f"{whole}, part int, first_text string, last_text string"

    def walk(batches):
        part = TaskContext.get().partitionId()
        first = before = None  # (doc_id, text, digest)
        names = None
        for batch in batches:
            ids = batch.column("doc_id").type
            for piece in pieces([batch], "t"):
                found = []
                for i, t in zip(piece.column("doc_id").to_pylist(), piece.column("t").to_pylist(), strict=True):
                    now = (i, t, fingerprint(t))
                    if before:
                        found.append((before[0], *_compared(before[1], before[2], t, now[2]), None, None, None))
                    first, before = first or now, now
                if found:
                    yield _batch(found, ids, edges_names)
                names = ids
        if before:  # the row whose next one is elsewhere, and the text that another range's last row needs
            yield _batch([(before[0], len(before[1]), None, before[2], first[2], None, None, part, first[1], before[1])], names, edges_names)

    edges_names = ["doc_id", *(f.split()[0] for f in RESULT.split(", ")), "part", "first_text", "last_text"]
    found = stored(sorted_rows.mapInArrow(walk, edges), "neighbours")
    inside = found.where("part IS NULL").select("doc_id", *edges_names[1:7])
    edge = found.where("part IS NOT NULL")  # one row of each range; its edited_fingerprint is the first row's digest
    ring = Window.orderBy("part")
    after = F.coalesce(F.lead("part").over(ring), F.first("part").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    heads = edge.select(F.col("part").alias("after"), F.col("first_text").alias("u"), F.col("edited_fingerprint").alias("g"))
    last = edge.select("part", "doc_id", "fingerprint", F.col("last_text").alias("t")).join(edge.select("part").withColumn("after", after), "part").join(heads, "after").drop("part", "after")

    def close(batches):
        for batch in batches:
            for piece in pieces([batch], "t"):
                if piece.num_rows:
                    yield _batch([(r["doc_id"], *_compared(r["t"], r["fingerprint"], r["u"], r["g"])) for r in piece.to_pylist()], piece.column("doc_id").type, edges_names[:7])

    return inside.unionByName(last.mapInArrow(close, whole))


_TYPES = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.string(), pa.string()]


def _batch(rows: list[tuple], ids: pa.DataType, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [ids, *_TYPES], strict=False)], names)


def op13_fingerprints(spark, sf_dir: str) -> DataFrame:
    return neighbours(read_table(spark, sf_dir, "documents"))
