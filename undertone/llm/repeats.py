"""Suffix-array deduplication of long repeats, by ranks of sampled positions, and by full prefix doubling.

`doubled_spans` is the method as it is named; it holds a row for every byte, and the README has the figures with which it
was stopped. `repeated_spans`, which the query uses, gives the same spans from sampled positions.

A byte goes if a string of LENGTH bytes covers it that also starts earlier (smaller doc_id, or
same document and earlier start). Full prefix doubling sorts every position of the corpus in
every round. Here the positions are sampled so that no repeat is lost, and rounds stop as soon
as a position is unique:

  sample   every LENGTH-byte string names the least of the hashes of its HALF-byte substrings
           (the leftmost on ties) as its position; strings that start next to each other mostly
           name the same one, so about one position in 25 is kept, each with the run of starts
           that name it. Equal strings name the same offset: they meet at equal positions.
  round 1  positions are ranked by their first HALF bytes; those with a rank of their own are done.
  round 2  what is left is ranked by the pair (rank so far, rank of everything from the first to the
           last byte that its run reaches): past LENGTH. Of equal pairs all but the earliest are
           repeats as a whole. A position whose first rank meets no other second rank is done.
  round 3  the earliest position of each pair, where several pairs share a first rank, is opened
           into groups of CELL starts, ranked by the bytes that all starts of a group cover; groups
           of a rank of their own are done.
  round 4  what is left is opened into single starts, ranked by their LENGTH bytes; all but the
           earliest go.

Ranks are hashes (64 bits for the first half, 64 for the rest, 128 for single starts): equality
is all that is asked of them, so ranks need no global order. Ranking is aggregation with
combining before the shuffle, and rows return to their ranks by equi-joins that Spark may
split, so a passage that very many documents share costs no single task.

Defined results: null texts are empty; texts under LENGTH bytes keep everything; rows that
share a doc_id are ordered by start and then by text, and equal ones don't remove each other; a
null doc_id comes before all others; doc_id is an integer (null stands for the least long, which no other row
may have); of rows that share an id, texts are told apart by 32 bits; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.shared import discard, pieces, read_table, stored
from undertone.llm.words import U64, Rolling, flat, mix

LENGTH = 100
#: Bits of a position within a chunk; longer texts are cut into chunks that overlap.
BITS = 22
CHUNK = 1 << 21
#: Starts that are ranked together before single ones are.
CELL = 5


def runs(data: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Of texts laid end to end: rank of each sampled position, rank of all that its run reaches,
    first start, number of starts, and how far the position lies after the first start."""
    half = length // 2
    parts = []
    cuts = [0] if len(data) <= CHUNK + length else list(range(0, len(data), CHUNK))
    inside = np.zeros(len(data) + 1, np.int8)
    size = np.diff(at)
    np.add.at(inside, at[:-1][size >= length], 1)
    np.add.at(inside, at[1:][size >= length] - length + 1, -1)
    inside = np.cumsum(inside, dtype=np.int8)[:-1] > 0
    for cut in cuts:
        end = len(data) if len(cuts) == 1 else min(len(data), cut + CHUNK + length - 1)
        part = data[cut:end]
        if len(part) < length:
            continue
        rolling = Rolling(part, 7)
        where = np.arange(len(part) - half + 1)
        rank = rolling.spans(where, where + half)
        low = (rank >> U64(BITS) << U64(BITS)) | where.astype(U64)
        width, span = length - half + 1, 1
        while 2 * span <= width:
            low, span = np.minimum(low[:-span], low[span:]), 2 * span
        if span < width:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        start = np.flatnonzero(inside[cut : cut + len(low)])
        if not len(start):
            continue
        position = (low[start] & U64((1 << BITS) - 1)).astype(np.int64)
        new = np.ones(len(start), bool)
        new[1:] = (position[1:] != position[:-1]) | (start[1:] != start[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(start)))
        lo = start[first]
        parts.append((rank[position[first]], rolling.spans(lo, lo + n + length - 1), lo + cut, n, position[first] - lo))
    if not parts:
        return (np.zeros(0, U64),) * 2 + (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _tag(column: pa.Array) -> np.ndarray:
    """32 bits of each text, to tell rows apart that share an id."""
    return np.array([int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "big") for t in column.to_pylist()], np.int64)


#: doc is the id, null as the least long; place is a start, then the text's tag in the last 32 bits;
#: n starts from there on; ahead: the sampled position after the start.
ROWS = "rank bigint, rest bigint, doc bigint, place bigint, n int, ahead int"


def _rows(rank, rest, ids: pa.Array, row, start, tag, n, ahead) -> pa.RecordBatch:
    columns = [pa.array(rank.view(np.int64)), pa.array(rest.view(np.int64)), ids.take(pa.array(row)), pa.array(start << 32 | tag), pa.array(n, pa.int32()), pa.array(ahead, pa.int32())]
    return pa.RecordBatch.from_arrays(columns, ["rank", "rest", "doc", "place", "n", "ahead"])


def _run_rows(docs: DataFrame, length: int) -> DataFrame:
    def emit(batches):
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            rank, rest, lo, n, ahead = runs(data, at, length)
            row = np.searchsorted(at, lo, "right") - 1
            yield _rows(rank, rest, piece.column("d"), row, lo - at[row], _tag(piece.column("t"))[row], n, ahead)

    return docs.mapInArrow(emit, ROWS)


def _run_ranks(docs: DataFrame, length: int) -> DataFrame:
    """Only the ranks of the sampled positions, and how often each occurs in a piece."""

    def emit(batches):
        for piece in pieces(batches, "t"):
            rank, times = np.unique(runs(*flat(piece.column("t")), length)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(rank.view(np.int64)), pa.array(times)], ["rank", "times"])

    return docs.select("t").mapInArrow(emit, "rank bigint, times bigint")


def _open(docs: DataFrame, chosen: DataFrame, split) -> DataFrame:
    """Rows of chosen ones opened by split(data, rank, first start, n, ahead), which returns the index of
    the row opened, rank, rest, first start, n and ahead of each part."""
    wanted = chosen.groupBy("doc", F.expr("place & 4294967295").alias("tag")).agg(F.collect_set(F.struct("rank", F.expr("shiftright(place, 32)").alias("lo"), "n", "ahead")).alias("runs"))

    def emit(batches):
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            of = piece.column("runs").combine_chunks() if isinstance(piece.column("runs"), pa.ChunkedArray) else piece.column("runs")
            row = np.repeat(np.arange(len(of)), np.diff(np.asarray(of.offsets)))
            each = of.flatten()
            rank, lo, n, ahead = (each.field(k).to_numpy().astype(np.int64) for k in ("rank", "lo", "n", "ahead"))
            k, rank, rest, start, n, ahead = split(data, rank.view(U64), lo + at[row], n, ahead)
            row = row[k]
            yield _rows(rank, rest, piece.column("d"), row, start - at[row], piece.column("tag").to_numpy()[row].astype(np.int64), n, ahead)

    tagged = _tagged(docs)
    joined = tagged.join(_hashed(wanted), (tagged.d == wanted.doc) & (tagged.g == wanted.tag)).select("d", "t", "tag", "runs")
    return joined.mapInArrow(emit, ROWS)


def _each(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of groups of n: the group and the place within it of each member."""
    group = np.repeat(np.arange(len(n)), n)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(n) - n, n)


def _cells(length: int):
    """Opens runs into cells: starts whose distance to the sampled position falls into one group of CELL."""

    def split(data, rank, lo, n, ahead):
        low, high = (ahead - n + 1) // CELL, ahead // CELL
        k, i = _each(high - low + 1)
        cell = high[k] - i
        far = np.minimum(ahead[k], cell * CELL + CELL - 1)
        near = np.maximum(ahead[k] - n[k] + 1, cell * CELL)
        position = lo[k] + ahead[k]
        core = position - cell * CELL
        rest = Rolling(data, 8).spans(core, core - CELL + 1 + length)
        return k, mix(rank[k] + cell.astype(U64)), rest, position - far, far - near + 1, far

    return split


def _starts(length: int):
    """Opens runs into single starts, with 128-bit ranks of their bytes."""

    def split(data, rank, lo, n, ahead):
        k, i = _each(n)
        start = lo[k] + i
        h = [Rolling(data, seed).spans(start, start + length) for seed in (8, 9)]
        return k, *h, start, np.ones(len(k), np.int64), ahead[k] - i

    return split


def _tagged(docs: DataFrame) -> DataFrame:
    def emit(batches):
        for piece in pieces(batches, "t"):
            yield pa.RecordBatch.from_arrays([piece.column("d"), piece.column("t"), pa.array(_tag(piece.column("t")), pa.int64())], ["d", "t", "g"])

    return docs.mapInArrow(emit, "d bigint, t string, g bigint")


def _hashed(df: DataFrame) -> DataFrame:
    """The side of a join that has one row for each key; a task hashes its part of it, and the other side, with
    the popular keys, streams past unsorted."""
    return df.hint("shuffle_hash")


def _ranked(rows: DataFrame) -> DataFrame:
    """Of each pair of ranks, the earliest row and the number of rows."""
    return rows.groupBy("rank", "rest").agg(F.min(F.struct("doc", "place", "n", "ahead")).alias("first"), F.count("*").alias("rows"))


def _later(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The rows that are not the earliest of their pair of ranks."""
    first = several.select("rank", "rest", F.col("first.doc").alias("fd"), F.col("first.place").alias("fp"))
    return rows.join(_hashed(first), ["rank", "rest"]).where("doc != fd OR place != fp").select("doc", "place", "n")


def repeated_spans(docs: DataFrame, *, doc_id="doc_id", text="text", length=LENGTH) -> DataFrame:
    """(doc, place, n): starts of repeats, n of them from `place` on (a start and the text's tag)."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = _run_rows(own, length)
    shared = stored(_run_ranks(own, length).groupBy("rank").agg(F.sum("times").alias("n")).where("n > 1").select("rank"), "shared-ranks")
    left = discard(stored(rows.join(_hashed(shared), "rank"), "shared-runs"), shared)
    pairs = stored(_ranked(left), "pairs")
    forked = stored(pairs.groupBy("rank").count().where("count > 1").select("rank"), "forked")
    opened = discard(stored(pairs.join(_hashed(forked), "rank").select("rank", "first.*"), "opened"), forked)
    cells = discard(stored(_open(own, opened, _cells(length)), "cells"), opened)
    alike = stored(cells.groupBy("rank", "rest").count().where("count > 1").select("rank", "rest"), "alike")
    kept = discard(stored(cells.join(_hashed(alike), ["rank", "rest"]).select("rank", "doc", "place", "n", "ahead"), "kept-cells"), cells, alike)
    single = discard(stored(_open(own, kept, _starts(length)), "starts"), kept)
    several = stored(_ranked(single).where("rows > 1"), "start-ranks")
    found = _later(left, pairs.where("rows > 1")).unionByName(_later(single, several))
    return discard(stored(found, "found"), left, pairs, single, several)


#: Bytes of the first ranks of full doubling.
FIRST = 4


def _positions(docs: DataFrame, length: int) -> DataFrame:
    """(doc, place, a, b): every position of texts of at least `length` bytes that FIRST bytes follow, a: those bytes as a number."""

    def emit(batches):
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            row, i = _each(np.where(np.diff(at) < length, 0, np.diff(at) - FIRST + 1))
            start = at[row] + i
            a = sum((data[start + k].astype(np.int64) << (8 * (FIRST - 1 - k)) for k in range(FIRST)), np.zeros(len(start), np.int64))
            place = pa.array(i << 32 | _tag(piece.column("t"))[row])
            yield pa.RecordBatch.from_arrays([piece.column("d").take(pa.array(row)), place, pa.array(a), pa.array(np.zeros(len(a), np.int64))], ["doc", "place", "a", "b"])

    return docs.mapInArrow(emit, "doc bigint, place bigint, a bigint, b bigint")


def _reranked(pairs: DataFrame) -> DataFrame:
    """(doc, place, rank) of positions whose pair of ranks is not their own: pairs are sorted, and equal neighbours numbered."""

    def number(batches):
        n, last, alone = TaskContext.get().partitionId() << 40, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, doc, place = (batch.column(c).to_numpy() for c in ("a", "b", "doc", "place"))
            if alone is not None:
                a, b, doc, place = (np.concatenate([[x], y]) for x, y in zip(alone, (a, b, doc, place), strict=True))
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = last is None or (a[0], b[0]) != last
            rank = n + np.cumsum(new)
            size = np.bincount(rank - rank[0])[rank - rank[0]]
            shared = (size > 1) | (rank == n)  # rank n went on from the batch before
            alone = None
            if not shared[-1]:
                alone = a[-1], b[-1], doc[-1], place[-1]
                a, b, doc, place, rank, shared = (x[:-1] for x in (a, b, doc, place, rank, shared))
            if len(a):
                n, last = int(rank[-1]), (a[-1], b[-1])
                yield pa.RecordBatch.from_arrays([pa.array(x[shared]) for x in (doc, place, rank)], ["doc", "place", "rank"])

    return pairs.repartitionByRange("a", "b").sortWithinPartitions("a", "b").mapInArrow(number, "doc bigint, place bigint, rank bigint")


def doubled_spans(docs: DataFrame, *, doc_id="doc_id", text="text", length=LENGTH) -> DataFrame:
    """What `repeated_spans` returns, by prefix doubling over every position: ranks of 4 bytes are paired with those 4, 8, 16 ...
    bytes on, pairs are sorted and numbered anew, and a position goes as soon as its rank is its own, until ranks stand for
    `length` bytes. Its first rounds hold a row for every byte of the corpus."""
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    ranked, width = stored(_reranked(_positions(own, length)), "doubled"), FIRST
    while width < length:
        step = min(width, length - width)
        ahead = ranked.select("doc", (F.col("place") - (step << 32)).alias("place"), F.col("rank").alias("b"))
        pairs = ranked.withColumnRenamed("rank", "a").join(ahead, ["doc", "place"])
        ranked, width = discard(stored(_reranked(pairs), "doubled"), ranked), width + step
    several = ranked.groupBy("rank").agg(F.min(F.struct("doc", "place")).alias("first"))
    found = ranked.join(_hashed(several), "rank").where("doc != first.doc OR place != first.place")
    return discard(stored(found.select("doc", "place", F.lit(1).alias("n")), "found"), ranked)


def _merged(lo: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes from starts and their numbers; none for none."""
    if not len(lo):
        return lo, lo
    hi = lo + n + length - 1
    order = np.argsort(lo, kind="stable")
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _with_spans(docs: DataFrame, doc_id: str, text: str, length: int, emit, schema: str, spans_of=repeated_spans) -> DataFrame:
    spans = spans_of(docs, doc_id=doc_id, text=text, length=length)
    by_doc = spans.groupBy("doc", F.expr("place & 4294967295").alias("tag")).agg(F.collect_set(F.struct(F.expr("shiftright(place, 32)").alias("lo"), "n")).alias("spans"))
    own = _tagged(docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63))).alias("d"), F.coalesce(F.col(text), F.lit("")).alias("t")))
    by_doc = discard(stored(by_doc, "spans"), spans)
    joined = own.join(_hashed(by_doc), (own.d == by_doc.doc) & (own.g == by_doc.tag), "left").select("d", "t", "spans")

    def run(batches):
        for piece in pieces(batches, "t"):
            data, at = flat(piece.column("t"))
            spans = piece.column("spans")
            each = spans.flatten()
            lo, n = (each.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("lo", "n"))
            top = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(spans), 0), np.int64))])
            rows = []
            for i in range(piece.num_rows):
                own = slice(top[i], top[i + 1])
                rows.append(emit(data[at[i] : at[i + 1]], *_merged(lo[own], n[own], length)))
            yield pa.RecordBatch.from_arrays([piece.column("d"), *(pa.array(c) for c in zip(*rows, strict=True))], ["doc_id", *(f.split()[0] for f in schema.split(", "))])

    out = joined.mapInArrow(run, "doc_id bigint, " + schema)
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(-(2**63))))


def _left_over(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> bytes:
    edges = np.concatenate([[0], np.stack([lo, hi], 1).ravel(), [len(data)]])
    return b"".join(data[a:b].tobytes() for a, b in zip(edges[::2], edges[1::2], strict=True))


def remove_repeats(docs: DataFrame, *, doc_id="doc_id", text="text", length=LENGTH, spans_of=repeated_spans) -> DataFrame:
    """doc_id, kept (what is left, as binary), and the removed byte spans as arrays."""

    def emit(data, lo, hi):
        return _left_over(data, lo, hi), lo.tolist(), hi.tolist()

    return _with_spans(docs, doc_id, text, length, emit, "kept binary, starts array<bigint>, ends array<bigint>", spans_of)


def digest_repeats(docs: DataFrame, *, doc_id="doc_id", text="text", length=LENGTH, spans_of=repeated_spans) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left."""

    def emit(data, lo, hi):
        return len(data), int((hi - lo).sum()), len(lo), hashlib.sha256(_left_over(data, lo, hi)).hexdigest()

    return _with_spans(docs, doc_id, text, length, emit, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", spans_of)


def op3_repeats(spark, sf_dir: str) -> DataFrame:
    return digest_repeats(read_table(spark, sf_dir, "documents"))
