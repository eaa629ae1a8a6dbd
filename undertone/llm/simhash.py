"""SimHash near-duplicates found with a Gray-order hierarchical index.

Fingerprint: A-Z lower-cased, words split at ASCII white space, three-word shingles (repeats
count; fewer words: the whole sequence), XXH64 with seed 42 of each; a bit is one if set in
over half of the hashes. No word: zero, linked like any other fingerprint. Two fingerprints
link if at most `DISTANCE` bits differ; a component is what links reach.

Index: distinct fingerprints sorted by the rank of their value in the Gray code, so that
neighbours share bit patterns. Every node (group of 32, block, super node) keeps the bits on
which all below it agree. Two nodes whose agreed bits differ in more than `DISTANCE` places
cannot hold a link, and the whole pair of groups is pruned; what is left descends. Blocks have
a fixed size, so no task's input depends on how alike the fingerprints are. Pairs of blocks are taken
by pairs of tiles of neighbouring blocks, so a block travels once for each tile it meets. A pair of blocks
returns its links as stars over the fingerprints they connect: as many rows as fingerprints
at most, and connectivity is kept in full. Components then come from `components`.

Defined results: null and empty texts have fingerprint zero; a null doc_id has a fingerprint
and its component, and never names a component; repeated rows are returned as they are; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from undertone.llm.components import components
from undertone.llm.shared import pieces, read_table, stored

SHINGLE_WORDS = 3
DISTANCE = 2
#: Bytes of a text whose words are held at once.
TEXT_BLOCK = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Fingerprints in a block, in a leaf group, and blocks under a super node.
BLOCK, GROUP, SUPER = 2048, 32, 1024
#: Blocks that stand next to each other travel together: 2 to this power make a tile, and a pair of tiles a task's work.
TILE_BITS = 3
#: Super nodes that may be broadcast; at 2^21 fingerprints each, this is reached at 10^11 fingerprints.
MOST_SUPERS = 50_000
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _word_blocks(data: bytes, size: int) -> Iterator[list[bytes]]:
    """The words of a text, in lists of about size bytes of it; a longer word stays whole."""
    begin = 0
    while begin < len(data):
        space = _SPACE.search(data, begin + size)
        end = space.start() if space else len(data)
        yield data[begin:end].split()
        begin = end


def _bits(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set."""
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return total


def fingerprint(text: str | None, n: int = SHINGLE_WORDS, size: int = TEXT_BLOCK) -> int:
    """The fingerprint of a text, whose words are held in blocks of about size bytes; shingles cross from block to block."""
    digest, total, shingles, carried = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for block in _word_blocks((text or "").encode().lower(), size):
        words = carried + block
        carried = words[max(0, len(words) - n + 1) :]
        if len(words) < n:
            continue
        joined = b" ".join(words)
        ends, starts, at = [], [], 0
        for w in words:
            starts.append(at)
            at += len(w)
            ends.append(at)
            at += 1
        hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, ends[n - 1 :], strict=False)), np.uint64, len(words) - n + 1)
        total += _bits(hashes)
        shingles += len(hashes)
    if not shingles:
        if not carried:
            return 0
        total, shingles = _bits(np.array([digest(b" ".join(carried), 42)], np.uint64)), 1
    return int(np.packbits(2 * total > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE_WORDS) -> DataFrame:
    """doc_id and its fingerprint as a long."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        for piece in pieces(batches, "t"):
            prints = np.fromiter((fingerprint(t.as_py(), n) for t in piece.column("t")), np.uint64, piece.num_rows)
            yield pa.RecordBatch.from_arrays([piece.column("d"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def gray_rank(fp: str):
    """Rank of a value in the Gray code, as a long that sorts in its unsigned order."""
    r = F.col(fp)
    for s in (1, 2, 4, 8, 16, 32):
        r = r.bitwiseXOR(F.shiftrightunsigned(r, s))
    return r.bitwiseXOR(F.lit(-(2**63)))


def _agreed(values: np.ndarray, cuts: np.ndarray, masks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Of each run of nodes: the bits on which all below agree, and those bits' values."""
    ones, zeros = np.bitwise_and.reduceat(values, cuts), np.bitwise_and.reduceat(~values, cuts)
    agreed = ones | zeros
    if masks is not None:
        agreed &= np.bitwise_and.reduceat(masks, cuts)
    return agreed, ones & agreed


def _close_pairs(mask_a, value_a, mask_b, value_b, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the pairs of nodes that their agreed bits don't rule out."""
    out = [(np.zeros(0, np.int64),) * 2]
    step = max(1, (1 << 22) // max(1, len(mask_b)))
    for s in range(0, len(mask_a), step):
        a, b = np.nonzero(np.bitwise_count((value_a[s : s + step, None] ^ value_b[None]) & mask_a[s : s + step, None] & mask_b[None]) <= most)
        out.append((a + s, b))
    return tuple(np.concatenate(z) for z in zip(*out, strict=True))


def _stars(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of n indexes is connected to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(x: np.ndarray, y: np.ndarray | None, most: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links within Gray-sorted block x, or between x and y, as (fingerprint, least one connected)."""
    same, y = y is None, x if y is None else y
    (mx, vx), (my, vy) = (_agreed(v, np.arange(0, len(v), GROUP)) for v in (x, y))
    gx, gy = _close_pairs(mx, vx, my, vy, most)
    if same:
        gx, gy = gx[gx <= gy], gy[gx <= gy]
    found = [(np.zeros(0, np.int64),) * 2]
    inner = np.arange(GROUP)
    for s in range(0, len(gx), 1024):
        i = (gx[s : s + 1024, None] * GROUP + inner)[:, :, None]
        j = (gy[s : s + 1024, None] * GROUP + inner)[:, None, :]
        hit = np.bitwise_count(x[np.minimum(i, len(x) - 1)] ^ y[np.minimum(j, len(y) - 1)]) <= most
        hit &= (i < len(x)) & (j < len(y))
        if same:
            hit &= i < j
        g, p, q = np.nonzero(hit)
        found.append((gx[s + g] * GROUP + p, gy[s + g] * GROUP + q))
    a, b = (np.concatenate(z) for z in zip(*found, strict=True))
    values = x if same else np.concatenate([x, y])
    label = _stars(len(values), a, b if same else b + len(x))
    at = np.flatnonzero(label != np.arange(len(values)))
    return values[at], values[label[at]]


def _runs(batches, columns: list[str], size: int):
    """The columns as arrays, `size` rows at a time."""
    held = [np.zeros(0, np.int64)] * len(columns)
    for batch in batches:
        held = [np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, columns, strict=True)]
        while len(held[0]) >= size:
            yield [h[:size] for h in held]
            held = [h[size:] for h in held]
    if len(held[0]):
        yield held


def _node(mask: np.ndarray, value: np.ndarray, k: int, payload: bytes) -> pa.RecordBatch:
    name = (TaskContext.get().partitionId() << 32) + k
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array(mask.view(np.int64)), pa.array(value.view(np.int64)), pa.array([payload], pa.binary())], ["node", "mask", "value", "below"])


NODE = "node bigint, mask bigint, value bigint, below binary"


def link_stars(prints: DataFrame, most: int = DISTANCE) -> DataFrame:
    """(a, b): edges over the distinct fingerprints fp that connect exactly what links connect."""
    spark = prints.sparkSession

    def blocks_of(batches):
        for k, (fp,) in enumerate(_runs(batches, ["fp"], BLOCK)):
            yield _node(*_agreed(fp.view(np.uint64), np.array([0])), k, fp.tobytes())

    def supers_of(batches):
        for k, (node, mask, value) in enumerate(_runs(batches, ["node", "mask", "value"], SUPER)):
            yield _node(*_agreed(value.view(np.uint64), np.array([0]), mask.view(np.uint64)), k, np.stack([node, mask, value]).tobytes())

    ordered = prints.select("fp", gray_rank("fp").alias("r")).repartitionByRange("r").sortWithinPartitions("r").select("fp")
    blocks = stored(ordered.mapInArrow(blocks_of, NODE), "blocks")
    supers = stored(blocks.select("node", "mask", "value").repartitionByRange("node").sortWithinPartitions("node").mapInArrow(supers_of, NODE), "supers")
    if supers.count() > MOST_SUPERS:
        raise ValueError(f"more than {MOST_SUPERS} super nodes; raise BLOCK or SUPER")
    tops = supers.select("node", "mask", "value").orderBy("node").collect()
    top = [np.array([r[c] for r in tops], np.int64).view(np.uint64) for c in range(3)]
    tops_sent = spark.sparkContext.broadcast(top)

    def super_pairs(batches):
        node, mask, value = tops_sent.value
        for batch in batches:
            own = [batch.column(c).to_numpy().view(np.uint64) for c in ("node", "mask", "value")]
            a, b = _close_pairs(own[1], own[2], mask, value, most)
            keep = own[0][a] <= node[b]
            yield pa.RecordBatch.from_arrays([pa.array(own[0][a][keep].view(np.int64)), pa.array(node[b][keep].view(np.int64))], ["x", "y"])

    def block_pairs(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y = (np.frombuffer(r[k], np.int64).reshape(3, -1) for k in ("bx", "by"))
                a, b = _close_pairs(*(z.view(np.uint64) for z in (x[1], x[2], y[1], y[2])), most)
                keep = x[0][a] <= y[0][b]
                yield pa.RecordBatch.from_arrays([pa.array(x[0][a][keep]), pa.array(y[0][b][keep])], ["x", "y"])

    def links(asked: pa.Table, own: pa.Table) -> pa.Table:
        held = {n: np.frombuffer(fp, np.uint64) for n, fp in zip(own.column("node").to_pylist(), own.column("below").to_pylist(), strict=True)}
        out = [(np.zeros(0, np.uint64),) * 2]
        out += [block_links(held[x], None if x == y else held[y], most) for x, y in zip(asked.column("x").to_pylist(), asked.column("y").to_pylist(), strict=True)]
        return pa.table([pa.array(np.concatenate(z).view(np.int64)) for z in zip(*out, strict=True)], ["a", "b"])

    over = supers.select("node", "mask", "value").mapInArrow(super_pairs, "x bigint, y bigint")
    for k in "xy":
        over = over.join(supers.select(F.col("node").alias(k), F.col("below").alias(f"b{k}")), k)
    tile = lambda c: F.shiftright(c, TILE_BITS)
    pairs = stored(over.mapInArrow(block_pairs, "x bigint, y bigint").withColumns({"tx": tile("x"), "ty": tile("y")}), "pairs")
    cells = pairs.groupBy(F.col("tx").alias("cx"), F.col("ty").alias("cy")).count().drop("count")
    tiles = blocks.select(tile("node").alias("tile"), "node", "below")
    shipped = cells.join(tiles, F.col("cx") == F.col("tile")).unionByName(cells.where("cx != cy").join(tiles, F.col("cy") == F.col("tile"))).drop("tile")
    return pairs.groupBy("tx", "ty").cogroup(shipped.groupBy("cx", "cy")).applyInArrow(links, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, *, doc_id="doc_id", text="text", n=SHINGLE_WORDS, most=DISTANCE) -> DataFrame:
    """doc_id, fp (long) and component_id: the least doc_id that links reach, itself included."""
    prints = stored(fingerprints(docs, doc_id, text, n), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    roots = components(link_stars(classes, most))
    named = classes.join(roots, classes.fp == roots.node)
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    linked = stored(roots.join(least, "root").select(F.col("node").alias("fp"), "component_id"), "linked")
    own = classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "rep").alias("component_id"))
    return prints.join(stored(own, "owners"), "fp").select("doc_id", "fp", "component_id")


def without_later(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents without those that have a lesser doc_id in their component (found: doc_id, component_id)."""
    name = next(c for c in (f"gone_{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    gone = found.filter(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(stored(gone, "gone"), docs[doc_id] == F.col(name), "left_anti").select([docs[c] for c in docs.columns])


def one_per_group(docs: DataFrame, *, doc_id="doc_id", text="text", n=SHINGLE_WORDS, most=DISTANCE) -> DataFrame:
    """The documents without those that have a lesser doc_id in their component."""
    return without_later(docs, near_duplicates(docs, doc_id=doc_id, text=text, n=n, most=most), doc_id)


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
