"""Similarity and correlation: nearest profiles, positional and interval joins, clustering.

Profiles are written in blocks of bounded size by tasks, and every row looks its best one up in one narrow pass, in which a task holds
one block at a time. The work is rows times profiles where nothing can be skipped; memory doesn't grow with either. A block is an index of cells around pivots: the angle between a row and a pivot, less the cell's radius, bounds how
similar anything in the cell can be, so most cells are skipped, and the answer is the same."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from undertone.operators.sequences import numbered
from undertone.sources.work import stored, work_folder

#: Profiles in one block of the library.
BLOCK = 4096


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def cosine(a, b, zero: float = 0.0) -> Column:
    """Cosine similarity of two arrays; a fixed value where one has no length."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(zero))


def centroids(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the mean of its vectors, summed place by place."""
    rows = df.select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg(F.avg(F.col("v").cast("double")).alias("v"))
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias(vector))


def best_match(df: DataFrame, profiles: DataFrame, *, id="id", vector="v", name="name", least: float = -2.0, centred: bool = False, count=None) -> DataFrame:
    """id, name, score: the most similar profile (cosine; or correlation of centred vectors), the first by name on ties, null
    under a threshold. count: an accumulator of the pairs that were compared, of rows times profiles."""
    kind = {f.name: f.dataType.simpleString() for f in df.schema}[id]
    name_type = {f.name: f.dataType for f in profiles.schema}[name]
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    # equal vectors are one, with their first name
    library = stored(profiles.select(F.col(name).alias("name"), F.col(vector).cast("array<double>").alias("v")).groupBy("v").agg(F.min("name").alias("name")), "library")
    n = library.count()
    blocks, unit = -(-n // BLOCK), lambda x: _unit(x - x.mean(1, keepdims=True) if centred else x)
    packed = f"{work_folder(df.sparkSession)}/cells"

    def index(batches):
        held = pa.Table.from_batches([*batches]) if blocks else None  # a partition is a block
        for t in [held] if held is not None and held.num_rows else []:
            t = t.sort_by("name")
            cells = Cells(unit(np.array(t.column("v").to_pylist(), float)))
            yield pa.RecordBatch.from_arrays([pa.array([t.column("name").to_pylist()], pa.list_(t.schema.field("name").type)), pa.array([pickle.dumps(cells)], pa.binary())], ["names", "cells"])

    if blocks:
        library.repartition(blocks).mapInArrow(index, f"names array<{name_type.simpleString()}>, cells binary").write.parquet(packed)
        rows = rows.repartition(max(1, min(4 * blocks, 2_048)))

    def run(batches):
        system, folder = pafs.FileSystem.from_uri(packed) if ":" in packed.split("/")[0] else (pafs.LocalFileSystem(), packed)
        files = sorted(f.path for f in system.get_file_info(pafs.FileSelector(folder)) if f.path.endswith(".parquet")) if blocks else []
        kept = None  # of a single block
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(np.array(batch.column("v").to_pylist(), float))
            best = [(None, None)] * batch.num_rows  # of the blocks so far, row by row
            for path in files:
                loaded = kept if kept is not None else _loaded(system, path)
                kept = loaded if len(files) == 1 else None
                for names, known in loaded:
                    top, s, compared = known.nearest(x)
                    if count is not None:
                        count.add(compared)
                    for i, (t, now) in enumerate(zip(top.tolist(), s.tolist(), strict=True)):
                        before, score = best[i]
                        if score is None or now > score or (now == score and names[t] < before):
                            best[i] = names[t], now
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([n for n, _ in best], to_arrow_type(name_type)), pa.array([s for _, s in best], pa.float64())], ["id", "name", "score"])

    out = rows.mapInArrow(run, f"id {kind}, name {name_type.simpleString()}, score double")
    return out.select("id", F.when(F.col("score") >= least, F.col("name")).alias("name"), "score")


def _loaded(system: pafs.FileSystem, path: str) -> list:
    """(names, cells) of a file of the packed library: one block."""
    with system.open_input_file(path) as file:
        t = pq.read_table(file)
    return [(names, pickle.loads(cells)) for names, cells in zip(t.column("names").to_pylist(), t.column("cells").to_pylist(), strict=True)]


class Cells:
    """Unit vectors in cells around some of them, and zero vectors, whose similarity to anything is 0, in one more."""

    def __init__(self, known: np.ndarray):
        zero = np.abs(known).sum(1) == 0
        units = np.flatnonzero(~zero)
        n, pivots = max(1, round(len(units) ** 0.5)) if len(units) else 0, [*units[:1]]
        away = np.where(zero, 3.0, -2.0)  # each vector's similarity to its nearest pivot
        while len(pivots) < n:  # the next pivot is the vector that is farthest from all
            away = np.maximum(away, known @ known[pivots[-1]])
            pivots.append(int(away.argmin()))
        self.pivots = known[pivots]
        similar = known[units] @ self.pivots.T
        own = similar.argmax(1) if n else np.zeros(0, np.int64)
        angle = np.arccos(np.clip(similar[np.arange(len(units)), own], -1, 1))
        self.radius = np.array([angle[own == c].max(initial=0.0) for c in range(n)])
        self.members = [*(units[own == c] for c in range(n)), np.flatnonzero(zero)]
        self.known = [known[m] for m in self.members]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """The first of the most similar vectors to each row, its similarity (to 12 digits), and how many pairs were compared."""
        angle = np.arccos(np.clip(x @ self.pivots.T, -1, 1))
        bound = np.cos(np.maximum(0.0, angle - self.radius)) + 1e-9
        bound[np.abs(x).sum(1) == 0] = 0.0
        bound = np.concatenate([bound, np.zeros((len(x), 1))], axis=1)
        bound[:, [not len(m) for m in self.members]] = -3.0
        top, score, compared = np.full(len(x), -1), np.full(len(x), -3.0), 0
        first = bound.argmax(1)
        for turn in (0, 1):  # each row's most promising cell, then what that leaves open
            for c, members in enumerate(self.members):
                rows = np.flatnonzero(first == c if turn == 0 else (first != c) & (bound[:, c] >= score))
                if len(rows) and len(members):
                    s = np.round(x[rows] @ self.known[c].T, 12)
                    at = s.argmax(1)
                    now, who = s[np.arange(len(rows)), at], members[at]
                    better = (now > score[rows]) | ((now == score[rows]) & (who < top[rows]))
                    top[rows[better]], score[rows[better]] = who[better], now[better]
                    compared += s.size
        return top, score, compared


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def by_position(frames: DataFrame, track: DataFrame, *, key="signal_id", frame="f", place="vf") -> DataFrame:
    """Frames with the track's value at their own position, or its last one."""
    last = track.groupBy(key).agg(F.max(place).alias("__last"))
    placed = frames.join(last, key).withColumn(place, F.least(F.col(frame), F.col("__last"))).drop("__last")
    return placed.join(track, [key, place])


def as_of(left: DataFrame, right: DataFrame, *, key: str, at: str, values: list[str]) -> DataFrame:
    """Left rows with the values of the right row at their time or the last before it: a union and one window, so any
    number of rows of a key is sorted once."""
    a = left.withColumns({**{f"__{v}": F.lit(None).cast(right.schema[v].dataType) for v in values}, "__side": F.lit(1)})
    b = right.select(*[F.col(c) if c in (key, at) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], *(F.col(v).alias(f"__{v}") for v in values), F.lit(0).alias("__side"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b)
    return both.select("*", *(F.last(F.when(F.col("__side") == 0, F.struct(f"__{v}")), ignorenulls=True).over(w)[f"__{v}"].alias(v) for v in values)).where("__side = 1").drop("__side", *(f"__{v}" for v in values))


def greedy_clusters(df: DataFrame, *, key: str, order: str, vector: str, least: float) -> DataFrame:
    """Adds cluster: in order, a vector joins the first cluster whose running mean is similar enough, or opens one."""
    schema = df.select("*", F.lit(0).cast("bigint").alias("cluster")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        means, sizes, out = [], [], []
        for v in np.array(group.column(vector).to_pylist(), float):
            hit = next((i for i, m in enumerate(means) if m @ v > least * np.linalg.norm(m) * np.linalg.norm(v)), None)
            if hit is None:
                hit = len(means)
                means.append(v)
                sizes.append(1)
            else:
                sizes[hit] += 1
                means[hit] = means[hit] + (v - means[hit]) / sizes[hit]
            out.append(hit)
        return group.append_column("cluster", pa.array(out, pa.int64()))

    return df.groupBy(key).applyInArrow(run, schema)


def kmeans(df: DataFrame, k: int, *, id: str, vector: str, rounds: int = 20) -> DataFrame:
    """id and label. Seeds are rows evenly spaced in order of id; ties go to the lowest label; an empty cluster keeps its
    centre; rounds end when the centres stay where they are, and with them the labels. Rows are written once, in order of id. A round is
    one narrow pass over them and one aggregation of k rows a task; only centres meet in the driver."""
    rows = df.select(F.col(id).alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = rows.count()
    if not n:
        return rows.select("id", F.lit(None).cast("bigint").alias("label"))
    marks = [int(i * n / k) + 1 for i in range(min(k, n))]
    placed = numbered(rows, "id")
    seeds, rows = [r.v for r in placed.where(F.col("place").isin(marks)).orderBy("place").collect()], placed.select("id", "v")
    centres, before = np.array(seeds, float), None
    spark = df.sparkSession
    kind = df.schema[id].dataType.simpleString()
    for _ in range(rounds):
        shipped = spark.sparkContext.broadcast(centres)

        def assign(batches, shipped=shipped):
            c = shipped.value
            for batch in batches:
                if batch.num_rows:
                    x = np.array(batch.column("v").to_pylist(), float)
                    label = np.round(((x[:, None] - c[None]) ** 2).sum(2), 12).argmin(1)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(label)], ["id", "v", "label"])

        labelled = rows.mapInArrow(assign, f"id {kind}, v array<double>, label bigint")
        sums = labelled.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.sum("x").alias("s"), F.count("*").alias("n")).collect()
        new = centres.copy()
        for r in sums:
            new[r.label, r.i] = r.s / r.n
        if before is not None and np.allclose(new, before, atol=1e-12):
            break
        before, centres = new, new
    return labelled.select("id", "label")


def nearest_means(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Labels by k-means: seeds evenly spaced in the order of rows, ties to the lowest label, an empty cluster keeps its centre."""
    centres = x[(np.arange(min(k, len(x))) * len(x)) // max(1, min(k, len(x)))]
    label = np.full(len(x), -1)
    for _ in range(rounds):
        now = np.round(((x[:, None] - centres[None]) ** 2).sum(2), 12).argmin(1)
        if (now == label).all():
            break
        label = now
        centres = np.array([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(len(centres))])
    return label


def clustered_frames(df: DataFrame, k, *, key: str, order: str, vector: str) -> DataFrame:
    """Adds label: the frames of each recording clustered by themselves; k(frames) is how many clusters so many frames make."""
    schema = df.select("*", F.lit(0).cast("bigint").alias("label")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        x = np.array(group.column(vector).to_pylist(), float)
        return group.append_column("label", pa.array(nearest_means(x, k(len(x))), pa.int64()))

    return df.groupBy(key).applyInArrow(run, schema)


def enrolled(df: DataFrame, *, key: str, order: str, vector: str, least: float) -> DataFrame:
    """Registry of each key after all its rows: cluster, how many rows it took, and its vector (the first one, as enrolled).
    A row that no registered vector resembles is enrolled; order decides, so a key is walked once."""
    named = greedy_first(df, key=key, order=order, vector=vector, least=least)
    return named.groupBy(key, "cluster").agg(F.count("*").alias("n"), F.min_by(vector, order).alias(vector))


def greedy_first(df: DataFrame, *, key: str, order: str, vector: str, least: float) -> DataFrame:
    """Adds cluster: the registered vector most like the row's, if it is like enough, else a new one."""
    schema = df.select("*", F.lit(0).cast("bigint").alias("cluster")).schema

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by(order)
        known, out = np.zeros((0, 0)), []
        for v in _unit(np.array(group.column(vector).to_pylist(), float)):
            s = np.round(known @ v, 12) if len(known) else np.zeros(0)
            if len(s) and s.max() >= least:
                out.append(int(s.argmax()))
            else:
                out.append(len(known))
                known = np.vstack([known, v]) if len(known) else v[None]
        return group.append_column("cluster", pa.array(out, pa.int64()))

    return df.groupBy(key).applyInArrow(run, schema)
