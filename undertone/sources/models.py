"""A store of model files as tables: a registry with sizes, digests and shapes, and the files in numbered chunks.

A file is cut into chunks, each with its own SHA-256 in the registry, so what is missing or damaged is known without putting
a file together, and only that has to be fetched again. A model is used only if all of it is there and right. A file is a
row when it is put together, so it has less than 2 GB; ranges of it are read from the chunks they touch."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from undertone.sources.work import work_folder

CHUNK = 1 << 20
NAME = ("name", "version")


def cut(blobs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """name, version, part, data: the files of blobs(name, version, data) in chunks; an empty file has one empty chunk."""
    last = F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / chunk).cast("int")
    parts = blobs.select(*NAME, "data", F.explode(F.sequence(F.lit(0), last)).alias("part"))
    return parts.select(*NAME, "part", F.substring("data", F.col("part") * chunk + 1, F.lit(chunk)).alias("data"))


def registry(blobs: DataFrame, chunk: int = CHUNK, shapes: Column | None = None) -> DataFrame:
    """name, version, size, sha256, the chunks' digests and shapes (a map of tensor names to sizes, null if not given)."""
    last = F.floor(F.greatest(F.octet_length("data") - 1, F.lit(0)) / chunk).cast("int")
    digests = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(F.substring(F.col("data"), i * chunk + 1, F.lit(chunk)), 256))
    return blobs.select(*NAME, F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"), digests.alias("digests"), (shapes if shapes is not None else F.lit(None).cast("map<string,array<int>>")).alias("shapes"))


def _judged(models: DataFrame, chunks: DataFrame) -> DataFrame:
    """A row for each chunk that a model should have, and whether it is there and right."""
    wanted = models.select(*NAME, F.posexplode("digests").alias("part", "digest"))
    there = chunks.groupBy(*NAME, "part").agg(F.collect_set(F.sha2("data", 256)).alias("held"))  # a chunk fetched twice may be there twice
    state = F.when(F.col("held").isNull(), "missing").when(F.array_contains("held", F.col("digest")), "right").otherwise("corrupt")
    return wanted.join(there, [*NAME, "part"], "left").select(*NAME, "part", "digest", state.alias("state"))


def inspected(models: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, version, status (ready, corrupt or missing) and the numbers of missing and corrupt chunks, in order."""
    of = lambda s: F.sort_array(F.collect_list(F.when(F.col("state") == s, F.col("part")))).alias(s)
    found = _judged(models, chunks).groupBy(*NAME).agg(of("missing"), of("corrupt"))
    return found.select(*NAME, F.when(F.size("corrupt") > 0, "corrupt").when(F.size("missing") > 0, "missing").otherwise("ready").alias("status"), "missing", "corrupt")


def to_fetch(models: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, version and part of the chunks that a fetch still has to bring."""
    return _judged(models, chunks).where("state != 'right'").select(*NAME, "part")


def assembled(models: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, version, data and shapes of the models that are whole: every chunk and the file have the registry's digests."""
    right = _judged(models, chunks).where("state = 'right'").drop("state")
    held = chunks.withColumn("digest", F.sha2("data", 256)).join(right, [*NAME, "part", "digest"], "left_semi").dropDuplicates([*NAME, "part"])
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("data").alias("data")))), lambda c: c["data"])
    whole = held.groupBy(*NAME).agg(F.unhex(F.array_join(ordered, "")).alias("data")).join(models, list(NAME))
    return whole.where((F.octet_length("data") == F.col("size")) & (F.sha2("data", 256) == F.col("sha256"))).select(*NAME, "data", "shapes")


def read_range(chunks: DataFrame, name: str, version: Any, start: int, length: int, chunk: int = CHUNK) -> bytes:
    """Bytes start..start + length of a file, from the chunks they lie in."""
    rows = chunks.where((F.col("name") == name) & (F.col("version") == version) & F.col("part").between(start // chunk, (start + length - 1) // chunk))
    parts = {r.part: bytes(r.data) for r in rows.select("part", "data").collect()}
    data = b"".join(parts[p] for p in sorted(parts))
    at = start - min(parts, default=0) * chunk
    return data[at : at + length]


# ---------------------------------------------------------------- models in tasks

_LOADED: dict[str, Any] = {}


def ship(spark: SparkSession, data: bytes, name: str = "model") -> str:
    """Sends a file to all executors, and returns the name by which tasks find it."""
    path = f"{work_folder(spark)}/{name}-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def loaded(name: str, load: Callable[[str], Any], count=None) -> Any:
    """The model in a shipped file, loaded once in a Python worker. count: an accumulator of loads."""
    if name not in _LOADED:
        _LOADED.clear()  # one model at a time
        _LOADED[name] = load(SparkFiles.get(name))
        if count is not None:
            count.add(1)
    return _LOADED[name]


def apply_model(df: DataFrame, name: str, load: Callable[[str], Any], run: Callable, outputs: tuple[str, ...], *, column: str = "mag", count=None) -> DataFrame:
    """Adds arrays made by run(model, frames) from an array column, a batch of frames at a time; frames in a batch have one length."""
    schema = df.select("*", *(F.array().cast("array<double>").alias(o) for o in outputs)).schema

    def batches_of(batches):
        for batch in batches:
            if batch.num_rows:
                found = run(loaded(name, load, count), np.array(batch.column(column).to_pylist(), float))
                found = found if isinstance(found, tuple) else (found,)
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(map(list, f)), pa.list_(pa.float64())) for f in found)], schema.names)

    return df.mapInArrow(batches_of, schema)
