"""Session helpers: the shared folder, tables that cut lineage, and column plumbing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; a temporary one only where none is set and
    the session runs on one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            path = held.get()
        elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            path = "file://" + tempfile.mkdtemp(prefix="shared-")
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Text in one piece of a batch; below 2^21, the size of the power tables that hashing keeps.
PIECE_BYTES = 2_000_000
#: Lets Spark delete a write's shuffle files when the write has ended, not when the driver next
#: happens to collect garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
READ_ROWS = "spark.sql.parquet.columnarReaderBatchSize"


def stored(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, a lost
    executor costs no recomputation, and the shuffle files behind it can go."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextmanager
def small_batches(spark: SparkSession, rows: int = 2_000, columnar: int | None = None):
    """Jobs inside hand texts to Python in smaller Arrow batches, so that less of them is held on both sides. columnar: rows that
    are read from Parquet at once, for tables of large rows."""
    wanted = {BATCH_ROWS: rows} | ({READ_ROWS: columnar} if columnar else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, n in wanted.items():
        spark.conf.set(k, str(min(n, int(before[k])) if int(before[k]) > 0 else n))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def discard(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """Deletes tables of `stored` that nothing reads any more, and returns df."""
    jvm = df.sparkSession._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for t in tables:
        if path := getattr(t, "_stored_at", None):
            path = jvm.org.apache.hadoop.fs.Path(path)
            path.getFileSystem(conf).delete(path, True)
    return df


def shared_file(spark: SparkSession, name: str, data: bytes) -> str:
    """Writes a file below the shared folder, through Spark's file systems, and returns its path."""
    path = f"{shared_dir(spark)}/files/{uuid.uuid4().hex}/{name}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of rows with at most about `most` bytes of text each, so that
    a task's memory does not depend on how many rows a batch holds. A longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64) + 1)
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + most, "right")))
            yield batch.slice(start, end - start)
            start = end
