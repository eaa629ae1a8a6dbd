"""Queries over the model store, and models run over frames."""

from __future__ import annotations

import io

import numpy as np
from pyspark.sql import functions as F

from undertone.operators import frames as O
from undertone.plans.registry import query
from undertone.plans.spectra import S, mags, values
from undertone.sources import models as M
from undertone.sources.tables import table

_CHUNK = 512
_PARTS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, greatest(0, (strlen(coalesce(text, '')) - 1) // {_CHUNK}) AS last FROM documents),
p AS (SELECT doc_id, unnest(range(last + 1)) AS part FROM d), j AS (SELECT doc_id, part, (doc_id + part) % 61 = 0 AS gone, (doc_id + part) % 61 = 7 AS bad FROM p)"""


def _store(spark, d):
    """Documents as files; some chunks are lost and some are damaged."""
    blobs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("name"), F.lit(1).alias("version"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    turn = (F.col("name").cast("bigint") + F.col("part")) % 61
    chunks = M.cut(blobs, _CHUNK).where(turn != 0)
    return M.registry(blobs, _CHUNK), chunks.withColumn("data", F.when(turn == 7, F.concat("data", F.lit(b"!"))).otherwise(F.col("data")))


@query("model_chunks", _PARTS + " SELECT doc_id, CASE WHEN bool_or(bad) THEN 'corrupt' WHEN bool_or(gone) THEN 'missing' ELSE 'ready' END AS status, coalesce(string_agg(part, ',' ORDER BY part) FILTER (gone), '') AS missing, coalesce(string_agg(part, ',' ORDER BY part) FILTER (bad), '') AS corrupt FROM j GROUP BY doc_id")
def model_chunks(spark, d):
    found = M.inspected(*_store(spark, d))
    lists = [F.array_join(F.transform(c, lambda p: p.cast("string")), ",").alias(c) for c in ("missing", "corrupt")]
    return found.select(F.col("name").cast("bigint").alias("doc_id"), "status", *lists)


@query("model_files", _PARTS + " SELECT doc_id, strlen(t) AS size, sha256(t) AS sha256 FROM d WHERE doc_id NOT IN (SELECT doc_id FROM j WHERE gone OR bad)")
def model_files(spark, d):
    """The files that are whole, put together again."""
    return M.assembled(*_store(spark, d)).select(F.col("name").cast("bigint").alias("doc_id"), F.octet_length("data").cast("bigint").alias("size"), F.sha2("data", 256).alias("sha256"))


def load_weights(path: str) -> np.ndarray:
    with open(path, "rb") as f:
        return np.load(io.BytesIO(f.read()))


def soft_mask(weights: np.ndarray, mag: np.ndarray) -> np.ndarray:
    return mag / (mag + weights + 1e-10)


@query("model_masks", S + ", n AS (SELECT k, avg(m) AS n FROM m GROUP BY k) SELECT signal_id, f, k, round(m / (m + n + 1e-10), 5) AS y FROM m JOIN n USING (k)")
def model_masks(spark, d):
    """A model of one number for each bin (its mean over all frames) goes through the store, is shipped, and masks the frames."""
    m = mags(spark, d)
    means = [r.n for r in O.bins(m).groupBy("k").agg(F.avg("m").alias("n")).orderBy("k").collect()]
    data = io.BytesIO()
    np.save(data, np.array(means))
    blobs = spark.createDataFrame([("mask", 1, bytearray(data.getvalue()))], "name string, version int, data binary")
    whole = M.assembled(M.registry(blobs, 64), M.cut(blobs, 64)).first()
    return values(M.apply_model(m, M.ship(spark, bytes(whole.data)), load_weights, soft_mask, ("mask",)), "mask", 5)
