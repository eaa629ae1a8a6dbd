"""The SQL surface: table functions and scalar functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="f bigint, frame array<double>")
class FramesOf:
    """frames_of(samples, size, hop): the full frames of an array."""

    def eval(self, samples: list, size: int, hop: int):
        for f in range((len(samples) - size) // hop + 1 if len(samples) >= size else 0):
            yield f, [float(v) for v in samples[f * hop : f * hop + size]]


#: Scalar functions as SQL expressions, so that calls are inlined into the plan.
SCALARS = {
    "db": ("x DOUBLE", "DOUBLE", "CASE WHEN x > 0 THEN 20 * log10(x) ELSE -96.0D END"),
    "from_db": ("d DOUBLE", "DOUBLE", "power(10.0D, d / 20)"),
    "hz_to_mel": ("hz DOUBLE", "DOUBLE", "2595 * log10(1 + hz / 700)"),
    "hz_to_erb": ("hz DOUBLE", "DOUBLE", "21.4 * log10(1 + 0.00437 * hz)"),
    "slug": ("s STRING", "STRING", "regexp_replace(lower(s), '[^a-z0-9]', '-')"),
}


def register(spark: SparkSession) -> None:
    spark.udtf.register("frames_of", FramesOf)
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
