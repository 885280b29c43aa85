"""Synthetic documents: seeded uniform vectors in [-1, 1), normalised, with a batch attribute."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import tagged


def synthetic_documents(spark: SparkSession, n: int, dims: int, batch_size: int = 100, seed: int = 42) -> DataFrame:
    """id, vector, attributes {"batch": id / batch_size}; the same for a seed wherever it runs."""
    part = lambda k: F.pmod(F.xxhash64("id", F.lit(k), F.lit(seed)), F.lit(1 << 24)) / float(1 << 23) - 1
    raw = F.array(*(part(k) for k in range(dims)))
    norm = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda a, x: a + x * x))
    rows = spark.range(n).withColumn("raw", raw).withColumn("norm", norm)
    vector = F.when(F.col("norm") == 0, F.col("raw")).otherwise(F.transform("raw", lambda x: x / F.col("norm"))).cast("array<float>")
    return rows.select("id", vector.alias("vector"), F.create_map(F.lit("batch"), tagged("u64", F.floor(F.col("id") / batch_size))).alias("attributes"))
