"""The log folded to its latest state, and its tail."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDER = ("sequence", "op_idx", "doc_idx")


def latest_ops(log: DataFrame) -> DataFrame:
    """The last operation on each id in (sequence, op, document) order.

    A grouped maximum: it combines on the map side, so an id that is written over and over
    is reduced before the shuffle."""
    last = log.groupBy("id").agg(F.max_by(F.struct(*(c for c in log.columns if c != "id")), F.struct(*ORDER)).alias("r"))
    return last.select("id", "r.*")


def latest_documents(log: DataFrame) -> DataFrame:
    """The live documents: ids whose last operation is an upsert, with ``last_seq``."""
    kept = [c for c in log.columns if c not in (*ORDER, "op", "ts_ms")]
    return latest_ops(log).where("op = 'upsert'").select(*kept, F.col("sequence").alias("last_seq"))


def tail(log: DataFrame, watermark: int) -> DataFrame:
    """What was written after the watermark; partitions up to it are not read."""
    return log.where(F.col("sequence") > watermark)


def overlay(base: DataFrame, newer_ops: DataFrame) -> DataFrame:
    """A snapshot with later operations applied to it (the latest of each id)."""
    cols = base.columns
    fresh = newer_ops.where("op = 'upsert'").withColumn("last_seq", F.col("sequence")).select(*cols)
    return base.join(newer_ops.select("id"), "id", "left_anti").select(*cols).unionByName(fresh)
