"""Shared scratch storage: cut lineage with tables every executor can read.

A result that several later steps need is written once as Parquet below the
folder named by ``spark.checkpoint.dir`` and read back.  Losing an executor then
costs nothing but the tasks it ran.  The setting is read from the session; a
private temporary folder is used only in local mode when nothing is set.

Tables that only steps of one operator read are made inside ``temporary`` and deleted at its
end; what a returned frame still reads stays until ``clear`` or the end of the process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_local_base: str | None = None
_made: dict[str, SparkSession] = {}
_open: list[list[DataFrame]] = []


def scratch_base(spark: SparkSession) -> str:
    """The shared folder; raises on a cluster that names none."""
    global _local_base
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="vecstrata-")
    return _local_base


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_base(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to shared scratch and return a reader over the written rows."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    _made[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    if _open:
        _open[-1].append(out)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    _made.pop(path, None)


def discard(df: DataFrame) -> None:
    """Delete the files behind a materialized DataFrame that no later step reads."""
    path = getattr(df, "_scratch_path", None)
    if path in _made:
        _delete(df.sparkSession, path)


@contextlib.contextmanager
def temporary() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside are deleted at the end, but for those given to the function that it
    yields, which returns them."""
    kept: list[DataFrame] = []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    _open.append([])
    try:
        yield keep
    finally:
        for df in _open.pop():
            if not any(df is k for k in kept):
                discard(df)
            elif _open:
                _open[-1].append(df)


@atexit.register
def clear() -> None:
    """Delete every scratch table that this process made and has not deleted."""
    for path, spark in list(_made.items()):
        with contextlib.suppress(Exception):  # at the end of the process the session may be gone
            _delete(spark, path)
