"""Helpers shared by the text operators.

Every operator selects the columns it needs by name and casts them, or carries the
caller's columns under names of its own (``Carried``), so further columns of the input,
whatever their names, never clash with its own.  A null text counts as empty unless the
operator says otherwise; a null doc_id is carried along.  Texts are always read whole; a
text longer than ``SLICE_BYTES`` is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import materialize

#: Text bytes handled at once by a Python worker; a longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: Bytes of an Arrow batch on its way to or from a Python worker.
BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While it lasts, Arrow batches to Python hold ``BATCH_BYTES`` at most; afterwards the
    caller's setting is back."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name)
    digits = held.rstrip("b")
    if digits.isdigit() and int(digits) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(name, held)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to shared scratch by small batches, and a reader of its rows."""
    with small_batches(df.sparkSession):
        return materialize(df, name)


class Carried:
    """The caller's columns under names of their own (c0, c1, ...) while an operator works,
    so that no column the operator adds can clash with one of them."""

    def __init__(self, docs: DataFrame):
        self.names = docs.columns
        self.frame = docs.toDF(*(f"c{i}" for i in range(len(self.names))))

    def __contains__(self, name: str) -> bool:
        return name in self.names

    def __getitem__(self, name: str) -> str:
        return f"c{self.names.index(name)}"

    def back(self, df: DataFrame) -> DataFrame:
        """The caller's columns of ``df`` under their old names, in their order."""
        return df.select(*(F.col(f"c{i}").alias(name) for i, name in enumerate(self.names)))


def doc_text(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``limit`` bytes of text."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
        block = np.cumsum(size) // limit
        cuts = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), n]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)


def map_texts(docs: DataFrame, work: Callable[[list, list], dict], schema: str, text: str = "text") -> DataFrame:
    """Apply ``work(doc_ids, texts) -> columns`` to slices of (doc_id, text), in one Arrow pass."""
    names = [part.split()[0] for part in schema.split(",")]

    def run(batches):
        for part in slices(batches):
            made = work(part.column("doc_id").to_pylist(), part.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict({k: made[k] for k in names}, schema=arrow)

    arrow = arrow_schema(schema)
    return doc_text(docs, text).mapInArrow(run, schema)


def about(rows: DataFrame, key: Column, most: int) -> DataFrame:
    """The rows with the smallest hash ``key``, a little more than twice ``most`` of them if
    there are as many: what a choice of ``most`` by this key is made from, or each partition
    would send as many to the driver."""
    n = rows.count()
    return rows if n <= 2 * most + 1000 else rows.where(key < int((1 << 64) * (2 * most + 1000) / n) - (1 << 63))


_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
    "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()), "array<string>": pa.list_(pa.string()),
}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(p.split()[0], _KINDS[p.split()[1]]) for p in schema.split(",")])


def sliced(docs: DataFrame, text: str, limit: int) -> DataFrame:
    """(slice_id, doc_ids, lens, data): documents by the slice of about ``limit`` bytes, in the
    order of doc_id (nulls last, equal ones as they were read), their texts end to end."""
    schema = "slice_id long,doc_ids array<long>,lens array<long>,data binary"

    def run(batches):
        task, n = TaskContext.get().partitionId() << 32, 0
        for part in slices(batches, limit=limit):
            part = part.take(pc.sort_indices(part, [("doc_id", "ascending")]))  # stable, nulls last
            data = [(t or "").encode() for t in part.column("text").to_pylist()]
            row = {"slice_id": [task + n], "doc_ids": [part.column("doc_id").to_pylist()], "lens": [[len(d) for d in data]], "data": [b"".join(data)]}
            yield pa.RecordBatch.from_pydict(row, schema=arrow_schema(schema))
            n += 1

    return doc_text(docs, text).mapInArrow(run, schema)
