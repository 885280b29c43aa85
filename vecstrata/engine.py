"""The engine: namespaces of documents, written to a log, queried by nearest neighbour.

Writes are synchronous batches: one call, one log entry, all or nothing.  A query reads the
newest index generation and what the log holds beyond its watermark, so it always sees every
write that returned before it.
"""

from __future__ import annotations

import json
import time
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import attributes as attr
from .functions.distance import metric_of
from .operators import exact, hybrid, index, replay
from .scratch import materialize
from .sources.store import Store
from .types import (
    ATTRIBUTES, DEFAULT_TOP_K, HEADS_SCHEMA, POSTINGS_SCHEMA, STATE_SCHEMA, VERSIONS_SCHEMA,
    AlreadyExists, DimensionMismatch, IndexConfig, Metric, NotFound, ValidationError, WriteConflict,
)


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    @staticmethod
    def health() -> str:
        return "ok"

    def create_namespace(self, name: str, distance_metric: str = Metric.COSINE) -> Namespace:
        if not name or "/" in name or name.startswith(("_", ".")):
            raise ValidationError(f"bad namespace name {name!r}")
        meta = {"name": name, "dimensions": None, "distance_metric": str(metric_of(distance_metric)), "created_at": int(time.time() * 1000)}
        try:
            self.store.create_meta(name, meta)
        except WriteConflict:
            raise AlreadyExists(f"namespace {name!r} already exists") from None
        return Namespace(self, name)

    def namespace(self, name: str) -> Namespace:
        self.store.read_meta(name)
        return Namespace(self, name)

    def delete_namespace(self, name: str) -> None:
        self.store.read_meta(name)
        self.store.delete_namespace(name)

    def list_namespaces(self) -> DataFrame:
        """name, dimensions, distance_metric, doc_count in the order of the names."""
        rows = []
        for name in self.store.namespaces():
            ns = Namespace(self, name)
            rows.append((name, ns.dimensions(), ns.meta()["distance_metric"], ns.doc_count()))
        return self.spark.createDataFrame(rows, "name string, dimensions int, distance_metric string, doc_count long").orderBy("name")


class Namespace:
    def __init__(self, engine: Engine, name: str):
        self.engine, self.spark, self.store, self.name = engine, engine.spark, engine.store, name

    def meta(self) -> dict:
        return self.store.read_meta(self.name)

    def dimensions(self) -> int | None:
        """As fixed by the first vector; read from the log if the metadata lost it."""
        held = self.meta()["dimensions"]
        if held is not None:
            return held
        first = self.log().where("vector IS NOT NULL").agg(F.min(F.struct("sequence", F.size("vector").alias("n"))).alias("f")).first().f
        return first.n if first else None

    # writes

    def _normalised(self, docs: DataFrame) -> DataFrame:
        """Rows (id, vector, attributes) from a frame whose attributes are a tagged map, JSON text, or missing."""
        types = dict(docs.dtypes)
        if "attributes" not in types:
            made = F.expr(f"CAST(map() AS {ATTRIBUTES})")
        elif types["attributes"] == "string":
            made = attr.from_json("attributes")
        else:
            made = F.coalesce(F.col("attributes").cast(ATTRIBUTES), F.expr(f"CAST(map() AS {ATTRIBUTES})"))
        vector = F.col("vector").cast("array<float>") if "vector" in types else F.lit(None).cast("array<float>")
        return docs.select(F.col("id").cast("long").alias("id"), vector.alias("vector"), made.alias("attributes"))

    def _append(self, rows: DataFrame, source: str | None = None) -> int | None:
        """Stage the rows, check what was staged, publish it; nothing is left of a refused call."""
        aside, staged = self.store.stage(self.name, rows.select("op_idx", "doc_idx", "op", "ts_ms", "id", "vector", "attributes"))
        size = F.when(F.col("vector").isNotNull(), F.size("vector"))
        least_id = F.min(F.coalesce("id", F.lit(-1))).alias("least_id")
        seen = staged.agg(F.count(F.lit(1)).alias("n"), F.min(size).alias("low"), F.max(size).alias("high"), least_id).first()
        held = self.dimensions() if seen.low is not None else None
        want = held if held is not None else seen.low
        wrong = next((s for s in (seen.low, seen.high) if s is not None and s != want), None)
        if not seen.n or seen.least_id < 0 or wrong is not None:
            self.store.drop_staged(self.name, aside)
            if not seen.n:
                return None
            if wrong is not None:
                raise DimensionMismatch(f"expected {want} dimensions, got {wrong}")
            raise ValidationError("ids must be integers from 0 to 2^63 - 1")
        sequence = self.store.publish(self.name, aside, source)
        if seen.low is not None:
            self._keep_dimensions()
        return sequence

    def write(self, operations: list[tuple[str, DataFrame]], source: str | None = None) -> int | None:
        """Several operations, ('upsert', documents) or ('delete', ids), as one log entry, in
        order.  A ``source`` names the write: the log takes each name once."""
        self.meta()
        parts = None
        for k, (op, df) in enumerate(operations):
            if op == "upsert":
                rows = self._normalised(df)
            else:
                rows = df.select(F.col("id").cast("long").alias("id"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast(ATTRIBUTES).alias("attributes"))
            place = (F.lit(k).alias("op_idx"), F.monotonically_increasing_id().alias("doc_idx"))
            rows = rows.select(*place, F.lit(op).alias("op"), F.lit(int(time.time() * 1000)).alias("ts_ms"), "id", "vector", "attributes")
            parts = rows if parts is None else parts.unionByName(rows)
        return self._append(parts, source) if parts is not None else None

    def upsert(self, docs: DataFrame) -> int | None:
        """The sequence written; None for no rows."""
        return self.write([("upsert", docs)])

    def delete(self, ids) -> int | None:
        """Delete ids (a list, or a frame with ``id``); unknown ones are accepted."""
        if not isinstance(ids, DataFrame):
            ids = list(ids)
            if not ids:
                self.meta()
                return None
            ids = self.spark.createDataFrame([(int(i),) for i in ids], "id long")
        return self.write([("delete", ids)])

    # state

    def log(self, after: int = 0, up_to: int | None = None) -> DataFrame:
        return self.store.log(self.name, after, up_to)

    def last_sequence(self) -> int:
        return self.store.last_sequence(self.name)

    def _index(self) -> dict | None:
        manifest = self.store.manifest(self.name)
        if manifest is None:
            return None
        read = lambda name, schema: self.store.read_table(self.name, manifest["gen"], name, schema)
        schemas = {"heads": HEADS_SCHEMA, "postings": f"{POSTINGS_SCHEMA}, part INT", "versions": VERSIONS_SCHEMA, "docs": STATE_SCHEMA}
        return manifest | {name: read(name, schema) for name, schema in schemas.items()}

    def documents(self) -> DataFrame:
        """The live documents: id, vector, attributes, last_seq."""
        held = self._index()
        if held is None:
            return replay.latest_documents(self.store.log(self.name))
        if self.last_sequence() <= held["wal_sequence"]:
            return held["docs"]
        return replay.overlay(held["docs"], replay.latest_ops(self.log(held["wal_sequence"])))

    def get(self, id: int):
        """The document's row; NotFound without it.  Filters reach every scan."""
        held, mine = self._index(), F.col("id") == id
        row = replay.latest_ops(self.log(held["wal_sequence"] if held else 0).where(mine)).first()
        if row is None and held:
            row = held["docs"].where(mine).first()
        elif row is not None and row.op == "delete":
            row = None
        if row is None:
            raise NotFound(f"document {id} not found")
        return row

    def doc_count(self) -> int:
        return self.documents().count()

    # queries

    def query(
        self, vector, top_k: int = DEFAULT_TOP_K, distance_metric: str | None = None, include_vectors: bool = False,
        num_search_heads: int | None = None, where=None,
    ) -> DataFrame:
        """The top_k nearest documents of one vector: id, dist, rank, attributes [, vector]."""
        found = self.query_batch(hybrid.queries_of(self.spark, [vector]), top_k, distance_metric, include_vectors, num_search_heads, where)
        return found.drop("qid").orderBy("rank")

    def query_batch(
        self, queries: DataFrame, top_k: int = DEFAULT_TOP_K, distance_metric: str | None = None, include_vectors: bool = False,
        num_search_heads: int | None = None, where=None,
    ) -> DataFrame:
        """The top_k nearest documents of every (qid, vector) row, among those that fulfil
        ``where`` (a Column or SQL over id and attributes), if given."""
        dims, metric = self.dimensions(), str(metric_of(distance_metric or self.meta()["distance_metric"]))
        if dims is not None:
            other = queries.where(F.size("vector") != dims).select(F.size("vector")).first()
            if other:
                raise DimensionMismatch(f"expected {dims} dimensions, got {other[0]}")
        held, last = self._index(), self.last_sequence()
        since, tail_ops = held["wal_sequence"] if held else 0, None
        allowed = self.documents().where(where).select("id") if where is not None else None
        if held is None:
            hits = hybrid.hybrid_knn(queries, top_k, metric, documents=self.documents(), allowed=allowed)
        else:
            config = replace(self._config(held), **({"num_search_heads": num_search_heads} if num_search_heads else {}))
            tail_ops = replay.latest_ops(self.log(since)) if last > since else None
            hits = hybrid.hybrid_knn(queries, top_k, metric, index=held, tail_ops=tail_ops, config=config, allowed=allowed)
        # queries x k rows: written once, so that only their documents are read and folded
        hits = materialize(hits, "hits")
        mine = lambda df: df.join(hits.select("id").distinct(), "id", "left_semi")
        if held is None:
            found = replay.latest_documents(mine(self.log()))
        else:
            found = mine(held["docs"]) if tail_ops is None else replay.overlay(mine(held["docs"]), replay.latest_ops(mine(self.log(since))))
        return hybrid.hydrate(hits, found, include_vectors)

    # index

    @staticmethod
    def _config(manifest: dict) -> IndexConfig:
        return IndexConfig(**manifest["config"])

    def indexed_count(self) -> int:
        held = self.store.manifest(self.name)
        return held["num_vectors"] if held else 0

    def build_index(self, config: IndexConfig | None = None, up_to: int | None = None) -> dict | None:
        """Index the log up to ``up_to`` (all of it): from nothing, or on top of the newest
        generation.  None if there is nothing new.  The manifest is written last."""
        held = self._index()
        last = min(self.last_sequence(), up_to) if up_to is not None else self.last_sequence()
        since = held["wal_sequence"] if held else 0
        if last <= since:
            return None
        if self.dimensions() is None:
            raise ValidationError(f"namespace {self.name!r} has no vectors")
        config = config or (self._config(held) if held else IndexConfig(metric=self.meta()["distance_metric"]))
        gen = (held["gen"] if held else 0) + 1
        fresh = materialize(replay.latest_ops(self.log(since, last)), "tail")
        if held is None:
            docs = fresh.where("op = 'upsert'").select("id", "vector", "attributes", F.col("sequence").alias("last_seq"))
            rows = docs.where("vector IS NOT NULL").select(F.col("id").alias("vector_id"), "vector")
            heads = materialize(index.build_heads(rows, config), "heads")
            versions = rows.select("vector_id", F.lit(1).cast("long").alias("version"), F.lit(False).alias("deleted"))
            postings = materialize(index.place(rows.withColumn("version", F.lit(1).cast("long")), heads, config), "postings")
        else:
            docs = replay.overlay(held["docs"], fresh)
            changed = fresh.select(F.col("id").alias("vector_id"), "vector", (F.col("op").eqNullSafe("delete") | F.col("vector").isNull()).alias("gone"))
            both = held["versions"].join(changed, "vector_id", "full_outer")
            version = F.when(F.col("gone").isNull(), F.col("version")).otherwise(F.coalesce("version", F.lit(0)) + 1)
            versions = materialize(both.select("vector_id", version.alias("version"), F.coalesce("gone", "deleted").alias("deleted")), "versions")
            added = changed.where("NOT gone").join(versions.select("vector_id", "version"), "vector_id").select("vector_id", "version", "vector")
            postings = materialize(held["postings"].drop("part").unionByName(index.place(added, held["heads"], config)), "postings")
            heads = held["heads"]
        versions = materialize(versions, "versions")
        for _ in range(config.max_split_depth):
            sizes = index.live(postings, versions).groupBy("head_id").count().where(F.col("count") > config.max_posting_size)
            if sizes.isEmpty():
                break
            before = heads.count()
            heads, postings, versions = index.split_oversized(heads, postings, versions, config)
            if heads.count() == before:
                break
        return self._persist(gen, last, config, heads, index.live(postings, versions), versions, docs)

    def _persist(self, gen: int, last: int, config: IndexConfig, heads: DataFrame, postings: DataFrame, versions: DataFrame, docs: DataFrame) -> dict:
        """Postings, heads, versions and documents of a generation, then its manifest."""
        if gen in self.store.generations(self.name):
            raise WriteConflict(f"generation {gen} exists")
        postings = materialize(postings.select("head_id", "vector_id", "version", "vector"), "live-postings")
        parts = index.part_count(postings)
        laid = postings.withColumn("part", F.pmod("head_id", F.lit(parts)).cast("int")).repartition("part").sortWithinPartitions("part", "head_id")
        self.store.write_table(self.name, gen, "postings", laid, "part")
        self.store.write_table(self.name, gen, "heads", heads)
        self.store.write_table(self.name, gen, "versions", versions)
        self.store.write_table(self.name, gen, "docs", docs)
        read = lambda name, schema: self.store.read_table(self.name, gen, name, schema)
        manifest = {
            "version": 1, "wal_sequence": last, "config": asdict(config), "parts": parts, "active_centroids": read("heads", HEADS_SCHEMA).where("active").count(),
            "num_vectors": read("versions", VERSIONS_SCHEMA).where("NOT deleted").count(), "created_at": int(time.time() * 1000),
        }
        self.store.commit_manifest(self.name, gen, json.loads(json.dumps(manifest)))
        return manifest | {"gen": gen}

    def shadow_recall(self, queries: DataFrame, k: int = DEFAULT_TOP_K, num_search_heads: int | None = None) -> float:
        """Recall at k of the index against an exact scan of the same state."""
        truth = hybrid.hybrid_knn(queries, k, self.meta()["distance_metric"], documents=self.documents())
        return exact.recall_at_k(truth, self.query_batch(queries, k, num_search_heads=num_search_heads), k).first().recall or 0.0

    def compact(self) -> int:
        """Delete the log entries that the newest generation holds; how many went.  Later
        entries count on from the manifest's watermark."""
        manifest = self.store.manifest(self.name)
        if not manifest:
            return 0
        self._keep_dimensions()
        return self.store.drop_entries(self.name, manifest["wal_sequence"])

    def _keep_dimensions(self) -> None:
        """Write dimensions that only the log knows into the metadata."""
        meta, dims = self.meta(), self.dimensions()
        if meta["dimensions"] is None and dims is not None:
            try:
                self.store.write_meta(self.name, meta | {"dimensions": dims})
            except WriteConflict:  # another writer noted them: the first entry's, as here
                pass

    def check_index(self) -> dict[str, int]:
        held = self._index()
        return index.invariants(held["heads"], held["postings"], held["versions"], self._config(held)) if held else {}
