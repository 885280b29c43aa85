import io
import json
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata import __main__ as cli
from vecstrata.engine import Engine
from vecstrata.operators import exact
from vecstrata.sources.synthetic import synthetic_documents
from vecstrata.sources.store import Store
from vecstrata.streaming.ingest import index_available, ingest
from vecstrata.types import WAL_SCHEMA, AlreadyExists, DimensionMismatch, IndexConfig, NotFound, ValidationError, WriteConflict


@pytest.fixture
def engine(spark, tmp_path):
    return Engine(spark, str(tmp_path / "store"))


def docs(spark, rows):
    return spark.createDataFrame(rows, "id long, vector array<float>, attributes string")


def test_namespaces(engine):
    assert engine.health() == "ok"
    engine.create_namespace("b", "dot_product")
    engine.create_namespace("a")
    assert [(r.name, r.dimensions, r.distance_metric, r.doc_count) for r in engine.list_namespaces().collect()] == [("a", None, "cosine_distance", 0), ("b", None, "dot_product", 0)]
    with pytest.raises(AlreadyExists) as e:
        engine.create_namespace("a")
    assert e.value.status == 409 and "error" in e.value.body()
    engine.delete_namespace("a")
    for call in (lambda: engine.delete_namespace("a"), lambda: engine.namespace("a")):
        with pytest.raises(NotFound) as e:
            call()
        assert e.value.status == 404
    with pytest.raises(ValidationError):
        engine.create_namespace("x", "manhattan")


def test_writes_and_queries(spark, engine):
    ns = engine.create_namespace("n", "euclidean_squared")
    assert ns.query([1.0, 2.0]).count() == 0
    assert ns.upsert(docs(spark, []).limit(0)) is None and ns.delete([]) is None
    assert ns.upsert(docs(spark, [(1, [1.0, 0.0], '{"a": 1}'), (2, [0.0, 1.0], None), (3, None, '{"only": "text"}')])) == 1
    assert ns.dimensions() == 2 and ns.doc_count() == 3
    assert [r.id for r in ns.query([1.0, 0.0]).collect()] == [1, 2]
    assert ns.query([1.0, 0.0], top_k=0).count() == 0
    row = ns.query([1.0, 0.0], 1, include_vectors=True).first()
    assert row.vector == [1.0, 0.0] and int(row.attributes["a"].u) == 1 and "vector" not in ns.query([1.0, 0.0], 1).columns
    assert ns.get(3).attributes["only"].s == "text"
    with pytest.raises(DimensionMismatch) as e:
        ns.upsert(docs(spark, [(5, [1.0, 0.0], None), (6, [1.0], None)]))
    assert e.value.status == 400 and ns.doc_count() == 3
    with pytest.raises(DimensionMismatch):
        ns.query([1.0])
    with pytest.raises(ValidationError):
        ns.upsert(docs(spark, [(-1, None, None)]))
    assert ns.delete([1, 99]) == 2
    with pytest.raises(NotFound):
        ns.get(1)
    ns.upsert(docs(spark, [(1, [5.0, 5.0], None), (1, [0.9, 0.0], None)]))  # the later one counts
    assert np.allclose(ns.get(1).vector, [0.9, 0.0])
    ns.write([("delete", spark.createDataFrame([(2,)], "id long")), ("upsert", docs(spark, [(2, [7.0, 7.0], None)]))])
    assert ns.get(2).vector == [7.0, 7.0]


def test_failed_first_batch_sets_no_dimensions(spark, engine):
    ns = engine.create_namespace("n")
    with pytest.raises(DimensionMismatch):
        ns.upsert(docs(spark, [(1, [1.0], None), (2, [1.0, 2.0], None)]))
    assert ns.dimensions() is None and ns.last_sequence() == 0
    with pytest.raises(ValidationError):
        ns.upsert(docs(spark, [(1, None, None)])) and ns.build_index()


def test_sequences_and_manifests_are_exclusive(spark, engine):
    ns = engine.create_namespace("n")
    ns.upsert(docs(spark, [(1, [1.0], None)]))
    with pytest.raises(WriteConflict):
        ns.store.files.create("", "n", "wal", "entries", f"{1:020d}.json")
    assert ns.upsert(docs(spark, [(2, [1.0], None)])) == 2
    assert ns.store.sequences("n") == [1, 2] and ns.store.entry("n", 3) is None and ns.store.entry("n", 2).count() == 1
    ns.build_index()
    with pytest.raises(WriteConflict):
        ns.store.commit_manifest("n", 1, {})


def staged(spark, ns, id):
    rows = spark.createDataFrame([(0, 0, "upsert", 0, id, [float(id)], {})], f"{WAL_SCHEMA}")
    return ns.store.stage(ns.name, rows)[0]


def test_a_slow_writer_loses_nothing(spark, engine):
    """A begins to write, B publishes and the index is built, then A publishes."""
    ns = engine.create_namespace("n", "euclidean_squared")
    ns.upsert(docs(spark, [(1, [1.0], None)]))
    slow, dead = staged(spark, ns, 2), staged(spark, ns, 9)
    ns.upsert(docs(spark, [(3, [3.0], None)]))
    ns.build_index()
    assert ns.store.manifest("n")["wal_sequence"] == 2
    assert ns.store.publish("n", slow) == 3
    assert sorted(r.id for r in ns.documents().collect()) == [1, 2, 3]
    ns.build_index()
    assert sorted(r.id for r in ns.documents().collect()) == [1, 2, 3] and dead not in str(ns.store.entries("n"))


def test_writers_at_once_get_numbers_of_their_own(spark, engine):
    ns = engine.create_namespace("n", "euclidean_squared")
    batches = [staged(spark, ns, k) for k in range(12)]
    with ThreadPoolExecutor(6) as pool:
        got = list(pool.map(lambda b: Engine(spark, engine.store.files.root).namespace("n").store.publish("n", b), batches))
    assert sorted(got) == list(range(1, 13)) and ns.doc_count() == 12


def test_metadata_versions(engine):
    ns = engine.create_namespace("n")
    engine.store.write_meta("n", ns.meta() | {"dimensions": 3})
    engine.store.write_meta("n", ns.meta() | {"dimensions": 4})
    assert ns.meta()["dimensions"] == 4 and engine.store.namespaces() == ["n"]


def test_index_lifecycle(spark, engine):
    ns = engine.create_namespace("n", "euclidean_squared")
    rows = synthetic_documents(spark, 600, 16, seed=1)
    ns.upsert(rows)
    config = IndexConfig(max_posting_size=50, replica_count=3, num_search_heads=10**6)
    first = ns.build_index(config)
    assert first["num_vectors"] == 600 and first["wal_sequence"] == 1 and ns.build_index() is None
    assert first["active_centroids"] >= 12
    more = synthetic_documents(spark, 150, 16, seed=2).withColumn("id", F.col("id") + 550)
    ns.upsert(more)  # updates 550-599, adds 600-699
    ns.delete(list(range(0, 40)))
    ns.upsert(docs(spark, [(100, None, None)]))
    queries = synthetic_documents(spark, 12, 16, seed=3).select(F.col("id").alias("qid"), "vector")

    def same():
        want = exact.knn_batch(ns.documents().where("vector IS NOT NULL"), queries, 10)
        got = ns.query_batch(queries, 10).select("qid", "id", "dist", "rank")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))

    same()
    with pytest.raises(NotFound):
        ns.get(3)
    assert ns.get(100).vector is None and ns.get(120).id == 120
    second = ns.build_index()
    assert second["gen"] == 2 and second["num_vectors"] == 700 - 40 - 1 and ns.indexed_count() == second["num_vectors"]
    same()
    checked = ns.check_index()
    assert checked["uncovered"] == checked["future"] == checked["headless"] == 0
    assert ns.doc_count() == 660
    assert ns.shadow_recall(queries, 10) == 1.0
    assert ns.compact() == 4 and ns.compact() == 0 and ns.doc_count() == 660 and ns.last_sequence() == 4
    same()
    assert ns.delete([650]) == 5 and ns.doc_count() == 659
    same()
    near = ns.query_batch(queries, 10, num_search_heads=8)
    assert exact.recall_at_k(exact.knn_batch(ns.documents().where("vector IS NOT NULL"), queries, 10), near, 10).first().recall > 0.5
    engine.delete_namespace("n")
    again = engine.create_namespace("n")
    assert again.upsert(docs(spark, [(1, [1.0], None)])) == 1 and again.doc_count() == 1


def test_filtered_queries(spark, engine):
    ns = engine.create_namespace("n", "euclidean_squared")
    rows = spark.range(60).selectExpr("id", "array(CAST(id AS FLOAT), 0F) AS vector", "to_json(named_struct('color', IF(id % 3 = 0, 'red', 'blue'), 'n', id)) AS attributes")
    ns.upsert(rows.where("id < 40"))
    red = "attributes['color'].s = 'red' AND attributes['n'].u >= 6"
    want = lambda: [r.id for r in ns.query([0.0, 0.0], 4, where=red, num_search_heads=1000).collect()]
    assert want() == [6, 9, 12, 15]
    ns.build_index(IndexConfig(max_posting_size=8, num_search_heads=1000, replica_count=1))
    assert want() == [6, 9, 12, 15]
    ns.upsert(rows.where("id >= 40"))
    ns.upsert(rows.where("id = 12").selectExpr("id", "vector", "'{\"color\": \"blue\", \"n\": 12}' AS attributes"))
    ns.delete([6])
    assert want() == [9, 15, 18, 21]
    assert ns.query([0.0, 0.0], 3, where="id >= 50").count() == 3 and ns.query([0.0, 0.0], 3, where="id > 99").count() == 0


def test_streams(spark, engine, tmp_path):
    ns = engine.create_namespace("n", "euclidean_squared")
    for part in range(3):
        synthetic_documents(spark, 40, 8, seed=part).withColumn("id", F.col("id") + 40 * part).select("id", "vector").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vector array<float>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest(stream, ns, str(tmp_path / "c1"), once=True).awaitTermination()
    assert ns.last_sequence() == 3 and ns.doc_count() == 120
    ingest(stream, ns, str(tmp_path / "c1"), once=True).awaitTermination()
    ingest(stream, ns, str(tmp_path / "c2"), once=True).awaitTermination()  # lost checkpoint: the same batches again
    assert ns.last_sequence() == 3
    index_available(ns, str(tmp_path / "c3")).awaitTermination()
    assert ns.indexed_count() == 120 and ns.store.manifest("n")["wal_sequence"] == 3
    ops = spark.createDataFrame([("upsert", 500, [0.0] * 8), ("delete", 1, None)], "op string, id long, vector array<float>")
    ops.coalesce(1).write.parquet(str(tmp_path / "ops"))
    changes = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))
    ingest(changes, ns, str(tmp_path / "c4"), name="changes", once=True).awaitTermination()
    assert ns.doc_count() == 120 and ns.get(500).id == 500
    index_available(ns, str(tmp_path / "c3")).awaitTermination()
    assert ns.store.manifest("n")["wal_sequence"] == 4
    assert ns.compact() == 4
    ingest(changes, ns, str(tmp_path / "c5"), name="changes", once=True).awaitTermination()  # compacted, and still written once
    assert ns.last_sequence() == 4


def test_a_batch_replayed_after_a_crash_is_written_once(spark, engine, tmp_path, monkeypatch):
    """The process dies right after the entry is published; another write follows; replay."""
    ns = engine.create_namespace("n", "euclidean_squared")
    spark.createDataFrame([(1, [1.0])], "id long, vector array<float>").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, vector array<float>").parquet(str(tmp_path / "in"))
    publish = Store.publish

    def dying(self, *args):
        publish(self, *args)
        raise RuntimeError("lost")

    monkeypatch.setattr(Store, "publish", dying)
    with pytest.raises(Exception, match="lost"):
        ingest(stream, ns, str(tmp_path / "c"), once=True).awaitTermination()
    monkeypatch.setattr(Store, "publish", publish)
    ns.upsert(docs(spark, [(1, [5.0], None)]))
    ingest(stream, ns, str(tmp_path / "c"), once=True).awaitTermination()
    assert ns.last_sequence() == 2 and ns.get(1).vector == [5.0]


def test_command_line(spark, tmp_path):
    def run(*args):
        out = io.StringIO()
        code = cli.run(spark, cli.parser().parse_args(["--root", str(tmp_path / "s"), *args]), out)
        return code, [json.loads(x) for x in out.getvalue().splitlines()]

    assert run("create-ns", "n", "--metric", "dot_product") == (0, [{"created": "n"}])
    assert run("create-ns", "n")[1][0]["status"] == 409
    assert run("generate", "n", "--count", "30", "--dims", "4", "--batch-size", "10") == (0, [{"sequence": 1}])
    assert run("list-ns")[1] == [{"name": "n", "dimensions": 4, "distance_metric": "dot_product", "doc_count": 30}]
    assert run("index", "n", "--max-posting-size", "8")[1][0]["num_vectors"] == 30
    assert run("index", "n")[1] == [{"indexed": "nothing new"}]
    assert len(run("query", "n", "--vector", "[1, 0, 0, 0]", "--top-k", "3", "--include-vectors")[1]) == 3 and len(run("query", "n")[1]) == 10
    assert run("get", "n", "29")[1][0]["attributes"]["batch"]["u"] == "2"
    assert run("get", "n", "77")[0] == 1 and run("delete-ns", "n")[0] == 0
