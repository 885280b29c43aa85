from pyspark.sql import functions as F

from vecstrata.llm import common


def test_about_holds_the_smallest_keys(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"))
    key = F.xxhash64("doc_id", F.lit(3))
    near = common.about(rows, key, 500)
    assert 1500 < near.count() < 2500
    assert near.orderBy(key).limit(500).collect() == rows.orderBy(key).limit(500).collect()
    assert common.about(rows.limit(900), key, 500).count() == 900


def test_the_session_keeps_its_batch_size(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    common.written(spark.range(3).toDF("id"), "few")
    with common.small_batches(spark):
        assert int(spark.conf.get(name).rstrip("b")) == common.BATCH_BYTES
    assert spark.conf.get(name) == before


def test_callers_columns_under_other_names(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, c0 string, `x.y` int")
    own = common.Carried(docs)
    assert own.frame.columns == ["c0", "c1", "c2"] and own["c0"] == "c1" and "x.y" in own and "z" not in own
    assert own.back(own.frame.withColumn("more", F.lit(1))).collect() == docs.collect()
