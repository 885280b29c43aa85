import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecstrata.functions import attributes as attr
from vecstrata.functions import distance as d
from vecstrata.types import Metric, ValidationError


@pytest.mark.parametrize("metric", list(Metric))
def test_kernels_and_expressions_agree(spark, metric):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(20)] + [(20, [0.0] * 8)]
    q = rng.normal(size=8)
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {r.id: r.dist for r in df.select("id", d.distance(metric, F.col("v"), d.vector_literal(q)).alias("dist")).collect()}
    m = np.array([v for _, v in rows])
    for values in (d.one_to_many(metric, q, m), d.many_to_many(metric, q[None], m)[0], d.one_to_many(metric, np.tile(q, (21, 1)), m)):
        assert all(math.isclose(got[i], x, abs_tol=1e-9) for i, x in enumerate(values))


def test_values(spark):
    one = lambda name, a, b: spark.range(1).select(d.distance(name, d.vector_literal(a), d.vector_literal(b))).first()[0]
    assert one("euclidean_squared", [1, 2], [4, 6]) == 25
    assert one("dot_product", [1, 2], [3, 4]) == -11
    assert one("cosine_distance", [1, 0], [0, 1]) == 1 and one("cosine_distance", [2, 0], [5, 0]) == 0
    assert one("cosine_distance", [0, 0], [1, 1]) == 1 and one("cosine_distance", [1, 1], [0, 0]) == 1
    with pytest.raises(ValidationError):
        d.metric_of("manhattan")


def test_sql_functions(spark):
    d.register_sql(spark)
    row = spark.sql("SELECT euclidean_squared(array(1D, 2D), array(4D, 6D)) a, dot_product(array(1D, 2D), array(3D, 4D)) b, cosine_distance(array(0D), array(1D)) c").first()
    assert tuple(row) == (25.0, -11.0, 1.0)


def test_attributes(spark):
    text = '{"a": null, "b": true, "c": 7, "d": -7, "e": 1.5, "f": "x\\"y", "g": [1], "h": {"i": 1}, "j": 18446744073709551615, "k": 18446744073709551616, "l": 0}'
    df = spark.createDataFrame([(text,), ("[1]",), (None,), ("not json",)], "t string").select(attr.from_json("t").alias("m"))
    rows = [r.m for r in df.collect()]
    got = {k: (v.kind, v.b, v.u and int(v.u), v.f, v.s) for k, v in rows[0].items()}
    none = ("null", None, None, None, None)
    assert got["a"] == got["g"] == got["h"] == none
    assert got["b"] == ("bool", True, None, None, None) and got["c"] == ("u64", None, 7, None, None)
    assert got["d"] == ("f64", None, None, -7.0, None) and got["e"] == ("f64", None, None, 1.5, None)
    assert got["f"] == ("string", None, None, None, 'x"y') and got["j"][2] == 2**64 - 1
    assert got["k"][0] == "f64" and rows[0]["l"].kind == "u64"
    assert rows[1:] == [{}, {}, {}]
    back = json.loads(df.select(attr.to_json("m").alias("j")).first().j)
    assert back["b"] is True and back["c"] == 7 and back["f"] == 'x"y' and back["g"] is None and back["j"] == 2**64 - 1
    assert list(back) == sorted(back)
