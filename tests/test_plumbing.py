import pytest
from pyspark.sql import functions as F

from ampliscope.functions import scalars
from ampliscope.operators import pools, regress
from ampliscope.plans import config, search


def test_config():
    base = {"a": {"n": 2, "x": None}, "names": []}
    got = config.overridden(base, ["a.n=16", "a.x=true", 'names=["p"]'])
    assert got == {"a": {"n": 16, "x": True}, "names": ["p"]} and base["a"]["n"] == 2
    assert config.nested(got, "a.n") == 16 and config.nested(got, "a.q.r", 5) == 5
    assert [config.cast(x) for x in ("none", "1", "1.5", "x")] == [None, 1, 1.5, "x"]
    for bad in ("a.zz=1", "q.n=1", "a.n"):
        with pytest.raises(KeyError):
            config.overridden(base, [bad])
    assert config.build(search.SearchConfig, {"steps": 1, "pool_sizes": [3]}).pool_sizes == (3,)
    with pytest.raises(KeyError):
        config.build(search.SearchConfig, {"stepz": 1})


def test_memoized_decisions(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "key string")
    cache = spark.createDataFrame([("a", "NO")], "key string, decision string")
    seen, fresh = pools.memoized(rows, cache, "key", lambda r: r.withColumn("decision", F.lit("YES")))
    assert sorted((r["key"], r["decision"]) for r in seen.collect()) == [("a", "NO"), ("b", "YES"), ("b", "YES"), ("c", "YES")]
    assert fresh.count() == 2
    with pytest.raises(ValueError):
        pools.covered_or_error(rows, spark.createDataFrame([], "key string, score double"), "key", "score")
    found = spark.createDataFrame([("x", 1.0, -1.0), ("y", 1.0, None), ("z", 1.0, 0.5)], "attr string, delta_rm double, delta_j double")
    assert [r["attr"] for r in pools.undesirable(found).collect()] == ["x"]


def test_weights_compare(spark):
    w = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.1)], "prompt string, attr string, w double")
    assert regress.max_difference(w, w.withColumn("w", F.col("w") + 0.25)) == pytest.approx(0.25)


def test_wrapping(spark):
    lines = spark.range(1).select(scalars.wrapped(F.lit("a bb ccc dddddddd e"), 4).alias("x")).first()["x"]
    assert lines == ["a bb", "ccc", "dddd", "dddd", "e"]
