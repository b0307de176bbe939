"""A repeated batch stores its models once."""

from pyspark.sql import functions as F

from tideline.operators.blocks import block_sketches, united_distinct
from tideline.sources.registry import Registry


def test_repeated_batch_is_stored_once(spark, tmp_path):
    registry = Registry(str(tmp_path))
    schema = "name string, kind string, created_at bigint, intercept double"
    first = spark.createDataFrame([("a", "MLR", 1, 1.0), ("b", "MLR", 1, 2.0)], schema)
    registry.append(first, "s-0")
    registry.append(spark.createDataFrame([("c", "MLR", 2, 3.0)], schema), "s-1")
    registry.append(first, "s-0")
    registry.append(first.limit(0), "s-0")
    registry.append(spark.createDataFrame([("d", "MLR", 3, 4.0)], schema))
    registry.append(spark.createDataFrame([("d", "MLR", 4, 5.0)], schema))
    assert sorted(r.name for r in registry.read(spark).collect()) == ["a", "b", "c", "d", "d"]
    assert registry.latest_named(spark, "d")["intercept"] == 5.0


def test_united_sketches_with_a_hot_key(spark):
    key = F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 7).cast("string"))
    value = F.when(F.col("id") % 10 != 0, F.col("id") % 4001)
    rows = spark.range(30000).select("id", key.alias("key"), value.alias("v"))
    stored = block_sketches(rows, ["key"], ["id"], "v", buckets=1024, size=500)
    exact = {r.key: r.n for r in rows.groupBy("key").agg(F.count_distinct("v").alias("n")).collect()}
    got = {r.key: r.distinct_values for r in united_distinct(stored, ["key"]).collect()}
    assert got.keys() == exact.keys()
    assert all(abs(got[k] - n) <= 3 * 1.04 / 32 * n for k, n in exact.items())
    halves = stored.where("block % 2 = 0").union(stored.where("block % 2 = 1"))
    assert {r.key: r.distinct_values for r in united_distinct(halves, ["key"]).collect()} == got
