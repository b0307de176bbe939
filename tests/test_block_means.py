"""Blocks of wide rows, taken apart by type afterwards, are those of each type's own rows."""

import pytest
from pyspark.sql import functions as F

from tideline.operators.blocks import block_stats, observations
from tideline.operators.sequence import sequence
from tideline.specs import TAXI
from tideline.workload.inputs import TAXI_ORDER, taxi_rides
from tideline.workload.statistics import keyed_block_average_taxi

TYPES = list(TAXI.averaged_types)


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Lines of three suppliers and of none, one supplier with most; values missing, rows that come twice."""
    some = lambda c, n: F.when(F.col("id") % n > 0, c)
    rows = spark.range(400).select(
        (F.col("id") * 7919 % 101).alias("l_orderkey"),
        some(F.col("id") % 37, 23).alias("l_partkey"),
        F.when(F.col("id") % 4 > 0, F.lit(1)).when(F.col("id") % 12 > 0, F.col("id") % 3 + 2).cast("long").alias("l_suppkey"),
        (F.col("id") % 7).cast("int").alias("l_linenumber"),
        some((F.col("id") % 50).cast("double"), 11).alias("l_quantity"),
        some(F.col("id") * 3.25 + 900, 13).alias("l_extendedprice"),
        some(F.col("id") % 10 / 100, 17).alias("l_discount"),
        some(F.col("id") % 8 / 100, 19).alias("l_tax"),
        F.lit("N").alias("l_returnflag"),
        F.lit("O").alias("l_linestatus"),
        some(F.timestamp_seconds(F.col("id") % 29 * 86400), 31).alias("l_shipdate"),
    )
    rows.union(rows.filter("l_orderkey % 9 = 0")).write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def by_type(spark, sf_dir):
    """The same means, each type's rows numbered by themselves."""
    long = observations(taxi_rides(spark, sf_dir), TYPES, ["taxi_identifier", *TAXI_ORDER])
    return block_stats(long, ["taxi_identifier", "obs_type"], TAXI_ORDER, mean_of="value", full_only=True)


def found(df):
    means = df.select("taxi_identifier", "obs_type", "block", F.round("mean", 8))
    return sorted((tuple(r) for r in means.collect()), key=repr)


def test_means_are_those_of_each_type(spark, sf_dir):
    out = keyed_block_average_taxi(spark, sf_dir)
    assert [(f.name, f.dataType.simpleString()) for f in out.schema] == [
        ("taxi_identifier", "string"), ("obs_type", "string"), ("block", "bigint"), ("mean", "double")
    ]
    want = found(by_type(spark, sf_dir))
    assert found(out) == want and len(want) > 8 * 50


def test_means_of_split_keys(spark, sf_dir, heavy):
    assert sequence(taxi_rides(spark, sf_dir), ["taxi_identifier"], TAXI_ORDER).split
    assert found(keyed_block_average_taxi(spark, sf_dir)) == found(by_type(spark, sf_dir))


def test_rides_are_sorted_once_for_all_types(spark, sf_dir):
    """Rows are multiplied by the number of types after they were shuffled, numbered and averaged."""
    lines = keyed_block_average_taxi(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = lambda name: [i for i, line in enumerate(lines) if name in line]
    assert len(at("Expand")) == len(at("Window [")) == 1
    assert at("Expand") < at("Aggregate") < at("Window [")
