"""Bad messages, numbers beyond the range, and the joins on streams and on other kinds of time."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tideline.functions.senml import parse_csv, wrap_envelope
from tideline.operators import joins
from tideline.operators.scoring import linear_score
from tideline.specs import TAXI


@pytest.mark.parametrize("pack", ["[]", '[{"n":"pickup_datetime","vs":"soon"}]', '[{"n":"speed","v":1}]'])
def test_pack_without_readable_pickup_time(spark, pack):
    df = spark.createDataFrame([(pack,)], "pack string")
    assert df.select(wrap_envelope(TAXI, F.col("pack")).alias("e")).first().e == '{"e":' + pack + ',"bt":0}'


def test_csv_with_unreadable_time(spark):
    df = spark.createDataFrame([("a,b,c,later,e,f,g",)], "line string")
    assert parse_csv(df, TAXI).first().timestamp is None


def test_scores_stop_at_the_int_range(spark):
    df = spark.createDataFrame([(3e9,), (-3e9,), (-1.9,), (float("nan"),), (None,)], "x double")
    got = [r.y for r in df.select(linear_score(["x"], F.lit(0.0), [F.lit(1.0)]).alias("y")).collect()]
    assert got == [2.0**31, -(2.0**31), -1.0, None, None]


def test_asof_ways_agree_on_times(spark, monkeypatch):
    start = datetime(2024, 1, 1)
    nanos = 1_700_000_000_000_000_000
    cases = {
        "timestamp": ([start + timedelta(seconds=s) for s in (0, 5, 9)], [start + timedelta(seconds=s) for s in (1, 6)]),
        "date": ([start.date() + timedelta(days=s) for s in (0, 5, 9)], [start.date() + timedelta(days=s) for s in (1, 6)]),
        "long": ([nanos, nanos + 2, nanos + 3], [nanos + 1, nanos + 3]),
    }
    for kind, (times, since) in cases.items():
        rows = spark.createDataFrame([(t,) for t in times], f"t {kind}")
        changes = spark.createDataFrame([(since[0], 1.0), (since[1], 2.0), (None, 9.0)], f"since {kind}, v double")
        for small in (True, False):
            monkeypatch.setattr(joins, "fits_broadcast", lambda *_, small=small: small)
            got = sorted((r.t, r.v) for r in joins.asof_join(rows, changes, [], "t", ["v"]).collect())
            assert got == list(zip(times, [None, 1.0, 2.0], strict=True)), (kind, small)


def test_lookup_of_a_large_table_on_a_stream(spark, tmp_path):
    spark.range(6).select((F.col("id") % 3).alias("k"), "id").write.parquet(f"{tmp_path}/in")
    table = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    stream = spark.readStream.schema("k long, id long").parquet(f"{tmp_path}/in")
    joined = joins.lookup_join(stream, table, ["k"], broadcast_rows=1)
    out = joined.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck")
    out.trigger(availableNow=True).start().awaitTermination(60)
    got = sorted((r.id, r.name) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [(0, "a"), (1, "b"), (2, None), (3, "a"), (4, "b"), (5, None)]
