"""Heavy keys: the split path gives what the plain one gives."""

import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import joins
from tideline.operators.blocks import block_stats, latest_block_mean
from tideline.operators.clean import interpolate_blocks
from tideline.operators.joins import asof_join, join_trips_fares, lookup_join, range_join
from tideline.operators.kalman import gains, kalman
from tideline.operators.regression import PREDICTIONS, horizon_mean, sliding_regression
from tideline.operators.sequence import heavy_keys, sequence
from tideline.operators.training import quartile_bounds

ORDER = ["ts", "event_id"]


@pytest.fixture
def skewed(events):
    """A third of the rows on one key, some without a key, copies in time."""
    key = F.when(F.col("event_id") % 3 == 0, 999).when(F.col("event_id") % 7 == 0, None)
    return events.select(
        "event_id",
        F.date_trunc("day", "ts").alias("ts"),
        key.otherwise(F.col("user_id")).alias("k"),
        F.when(F.col("value") < 80, F.col("value")).alias("value"),
    )


def table(df, *columns):
    return sorted(
        tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()
    ) if not columns else sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()),
        key=repr,
    )


def numbered(df):
    return table(sequence(df, ["k"], ORDER).rows, "event_id", "seq")


OPERATIONS = {
    "numbers": numbered,
    "whole": lambda df: table(sequence(df, [], ORDER).rows, "event_id", "seq"),
    "interpolate": lambda df: table(interpolate_blocks(df, ["value"], ["k"], ORDER), "event_id", "value"),
    "blocks": lambda df: table(
        block_stats(df, ["k"], ORDER, mean_of="value", distinct_of="value"), "k", "block", "rows", "mean", "distinct_values"
    ),
    "kalman": lambda df: table(kalman(df, "value", ["k"], ORDER, "x"), "event_id", "x"),
    "regression": lambda df: table(
        sliding_regression(sequence(df, ["k"], ORDER), "value").withColumn("h", horizon_mean(F.col(PREDICTIONS))),
        "event_id", "h",
    ),
    "latest": lambda df: table(latest_block_mean(sequence(df, ["k"], ORDER), "value", "m"), "event_id", "m"),
    "quartiles": lambda df: table(quartile_bounds(df, ["k"], "value"), "k", "n", "q25", "q50", "q75", "q100"),
}


@pytest.mark.parametrize("name", sorted(OPERATIONS))
def test_split_equals_plain(spark, skewed, name, request):
    plain = OPERATIONS[name](skewed)
    request.getfixturevalue("heavy")
    assert sequence(skewed, ["k"], ORDER).split
    assert OPERATIONS[name](skewed) == plain


def test_equal_rows_are_numbered_once_each(spark, heavy):
    rows = spark.range(1000).select(F.lit(1).alias("k"), F.lit(5).alias("t"))
    out = sequence(rows, ["k"], ["t"])
    assert out.split
    assert sorted(r["seq"] for r in out.rows.collect()) == list(range(1, 1001))


def test_heavy_keys_are_found(spark, skewed, heavy):
    found = {r["k"]: r["rows"] for r in heavy_keys(skewed, ["k"]).collect()}
    assert found[999] == skewed.filter("k = 999").count() and None in found


def test_kalman_follows_the_recursion(spark, skewed):
    out = kalman(skewed, "value", ["k"], ORDER, "x").filter("k = 999").orderBy(*ORDER).collect()
    x, k = 0.0, gains(len(out))
    for gain, row in zip(k, out):
        x += gain * ((row["value"] or 0.0) - x)
        assert row["x"] == pytest.approx(x, abs=1e-9)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set(joins.BROADCAST_ROWS_CONF, "2")
    yield
    spark.conf.unset(joins.BROADCAST_ROWS_CONF)


@pytest.mark.parametrize("how", ["left", "inner", "left_semi"])
def test_lookup_join_by_shuffle(spark, skewed, how, request):
    dim = skewed.select("k").filter("k > 5").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    columns = ["event_id", "k"] + ([] if how == "left_semi" else ["name"])
    plain = table(lookup_join(skewed, dim, ["k"], how), *columns)
    request.getfixturevalue("no_broadcast")
    assert table(lookup_join(skewed, dim, ["k"], how), *columns) == plain
    request.getfixturevalue("heavy")
    assert table(lookup_join(skewed, dim, ["k"], how), *columns) == plain


def test_range_join_by_shuffle_and_salt(spark, skewed, request):
    requests = spark.createDataFrame(
        [(1, 0, 50), (2, 40, 45), (3, 10, 700), (4, 5, 5), (5, 990, 2000)], "msgid int, row_start long, row_end long"
    )
    expected = sorted(
        (m, e) for m, a, b in [(1, 0, 50), (2, 40, 45), (3, 10, 700), (5, 990, 2000)] for e in range(1000) if a <= e < b
    )
    run = lambda: sorted(
        (r["msgid"], r["event_id"]) for r in range_join(requests, skewed, "event_id").select("msgid", "event_id").collect()
    )
    assert run() == expected
    request.getfixturevalue("no_broadcast")
    assert run() == expected
    request.getfixturevalue("heavy")
    assert run() == expected


def test_range_cells_of_long_and_short_requests(spark):
    half_hour, ten_years = 1_800_000, 10 * 365 * 86_400_000
    rows = [(i, 1_700_000_000_000 + i * 777_777, 1_700_000_000_000 + i * 777_777 + half_hour) for i in range(60)]
    few = joins.range_cells(spark.createDataFrame(rows, "msgid int, row_start long, row_end long"), "row_start", "row_end")[0].count()
    rows.append((99, 1_400_000_000_123, 1_400_000_000_123 + ten_years))
    pieces, width, levels = joins.range_cells(spark.createDataFrame(rows, "msgid int, row_start long, row_end long"), "row_start", "row_end")
    assert pieces.count() - few < 100 and few <= 4 * 60 and len(levels) < 16 and width <= half_hour


def test_range_join_of_mixed_lengths(spark, request):
    rnd = random.Random(2)
    spans = [(i, a, a + n) for i, (a, n) in enumerate((rnd.randrange(-500, 4000), rnd.choice([1, 2, 7, 16, 17, 90, 1000, 5000])) for _ in range(60))]
    times = [(rnd.randrange(-600, 6000), i) for i in range(400)] + [(None, 1)]
    requests = spark.createDataFrame(spans + [(77, None, 5), (78, 5, None)], "msgid int, row_start long, row_end long")
    history = spark.createDataFrame(times, "t long, level int")
    want = sorted((m, t, i) for m, a, b in spans for t, i in times if t is not None and a <= t < b)
    run = lambda: sorted(map(tuple, range_join(requests, history, "t").select("msgid", "t", "level").collect()))
    assert run() == want
    request.getfixturevalue("no_broadcast")
    request.getfixturevalue("heavy")
    assert run() == want


def test_asof_join_ways_agree(spark, skewed, monkeypatch, request):
    changes = skewed.filter("event_id % 10 = 0").select(
        F.col("k"), F.col("event_id").alias("since"), F.col("event_id").alias("found")
    )
    run = lambda: table(
        asof_join(skewed, changes, ["k"], "event_id", ["found"]), "event_id", "found"
    )
    rows = {}
    expected = []
    for r in sorted(skewed.collect(), key=lambda r: r["event_id"]):
        if r["event_id"] % 10 == 0:
            rows[r["k"]] = r["event_id"]
        expected.append((r["event_id"], rows.get(r["k"])))
    expected.sort(key=repr)
    assert run() == expected
    monkeypatch.setattr(joins, "fits_broadcast", lambda df, rows=None: False)
    assert run() == expected
    request.getfixturevalue("heavy")
    assert run() == expected


def test_asof_without_changes(spark, skewed):
    none = spark.createDataFrame([], "since long, b double")
    out = asof_join(skewed, none, [], "event_id", ["b"])
    assert out.filter("b is not null").count() == 0 and out.count() == 1000


def test_trips_and_fares_with_repeated_keys(spark):
    trips = spark.createDataFrame([(1, 10, "a"), (1, 20, "b"), (2, 5, "c")], "k int, t int, trip string")
    fares = spark.createDataFrame([(1, 20, "y"), (1, 10, "x"), (2, 5, "z")], "k int, t int, fare string")
    out = join_trips_fares(trips, fares.withColumnRenamed("t", "t2"), ["k"]).count()
    assert out == 5
    pairs = join_trips_fares(trips, fares, ["k", "t"], ["t"])
    assert sorted((r["trip"], r["fare"]) for r in pairs.collect()) == [("a", "x"), ("b", "y"), ("c", "z")]
