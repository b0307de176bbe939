import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.test_senml import packs, taxi_pack
from tideline.operators.clean import annotate_by_choice, drop_incomplete, interpolate_blocks, null_out_of_range
from tideline.operators.membership import BloomTable, bloom_build, bloom_filter, bloom_size, keep_members
from tideline.plans.etl import clean, packed
from tideline.specs import FIT, GRID, SYS, TAXI

COLUMNS = TAXI.interpolated


def test_interpolation_fills_with_block_means(spark):
    rows = spark.createDataFrame(
        [
            (1, 140.0, 1.40, 7.0, 0.7, 2.6),
            (2, 145.0, 3.1, 9.0, 1.3, 4.3),
            (3, None, None, None, None, None),
        ],
        "at int, " + ", ".join(f"{c} double" for c in COLUMNS),
    )
    filled = interpolate_blocks(rows, COLUMNS, [], ["at"], size=3)
    last = filled.filter("at = 3").first()
    assert [last[c] for c in COLUMNS] == pytest.approx([142.5, 2.25, 8.0, 1.0, 3.45])
    assert filled.count() == 3 and filled.columns == rows.columns


def test_all_missing_becomes_zero(spark):
    rows = spark.createDataFrame([(1, None), (2, None)], "at int, m double")
    assert {r["m"] for r in interpolate_blocks(rows, ["m"], [], ["at"]).collect()} == {0.0}


@pytest.mark.parametrize(
    "spec, column, value, kept",
    [
        (TAXI, "trip_time_in_secs", 140.0, False),
        (TAXI, "trip_time_in_secs", 141.0, True),
        (TAXI, "trip_time_in_secs", 3155.0, False),
        (TAXI, "tolls_amount", 2.5, False),
        (FIT, "acc_ankle_x", -2.0, True),
        (FIT, "acc_ankle_x", 30.1, False),
        (GRID, "grid_measurement", 0.95, True),
        (GRID, "grid_measurement", 0.079, False),
        (SYS, "light", 1345.0, True),
    ],
)
def test_range_bounds(spark, spec, column, value, kept):
    rows = spark.createDataFrame([(value,)], f"{column} double")
    out = null_out_of_range(rows, {column: spec.ranges[column]}).first()[0]
    assert (out is not None) == kept


# identifier, trip time, distance, payment, fare, tip, tolls, total
RIDES = [
    ("2010000001", 34.0, 14.05, "CAS", 34.1, 0.0, 0.0, 35.1),
    ("2010000002", 33.0, 9.65, "CAS", 27.3, 0.0, 0.0, 28.3),
    ("2010000003", 7.0, 1.63, "CAS", 6.9, 0.0, 0.0, 7.9),
    ("2010000004", 33.0, 26.61, "Cre", 56.1, 10.0, 9.14, 76.24),
    ("2010000005", 28.0, 3.15, "CAS", 14.5, 0.0, 0.0, 15.5),
    ("2010000006", 27.0, 11.15, "CAS", 27.7, 0.0, 0.0, 28.7),
    ("2010000007", 18.0, 4.3, "CAS", 13.3, 0.0, 0.0, 14.3),
    ("2010000008", 27.0, 9.83, "Cre", 25.7, 0.0, 4.57, 31.27),
    ("2010000009", 18.22, 3.4, "Cas", 12.5, 0.0, 0.0, 13.5),
    ("2010000010", 36.42, 12.4, "Cas", 31.7, 0.0, 0.0, 32.7),
]
NAMES = (
    "taxi_identifier", "trip_time_in_secs", "trip_distance", "payment_type", "fare_amount",
    "tip_amount", "tolls_amount", "total_amount",
)


def test_taxi_job_end_to_end(spark):
    """All rides through one global order; the fourth and seventh taxi are unknown."""
    messages = spark.createDataFrame(
        [(i, taxi_pack(**dict(zip(NAMES, r)))) for i, r in enumerate(RIDES)], "at int, pack string"
    )
    known = spark.createDataFrame(
        [(r[0],) for i, r in enumerate(RIDES) if i not in (3, 6)], "taxi_identifier string"
    )
    out = clean(messages, TAXI, ["at"], keys=[], members=known).orderBy("at").collect()
    assert [r["at"] for r in out] == [0, 1, 2, 4, 5, 7, 8, 9]
    assert {r["trip_time_in_secs"] for r in out} == {0.0}
    assert [r["tolls_amount"] for r in out] == [0.0] * 5 + [4.57] * 3
    assert {r["tip_amount"] for r in out} == {None}
    for r in out:
        ride = RIDES[r["at"]]
        assert (r["trip_distance"], r["fare_amount"], r["total_amount"]) == (ride[2], ride[4], ride[7])
        assert r["taxi_company"] in TAXI.choices["taxi_company"]
    assert '"taxi_city"' in packed(clean(messages, TAXI, ["at"]), TAXI).first()["pack"]


def test_annotation_is_stable(spark):
    rows = spark.range(200).select(F.concat(F.lit("s"), (F.col("id") % 20).cast("string")).alias("subjectId"))
    out = annotate_by_choice(rows, FIT, "subjectId").distinct()
    assert out.count() == 20 and {r["name"] for r in out.collect()} == set(FIT.choices["name"])


def test_incomplete_rows_are_counted(spark):
    rows = spark.createDataFrame(
        [(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, y string"
    )
    seen = Observation()
    assert drop_incomplete(rows, ["x", "y"], seen).count() == 1
    assert seen.get["skipped"] == 3


def test_members(spark):
    rows = spark.createDataFrame([("a",), ("b",), (None,)], "k string")
    assert keep_members(rows, None, "k").count() == 3
    assert [r["k"] for r in keep_members(rows, rows.filter("k = 'a'"), "k").collect()] == ["a"]
    assert keep_members(rows, rows.filter("k = 'zz'"), "k").count() == 0


def test_bloom_has_no_false_negatives_and_few_false_positives(spark, tmp_path):
    keys = spark.range(0, 20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    bloom = bloom_build(keys, "k", expected=20_000, ratio=0.01)
    assert bloom_filter(keys, bloom, "k").count() == 20_000
    others = spark.range(100_000, 120_000).select(F.concat(F.lit("k"), "id").alias("k"))
    assert bloom_filter(others, bloom, "k").count() < 0.02 * 20_000
    bloom.write(str(tmp_path / "bloom"))
    again = BloomTable.read(spark, str(tmp_path / "bloom"))
    assert bloom_filter(others, again, "k").count() == bloom_filter(others, bloom, "k").count()


def test_bloom_beyond_the_broadcast_limit(spark, monkeypatch):
    from tideline.operators import membership

    keys = spark.range(0, 1000).select(F.col("id").alias("k"))
    bloom = bloom_build(keys, "k", expected=1000)
    rows = spark.range(0, 5000).select((F.col("id") % 1500).alias("k"))
    small = bloom_filter(rows, bloom, "k").count()
    monkeypatch.setattr(membership, "BROADCAST_PAGES", 0)
    assert bloom_filter(rows, bloom, "k").count() == small


def test_bloom_size():
    pages, hashes = bloom_size(20_000_000, 0.01)
    assert hashes == 7 and 46_000 < pages < 47_500
