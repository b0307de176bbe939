"""Test tables as sensor messages, in Spark and as SQL text.

events   -> GRID, FIT and SYS messages, one per event, ordered by (ts, event_id)
lineitem -> TAXI messages, one per line, ordered by ``TAXI_ORDER``
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.senml import to_pack
from tideline.specs import FIT, GRID, SYS, TAXI

EVENT_ORDER = ["ts", "event_id"]
TAXI_ORDER = [
    "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_event_numbers(table(spark, sf_dir, "events"))


def with_event_numbers(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k", F.regexp_extract("props", "([0-9]+)", 1).cast("int"))


def grid_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        "ts",
        F.col("user_id").cast("double").alias("id"),
        (F.col("value") / 500.0).alias("grid_measurement"),
        F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
    )


GRID_SQL = """
grid AS (
  SELECT event_id, ts, CAST(user_id AS DOUBLE) AS id, value / 500.0 AS grid_measurement,
         floor(epoch_us(ts) / 1000000) AS "timestamp"
  FROM events
)"""


def fit_of(rows: DataFrame) -> DataFrame:
    channels = [
        (F.col("value") * (i + 1) / 100.0 - F.col("k") / 20.0).alias(name)
        for i, name in enumerate(FIT.field_names[1:-1])
    ]
    return rows.select(
        "event_id",
        "ts",
        F.concat(F.lit("subject"), (F.col("user_id") % 10).cast("string")).alias("subjectId"),
        *channels,
        (F.col("k") % 13).cast("double").alias("label"),
    )


FIT_SQL = """
fit AS (
  SELECT event_id, ts, 'subject' || CAST(user_id % 10 AS VARCHAR) AS "subjectId",
         {channels},
         CAST(k % 13 AS DOUBLE) AS label
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)""".format(
    channels=",\n         ".join(
        f"value * {i + 1} / 100.0 - k / 20.0 AS {name}"
        for i, name in enumerate(FIT.field_names[1:-1])
    )
)


def sys_of(rows: DataFrame) -> DataFrame:
    return rows.select(
        "event_id",
        "ts",
        F.concat(F.lit("device"), F.col("user_id").cast("string")).alias("source"),
        (F.col("user_id") - 75.0).alias("longitude"),
        (F.col("user_id") % 90).cast("double").alias("latitude"),
        (F.col("value") / 5.0 - 15.0).alias("temperature"),
        F.col("k").cast("double").alias("humidity"),
        (F.col("value") * 300.0).alias("light"),
        (F.col("value") * 40.0 + 100.0).alias("dust"),
        (F.col("k") * 4.0).alias("airquality_raw"),
    )


SYS_SQL = """
sys AS (
  SELECT event_id, ts, 'device' || CAST(user_id AS VARCHAR) AS source,
         user_id - 75.0::DOUBLE AS longitude, CAST(user_id % 90 AS DOUBLE) AS latitude,
         value / 5.0 - 15.0 AS temperature, CAST(k AS DOUBLE) AS humidity,
         value * 300.0 AS light, value * 40.0 + 100.0 AS dust,
         CAST(k * 4 AS DOUBLE) AS airquality_raw
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
)"""


def taxi_rides(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        *TAXI_ORDER,
        F.col("l_suppkey").cast("string").alias("taxi_identifier"),
        F.col("l_partkey").cast("string").alias("hack_license"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("pickup_datetime"),
        (F.col("l_quantity") * 70.0).alias("trip_time_in_secs"),
        (F.col("l_quantity") * 0.5 + line * 0.75).alias("trip_distance"),
        (F.lit(-70.0) - line).alias("pickup_longitude"),
        (F.lit(40.0) + line).alias("pickup_latitude"),
        (F.lit(-71.0) - line).alias("dropoff_longitude"),
        (F.lit(41.0) + line).alias("dropoff_latitude"),
        F.col("l_returnflag").alias("payment_type"),
        (F.col("l_extendedprice") / 500.0).alias("fare_amount"),
        F.col("l_tax").alias("surcharge"),
        F.col("l_discount").alias("mta_tax"),
        (F.col("l_discount") * 400.0).alias("tip_amount"),
        (F.col("l_tax") * 250.0).alias("tolls_amount"),
        (F.col("l_extendedprice") / 500.0 + F.col("l_discount") * 400.0).alias("total_amount"),
    )


TAXI_SQL = """
taxi AS (
  SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice,
         l_discount, l_tax,
         CAST(l_suppkey AS VARCHAR) AS taxi_identifier, CAST(l_partkey AS VARCHAR) AS hack_license,
         strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS pickup_datetime,
         l_quantity * 70.0 AS trip_time_in_secs,
         l_quantity * 0.5::DOUBLE + l_linenumber * 0.75::DOUBLE AS trip_distance,
         -70.0::DOUBLE - l_linenumber AS pickup_longitude,
         40.0::DOUBLE + l_linenumber AS pickup_latitude,
         -71.0::DOUBLE - l_linenumber AS dropoff_longitude,
         41.0::DOUBLE + l_linenumber AS dropoff_latitude,
         l_returnflag AS payment_type, l_extendedprice / 500.0 AS fare_amount,
         l_tax AS surcharge, l_discount AS mta_tax, l_discount * 400.0 AS tip_amount,
         l_tax * 250.0 AS tolls_amount,
         l_extendedprice / 500.0 + l_discount * 400.0 AS total_amount
  FROM lineitem
)"""
TAXI_ORDER_SQL = ", ".join(TAXI_ORDER)


def spread(df: DataFrame) -> DataFrame:
    """Use all cores for the JSON work when the scan has fewer splits than cores.

    A scan of any size beyond cores x split size is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def _packs(rows: DataFrame, spec, keep: list[str]) -> DataFrame:
    return spread(rows).select(*keep, to_pack(spec).alias("pack"))


def grid_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(grid_of(events(spark, sf_dir)), GRID, ["event_id", "ts"])


def fit_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(fit_of(events(spark, sf_dir)), FIT, ["event_id", "ts"])


def sys_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(sys_of(events(spark, sf_dir)), SYS, ["event_id", "ts"])


def taxi_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packs(taxi_rides(spark, sf_dir), TAXI, TAXI_ORDER)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round the double columns, for comparison with another engine."""
    names = [n for n, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One training request per nation: 36 hours from its day of the event month."""
    start = F.lit(1704067200000) + F.col("n_nationkey").cast("bigint") * 86400000
    text = F.concat_ws(
        ",", F.lit(1443033000).cast("string"), start.cast("string"), (start + 129600000).cast("string")
    )
    return table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("msgid"), text.alias("value")
    )


REQUEST_SQL = """
requests AS (
  SELECT CAST(n_nationkey AS BIGINT) AS msgid, CAST(1443033000 AS BIGINT) AS ts,
         1704067200000 + CAST(n_nationkey AS BIGINT) * 86400000 AS row_start,
         1704067200000 + CAST(n_nationkey AS BIGINT) * 86400000 + 129600000 AS row_end
  FROM nation
)"""
