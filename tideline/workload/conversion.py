"""Queries: raw files, trip/fare pairing, replay times, replay files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.senml import parse_pack
from tideline.functions.times import (
    epoch_millis,
    fixed_rate_offset,
    scaled_offset,
    timecode_offset,
    timecode_seconds,
)
from tideline.operators.joins import join_trips_fares, pair_by_position
from tideline.operators.sequence import SEQ, sequence
from tideline.plans.convert import convert_fit, convert_fit_logs, convert_grid, convert_meters, convert_taxi
from tideline.session import scratch_path
from tideline.sources.files import (
    read_fares,
    read_fitness_logs,
    read_grid,
    read_meter_timecodes,
    read_replay,
    read_trips,
    write_replay,
)
from tideline.specs import FIT, GRID, SYS, TAXI
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    EVENT_ORDER,
    FIT_SQL,
    GRID_SQL,
    events,
    fit_of,
    grid_of,
    rounded,
    table,
)


@query(
    "trip_fare_join",
    """
    SELECT o_orderkey, o_custkey, l_linenumber, l_extendedprice FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    """,
)
def trip_fare_join(spark, sf_dir):
    trips = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    fares = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_extendedprice"
    )
    return join_trips_fares(trips, fares, ["o_orderkey"])


@query(
    "trip_fare_pairs",
    """
    WITH n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                                            ORDER BY l_partkey, l_suppkey, l_extendedprice) AS seq FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_tax FROM n
    """,
)
def trip_fare_pairs(spark, sf_dir):
    """Rows that share a key are paired first with first, second with second."""
    lines = table(spark, sf_dir, "lineitem")
    order = ["l_partkey", "l_suppkey", "l_extendedprice"]
    trips = lines.select("l_orderkey", "l_linenumber", *order, "l_quantity")
    fares = lines.select("l_orderkey", "l_linenumber", *order, "l_tax")
    joined = join_trips_fares(
        trips, fares.withColumnsRenamed({c: c for c in order}), ["l_orderkey", "l_linenumber", *order], order
    )
    return joined


@query(
    "pair_by_position",
    """
    WITH a AS (SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events),
    b AS (SELECT value, event_id AS other, row_number() OVER (ORDER BY value, event_id) AS seq FROM events)
    SELECT seq, event_id, other, value FROM a JOIN b USING (seq)
    """,
)
def pair_by_position_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    left = rows.select("event_id", "ts")
    right = rows.select("value", F.col("event_id").alias("other"))
    return pair_by_position(left, right, ["ts", "event_id"], ["value", "other"]).drop("ts")


@query(
    "relative_time",
    """
    SELECT o_orderkey, epoch_ms(o_orderdate) AS time_ms,
           CAST(floor((epoch_ms(o_orderdate) - (SELECT min(epoch_ms(o_orderdate)) FROM orders)) * 0.5::DOUBLE) AS BIGINT)
             AS delay
    FROM orders
    """,
)
def relative_time(spark, sf_dir):
    text = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", epoch_millis(text).alias("time_ms"))
    first = rows.agg(F.min("time_ms")).first()[0]
    return rows.withColumn("delay", scaled_offset(F.col("time_ms"), F.lit(first), 0.5))


@query(
    "fixed_rate_time",
    """
    SELECT event_id, CAST(floor((row_number() OVER (ORDER BY ts, event_id) - 1) * 2 * 0.25::DOUBLE) AS BIGINT) AS delay
    FROM events
    """,
)
def fixed_rate_time(spark, sf_dir):
    rows = sequence(table(spark, sf_dir, "events").select("event_id", "ts"), [], EVENT_ORDER).rows
    return rows.select("event_id", fixed_rate_offset(F.col(SEQ) - 1, 0.25).alias("delay"))


CODE = "CAST(195 + user_id % 500 AS VARCHAR) || lpad(CAST(k % 48 + 1 AS VARCHAR), 2, '0')"


@query(
    "timecode",
    f"""
    WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
    t AS (
      SELECT event_id, {CODE} AS code,
             CAST(epoch(DATE '2009-01-01') AS BIGINT) + (194 + user_id % 500) * 86400 + (k % 48) * 1800 AS time
      FROM e
    )
    SELECT event_id, code, time, CAST(floor(abs(time - (SELECT min(time) FROM t)) * 0.5::DOUBLE) AS BIGINT) AS delay FROM t
    """,
)
def timecode(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", _code().alias("code"))
    timed = rows.withColumn("time", timecode_seconds(F.col("code")))
    first = timed.agg(F.min("time")).first()[0]
    return timed.withColumn("delay", timecode_offset(F.col("time"), F.lit(first), 0.5))


def _code():
    slot = F.lpad((F.col("k") % 48 + 1).cast("string"), 2, "0")
    return F.concat((F.col("user_id") % 500 + 195).cast("string"), slot)


@query(
    "replay_file",
    f"""
    WITH {GRID_SQL}, first AS (SELECT min("timestamp") AS t FROM grid)
    SELECT CAST(floor(("timestamp" - t) * 0.5::DOUBLE) AS BIGINT) AS delay,
           1000000 + CAST(floor(("timestamp" - t) * 0.5::DOUBLE) AS BIGINT) AS event_ms, id, grid_measurement, "timestamp"
    FROM grid, first
    """,
)
def replay_file(spark, sf_dir):
    """Convert, write the replay file, read it as events and parse the packs."""
    path = scratch_path(spark, "replay")
    write_replay(convert_grid(grid_of(events(spark, sf_dir)), 0.5), path)
    back = read_replay(spark, path, start_ms=1_000_000)
    return parse_pack(
        back.select("delay", F.unix_millis("event_time").alias("event_ms"), "pack"), GRID
    )


@query(
    "convert_taxi_files",
    """
    WITH o AS (SELECT * FROM orders WHERE o_orderstatus <> 'P')
    SELECT CAST(floor((epoch_ms(o_orderdate) - (SELECT min(epoch_ms(o_orderdate)) FROM o)) * 0.5::DOUBLE) AS BIGINT) AS delay,
           CAST(o_custkey AS VARCHAR) AS taxi_identifier, CAST(o_orderkey AS VARCHAR) AS hack_license,
           CAST(o_orderkey % 3000 AS DOUBLE) AS trip_time_in_secs, o_totalprice AS trip_distance,
           o_orderpriority AS payment_type, o_totalprice * 2 AS fare_amount
    FROM o
    """,
)
def convert_taxi_files(spark, sf_dir):
    """Raw trip and fare files; trips of pending orders lack the distance and are dropped."""
    orders = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    keys = [
        F.col("o_custkey").alias("medallion"),
        F.col("o_orderkey").alias("hack_license"),
        F.col("o_orderpriority").alias("vendor_id"),
    ]
    zero = [F.lit(0.0).alias(c) for c in ("surcharge", "mta_tax", "tip_amount", "tolls_amount")]
    trips_path, fares_path = scratch_path(spark, "trips"), scratch_path(spark, "fares")
    distance = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice"))
    orders.select(
        *keys, F.lit(1).alias("rate_code"), F.lit("N").alias("flag"), day.alias("pickup"),
        day.alias("dropoff"), F.lit(1).alias("passengers"), (F.col("o_orderkey") % 3000).alias("seconds"),
        distance.alias("distance"), F.lit(-73.9).alias("lon"), F.lit(40.7).alias("lat"),
        F.lit(-73.8).alias("lon2"), F.lit(40.8).alias("lat2"),
    ).write.csv(trips_path, header=True)
    orders.select(
        *keys, day.alias("pickup"), F.col("o_orderpriority").alias("payment_type"),
        (F.col("o_totalprice") * 2).alias("fare"), *zero, F.col("o_totalprice").alias("total"),
    ).write.csv(fares_path, header=True)
    lines = convert_taxi(read_trips(spark, trips_path), read_fares(spark, fares_path), 0.5)
    return parse_pack(lines, TAXI).select(
        "delay", "taxi_identifier", "hack_license", "trip_time_in_secs", "trip_distance",
        "payment_type", "fare_amount",
    )


@query(
    "convert_fit_files",
    f"""
    WITH {FIT_SQL},
    f AS (SELECT *, 'subject' || CAST(CAST(substr("subjectId", 8) AS INTEGER) + 1 AS VARCHAR) AS s FROM fit)
    SELECT s AS "subjectId", count(*) AS messages, round(sum(acc_chest_x), 4) AS chest,
           CAST(sum(label) AS BIGINT) AS labels
    FROM f GROUP BY s
    """,
)
def convert_fit_files(spark, sf_dir):
    """One tab-separated log per subject; the subject number comes from the file name."""
    root = scratch_path(spark, "fitness")
    rows = fit_of(events(spark, sf_dir))
    channels = FIT.field_names[1:-1]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in channels], F.col("label").cast("int"))
    out = rows.select(
        (F.substring("subjectId", 8, 2).cast("int") + 1).alias("subject"), line.alias("value")
    )
    out.write.partitionBy("subject").text(root)
    back = read_fitness_logs(spark, root, r"subject=(\d+)")
    packs = convert_fit(back, ["subjectId", *channels], 1.0)
    parsed = parse_pack(packs, FIT)
    return rounded(
        parsed.groupBy("subjectId").agg(
            F.count(F.lit(1)).alias("messages"),
            F.sum("acc_chest_x").alias("chest"),
            F.sum("label").cast("bigint").alias("labels"),
        ),
        4,
    )


@query(
    "read_grid_files",
    f"""
    WITH {GRID_SQL}
    SELECT CAST("timestamp" AS BIGINT) AS "timestamp", id, grid_measurement FROM grid
    """,
)
def read_grid_files(spark, sf_dir):
    path = scratch_path(spark, "grid")
    rows = grid_of(events(spark, sf_dir))
    line = F.concat_ws(
        " ", F.col("timestamp").cast("bigint"), F.col("id"), F.col("grid_measurement")
    )
    rows.select(line.alias("value")).write.text(path)
    return read_grid(spark, path)


@query(
    "convert_meter_files",
    f"""
    WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events),
    t AS (
      SELECT user_id, value, k, (194 + user_id % 500) * 86400 + (k % 48) * 1800 AS time FROM e
    )
    SELECT CAST(floor((time - (SELECT min(time) FROM t)) * 0.5::DOUBLE) AS BIGINT) AS delay,
           'ci4lrerertvs' || CAST(user_id AS VARCHAR) AS source, value AS dust
    FROM t
    """,
)
def convert_meter_files(spark, sf_dir):
    """Meter file with time codes; the measured columns are taken from the reading."""
    path = scratch_path(spark, "meters")
    rows = events(spark, sf_dir)
    line = F.concat_ws(" ", F.col("user_id"), _code(), F.col("value"))
    rows.select(line.alias("value")).write.text(path)
    meters = read_meter_timecodes(spark, path).withColumns(
        {
            "dust": F.col("value"),
            **{
                c: F.lit(None).cast("double")
                for c in ("longitude", "latitude", "temperature", "humidity", "light", "airquality_raw")
            },
        }
    )
    return parse_pack(convert_meters(meters, 0.5), SYS).select("delay", "source", "dust")


@query(
    "convert_fit_in_file_order",
    f"""
    WITH {FIT_SQL},
    f AS (
      SELECT *, row_number() OVER (PARTITION BY "subjectId" ORDER BY event_id) - 1 AS line FROM fit
    )
    SELECT 'subject' || CAST(CAST(substr("subjectId", 8) AS INTEGER) + 1 AS VARCHAR) AS "subjectId",
           CAST(floor(line * 2 * 0.5::DOUBLE) AS BIGINT) AS delay,
           round(acc_chest_x, 6) AS acc_chest_x, CAST(label AS BIGINT) AS label
    FROM f
    """,
)
def convert_fit_in_file_order(spark, sf_dir):
    """Each log's lines at their place in the file; every delay and value is compared."""
    root = scratch_path(spark, "fitness")
    channels = FIT.field_names[1:-1]
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in channels], F.col("label").cast("int"))
    rows = fit_of(events(spark, sf_dir))
    out = rows.select((F.substring("subjectId", 8, 2).cast("int") + 1).alias("subject"), "event_id", line.alias("value"))
    # one file a subject, as the logs come
    dealt = out.repartition("subject").sortWithinPartitions("subject", "event_id")
    dealt.select("subject", "value").write.partitionBy("subject").text(root)
    packs = convert_fit_logs(read_fitness_logs(spark, root, r"subject=(\d+)", numbered=True), 0.5)
    parsed = parse_pack(packs, FIT)
    return rounded(parsed.select("subjectId", "delay", "acc_chest_x", F.col("label").cast("bigint").alias("label")), 6)
