"""Queries: parsing, projection, filters, membership, annotation, cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.senml import (
    full_name,
    parse_csv,
    parse_envelope,
    parse_pack,
    record,
    record_set,
    reject_unreadable,
    split_roles,
    to_pack,
    wrap_envelope,
)
from tideline.operators.clean import (
    annotate,
    annotate_by_choice,
    drop_incomplete,
    gate,
    interpolate_blocks,
    null_out_of_range,
    suppress_empty,
)
from tideline.operators.membership import bloom_build, bloom_filter, keep_members
from tideline.plans.etl import clean, packed
from tideline.session import materialise
from tideline.specs import FIT, GRID, SYS, TAXI
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    EVENT_ORDER,
    FIT_SQL,
    GRID_SQL,
    SYS_SQL,
    TAXI_ORDER,
    TAXI_ORDER_SQL,
    TAXI_SQL,
    events,
    fit_packs,
    grid_of,
    grid_packs,
    rounded,
    sys_of,
    sys_packs,
    table,
    taxi_packs,
    taxi_rides,
)

TAXI_FIELDS = ", ".join(TAXI.field_names)
FIT_FIELDS = ", ".join(f'"{n}"' for n in FIT.field_names)
SYS_FIELDS = ", ".join(SYS.field_names)


@query(
    "senml_record",
    """
    SELECT event_id, 'dev' || CAST(user_id AS VARCHAR) AS bn, event_type AS n, 'u' AS u, value,
           CAST(NULL AS VARCHAR) AS text, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS t
    FROM events
    """,
)
def senml_record(spark, sf_dir):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    text = F.to_json(
        F.struct(
            F.concat(F.lit("dev"), F.col("user_id").cast("string")).alias("bn"),
            F.col("event_type").alias("n"),
            F.lit("u").alias("u"),
            F.col("value").cast("string").alias("v"),
            seconds.alias("t"),
        )
    )
    parsed = events(spark, sf_dir).select("event_id", record(text).alias("r"))
    return parsed.select(
        "event_id", "r.bn", "r.n", "r.u", "r.value", "r.text", F.unix_seconds("r.time").alias("t")
    )


@query(
    "senml_record_set",
    """
    WITH e AS (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
                      'dev' || CAST(user_id AS VARCHAR) AS bn FROM events)
    SELECT event_id, bn, event_type AS n, 'x' AS u, value AS v, CAST(NULL AS VARCHAR) AS vs,
           bn || event_type AS full_name FROM e
    UNION ALL
    SELECT event_id, bn, 'k' AS n, NULL AS u, CAST(k AS DOUBLE) AS v, NULL AS vs, bn || 'k' FROM e
    UNION ALL
    SELECT event_id, 'own' AS bn, 'kind' AS n, NULL AS u, NULL AS v, event_type AS vs, 'ownkind' FROM e
    """,
)
def senml_record_set(spark, sf_dir):
    """Four records, two of them the same; only the first has the common base name."""
    text = lambda name: F.col(name).cast("string")
    pack = F.concat(
        F.lit('[{"bn":"dev'), text("user_id"), F.lit('","n":"'), F.col("event_type"),
        F.lit('","u":"x","v":'), text("value"), F.lit('},{"n":"k","v":"'), text("k"),
        F.lit('"},{"n":"k","v":"'), text("k"),
        F.lit('"},{"bn":"own","n":"kind","sv":"'), F.col("event_type"), F.lit('"}]'),
    )
    rows = events(spark, sf_dir).select("event_id", pack.alias("pack"))
    return record_set(rows, "pack").drop("t")


@query(
    "full_name",
    "SELECT event_id, 'dev' || CAST(user_id AS VARCHAR) || ':' || event_type AS full_name FROM events",
)
def full_name_query(spark, sf_dir):
    base = F.concat(F.lit("dev"), F.col("user_id").cast("string"), F.lit(":"))
    return events(spark, sf_dir).select(
        "event_id", full_name(base, F.col("event_type")).alias("full_name")
    )


@query("parse_taxi", f"WITH {TAXI_SQL} SELECT l_orderkey, l_linenumber, {TAXI_FIELDS} FROM taxi")
def parse_taxi(spark, sf_dir):
    rows = parse_pack(taxi_packs(spark, sf_dir), TAXI)
    return rows.select("l_orderkey", "l_linenumber", *TAXI.field_names)


@query("parse_fit", f"WITH {FIT_SQL} SELECT event_id, {FIT_FIELDS} FROM fit")
def parse_fit(spark, sf_dir):
    return parse_pack(fit_packs(spark, sf_dir).drop("ts"), FIT)


@query("parse_grid", f'WITH {GRID_SQL} SELECT event_id, id, grid_measurement, "timestamp" FROM grid')
def parse_grid(spark, sf_dir):
    return parse_pack(grid_packs(spark, sf_dir).drop("ts"), GRID)


@query("parse_sys", f"WITH {SYS_SQL} SELECT event_id, {SYS_FIELDS} FROM sys")
def parse_sys(spark, sf_dir):
    return parse_pack(sys_packs(spark, sf_dir).drop("ts"), SYS)


@query(
    "senml_roundtrip",
    f"""
    WITH {GRID_SQL}
    SELECT event_id, id, CASE WHEN grid_measurement BETWEEN 0.08 AND 0.95 THEN grid_measurement END
             AS grid_measurement, "timestamp",
           'h' || CAST(CAST(id AS BIGINT) % 7 AS VARCHAR) AS house_id,
           CAST(NULL AS VARCHAR) AS "ownerFullName"
    FROM grid
    """,
)
def senml_roundtrip(spark, sf_dir):
    """Parse, change, write with annotation and a null field, parse again."""
    rows = null_out_of_range(parse_pack(grid_packs(spark, sf_dir).drop("ts"), GRID), GRID.ranges)
    rows = rows.withColumns(
        {
            "house_id": F.concat(F.lit("h"), (F.col("id").cast("bigint") % 7).cast("string")),
            "ownerFullName": F.lit(None).cast("string"),
        }
    )
    return parse_pack(packed(rows, GRID, ["event_id"]), GRID, annotated=True)


@query(
    "unreadable_messages",
    """
    SELECT event_type, count(*) AS messages FROM events WHERE event_type = 'error' GROUP BY event_type
    """,
)
def unreadable_messages(spark, sf_dir):
    """Packs of error events are cut off in the middle and must be set aside."""
    packs = grid_packs(spark, sf_dir).join(
        table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"
    )
    broken = packs.withColumn(
        "pack",
        F.when(F.col("event_type") == "error", F.expr("substring(pack, 1, length(pack) div 2)"))
        .otherwise(F.col("pack")),
    )
    _, unreadable = reject_unreadable(broken)
    return unreadable.groupBy("event_type").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "envelope_parse",
    f"""
    WITH {TAXI_SQL}
    SELECT l_orderkey, l_linenumber, CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR) AS "timestamp",
           taxi_identifier, pickup_datetime, payment_type,
           trip_time_in_secs, fare_amount FROM taxi
    """,
)
def envelope_parse(spark, sf_dir):
    packs = taxi_packs(spark, sf_dir).select("l_orderkey", "l_linenumber", "pack")
    wrapped = packs.withColumn("envelope", wrap_envelope(TAXI, F.col("pack"))).drop("pack")
    names = ["taxi_identifier", "pickup_datetime", "payment_type", "trip_time_in_secs", "fare_amount"]
    return parse_envelope(wrapped, names).withColumns(
        {n: F.col(n).cast("double") for n in names[3:]}
    )


@query(
    "envelope_last_name_wins",
    f"""
    WITH {SYS_SQL}
    SELECT event_id, '1358101800000' AS "timestamp", source, dust AS temperature FROM sys
    """,
)
def envelope_last_name_wins(spark, sf_dir):
    """A name given twice: the later record counts in an envelope."""
    rows = sys_of(events(spark, sf_dir))
    pack = F.to_json(
        F.array(
            *[
                F.struct(F.lit(n).alias("n"), F.col(c).cast("string").alias("v"))
                for n, c in (("source", "source"), ("temperature", "temperature"), ("temperature", "dust"))
            ]
        )
    )
    wrapped = rows.select("event_id", wrap_envelope(SYS, pack).alias("envelope"))
    parsed = parse_envelope(wrapped, ["source", "temperature"])
    return parsed.withColumn("temperature", F.col("temperature").cast("double"))


@query(
    "csv_parse",
    """
    SELECT o_orderkey, CAST(CAST(epoch(o_orderdate) AS BIGINT) AS VARCHAR) AS "timestamp",
           CAST(o_custkey AS VARCHAR) AS taxi_identifier, CAST(o_custkey AS VARCHAR) AS hack_license,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS pickup_datetime,
           o_orderpriority AS payment_type, CAST(o_orderkey AS VARCHAR) AS trip_time_in_secs,
           '70' AS total_amount
    FROM orders
    """,
)
def csv_parse(spark, sf_dir):
    text = lambda c: F.col(c).cast("string")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    fill = [F.lit(str(i)) for i in range(4, 9)]
    line = F.concat_ws(
        ",", text("o_custkey"), day, day, text("o_orderkey"), *fill, F.col("o_orderpriority"),
        *[F.lit(str(i)) for i in (10, 20, 30, 40, 50, 70)],
    )
    rows = table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line"))
    return parse_csv(rows, TAXI).select(
        "o_orderkey", "timestamp", "taxi_identifier", "hack_license", "pickup_datetime",
        "payment_type", "trip_time_in_secs", "total_amount",
    )


@query(
    "role_split",
    f"""
    WITH {TAXI_SQL}
    SELECT l_orderkey, l_linenumber, taxi_identifier AS sensor_id,
           pickup_datetime || ',' || CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR) || ',' ||
             CAST(pickup_longitude AS VARCHAR) || ',' || CAST(pickup_latitude AS VARCHAR) || ',' ||
             CAST(dropoff_longitude AS VARCHAR) || ',' || CAST(dropoff_latitude AS VARCHAR) || ',' ||
             payment_type AS meta,
           taxi_identifier || ',' || hack_license || ',' || CAST(trip_time_in_secs AS VARCHAR) || ',' ||
             CAST(trip_distance AS VARCHAR) || ',null,' || CAST(surcharge AS VARCHAR) || ',' ||
             CAST(mta_tax AS VARCHAR) || ',null,null,null' AS obs
    FROM taxi
    """,
)
def role_split(spark, sf_dir):
    """Fields without a value print as null."""
    packs = taxi_packs(spark, sf_dir).select("l_orderkey", "l_linenumber", "pack")
    wrapped = packs.withColumn("envelope", wrap_envelope(TAXI, F.col("pack"))).drop("pack")
    rows = parse_envelope(wrapped, [n for n in TAXI.schema_line if n != "timestamp"])
    gone = ("fare_amount", "tip_amount", "tolls_amount", "total_amount")
    rows = rows.withColumns({n: F.lit(None).cast("string") for n in gone})
    return split_roles(rows, TAXI).select("l_orderkey", "l_linenumber", "sensor_id", "meta", "obs")


@query(
    "range_filter_taxi",
    f"""
    WITH {TAXI_SQL}
    SELECT l_orderkey, l_linenumber, taxi_identifier,
           CASE WHEN trip_time_in_secs > 140 AND trip_time_in_secs < 3155 THEN trip_time_in_secs END
             AS trip_time_in_secs,
           CASE WHEN trip_distance > 1.37 AND trip_distance < 29.86 THEN trip_distance END AS trip_distance,
           CASE WHEN fare_amount > 6 AND fare_amount < 201 THEN fare_amount END AS fare_amount,
           CASE WHEN tip_amount > 0.65 AND tip_amount < 38.55 THEN tip_amount END AS tip_amount,
           CASE WHEN tolls_amount > 2.5 AND tolls_amount < 18 THEN tolls_amount END AS tolls_amount
    FROM taxi
    """,
)
def range_filter_taxi(spark, sf_dir):
    rows = null_out_of_range(parse_pack(taxi_packs(spark, sf_dir), TAXI), TAXI.ranges)
    return rows.select("l_orderkey", "l_linenumber", "taxi_identifier", *TAXI.ranges)


@query(
    "range_filter_fit",
    f"""
    WITH {FIT_SQL}
    SELECT event_id,
           CASE WHEN acc_ankle_x BETWEEN -2 AND 30 THEN acc_ankle_x END AS acc_ankle_x,
           CASE WHEN acc_ankle_y BETWEEN -2 AND 30 THEN acc_ankle_y END AS acc_ankle_y,
           CASE WHEN acc_ankle_z BETWEEN -2 AND 30 THEN acc_ankle_z END AS acc_ankle_z
    FROM fit
    """,
)
def range_filter_fit(spark, sf_dir):
    rows = null_out_of_range(parse_pack(fit_packs(spark, sf_dir), FIT), FIT.ranges)
    return rows.select("event_id", *FIT.ranges)


@query(
    "range_filter_grid",
    f"""
    WITH {GRID_SQL}
    SELECT event_id, CASE WHEN grid_measurement BETWEEN 0.08 AND 0.95 THEN grid_measurement END
      AS grid_measurement FROM grid
    """,
)
def range_filter_grid(spark, sf_dir):
    rows = null_out_of_range(parse_pack(grid_packs(spark, sf_dir), GRID), GRID.ranges)
    return rows.select("event_id", "grid_measurement")


@query(
    "range_filter_sys",
    f"""
    WITH {SYS_SQL}
    SELECT event_id,
           CASE WHEN temperature BETWEEN -12.5 AND 43.1 THEN temperature END AS temperature,
           CASE WHEN humidity BETWEEN 10.7 AND 95.2 THEN humidity END AS humidity,
           CASE WHEN light BETWEEN 1345 AND 26282 THEN light END AS light,
           CASE WHEN dust BETWEEN 186.61 AND 5188.21 THEN dust END AS dust,
           CASE WHEN airquality_raw BETWEEN 17 AND 363 THEN airquality_raw END AS airquality_raw
    FROM sys
    """,
)
def range_filter_sys(spark, sf_dir):
    rows = null_out_of_range(parse_pack(sys_packs(spark, sf_dir), SYS), SYS.ranges)
    return rows.select("event_id", *SYS.ranges)


MEMBERS_SQL = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'"


def _members(spark, sf_dir):
    return (
        table(spark, sf_dir, "customer")
        .filter(F.col("c_mktsegment") == "MACHINERY")
        .select(F.col("c_custkey").alias("user_id"))
    )


@query(
    "member_filter",
    f"SELECT event_id, user_id, value FROM events WHERE user_id IN ({MEMBERS_SQL})",
)
def member_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return keep_members(rows, _members(spark, sf_dir), "user_id")


@query(
    "bloom_then_exact",
    f"SELECT event_id, user_id, value FROM events WHERE user_id IN ({MEMBERS_SQL})",
)
def bloom_then_exact(spark, sf_dir):
    """Bloom filter first, exact filter on what is left: no member is lost on the way."""
    members = _members(spark, sf_dir)
    bloom = bloom_build(members, "user_id", expected=20_000, ratio=0.01)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return keep_members(bloom_filter(rows, bloom, "user_id"), members, "user_id")


@query("bloom_filter")
def bloom_filter_query(spark, sf_dir):
    """The Bloom filter alone; which other keys pass depends on the hash."""
    bloom = bloom_build(_members(spark, sf_dir), "user_id", expected=20_000, ratio=0.01)
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    return bloom_filter(rows, bloom, "user_id")


@query(
    "drop_incomplete",
    f"""
    WITH {TAXI_SQL}
    SELECT l_orderkey, l_linenumber, trip_time_in_secs, trip_distance, fare_amount FROM taxi
    WHERE trip_time_in_secs > 140 AND trip_time_in_secs < 3155 AND trip_distance > 1.37
      AND trip_distance < 29.86 AND fare_amount > 6 AND fare_amount < 201
      AND tip_amount > 0.65 AND tip_amount < 38.55 AND tolls_amount > 2.5 AND tolls_amount < 18
    """,
)
def drop_incomplete_query(spark, sf_dir):
    rows = null_out_of_range(parse_pack(taxi_packs(spark, sf_dir), TAXI), TAXI.ranges)
    return drop_incomplete(rows, TAXI.field_names).select(
        "l_orderkey", "l_linenumber", "trip_time_in_secs", "trip_distance", "fare_amount"
    )


@query(
    "type_gate",
    """
    SELECT event_type, count(*) AS messages, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents FROM events
    WHERE event_type IN ('view', 'click') GROUP BY event_type
    """,
)
def type_gate(spark, sf_dir):
    rows = gate(table(spark, sf_dir, "events"), "event_type", ["view", "click"])
    cents = F.sum(F.round(F.col("value") * 100).cast("bigint"))
    return rows.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("messages"), cents.alias("cents")
    )


@query(
    "suppress_empty",
    f"""
    WITH {GRID_SQL}
    SELECT event_id, grid_measurement FROM grid WHERE grid_measurement BETWEEN 0.08 AND 0.95
    """,
)
def suppress_empty_query(spark, sf_dir):
    rows = null_out_of_range(parse_pack(grid_packs(spark, sf_dir), GRID), GRID.ranges)
    return suppress_empty(rows, "grid_measurement").select("event_id", "grid_measurement")


GRID_BLOCKS_SQL = f"""
{GRID_SQL},
ranged AS (
  SELECT event_id, ts, id, "timestamp",
         CASE WHEN grid_measurement BETWEEN 0.08 AND 0.95 THEN grid_measurement END AS m,
         (row_number() OVER (PARTITION BY id ORDER BY ts, event_id) - 1) // 5 AS block
  FROM grid
),
filled AS (
  SELECT *, coalesce(m, avg(m) OVER (PARTITION BY id, block), 0.0) AS grid_measurement FROM ranged
)"""


@query(
    "interpolate_grid",
    f"WITH {GRID_BLOCKS_SQL} SELECT event_id, id, round(grid_measurement, 8) AS grid_measurement FROM filled",
)
def interpolate_grid(spark, sf_dir):
    rows = null_out_of_range(parse_pack(grid_packs(spark, sf_dir), GRID), GRID.ranges)
    filled = interpolate_blocks(rows, GRID.interpolated, ["id"], EVENT_ORDER)
    return rounded(filled.select("event_id", "id", "grid_measurement"), 8)


TAXI_BLOCKS_SQL = f"""
{TAXI_SQL},
ranged AS (
  SELECT * REPLACE (
           CASE WHEN trip_time_in_secs > 140 AND trip_time_in_secs < 3155 THEN trip_time_in_secs END
             AS trip_time_in_secs,
           CASE WHEN trip_distance > 1.37 AND trip_distance < 29.86 THEN trip_distance END AS trip_distance,
           CASE WHEN fare_amount > 6 AND fare_amount < 201 THEN fare_amount END AS fare_amount,
           CASE WHEN tip_amount > 0.65 AND tip_amount < 38.55 THEN tip_amount END AS tip_amount,
           CASE WHEN tolls_amount > 2.5 AND tolls_amount < 18 THEN tolls_amount END AS tolls_amount),
         (row_number() OVER (PARTITION BY taxi_identifier ORDER BY {TAXI_ORDER_SQL}) - 1) // 5 AS block
  FROM taxi
),
filled AS (
  SELECT * REPLACE (
           coalesce(trip_time_in_secs, avg(trip_time_in_secs) OVER b, 0.0) AS trip_time_in_secs,
           coalesce(trip_distance, avg(trip_distance) OVER b, 0.0) AS trip_distance,
           coalesce(fare_amount, avg(fare_amount) OVER b, 0.0) AS fare_amount,
           coalesce(tolls_amount, avg(tolls_amount) OVER b, 0.0) AS tolls_amount,
           coalesce(total_amount, avg(total_amount) OVER b, 0.0) AS total_amount)
  FROM ranged WINDOW b AS (PARTITION BY taxi_identifier, block)
)"""
_TAXI_FILLED = """round(trip_time_in_secs, 6) AS trip_time_in_secs, round(trip_distance, 6) AS trip_distance,
           round(fare_amount, 8) AS fare_amount, round(tip_amount, 6) AS tip_amount,
           round(tolls_amount, 6) AS tolls_amount, round(total_amount, 8) AS total_amount"""


def _taxi_filled(df):
    digits = {"fare_amount": 8, "total_amount": 8}
    names = (
        "trip_time_in_secs", "trip_distance", "fare_amount", "tip_amount", "tolls_amount", "total_amount",
    )
    return df.withColumns({n: F.round(n, digits.get(n, 6)) for n in names}).select(
        "l_orderkey", "l_linenumber", "taxi_identifier", *names,
        *[c for c in df.columns if c in TAXI.annotation_names],
    )


@query(
    "interpolate_taxi",
    f"WITH {TAXI_BLOCKS_SQL} SELECT l_orderkey, l_linenumber, taxi_identifier, {_TAXI_FILLED} FROM filled",
)
def interpolate_taxi(spark, sf_dir):
    rows = parse_pack(taxi_packs(spark, sf_dir), TAXI)
    rows = materialise(null_out_of_range(rows, TAXI.ranges))
    return _taxi_filled(interpolate_blocks(rows, TAXI.interpolated, ["taxi_identifier"], TAXI_ORDER))


FIT_BLOCKS_SQL = f"""
{FIT_SQL},
ranged AS (
  SELECT * REPLACE (
           CASE WHEN acc_ankle_x BETWEEN -2 AND 30 THEN acc_ankle_x END AS acc_ankle_x,
           CASE WHEN acc_ankle_y BETWEEN -2 AND 30 THEN acc_ankle_y END AS acc_ankle_y,
           CASE WHEN acc_ankle_z BETWEEN -2 AND 30 THEN acc_ankle_z END AS acc_ankle_z),
         (row_number() OVER (PARTITION BY "subjectId" ORDER BY ts, event_id) - 1) // 5 AS block
  FROM fit
),
filled AS (
  SELECT * REPLACE (
           coalesce(acc_ankle_x, avg(acc_ankle_x) OVER b, 0.0) AS acc_ankle_x,
           coalesce(acc_ankle_y, avg(acc_ankle_y) OVER b, 0.0) AS acc_ankle_y,
           coalesce(acc_ankle_z, avg(acc_ankle_z) OVER b, 0.0) AS acc_ankle_z)
  FROM ranged WINDOW b AS (PARTITION BY "subjectId", block)
)"""


@query(
    "interpolate_fit",
    f"""
    WITH {FIT_BLOCKS_SQL}
    SELECT event_id, "subjectId", round(acc_ankle_x, 8) AS acc_ankle_x,
           round(acc_ankle_y, 8) AS acc_ankle_y, round(acc_ankle_z, 8) AS acc_ankle_z FROM filled
    """,
)
def interpolate_fit(spark, sf_dir):
    rows = parse_pack(fit_packs(spark, sf_dir), FIT)
    rows = materialise(null_out_of_range(rows, FIT.ranges))
    filled = interpolate_blocks(rows, FIT.interpolated, ["subjectId"], EVENT_ORDER)
    return rounded(filled.select("event_id", "subjectId", *FIT.interpolated), 8)


@query(
    "interpolate_one_global_key",
    f"""
    WITH {GRID_SQL},
    ranged AS (
      SELECT event_id, CASE WHEN grid_measurement BETWEEN 0.08 AND 0.95 THEN grid_measurement END AS m,
             (row_number() OVER (ORDER BY ts, event_id) - 1) // 5 AS block FROM grid
    )
    SELECT event_id, round(coalesce(m, avg(m) OVER (PARTITION BY block), 0.0), 8) AS grid_measurement
    FROM ranged
    """,
)
def interpolate_one_global_key(spark, sf_dir):
    """All sensors in one order, as a single-key job would see them."""
    rows = null_out_of_range(parse_pack(grid_packs(spark, sf_dir), GRID), GRID.ranges)
    filled = interpolate_blocks(rows, GRID.interpolated, [], EVENT_ORDER)
    return rounded(filled.select("event_id", "grid_measurement"), 8)


def _house_dimension(spark, sf_dir):
    customer, nation = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    joined = customer.join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.col("c_custkey").cast("double").alias("id"),
        F.col("n_name").alias("house_id"),
        F.col("c_name").alias("ownerFullName"),
    )


HOUSE_SQL = """
house AS (
  SELECT CAST(c_custkey AS DOUBLE) AS id, n_name AS house_id, c_name AS "ownerFullName"
  FROM customer JOIN nation ON c_nationkey = n_nationkey
)"""


@query(
    "annotate_grid",
    f"""
    WITH {GRID_SQL}, {HOUSE_SQL}
    SELECT event_id, grid.id AS id, house_id, "ownerFullName" FROM grid LEFT JOIN house ON grid.id = house.id
    """,
)
def annotate_grid(spark, sf_dir):
    rows = parse_pack(grid_packs(spark, sf_dir), GRID).select("event_id", "id")
    return annotate(rows, _house_dimension(spark, sf_dir), ["id"])


@query(
    "annotate_taxi",
    """
    SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS taxi_identifier,
           r_name AS taxi_company, s_name AS driver_name, n_name AS taxi_city
    FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey
    LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey
    """,
)
def annotate_taxi(spark, sf_dir):
    rows = parse_pack(taxi_packs(spark, sf_dir), TAXI).select(
        "l_orderkey", "l_linenumber", "taxi_identifier"
    )
    return annotate(rows, _taxi_dimension(spark, sf_dir), ["taxi_identifier"])


def _taxi_dimension(spark, sf_dir):
    joined = (
        table(spark, sf_dir, "supplier")
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.select(
        F.col("s_suppkey").cast("string").alias("taxi_identifier"),
        F.col("r_name").alias("taxi_company"),
        F.col("s_name").alias("driver_name"),
        F.col("n_name").alias("taxi_city"),
    )


def _pick_sql(column: str, key: str, values: tuple[str, ...]) -> str:
    number = f"CAST('0x' || substr(md5('{column}:' || {key}), 1, 8) AS BIGINT) % {len(values)}"
    cases = " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values))
    return f"CASE {number} {cases} END"


@query(
    "annotate_by_choice",
    f"""
    WITH {FIT_SQL}
    SELECT event_id, "subjectId", {_pick_sql("age", '"subjectId"', ("2.0::DOUBLE", "5.0::DOUBLE", "60.0::DOUBLE"))} AS age,
           {_pick_sql("name", '"subjectId"', ("'John'", "'Jane'", "'Hans'"))} AS name
    FROM fit
    """,
)
def annotate_by_choice_query(spark, sf_dir):
    rows = parse_pack(fit_packs(spark, sf_dir), FIT).select("event_id", "subjectId")
    return annotate_by_choice(rows, FIT, "subjectId")


@query(
    "etl_grid",
    f"""
    WITH {GRID_BLOCKS_SQL}, {HOUSE_SQL}
    SELECT event_id, filled.id AS id, round(grid_measurement, 8) AS grid_measurement, "timestamp",
           house_id, "ownerFullName"
    FROM filled LEFT JOIN house ON filled.id = house.id
    """,
)
def etl_grid(spark, sf_dir):
    rows = clean(
        grid_packs(spark, sf_dir), GRID, EVENT_ORDER, dimension=_house_dimension(spark, sf_dir)
    )
    return rounded(rows.drop("ts"), 8)


@query(
    "etl_taxi",
    f"""
    WITH {TAXI_SQL.replace("FROM lineitem", "FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)")
          + TAXI_BLOCKS_SQL[len(TAXI_SQL) + 1:]},
    dim AS (
      SELECT CAST(s_suppkey AS VARCHAR) AS sid, r_name AS taxi_company, s_name AS driver_name,
             n_name AS taxi_city
      FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    )
    SELECT l_orderkey, l_linenumber, taxi_identifier, {_TAXI_FILLED}, taxi_company, driver_name, taxi_city
    FROM filled LEFT JOIN dim ON taxi_identifier = sid
    """,
)
def etl_taxi(spark, sf_dir):
    """Known taxis only: suppliers with a positive balance."""
    known = (
        table(spark, sf_dir, "supplier")
        .filter(F.col("s_acctbal") > 0)
        .select(F.col("s_suppkey").cast("string").alias("taxi_identifier"))
    )
    rows = clean(
        taxi_packs(spark, sf_dir), TAXI, TAXI_ORDER, members=known,
        dimension=_taxi_dimension(spark, sf_dir),
    )
    return _taxi_filled(rows)


@query(
    "etl_fit",
    f"""
    WITH {FIT_BLOCKS_SQL}
    SELECT event_id, "subjectId", round(acc_ankle_x, 8) AS acc_ankle_x,
           round(acc_ankle_y, 8) AS acc_ankle_y, round(acc_ankle_z, 8) AS acc_ankle_z,
           {_pick_sql("age", '"subjectId"', ("2.0::DOUBLE", "5.0::DOUBLE", "60.0::DOUBLE"))} AS age,
           {_pick_sql("name", '"subjectId"', ("'John'", "'Jane'", "'Hans'"))} AS name
    FROM filled
    """,
)
def etl_fit(spark, sf_dir):
    """Cleaned, written as a pack and read back with its annotation."""
    rows = clean(fit_packs(spark, sf_dir), FIT, EVENT_ORDER)
    back = parse_pack(packed(rows, FIT, ["event_id"]), FIT, annotated=True)
    return rounded(back.select("event_id", "subjectId", *FIT.interpolated, "age", "name"), 8)


@query(
    "etl_sys",
    f"""
    WITH {SYS_SQL},
    ranged AS (
      SELECT event_id, source,
             CASE WHEN temperature BETWEEN -12.5 AND 43.1 THEN temperature END AS temperature,
             CASE WHEN humidity BETWEEN 10.7 AND 95.2 THEN humidity END AS humidity,
             CASE WHEN dust BETWEEN 186.61 AND 5188.21 THEN dust END AS dust,
             (row_number() OVER (PARTITION BY source ORDER BY ts, event_id) - 1) // 5 AS block
      FROM sys
    )
    SELECT event_id, source,
           round(coalesce(temperature, avg(temperature) OVER b, 0.0), 8) AS temperature,
           round(coalesce(humidity, avg(humidity) OVER b, 0.0), 8) AS humidity,
           round(coalesce(dust, avg(dust) OVER b, 0.0), 8) AS dust
    FROM ranged WINDOW b AS (PARTITION BY source, block)
    """,
)
def etl_sys(spark, sf_dir):
    rows = clean(sys_packs(spark, sf_dir), SYS, EVENT_ORDER)
    return rounded(rows.select("event_id", "source", "temperature", "humidity", "dust"), 8)
