"""Queries: block aggregates, Kalman filter, sliding regression, plotted series."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.senml import parse_pack
from tideline.operators.blocks import block_sketches, block_stats, latest_block_mean, observations, united_distinct
from tideline.operators.kalman import kalman, kalman_sequenced
from tideline.operators.regression import PREDICTIONS, horizon_mean, sliding_regression
from tideline.operators.sequence import SEQ, sequence
from tideline.plans.stats import averages, distinct_counts, forecasts, report
from tideline.session import materialise
from tideline.specs import FIT, GRID, TAXI
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    EVENT_ORDER,
    FIT_SQL,
    TAXI_ORDER,
    TAXI_ORDER_SQL,
    TAXI_SQL,
    events,
    fit_packs,
    grid_of,
    rounded,
    table,
    taxi_packs,
    taxi_rides,
)

# Positions of events per user, for the SQL twins.
NUMBERED = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events
)"""


@query(
    "row_numbers",
    f"WITH {NUMBERED} SELECT event_id, user_id, seq FROM numbered",
)
def row_numbers(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return sequence(rows, ["user_id"], EVENT_ORDER).rows.drop("ts")


@query(
    "count_blocks",
    f"""
    WITH {NUMBERED}
    SELECT user_id, (seq - 1) // 5 AS block, count(*) AS rows, max(event_id) AS last_event
    FROM numbered GROUP BY ALL
    """,
)
def count_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    blocks = sequence(rows, ["user_id"], EVENT_ORDER).blocks(5)
    return blocks.groupBy("user_id", "block").agg(
        F.count(F.lit(1)).alias("rows"), F.max("event_id").alias("last_event")
    )


@query(
    "block_average_grid",
    f"""
    WITH {NUMBERED}
    SELECT CAST(user_id AS DOUBLE) AS id, (seq - 1) // 5 AS block, count(*) AS rows,
           arg_max(event_id, seq) AS event_id, round(avg(value / 500.0), 8) AS mean
    FROM numbered GROUP BY ALL
    """,
)
def block_average_grid(spark, sf_dir):
    rows = grid_of(events(spark, sf_dir))
    return rounded(averages(rows, GRID, ["id"], EVENT_ORDER).drop("ts", "last_seq"), 8)


@query(
    "block_average_taxi",
    f"""
    WITH {TAXI_SQL},
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY taxi_identifier ORDER BY {TAXI_ORDER_SQL}) AS seq FROM taxi
    )
    SELECT taxi_identifier, (seq - 1) // 5 AS block, count(*) AS rows, round(avg(trip_distance), 6) AS mean
    FROM numbered GROUP BY ALL
    """,
)
def block_average_taxi(spark, sf_dir):
    rows = materialise(parse_pack(taxi_packs(spark, sf_dir), TAXI))
    means = averages(rows, TAXI, ["taxi_identifier"], TAXI_ORDER)
    return rounded(means.select("taxi_identifier", "block", "rows", "mean"))


@query(
    "block_average_fit",
    f"""
    WITH {FIT_SQL},
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY "subjectId" ORDER BY ts, event_id) AS seq FROM fit
    )
    SELECT "subjectId", (seq - 1) // 5 AS block, count(*) AS rows,
           round(avg(CASE WHEN acc_ankle_x BETWEEN -2 AND 30 THEN acc_ankle_x ELSE 0.0 END), 8) AS mean
    FROM numbered GROUP BY ALL
    """,
)
def block_average_fit(spark, sf_dir):
    """Values out of range are missing and count as 0.0."""
    rows = materialise(parse_pack(fit_packs(spark, sf_dir), FIT))
    rows = rows.withColumn(
        "acc_ankle_x", F.when(F.col("acc_ankle_x").between(-2, 30), F.col("acc_ankle_x"))
    )
    means = averages(rows, FIT, ["subjectId"], EVENT_ORDER)
    return rounded(means.select("subjectId", "block", "rows", "mean"), 8)


@query(
    "block_distinct_grid",
    f"""
    WITH numbered AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS seq FROM events)
    SELECT (seq - 1) // 5 AS block, count(*) AS rows, count(DISTINCT user_id) AS distinct_values
    FROM numbered GROUP BY ALL
    """,
)
def block_distinct_grid(spark, sf_dir):
    """Different meters among five consecutive readings of the whole stream."""
    rows = grid_of(events(spark, sf_dir))
    counts = distinct_counts(rows, GRID, [], EVENT_ORDER)
    return counts.select("block", "rows", "distinct_values")


@query(
    "block_distinct_taxi",
    f"""
    WITH {TAXI_SQL},
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY payment_type ORDER BY {TAXI_ORDER_SQL}, taxi_identifier) AS seq
      FROM taxi
    )
    SELECT payment_type, (seq - 1) // 5 AS block,
           count(DISTINCT taxi_identifier) AS distinct_values
    FROM numbered GROUP BY ALL
    """,
)
def block_distinct_taxi(spark, sf_dir):
    rows = materialise(parse_pack(taxi_packs(spark, sf_dir), TAXI))
    counts = distinct_counts(rows, TAXI, ["payment_type"], [*TAXI_ORDER, "taxi_identifier"])
    return counts.select("payment_type", "block", "distinct_values")


@query(
    "block_distinct_fit",
    f"""
    WITH {FIT_SQL},
    numbered AS (
      SELECT CASE WHEN label <> 3 THEN "subjectId" END AS s, label,
             row_number() OVER (PARTITION BY label ORDER BY ts, event_id) AS seq FROM fit
    )
    SELECT label, (seq - 1) // 5 AS block,
           count(DISTINCT s) + max(CASE WHEN s IS NULL THEN 1 ELSE 0 END) AS distinct_values
    FROM numbered GROUP BY ALL
    """,
)
def block_distinct_fit(spark, sf_dir):
    """A missing subject is one more value."""
    rows = materialise(parse_pack(fit_packs(spark, sf_dir), FIT))
    rows = rows.withColumn("subjectId", F.when(F.col("label") != 3, F.col("subjectId")))
    counts = distinct_counts(rows, FIT, ["label"], EVENT_ORDER)
    return counts.select("label", "block", "distinct_values")


@query("approximate_distinct")
def approximate_distinct(spark, sf_dir):
    """Approximate number of sensors per type; the sketch merges before the shuffle."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.approx_count_distinct("user_id", 0.05).alias("sensors")
    )


@query(
    "distinct_sketches",
    """
    SELECT event_type, (count(*) + 999) // 1000 AS blocks, TRUE AS within, count(*) AS rows FROM events GROUP BY event_type
    """,
)
def distinct_sketches(spark, sf_dir):
    """Sketches per block of 1000 events, united per type: within three standard errors of the exact count."""
    rows = table(spark, sf_dir, "events")
    stored = block_sketches(rows, ["event_type"], EVENT_ORDER, "user_id", 1024, 1000)
    sizes = stored.groupBy("event_type").agg(F.count(F.lit(1)).alias("blocks"), F.sum("rows").alias("rows"))
    exact = rows.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"))
    both = united_distinct(stored, ["event_type"]).join(exact, "event_type").join(sizes, "event_type")
    error = F.abs(F.col("distinct_values") - F.col("exact")) / F.col("exact")
    return both.select("event_type", "blocks", (error <= 3 * 1.04 / 32).alias("within"), "rows")


# The filter as a step-by-step recursion.
KALMAN_SQL = f"""
{NUMBERED},
filtered AS (
  SELECT event_id, user_id, seq,
         (0.125 / (0.125 + 0.32)) * value AS estimate,
         (1 - 0.125 / (0.125 + 0.32)) * 0.125 AS p
  FROM numbered WHERE seq = 1
  UNION ALL
  SELECT n.event_id, n.user_id, n.seq,
         f.estimate + (f.p + 0.125) / (f.p + 0.125 + 0.32) * (n.value - f.estimate),
         (1 - (f.p + 0.125) / (f.p + 0.125 + 0.32)) * (f.p + 0.125)
  FROM filtered f JOIN numbered n ON n.user_id = f.user_id AND n.seq = f.seq + 1
)"""


@query(
    "kalman",
    f"WITH RECURSIVE {KALMAN_SQL} SELECT event_id, user_id, round(estimate, 6) AS value FROM filtered",
)
def kalman_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = kalman(rows, "value", ["user_id"], EVENT_ORDER)
    return rounded(out.select("event_id", "user_id", "value"))


@query(
    "kalman_final",
    f"""
    WITH RECURSIVE {KALMAN_SQL}
    SELECT user_id, max(seq) AS seq, round(arg_max(estimate, seq), 6) AS estimate
    FROM filtered GROUP BY user_id
    """,
)
def kalman_final(spark, sf_dir):
    """Last estimate of every sensor."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    numbered = sequence(rows, ["user_id"], EVENT_ORDER)
    out = kalman_sequenced(numbered, "value", "estimate").groupBy("user_id").agg(
        F.max(SEQ).alias("seq"), F.max_by("estimate", SEQ).alias("estimate")
    )
    return rounded(out)


FIT_LINE = """
lined AS (
  SELECT event_id, user_id, seq, ts,
         regr_slope({y}, CAST(seq AS DOUBLE)) OVER w AS slope, avg({y}) OVER w AS mean,
         count(*) OVER w AS n
  FROM {source}
  WINDOW w AS (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)
)"""


@query(
    "sliding_regression",
    f"""
    WITH {NUMBERED}, {FIT_LINE.format(y="value", source="numbered")}
    SELECT event_id, user_id, h AS ahead, round(mean + slope * (h + (n - 1) / 2.0), 6) AS prediction
    FROM lined CROSS JOIN (SELECT unnest(range(1, 11)) AS h) WHERE n > 1
    """,
)
def sliding_regression_query(spark, sf_dir):
    """Ten predictions per row, one output row each."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    fitted = sliding_regression(sequence(rows, ["user_id"], EVENT_ORDER), "value")
    points = fitted.select("event_id", "user_id", F.posexplode(PREDICTIONS).alias("ahead", "prediction"))
    return rounded(points.withColumn("ahead", (F.col("ahead") + 1).cast("bigint")))


@query(
    "horizon_mean",
    f"""
    WITH {NUMBERED}, {FIT_LINE.format(y="value", source="numbered")}
    SELECT event_id, round(CASE WHEN n > 1 THEN mean + slope * (5.5 + (n - 1) / 2.0) END, 6) AS horizon_mean
    FROM lined
    """,
)
def horizon_mean_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    fitted = sliding_regression(sequence(rows, ["user_id"], EVENT_ORDER), "value")
    return rounded(fitted.select("event_id", horizon_mean(F.col(PREDICTIONS)).alias("horizon_mean")))


@query(
    "stats_forecast_grid",
    f"""
    WITH RECURSIVE {KALMAN_SQL},
    estimates AS (SELECT f.*, n.ts FROM filtered f JOIN numbered n USING (event_id)),
    {FIT_LINE.format(y="estimate", source="estimates")}
    SELECT event_id, lined.user_id AS user_id, lined.seq AS seq, round(estimate, 6) AS estimate,
           round(CASE WHEN n > 1 THEN mean + slope * (5.5 + (n - 1) / 2.0) END, 6) AS horizon_mean
    FROM lined JOIN filtered USING (event_id)
    """,
)
def stats_forecast_grid(spark, sf_dir):
    """Filter, sliding regression on the filtered values, mean of the predictions."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", F.col("value").alias("grid_measurement")
    )
    out = forecasts(rows, GRID, ["user_id"], EVENT_ORDER)
    return rounded(out.select("event_id", "user_id", "seq", "estimate", "horizon_mean"))


@query(
    "series_average",
    f"""
    WITH {NUMBERED},
    blocks AS (
      SELECT user_id, (seq - 1) // 5 AS block, arg_max(event_id, seq) AS event_id,
             round(avg(value / 500.0), 8) AS mean
      FROM numbered GROUP BY ALL
    )
    SELECT CAST(user_id AS DOUBLE) AS id, block // 10 AS series, block % 10 AS place, event_id, mean AS value
    FROM blocks
    """,
)
def series_average(spark, sf_dir):
    """Plotted points of the block means, one row per point in series order."""
    return rounded(_points(_report(spark, sf_dir)["average"]), 8)


@query(
    "series_distinct",
    f"""
    WITH {NUMBERED},
    blocks AS (
      SELECT user_id, (seq - 1) // 5 AS block, arg_max(event_id, seq) AS event_id,
             count(DISTINCT user_id) AS n
      FROM numbered GROUP BY ALL
    )
    SELECT CAST(user_id AS DOUBLE) AS id, block // 10 AS series, block % 10 AS place, event_id, n AS value
    FROM blocks
    """,
)
def series_distinct(spark, sf_dir):
    return _points(_report(spark, sf_dir)["distinct"])


@query(
    "series_forecast",
    f"""
    WITH RECURSIVE {KALMAN_SQL.replace("FROM events", "FROM (SELECT * REPLACE (value / 500.0 AS value) FROM events)")},
    estimates AS (SELECT f.*, n.ts FROM filtered f JOIN numbered n USING (event_id)),
    {FIT_LINE.format(y="estimate", source="estimates")}
    SELECT CAST(user_id AS DOUBLE) AS id, (seq - 1) // 10 AS series, (seq - 1) % 10 AS place, event_id,
           round(CASE WHEN n > 1 THEN mean + slope * (5.5 + (n - 1) / 2.0) END, 6) AS value
    FROM lined
    """,
)
def series_forecast(spark, sf_dir):
    return rounded(_points(_report(spark, sf_dir)["forecast"]))


def _report(spark, sf_dir):
    return report(grid_of(events(spark, sf_dir)), GRID, ["id"], EVENT_ORDER)


def _points(df):
    point = df.select("id", "series", F.posexplode("points").alias("place", "p"))
    return point.select(
        "id",
        "series",
        F.col("place").cast("bigint").alias("place"),
        F.col("p.event_id").alias("event_id"),
        F.col("p.value").alias("value"),
    )


TYPED = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seq FROM events
)"""


@query(
    "keyed_block_average",
    f"""
    WITH {TYPED}
    SELECT user_id, event_type, (seq - 1) // 5 AS block, arg_max(event_id, seq) AS event_id,
           round(avg(value), 6) AS mean
    FROM numbered GROUP BY user_id, event_type, (seq - 1) // 5 HAVING count(*) = 5
    """,
)
def keyed_block_average(spark, sf_dir):
    """Mean of every whole block of five per sensor and observation type."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    means = block_stats(
        rows, ["user_id", "event_type"], EVENT_ORDER, mean_of="value", full_only=True
    )
    return rounded(means.select("user_id", "event_type", "block", "event_id", "mean"))


@query(
    "keyed_block_average_taxi",
    f"""
    WITH {TAXI_SQL},
    long AS (
      SELECT {TAXI_ORDER_SQL}, taxi_identifier, obs_type, value
      FROM taxi UNPIVOT (value FOR obs_type IN (trip_time_in_secs, trip_distance, fare_amount, surcharge,
                                                mta_tax, tip_amount, tolls_amount, total_amount))
    ),
    numbered AS (
      SELECT *, row_number() OVER (PARTITION BY taxi_identifier, obs_type ORDER BY {TAXI_ORDER_SQL}) AS seq
      FROM long
    )
    SELECT taxi_identifier, obs_type, (seq - 1) // 5 AS block, round(avg(value), 8) AS mean
    FROM numbered GROUP BY ALL HAVING count(*) = 5
    """,
)
def keyed_block_average_taxi(spark, sf_dir):
    """Blocks are numbered and averaged by ride, and taken apart by type with a fifth of the rows."""
    types = TAXI.averaged_types
    rides = taxi_rides(spark, sf_dir).select("taxi_identifier", *TAXI_ORDER, *types)
    blocks = block_stats(rides, ["taxi_identifier"], TAXI_ORDER, mean_of=types, full_only=True)
    means = observations(blocks, types, ["taxi_identifier", "block"]).withColumnRenamed("value", "mean")
    return rounded(means.select("taxi_identifier", "obs_type", "block", "mean"), 8)


@query(
    "latest_average",
    f"""
    WITH {TYPED},
    blocks AS (
      SELECT user_id, event_type, (seq - 1) // 5 AS block, avg(value) AS mean
      FROM numbered GROUP BY ALL HAVING count(*) = 5
    )
    SELECT event_id, n.user_id AS user_id, n.event_type AS event_type, round(mean, 6) AS average
    FROM numbered n LEFT JOIN blocks b
      ON b.user_id = n.user_id AND b.event_type = n.event_type AND b.block = n.seq // 5 - 1
    """,
)
def latest_average(spark, sf_dir):
    """For every row the mean of the last whole block of its series."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", "value")
    numbered = sequence(rows, ["user_id", "event_type"], EVENT_ORDER)
    out = latest_block_mean(numbered, "value", "average")
    return rounded(out.select("event_id", "user_id", "event_type", "average"))
