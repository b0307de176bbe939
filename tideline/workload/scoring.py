"""Queries: models, scoring, error estimate, published results."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions.senml import parse_pack
from tideline.operators.joins import asof_join
from tideline.operators.scoring import (
    Split,
    class_name,
    error_estimate,
    latency_ms,
    latency_summary,
    linear_score,
    result_message,
    tree_score,
)
from tideline.operators.sequence import sequence
from tideline.operators.blocks import latest_block_mean
from tideline.plans.pred import parse_messages, published, score, with_models
from tideline.session import materialise
from tideline.sources.registry import control_messages, latest_models
from tideline.sources.topics import message_ids
from tideline.specs import SYS, TAXI
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    EVENT_ORDER,
    SYS_SQL,
    TAXI_ORDER,
    TAXI_ORDER_SQL,
    TAXI_SQL,
    events,
    rounded,
    sys_packs,
    table,
    taxi_packs,
    taxi_rides,
)

# A small tree over the taxi features, used by the queries below.
TAXI_TREE = Split(
    "fare_amount",
    60.0,
    Split("trip_distance", 9.0, 0, 1),
    Split("trip_time_in_secs", 2100.0, 1, 2),
)
TAXI_TREE_SQL = """
CASE WHEN fare_amount <= 60 THEN CASE WHEN trip_distance <= 9 THEN 0 ELSE 1 END
     ELSE CASE WHEN trip_time_in_secs <= 2100 THEN 1 ELSE 2 END END"""

MODELS_SQL = """
models AS (
  SELECT CASE WHEN n_nationkey % 3 = 2 THEN 'DTC' ELSE 'MLR' END AS kind,
         CAST(epoch_us(TIMESTAMP '2024-01-01') + n_nationkey * 86400000000 + 43200000000 AS BIGINT) AS since,
         n_nationkey * 0.5::DOUBLE AS b0, n_regionkey * 0.25::DOUBLE AS b1
  FROM nation
)"""


def _models(spark, sf_dir):
    start = 1704067200000000 + 43200000000
    return table(spark, sf_dir, "nation").select(
        F.when(F.col("n_nationkey") % 3 == 2, "DTC").otherwise("MLR").alias("kind"),
        (F.lit(start) + F.col("n_nationkey").cast("bigint") * 86400000000).alias("since"),
        (F.col("n_nationkey") * 0.5).alias("intercept"),
        F.array(F.col("n_regionkey") * 0.25).alias("weights"),
    )


@query(
    "control_messages",
    """
    SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 2 THEN 'DTC' ELSE 'MLR' END AS kind,
           'TAXI-' || CASE WHEN n_nationkey % 3 = 2 THEN 'DTC' ELSE 'MLR' END || '-' ||
             CAST(n_nationkey AS VARCHAR) || '.model' AS path
    FROM nation
    """,
)
def control_messages_query(spark, sf_dir):
    rows = table(spark, sf_dir, "nation")
    kind = F.when(F.col("n_nationkey") % 3 == 2, "DTC").otherwise("MLR")
    text = F.concat(
        F.lit("TAXI-"), kind, F.lit("-"), F.col("n_nationkey").cast("string"), F.lit(".model")
    )
    return control_messages(rows.select("n_nationkey", text.alias("value")))


@query(
    "latest_model",
    """
    SELECT 'model-' || CAST(o_custkey AS VARCHAR) AS name, max(o_orderkey) AS created_at,
           arg_max(o_totalprice, o_orderkey) AS intercept
    FROM orders GROUP BY o_custkey
    """,
)
def latest_model(spark, sf_dir):
    """Orders as model versions, customers as model names: the newest version of each."""
    versions = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("model-"), F.col("o_custkey").cast("string")).alias("name"),
        F.col("o_orderkey").alias("created_at"),
        F.col("o_totalprice").alias("intercept"),
    )
    return latest_models(versions)


@query(
    "asof_model",
    f"""
    WITH {MODELS_SQL},
    mlr AS (SELECT * FROM models WHERE kind = 'MLR'),
    e AS (SELECT event_id, epoch_us(ts) AS at_us FROM events)
    SELECT event_id, at_us, b0, b1 FROM e ASOF LEFT JOIN mlr ON e.at_us >= mlr.since
    """,
)
def asof_model(spark, sf_dir):
    """Every event with the regression model in force at its time."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    )
    out = with_models(rows, _models(spark, sf_dir), "at_us")
    return out.select("event_id", "at_us", F.col("intercept").alias("b0"), F.col("weights")[0].alias("b1"))


@query(
    "asof_series",
    """
    WITH c AS (SELECT user_id, epoch_us(ts) AS since, value AS last_purchase FROM events
               WHERE event_type = 'purchase'),
    e AS (SELECT event_id, user_id, epoch_us(ts) AS at_us FROM events WHERE event_type <> 'purchase')
    SELECT event_id, e.user_id AS user_id, at_us, last_purchase
    FROM e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.at_us >= c.since
    """,
)
def asof_series(spark, sf_dir):
    """Latest purchase value of the same user, for every other event."""
    all_events = table(spark, sf_dir, "events").withColumn(
        "at_us", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    purchases = all_events.filter("event_type = 'purchase'").select(
        "user_id", F.col("at_us").alias("since"), F.col("value").alias("last_purchase")
    )
    others = all_events.filter("event_type <> 'purchase'").select("event_id", "user_id", "at_us")
    return asof_join(others, purchases, ["user_id"], "at_us", ["last_purchase"])


@query(
    "linear_score",
    f"""
    WITH {TAXI_SQL}
    SELECT l_orderkey, l_linenumber, taxi_identifier,
           CAST(trunc(2.5::DOUBLE + 0.01::DOUBLE * trip_time_in_secs + 1.75::DOUBLE * trip_distance) AS DOUBLE)
             AS res
    FROM taxi
    """,
)
def linear_score_query(spark, sf_dir):
    rows = parse_pack(taxi_packs(spark, sf_dir), TAXI)
    res = linear_score(
        ["trip_time_in_secs", "trip_distance"], F.lit(2.5), [F.lit(0.01), F.lit(1.75)]
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "taxi_identifier", res.cast("double").alias("res")
    )


@query(
    "linear_score_asof",
    f"""
    WITH {MODELS_SQL},
    mlr AS (SELECT * FROM models WHERE kind = 'MLR'),
    e AS (SELECT event_id, epoch_us(ts) AS at_us, value FROM events)
    SELECT event_id, CAST(trunc(b0 + b1 * value) AS DOUBLE) AS res
    FROM e ASOF JOIN mlr ON e.at_us >= mlr.since
    """,
)
def linear_score_asof(spark, sf_dir):
    """Score with the coefficients in force; rows before the first model give no result."""
    rows = table(spark, sf_dir, "events").select(
        "event_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us")
    )
    models = with_models(rows, _models(spark, sf_dir), "at_us")
    res = linear_score(["value"], F.col("intercept"), [F.col("weights")[0]])
    return models.select("event_id", res.cast("double").alias("res")).filter("res IS NOT NULL")


@query(
    "tree_score",
    f"""
    WITH {TAXI_SQL}, scored AS (SELECT *, {TAXI_TREE_SQL} AS c FROM taxi)
    SELECT l_orderkey, l_linenumber, taxi_identifier, CAST(c AS DOUBLE) AS res,
           CASE c WHEN 0 THEN 'Bad' WHEN 1 THEN 'Good' ELSE 'VeryGood' END AS class_name
    FROM scored
    """,
)
def tree_score_query(spark, sf_dir):
    rows = parse_pack(taxi_packs(spark, sf_dir), TAXI).withColumn("res", tree_score(TAXI_TREE))
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "taxi_identifier",
        F.col("res").cast("double").alias("res"),
        class_name(F.col("res"), TAXI.classes).alias("class_name"),
    )


ERROR_SQL = f"""
{TAXI_SQL},
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY taxi_identifier ORDER BY {TAXI_ORDER_SQL}) AS seq FROM taxi
),
blocks AS (
  SELECT taxi_identifier, (seq - 1) // 5 AS block, avg(fare_amount) AS average
  FROM numbered GROUP BY ALL HAVING count(*) = 5
),
predicted AS (
  SELECT n.*, average, CAST(trunc(2.5::DOUBLE + 0.01::DOUBLE * trip_time_in_secs
                                  + 1.75::DOUBLE * trip_distance) AS DOUBLE) AS res
  FROM numbered n LEFT JOIN blocks b
    ON n.taxi_identifier = b.taxi_identifier AND b.block = n.seq // 5 - 1
)"""


@query(
    "error_estimate",
    f"""
    WITH {ERROR_SQL}
    SELECT l_orderkey, l_linenumber, taxi_identifier, res, round((fare_amount - res) / average, 6) AS error
    FROM predicted
    """,
)
def error_estimate_query(spark, sf_dir):
    rows = materialise(parse_pack(taxi_packs(spark, sf_dir), TAXI))
    numbered = sequence(rows, ["taxi_identifier"], TAXI_ORDER)
    averaged = latest_block_mean(numbered, "fare_amount", "average")
    res = linear_score(
        ["trip_time_in_secs", "trip_distance"], F.lit(2.5), [F.lit(0.01), F.lit(1.75)]
    )
    out = averaged.withColumn("res", res.cast("double")).withColumn(
        "error", error_estimate(F.col("fare_amount"), F.col("res"), F.col("average"))
    )
    return rounded(out.select("l_orderkey", "l_linenumber", "taxi_identifier", "res", "error"))


def _results(spark, sf_dir):
    rows = taxi_rides(spark, sf_dir).withColumns(
        {
            "msgid": F.col("l_orderkey") * 10 + F.col("l_linenumber"),
            "arrival": F.col("l_shipdate").cast("timestamp"),
            "timestamp": F.unix_seconds(F.col("l_shipdate").cast("timestamp")),
        }
    )
    return score(
        rows, TAXI, TAXI_ORDER, F.lit(2.5), [F.lit(0.01), F.lit(1.75)], TAXI_TREE
    )


@query(
    "score_results",
    f"""
    WITH {ERROR_SQL}
    SELECT l_orderkey * 10 + l_linenumber AS msgid, taxi_identifier AS sensor_id, 'MLR' AS analytic_type,
           res, round((fare_amount - res) / average, 6) AS error
    FROM predicted
    UNION ALL
    SELECT l_orderkey * 10 + l_linenumber, taxi_identifier, 'DTC', CAST({TAXI_TREE_SQL} AS DOUBLE), NULL
    FROM predicted
    """,
)
def score_results(spark, sf_dir):
    """Regression and tree results of all rides in one long table."""
    table_ = _results(spark, sf_dir)
    return rounded(table_.select("msgid", "sensor_id", "analytic_type", "res", "error"))


@query(
    "result_messages",
    f"""
    WITH {TAXI_SQL},
    meta AS (
      SELECT *, l_orderkey * 10 + l_linenumber AS msgid,
             pickup_datetime || ',' || CAST(CAST(epoch(l_shipdate) AS BIGINT) AS VARCHAR) || ',' ||
             CAST(pickup_longitude AS VARCHAR) || ',' || CAST(pickup_latitude AS VARCHAR) || ',' ||
             CAST(dropoff_longitude AS VARCHAR) || ',' || CAST(dropoff_latitude AS VARCHAR) || ',' ||
             payment_type AS meta,
             {TAXI_TREE_SQL} AS c
      FROM taxi
    )
    SELECT msgid, CAST(msgid AS VARCHAR) || ',' || meta || ',DTC,obsVal:' || taxi_identifier || ',' ||
           hack_license || ',' || CAST(trip_time_in_secs AS VARCHAR) || ',RES:' ||
           CAST(CAST(c AS DOUBLE) AS VARCHAR) AS value
    FROM meta
    """,
)
def result_messages(spark, sf_dir):
    """Published text of the tree results (observed values cut to the first three)."""
    rows = _results(spark, sf_dir).filter(F.col("analytic_type") == "DTC")
    return published(rows.withColumn("obs", F.substring_index("obs", ",", 3)))


@query(
    "result_message_kinds",
    """
    SELECT event_type, count(*) AS rows,
           CAST(sum(CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE 0 END) AS BIGINT) AS messages
    FROM events GROUP BY event_type
    """,
)
def result_message_kinds(spark, sf_dir):
    """Only regression and tree rows carry text."""
    kinds = {"view": "MLR", "click": "DTC"}
    kind = F.coalesce(*[F.when(F.col("event_type") == t, k) for t, k in kinds.items()], F.lit("AVG"))
    rows = table(spark, sf_dir, "events").select(
        "event_type",
        F.col("event_id").alias("msgid"),
        F.lit("m").alias("meta"),
        kind.alias("analytic_type"),
        F.lit("1,2").alias("obs"),
        F.col("value").alias("res"),
        F.col("value").alias("error"),
    )
    text = rows.withColumn("text", result_message(rows))
    return text.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("rows"), F.sum((F.col("text") != "").cast("bigint")).alias("messages")
    )


@query(
    "parse_and_score_sys",
    f"""
    WITH {SYS_SQL}
    SELECT event_id, source, '1358101800000' AS "timestamp",
           CAST(trunc(1 + 0.5::DOUBLE * temperature + 0.25::DOUBLE * humidity + 0.01::DOUBLE * light
                      + 0.1::DOUBLE * dust) AS DOUBLE) AS res
    FROM sys
    """,
)
def parse_and_score_sys(spark, sf_dir):
    """Envelope, typed row, four-feature regression."""
    rows = parse_messages(sys_packs(spark, sf_dir), SYS)
    weights = [F.lit(0.5), F.lit(0.25), F.lit(0.01), F.lit(0.1)]
    res = linear_score(SYS.training_fields[:-1], F.lit(1.0), weights)
    return rows.select("event_id", "source", "timestamp", res.cast("double").alias("res"))


@query(
    "latency",
    """
    SELECT l_returnflag, count(*) AS measured, min(ms) AS min_ms, max(ms) AS max_ms, round(avg(ms), 4) AS mean_ms
    FROM (SELECT l_returnflag, epoch_ms(l_shipdate) - epoch_ms(o_orderdate) AS ms
          FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 100 = 0)
    GROUP BY l_returnflag
    """,
)
def latency(spark, sf_dir):
    """Order time as arrival, ship time as sink time; every hundredth order is stamped."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 100 == 0, F.col("o_orderdate").cast("timestamp")).alias("arrival"),
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_shipdate")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    measured = joined.withColumn(
        "ms", latency_ms(F.col("l_shipdate").cast("timestamp"), F.col("arrival"))
    )
    return rounded(latency_summary(measured.groupBy("l_returnflag"), "ms"), 4)


@query(
    "message_ids",
    "SELECT count(*) AS messages, count(DISTINCT event_id) AS different_ids FROM events",
)
def message_ids_query(spark, sf_dir):
    ids = message_ids(table(spark, sf_dir, "events").select("event_id"))
    return ids.agg(
        F.count(F.lit(1)).alias("messages"), F.count_distinct("msgid").alias("different_ids")
    )


@query(
    "union_results",
    """
    SELECT o_orderkey AS msgid, 'orders' AS source, o_totalprice AS res FROM orders
    UNION ALL SELECT event_id, 'events', value FROM events
    """,
)
def union_results(spark, sf_dir):
    left = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("msgid"), F.lit("orders").alias("source"), F.col("o_totalprice").alias("res")
    )
    right = table(spark, sf_dir, "events").select(
        F.col("value").alias("res"), F.col("event_id").alias("msgid"), F.lit("events").alias("source")
    )
    return left.unionByName(right)
