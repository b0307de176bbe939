"""Queries: training requests, range join, labels, regression and tree models."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.c45 import train_c45
from tideline.operators.joins import range_join
from tideline.operators.training import (
    annotate_quartiles,
    fit_tree,
    model_name,
    quartile_bounds,
    train_linear,
    train_linear_1f,
    training_projection,
)
from tideline.operators.trees import score_trees, train_trees
from tideline.plans.train import REQUEST, run, train_labelled_trees, train_regressions, training_rows
from tideline.session import scratch_path
from tideline.sources.files import range_scan, training_requests
from tideline.sources.registry import Registry
from tideline.specs import FIT, QUARTILE_LABELS, SYS, TAXI
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    FIT_SQL,
    REQUEST_SQL,
    SYS_SQL,
    TAXI_SQL,
    events,
    fit_of,
    requests,
    rounded,
    sys_of,
    table,
    taxi_rides,
)

IN_RANGE = "epoch_ms({t}.ts) >= row_start AND epoch_ms({t}.ts) < row_end"


def _millis(rows):
    return rows.withColumn("time_ms", F.unix_millis(F.col("ts").cast("timestamp")))


def _requests(spark, sf_dir):
    return training_requests(requests(spark, sf_dir))


@query("training_requests", f"WITH {REQUEST_SQL} SELECT * FROM requests")
def training_requests_query(spark, sf_dir):
    return _requests(spark, sf_dir)


@query(
    "range_scan",
    """
    SELECT event_id, event_type, value FROM events
    WHERE event_type = 'view' AND epoch_ms(ts) >= 1704499200000 AND epoch_ms(ts) < 1705708800000
    """,
)
def range_scan_query(spark, sf_dir):
    """One partition value and a time range."""
    rows = _millis(table(spark, sf_dir, "events"))
    found = range_scan(rows, "time_ms", 1704499200000, 1705708800000, ("event_type", "view"))
    return found.select("event_id", "event_type", "value")


@query(
    "range_join",
    f"""
    WITH {REQUEST_SQL}
    SELECT msgid, event_id, user_id, value FROM requests JOIN events e ON {IN_RANGE.format(t="e")}
    """,
)
def range_join_query(spark, sf_dir):
    history = _millis(table(spark, sf_dir, "events")).select("event_id", "user_id", "value", "time_ms")
    out = range_join(_requests(spark, sf_dir), history, "time_ms")
    return out.select("msgid", "event_id", "user_id", "value")


@query(
    "range_join_per_type",
    f"""
    WITH {REQUEST_SQL}, typed AS (SELECT *, CASE msgid % 2 WHEN 0 THEN 'view' ELSE 'click' END AS event_type FROM requests)
    SELECT msgid, event_id, e.event_type AS event_type FROM typed JOIN events e
      ON {IN_RANGE.format(t="e")} AND e.event_type = typed.event_type
    """,
)
def range_join_per_type(spark, sf_dir):
    """Range and partition key together."""
    typed = _requests(spark, sf_dir).withColumn(
        "event_type", F.when(F.col("msgid") % 2 == 0, "view").otherwise("click")
    )
    history = _millis(table(spark, sf_dir, "events")).select("event_id", "event_type", "time_ms")
    out = range_join(typed, history, "time_ms", keys=["event_type"])
    return out.select("msgid", "event_id", "event_type")


@query(
    "training_projection_taxi",
    f"WITH {TAXI_SQL} SELECT l_orderkey, l_linenumber, trip_time_in_secs, trip_distance, fare_amount FROM taxi",
)
def training_projection_taxi(spark, sf_dir):
    return training_projection(taxi_rides(spark, sf_dir), TAXI, ["l_orderkey", "l_linenumber"])


@query(
    "training_projection_fit",
    f"""
    WITH {FIT_SQL}
    SELECT event_id, acc_ankle_x, acc_ankle_y, acc_ankle_z, acc_arm_x, acc_arm_y, acc_arm_z,
           acc_chest_x, acc_chest_y, acc_chest_z, ecg_lead_1 FROM fit
    """,
)
def training_projection_fit(spark, sf_dir):
    return training_projection(fit_of(events(spark, sf_dir)), FIT, ["event_id"])


@query(
    "training_rows_sys",
    f"""
    WITH {REQUEST_SQL}, {SYS_SQL}
    SELECT msgid, row_start, row_end, temperature, humidity, light, dust, airquality_raw
    FROM requests JOIN sys ON {IN_RANGE.format(t="sys")}
    """,
)
def training_rows_sys(spark, sf_dir):
    history = _millis(sys_of(events(spark, sf_dir)))
    return training_rows(_requests(spark, sf_dir), history, SYS, "time_ms")


def _bounds_sql(rows: str, keys: str, value: str) -> str:
    """(n + 1) p positions, clamped, with linear interpolation between neighbours."""

    def q(p: float, name: str) -> str:
        place = f"least(greatest((n + 1) * {p}::DOUBLE, 1.0), n)"
        low = f"max(CASE WHEN r = floor({place}) THEN v END)"
        high = f"max(CASE WHEN r = ceil({place}) THEN v END)"
        return f"{low} + max({place} - floor({place})) * ({high} - {low}) AS {name}"

    return f"""
ranked AS (
  SELECT {keys}, {value} AS v, row_number() OVER (PARTITION BY {keys} ORDER BY {value}) AS r,
         CAST(count(*) OVER (PARTITION BY {keys}) AS DOUBLE) AS n
  FROM {rows}
),
bounds AS (
  SELECT {keys}, max(n) AS n, {q(0.25, "q25")}, {q(0.5, "q50")}, {q(0.75, "q75")}, max(v) AS q100
  FROM ranked GROUP BY {keys}
)"""


@query(
    "quartile_bounds",
    f"""
    WITH {_bounds_sql("events", "user_id", "value")}
    SELECT user_id, CAST(n AS BIGINT) AS n, round(q25, 6) AS q25, round(q50, 6) AS q50,
           round(q75, 6) AS q75, q100 FROM bounds
    """,
)
def quartile_bounds_query(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "value")
    return rounded(quartile_bounds(rows, ["user_id"], "value"))


@query(
    "quartile_labels",
    f"""
    WITH {REQUEST_SQL},
    joined AS (SELECT msgid, event_id, value FROM requests JOIN events e ON {IN_RANGE.format(t="e")}),
    {_bounds_sql("joined", "msgid", "value")}
    SELECT j.msgid AS msgid, event_id, value,
           CASE WHEN value >= q100 THEN 'EXCELLENT' WHEN value >= q75 THEN 'VERYGOOD'
                WHEN value >= q50 THEN 'GOOD' ELSE 'BAD' END AS result
    FROM joined j JOIN bounds b ON j.msgid = b.msgid
    """,
)
def quartile_labels(spark, sf_dir):
    """Every selected row labelled by its quarter within its request."""
    history = _millis(table(spark, sf_dir, "events")).select("event_id", "value", "time_ms")
    rows = range_join(_requests(spark, sf_dir), history, "time_ms").select("msgid", "event_id", "value")
    return annotate_quartiles(rows, ["msgid"], "value")


@query(
    "quartile_labels_whole_table",
    f"""
    WITH one AS (SELECT 0 AS k, event_id, value FROM events), {_bounds_sql("one", "k", "value")}
    SELECT event_id, value,
           CASE WHEN value >= q100 THEN 'EXCELLENT' WHEN value >= q75 THEN 'VERYGOOD'
                WHEN value >= q50 THEN 'GOOD' ELSE 'BAD' END AS result
    FROM one CROSS JOIN bounds
    """,
)
def quartile_labels_whole_table(spark, sf_dir):
    """One request over everything: ranks of a single group from many tasks."""
    return annotate_quartiles(table(spark, sf_dir, "events").select("event_id", "value"), [], "value")


@query(
    "linear_training_one_feature",
    """
    SELECT user_id, CAST(regr_count(value, k) AS BIGINT) AS rows, round(regr_intercept(value, k), 6) AS intercept,
           round(regr_slope(value, k), 6) AS slope
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events)
    GROUP BY user_id
    """,
)
def linear_training_one_feature(spark, sf_dir):
    return rounded(train_linear_1f(events(spark, sf_dir), ["user_id"], "k", "value"))


@query(
    "linear_training_taxi",
    f"""
    WITH {TAXI_SQL},
    m AS (
      SELECT taxi_identifier, count(*) AS rows, avg(fare_amount) AS my, avg(trip_time_in_secs) AS m1,
             avg(trip_distance) AS m2, var_pop(trip_time_in_secs) AS c11, var_pop(trip_distance) AS c22,
             covar_pop(trip_time_in_secs, trip_distance) AS c12,
             covar_pop(fare_amount, trip_time_in_secs) AS c1y, covar_pop(fare_amount, trip_distance) AS c2y
      FROM taxi GROUP BY taxi_identifier
    ),
    s AS (
      SELECT *, (c1y * c22 - c2y * c12) / (c11 * c22 - c12 * c12) AS w1,
             (c2y * c11 - c1y * c12) / (c11 * c22 - c12 * c12) AS w2 FROM m
    )
    SELECT taxi_identifier, rows, round(my - w1 * m1 - w2 * m2, 6) AS intercept, round(w1, 6) AS w1,
           round(w2, 6) AS w2 FROM s
    """,
)
def linear_training_taxi(spark, sf_dir):
    """Two features per taxi by the normal equations."""
    *features, target = TAXI.training_fields
    models = train_linear(taxi_rides(spark, sf_dir), ["taxi_identifier"], features, target)
    return rounded(
        models.select(
            "taxi_identifier", "rows", "intercept",
            F.col("weights")[0].alias("w1"), F.col("weights")[1].alias("w2"),
        )
    )


@query(
    "linear_training_requests",
    f"""
    WITH {REQUEST_SQL}, {SYS_SQL},
    fit AS (
      SELECT msgid, row_start, row_end, count(*) AS rows, regr_intercept(airquality_raw, humidity) AS b0,
             regr_slope(airquality_raw, humidity) AS b2, regr_sxx(airquality_raw, humidity) AS sxx
      FROM requests JOIN sys ON {IN_RANGE.format(t="sys")} GROUP BY ALL
    )
    SELECT msgid, row_start, row_end, rows, round(b0, 6) + 0.0 AS intercept, 0.0::DOUBLE AS w1, round(b2, 6) AS w2,
           0.0::DOUBLE AS w3, 0.0::DOUBLE AS w4, 'SYS-MLR-' || row_end || '.model' AS name, 'MLR' AS kind
    FROM fit
    """,
)
def linear_training_requests(spark, sf_dir):
    """Four features per training request; three are collinear and one explains the target."""
    history = _millis(sys_of(events(spark, sf_dir)))
    rows = training_rows(_requests(spark, sf_dir), history, SYS, "time_ms")
    models = train_regressions(rows, SYS)
    weights = [F.get("weights", i).alias(f"w{i + 1}") for i in range(4)]
    exact = models.select("msgid", "row_start", "row_end", "rows", "intercept", *weights, "name", "kind")
    return rounded(exact).withColumn("intercept", F.round("intercept", 6) + 0.0)


@query(
    "linear_training_selected",
    f"""
    WITH {REQUEST_SQL}, {SYS_SQL},
    d AS (SELECT msgid, airquality_raw + sin(event_id) * 40 AS y, humidity AS a, cos(event_id * 3) AS b
          FROM requests JOIN sys ON {IN_RANGE.format(t="sys")}),
    m AS (
      SELECT msgid, count(*)::DOUBLE AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, var_pop(y) AS vy, var_pop(a) AS va,
             var_pop(b) AS vb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS yb
      FROM d GROUP BY msgid
    ),
    both_in AS (
      SELECT *, (ay * vb - yb * ab) / (va * vb - ab * ab) AS wa, (yb * va - ay * ab) / (va * vb - ab * ab) AS wb FROM m
    ),
    left_over AS (
      SELECT *, vy - wa * ay - wb * yb AS s_both, vy - ay * ay / va AS s_a FROM both_in
    ),
    judged AS (SELECT *, (n - 3) * s_a / s_both + 4 < n + 3 AS dropped FROM left_over)
    SELECT msgid, n::BIGINT AS rows, round(my - CASE WHEN dropped THEN ay / va * ma ELSE wa * ma + wb * mb END, 6) AS intercept,
           round(CASE WHEN dropped THEN ay / va ELSE wa END, 6) AS w1, round(CASE WHEN dropped THEN 0 ELSE wb END, 6) AS w2
    FROM judged
    """,
)
def linear_training_selected(spark, sf_dir):
    """Noise on the target: the criterion keeps the feature that matters and judges the other one."""
    history = _millis(sys_of(events(spark, sf_dir)))
    rows = range_join(_requests(spark, sf_dir), history, "time_ms").select(
        "msgid",
        (F.col("airquality_raw") + F.sin(F.col("event_id").cast("double")) * 40).alias("y"),
        F.col("humidity").alias("a"),
        F.cos((F.col("event_id") * 3).cast("double")).alias("b"),
    )
    models = train_linear(rows, ["msgid"], ["a", "b"], "y", select=True)
    return rounded(models.select("msgid", "rows", "intercept", F.get("weights", 0).alias("w1"), F.get("weights", 1).alias("w2")))


_CLASS_COUNTS = ", ".join(f"sum(CASE WHEN result = '{c}' THEN 1 ELSE 0 END)::DOUBLE AS c{i}" for i, c in enumerate(QUARTILE_LABELS))


def _bits_sql(*parts: str) -> str:
    total = f"({' + '.join(parts)})"
    each = " + ".join(f"CASE WHEN {p} > 0 THEN ({p}) * log2({p}) ELSE 0 END" for p in parts)
    return f"({total} * log2({total}) - ({each}))"


@query(
    "tree_roots",
    f"""
    WITH {REQUEST_SQL}, {SYS_SQL},
    joined AS (
      SELECT msgid, event_id, temperature, humidity, dust, airquality_raw AS value
      FROM requests JOIN sys ON {IN_RANGE.format(t="sys")}
    ),
    {_bounds_sql("joined", "msgid", "value")},
    labelled AS (
      SELECT j.*, CASE WHEN value >= q100 THEN 'EXCELLENT' WHEN value >= q75 THEN 'VERYGOOD'
                       WHEN value >= q50 THEN 'GOOD' ELSE 'BAD' END AS result
      FROM joined j JOIN bounds b ON j.msgid = b.msgid
    ),
    list AS (
      SELECT msgid, feature, value, {_CLASS_COUNTS}
      FROM (UNPIVOT (SELECT msgid, result, temperature, humidity, dust FROM labelled)
            ON temperature, humidity, dust INTO NAME feature VALUE value)
      GROUP BY msgid, feature, value
    ),
    upto AS (
      SELECT msgid, feature, value, {", ".join(f"sum(c{i}) OVER u AS l{i}, sum(c{i}) OVER w AS k{i}" for i in range(4))}
      FROM list WINDOW u AS (PARTITION BY msgid, feature ORDER BY value), w AS (PARTITION BY msgid, feature)
    ),
    cuts AS (
      SELECT *, l0 + l1 + l2 + l3 AS nl, k0 + k1 + k2 + k3 AS n,
             round(({_bits_sql("k0", "k1", "k2", "k3")} - {_bits_sql("l0", "l1", "l2", "l3")}
                    - {_bits_sql("(k0 - l0)", "(k1 - l1)", "(k2 - l2)", "(k3 - l3)")}) / (k0 + k1 + k2 + k3), 12) AS gain
      FROM upto WHERE l0 + l1 + l2 + l3 < k0 + k1 + k2 + k3
    ),
    tried AS (
      SELECT *, count(*) OVER (PARTITION BY msgid, feature) AS candidates FROM cuts
      WHERE nl >= least(greatest(0.1 * n / 4, 2), 25) AND n - nl >= least(greatest(0.1 * n / 4, 2), 25)
    ),
    best AS (
      SELECT *, gain - log2(candidates) / n AS net FROM tried
      QUALIFY row_number() OVER (PARTITION BY msgid, feature ORDER BY gain DESC, value) = 1
    ),
    gains AS (
      SELECT *, avg(net) OVER (PARTITION BY msgid) AS mean, round(net / ({_bits_sql("nl", "(n - nl)")} / n), 12) AS ratio
      FROM best WHERE net > 1e-12
    )
    SELECT msgid, feature, value AS threshold, round(n, 6) AS rows FROM gains WHERE net >= mean - 1e-3
    QUALIFY row_number() OVER (PARTITION BY msgid ORDER BY ratio DESC,
                               CASE feature WHEN 'temperature' THEN 0 WHEN 'humidity' THEN 1 ELSE 2 END) = 1
    """,
)
def tree_roots(spark, sf_dir):
    """The cut at the root of every request's unpruned tree: the greatest gain ratio."""
    history = _millis(sys_of(events(spark, sf_dir)))
    rows = training_rows(_requests(spark, sf_dir), history, SYS, "time_ms")
    labelled = annotate_quartiles(rows, REQUEST, "airquality_raw")
    nodes = train_c45(labelled, REQUEST, ["temperature", "humidity", "dust"], "result", QUARTILE_LABELS, confidence=None)
    roots = nodes.where("node = '' AND feature IS NOT NULL")
    return roots.select("msgid", "feature", "threshold", F.round("rows", 6).alias("rows"))


@query("tree_training_pruned")
def tree_training_pruned(spark, sf_dir):
    """The whole pruned tree of every training request, by the job's own function."""
    history = _millis(sys_of(events(spark, sf_dir)))
    rows = training_rows(_requests(spark, sf_dir), history, SYS, "time_ms")
    return train_labelled_trees(rows, SYS, "airquality_raw", ["temperature", "humidity", "light", "dust"])


@query("tree_training_requests")
def tree_training_requests(spark, sf_dir):
    """One tree per training request, all grown together."""
    history = _millis(sys_of(events(spark, sf_dir)))
    rows = training_rows(_requests(spark, sf_dir), history, SYS, "time_ms")
    labelled = annotate_quartiles(rows, REQUEST, "airquality_raw")
    return train_trees(
        labelled, REQUEST, list(SYS.training_fields), "result", QUARTILE_LABELS, depth=3
    )


@query(
    "tree_recovers_rule",
    f"""
    WITH {TAXI_SQL}
    SELECT taxi_identifier, count(*) AS rows, count(*) AS hits FROM taxi GROUP BY taxi_identifier
    """,
)
def tree_recovers_rule(spark, sf_dir):
    """Rows labelled by a rule with one cut on whole numbers: the grown trees reproduce it."""
    rows = taxi_rides(spark, sf_dir).select(
        "taxi_identifier",
        "trip_time_in_secs",
        "fare_amount",
        F.when(F.col("trip_time_in_secs") <= 1750, "BAD").otherwise("GOOD").alias("truth"),
    )
    features = ["trip_time_in_secs", "fare_amount"]
    nodes = train_trees(
        rows, ["taxi_identifier"], features, "truth", ("BAD", "GOOD"), depth=2, min_rows=1, bins=256
    )
    scored = score_trees(rows, nodes, ["taxi_identifier"], features, depth=2, out="guess")
    return scored.groupBy("taxi_identifier").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((F.col("truth") == F.col("guess")).cast("bigint")).alias("hits"),
    )


@query("tree_training_whole_table")
def tree_training_whole_table(spark, sf_dir):
    """One tree over all rides by MLlib, with its scores."""
    rows = annotate_quartiles(
        taxi_rides(spark, sf_dir).select("l_orderkey", "l_linenumber", *TAXI.training_fields),
        [], "fare_amount",
    )
    model = fit_tree(rows, list(TAXI.training_fields), "result")
    return model.transform(rows).groupBy("result", "prediction").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "model_names",
    f"""
    WITH {REQUEST_SQL}
    SELECT msgid, 'SYS-MLR-' || CAST(row_end AS VARCHAR) || '.model' AS regression,
           'SYS-DTC-' || CAST(row_end AS VARCHAR) || '.model' AS tree
    FROM requests
    """,
)
def model_names(spark, sf_dir):
    return _requests(spark, sf_dir).select(
        "msgid",
        model_name("SYS", "MLR", F.col("row_end")).alias("regression"),
        model_name("SYS", "DTC", F.col("row_end")).alias("tree"),
    )


@query(
    "train_and_publish",
    f"""
    WITH {REQUEST_SQL}, {SYS_SQL},
    used AS (SELECT DISTINCT msgid, row_end FROM requests JOIN sys ON {IN_RANGE.format(t="sys")})
    SELECT msgid, 'SYS-MLR-' || CAST(row_end AS VARCHAR) || '.model' AS name, 'MLR' AS kind FROM used
    UNION ALL
    SELECT msgid, 'SYS-DTC-' || CAST(row_end AS VARCHAR) || '.model', 'DTC' FROM used
    """,
)
def train_and_publish(spark, sf_dir):
    """The whole training job; the published names are also what the registry then holds."""
    registry = Registry(scratch_path(spark, "registry"))
    history = _millis(sys_of(events(spark, sf_dir)))
    sent = run(_requests(spark, sf_dir), history, SYS, "time_ms", registry)
    stored = registry.latest(spark).select("name", "kind")
    return sent.join(stored, ["name", "kind"])
