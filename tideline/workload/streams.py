"""Queries that run as streams over the event table until its end.

Each writes to the shared folder and returns what was written. With one file per
table the stream has one micro-batch; the tests split the files.
"""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tideline.plans.etl import packed
from tideline.session import scratch_path
from tideline.sources.topics import read_documents, store_documents
from tideline.specs import GRID, SYS
from tideline.sources.registry import Registry
from tideline.operators.scoring import Split
from tideline.streaming.jobs import clean_open, clean_stream, score_stream, score_swapped
from tideline.streaming.pieces import forecast_in_pieces
from tideline.streaming.stateful import (
    block_stats_open,
    stream_block_stats,
    stream_forecast,
    stream_latest_average,
)
from tideline.streaming.versions import still_waiting, swap_stream, tree_nodes
from tideline.functions.senml import parse_pack, to_pack
from tideline.workload.catalog import query
from tideline.workload.inputs import (
    EVENT_ORDER,
    SYS_SQL,
    grid_of,
    rounded,
    sys_of,
    table,
    with_event_numbers,
)
from tideline.workload.messages import GRID_BLOCKS_SQL
from tideline.workload.statistics import FIT_LINE, KALMAN_SQL, NUMBERED, TYPED


def stream_table(spark, sf_dir, name="events"):
    """The table as a file stream, a few files per micro-batch."""
    schema = table(spark, sf_dir, name).schema
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64)
    # A pattern, because a file stream takes a folder or a pattern but no single file.
    return reader.parquet(f"{sf_dir}/{name}.parquet*")


def drain(df, name, at_end=None):
    """Run a stream to the end of its input and return its whole output.

    ``at_end`` gives the rows that the stream still holds, from its checkpoint.
    """
    spark = df.sparkSession
    root = scratch_path(spark, name)
    writer = df.writeStream.format("parquet").option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    out = spark.read.schema(df.schema).parquet(f"{root}/out")
    return out if at_end is None else out.unionByName(at_end(f"{root}/checkpoint"))


@query(
    "stream_etl_grid",
    f"""
    WITH {GRID_BLOCKS_SQL}
    SELECT event_id, id, round(grid_measurement, 8) AS grid_measurement, "timestamp" FROM filled
    """,
)
def stream_etl_grid(spark, sf_dir):
    rows = grid_of(stream_table(spark, sf_dir))
    packs = rows.select("event_id", "ts", to_pack(GRID).alias("pack"))
    cleaned = clean_stream(packs, GRID, EVENT_ORDER)
    out = drain(cleaned, "stream-etl", lambda checkpoint: clean_open(spark, checkpoint, GRID))
    return rounded(out.select("event_id", "id", "grid_measurement", "timestamp"), 8)


@query(
    "stream_documents",
    f"""
    WITH {GRID_BLOCKS_SQL}
    SELECT id, round(grid_measurement, 8) AS grid_measurement, "timestamp" FROM filled
    """,
)
def stream_documents(spark, sf_dir):
    """Cleaned packs stored as documents, read back and parsed."""
    rows = grid_of(stream_table(spark, sf_dir))
    packs = rows.select("event_id", "ts", to_pack(GRID).alias("pack"))
    text = packed(clean_stream(packs, GRID, EVENT_ORDER), GRID)
    root = scratch_path(spark, "documents")
    sink = store_documents("senml-cleaned", root)
    writer = text.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    # a batch after the last one of the stream
    sink(packed(clean_open(spark, f"{root}/checkpoint", GRID), GRID), (1 << 31) - 1)
    stored = read_documents(spark, "senml-cleaned", root).select(F.col("entry").alias("pack"))
    return rounded(parse_pack(stored, GRID), 8)


@query(
    "stream_block_stats",
    f"""
    WITH {NUMBERED}
    SELECT user_id, (seq - 1) // 5 AS block, count(*) AS rows, arg_max(event_id, seq) AS event_id,
           round(avg(value), 6) AS mean, count(DISTINCT event_type) AS distinct_values
    FROM numbered GROUP BY user_id, (seq - 1) // 5
    """,
)
def stream_block_stats_query(spark, sf_dir):
    rows = stream_table(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    what = (["user_id"], EVENT_ORDER, "value", "event_type")
    out = drain(stream_block_stats(rows, *what), "stream-blocks", lambda c: block_stats_open(spark, c, *what))
    return rounded(out.drop("ts"))


@query(
    "stream_keyed_block_average",
    f"""
    WITH {TYPED}
    SELECT user_id, event_type, (seq - 1) // 5 AS block, arg_max(event_id, seq) AS event_id,
           round(avg(value), 6) AS mean
    FROM numbered GROUP BY user_id, event_type, (seq - 1) // 5
    """,
)
def stream_keyed_block_average(spark, sf_dir):
    rows = stream_table(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    what = (["user_id", "event_type"], EVENT_ORDER, "value", "value")
    out = drain(stream_block_stats(rows, *what), "stream-keyed", lambda c: block_stats_open(spark, c, *what))
    return rounded(out.drop("ts", "rows", "distinct_values"))


@query(
    "stream_forecast",
    f"""
    WITH RECURSIVE {KALMAN_SQL},
    estimates AS (SELECT f.*, n.ts FROM filtered f JOIN numbered n USING (event_id)),
    {FIT_LINE.format(y="estimate", source="estimates")}
    SELECT event_id, lined.user_id AS user_id, lined.seq AS seq, round(estimate, 6) AS estimate,
           round(CASE WHEN n > 1 THEN mean + slope * (5.5 + (n - 1) / 2.0) END, 6) AS horizon_mean
    FROM lined JOIN filtered USING (event_id)
    """,
)
def stream_forecast_query(spark, sf_dir):
    rows = stream_table(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    out = drain(stream_forecast(rows, "value", ["user_id"], EVENT_ORDER), "stream-forecast")
    return rounded(out.drop("ts", "value"))


@query(
    "stream_forecast_pieces",
    f"""
    WITH RECURSIVE {KALMAN_SQL},
    estimates AS (SELECT f.*, n.ts FROM filtered f JOIN numbered n USING (event_id)),
    {FIT_LINE.format(y="estimate", source="estimates")}
    SELECT event_id, lined.user_id AS user_id, lined.seq AS seq, round(estimate, 6) AS estimate,
           round(CASE WHEN n > 1 THEN mean + slope * (5.5 + (n - 1) / 2.0) END, 6) AS horizon_mean
    FROM lined JOIN filtered USING (event_id)
    """,
)
def stream_forecast_pieces(spark, sf_dir):
    """The same forecast with every micro-batch cut into pieces that any task takes."""
    rows = stream_table(spark, sf_dir).select("event_id", "ts", "user_id", "value")
    root = scratch_path(spark, "pieces")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    step = forecast_in_pieces("value", ["user_id"], EVENT_ORDER, f"{root}/state", sink)
    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", f"{root}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return rounded(spark.read.parquet(f"{root}/out").drop("batch", "ts", "value"))


@query(
    "stream_latest_average",
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
def stream_latest_average_query(spark, sf_dir):
    rows = stream_table(spark, sf_dir).select("event_id", "ts", "user_id", "event_type", "value")
    out = stream_latest_average(rows, "value", ["user_id", "event_type"], EVENT_ORDER)
    return rounded(drain(out, "stream-average").drop("ts", "value"))


@query(
    "stream_scores",
    f"""
    WITH {SYS_SQL},
    scored AS (
      SELECT event_id, source, CAST(trunc(1 + 0.5::DOUBLE * temperature + 0.25::DOUBLE * humidity
               + 0.01::DOUBLE * light + 0.1::DOUBLE * dust) AS DOUBLE) AS res FROM sys
    )
    SELECT event_id AS msgid, 'MLR' AS kind, source FROM scored
    """,
)
def stream_scores(spark, sf_dir):
    """Scoring job with its model from the registry; message id, kind and sensor of every message."""
    registry = Registry(scratch_path(spark, "registry"))
    registry.append(
        spark.createDataFrame(
            [("SYS-MLR-1.model", "MLR", 1, 9.0, [0.0, 0.0, 0.0, 0.0]),
             ("SYS-MLR-1.model", "MLR", 2, 1.0, [0.5, 0.25, 0.01, 0.1])],
            "name string, kind string, created_at bigint, intercept double, weights array<double>",
        )
    )
    rows = sys_of(with_event_numbers(stream_table(spark, sf_dir)))
    packs = rows.select(F.col("event_id").alias("msgid"), "ts", to_pack(SYS).alias("pack"))
    root = scratch_path(spark, "scores")

    def sink(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    score_stream(
        packs, SYS, ["ts", "msgid"], registry, "SYS-MLR-1.model", sink, f"{root}/checkpoint"
    ).awaitTermination()
    out = spark.read.schema("msgid bigint, value string").parquet(f"{root}/out")
    parts = F.split("value", ",")
    return out.select("msgid", parts[5].alias("kind"), parts[2].alias("source"))


def model_versions(rows):
    """Control messages of both kinds, one of each per nation: (since, kind, model)."""
    n = F.col("n_nationkey")
    day = F.timestamp_seconds(F.lit(1704067200) + n * 86400)
    weights = F.array(*[F.lit(w) * (n + 1) for w in (0.5, 0.25, 0.01, 0.1)])
    regression = F.to_json(F.struct(n.cast("double").alias("intercept"), weights.alias("weights")))
    shape = tree_nodes(Split("temperature", 0.0, Split("humidity", 50.0, 0, 1), 2), SYS.training_fields[:-1])
    # each version has thresholds of its own
    tree = F.replace(F.lit(json.dumps(shape)), F.lit('"threshold": 50.0'), F.concat(F.lit('"threshold": '), (n * 4).cast("double").cast("string")))
    each = F.explode(F.array(F.struct(F.lit("MLR").alias("kind"), regression.alias("model")), F.struct(F.lit("DTC").alias("kind"), tree.alias("model"))))
    return rows.select(day.alias("since"), each.alias("m")).select("since", "m.kind", "m.model")


@query(
    "stream_model_swap",
    f"""
    WITH {SYS_SQL},
    v AS (SELECT n_nationkey AS n, TIMESTAMP '2024-01-01' + to_days(n_nationkey) AS since FROM nation),
    r AS (SELECT s.*, v.n FROM sys s ASOF LEFT JOIN v ON CAST(s.ts AS TIMESTAMP) >= v.since)
    SELECT event_id AS msgid, 'MLR' AS analytic_type,
           trunc(n + 0.5::DOUBLE * (n + 1) * temperature + 0.25::DOUBLE * (n + 1) * humidity
                 + 0.01::DOUBLE * (n + 1) * light + 0.1::DOUBLE * (n + 1) * dust)::FLOAT::DOUBLE AS res
    FROM r WHERE n IS NOT NULL
    UNION ALL
    SELECT event_id, 'DTC', CASE WHEN temperature > 0 THEN 2.0 WHEN humidity <= n * 4 THEN 0.0 ELSE 1.0 END
    FROM r WHERE n IS NOT NULL
    """,
)
def stream_model_swap(spark, sf_dir):
    """Each row scored by the regression and the tree in force at its time, both swapped by control messages."""
    rows = sys_of(with_event_numbers(stream_table(spark, sf_dir))).withColumnRenamed("event_id", "msgid")
    rows = rows.withColumns({"timestamp": F.col("ts").cast("string"), "average": F.lit(None).cast("double"), "arrival": F.lit(None).cast("timestamp")})
    control = model_versions(stream_table(spark, sf_dir, "nation"))
    kinds = ["MLR", "DTC"]
    out = drain(swap_stream(rows, control, "ts", kinds, "1 hour"), "swap", lambda c: still_waiting(spark, c, kinds))
    return score_swapped(out, SYS).select("msgid", "analytic_type", "res")
