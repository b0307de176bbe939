"""Streams over split files, several micro-batches: same results as the batch forms."""

import pytest
from pyspark.sql import functions as F

from tideline.functions.senml import to_pack
from tideline.operators.blocks import block_stats, latest_block_mean
from tideline.operators.sequence import SEQ, sequence
from tideline.plans.etl import clean
from tideline.plans.stats import forecasts
from tideline.sources.files import read_replay, replay_line, stream_replay, training_requests
from tideline.sources.registry import Registry
from tideline.sources.topics import message_ids, messages, read_documents, stamp_arrival, store_documents
from tideline.specs import GRID, SYS
from tideline.streaming.jobs import clean_open, clean_stream, statistics_streams, train_stream
from tideline.streaming import pieces
from tideline.streaming.pieces import forecast_in_pieces
from tideline.streaming.stateful import (
    block_stats_open,
    open_rows,
    stream_block_stats,
    stream_forecast,
    stream_interpolate,
    stream_latest_average,
)
from tideline.workload.inputs import grid_of, sys_of, with_event_numbers
from tideline.workload.streams import drain

ORDER = ["ts", "event_id"]
PARTS = 4


@pytest.fixture(scope="module")
def split_events(spark, tmp_path_factory):
    """Event files in time order; one file per micro-batch."""
    from tests.conftest import SF_DIR

    root = tmp_path_factory.mktemp("split")
    rows = spark.read.parquet(f"{SF_DIR}/events.parquet")
    rank = sequence(rows, [], ORDER).rows.drop("all_rows")
    for part in range(PARTS):
        chosen = rank.filter(F.expr(f"(seq - 1) div 250 = {part}")).drop("seq")
        chosen.coalesce(1).write.mode("append").parquet(str(root))
    return str(root)


@pytest.fixture
def stream(spark, events, split_events):
    reader = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1)
    return reader.option("latestFirst", "false").parquet(split_events)


def rows(df, columns):
    out = df.select(*columns).collect()
    return sorted((tuple(round(v, 7) if isinstance(v, float) else v for v in r) for r in out), key=repr)


def test_forecast(spark, events, stream):
    live = drain(stream_forecast(stream.select("event_id", "ts", "user_id", "value"), "value", ["user_id"], ORDER), "f")
    columns = ["event_id", "seq", "estimate", "horizon_mean"]
    batch = forecasts(
        events.withColumnRenamed("value", "grid_measurement"), GRID, ["user_id"], ORDER
    )
    assert rows(live, columns) == rows(batch, columns)


@pytest.mark.parametrize("compact", (2,))
def test_forecast_in_pieces_of_one_key(spark, events, stream, heavy, monkeypatch, tmp_path, compact):
    """One key has all rows: a micro-batch of 250 rows is cut into eight pieces and more."""
    from tideline.operators import sequence as module

    monkeypatch.setattr(module, "SLICE_ROWS", 30)
    monkeypatch.setattr(pieces, "COMPACT", compact)
    columns = ["event_id", "seq", "estimate", "horizon_mean"]
    one = lambda df: df.select("event_id", "ts", F.lit(None).cast("int").alias("k"), F.when(F.col("event_id") % 7 > 0, F.col("value")).alias("value"))
    cuts = []
    real = module._number_by_range

    def counted(*args):
        out = real(*args)
        cuts.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(module, "_number_by_range", counted)
    done = {}
    step = forecast_in_pieces("value", ["k"], ORDER, str(tmp_path / "state"), lambda b, i: done.__setitem__(i, rows(b, columns)))

    def twice(batch, i):  # a micro-batch that is run again gives the same
        step(batch, i)
        first = done[i]
        step(batch, i)
        assert done[i] == first

    writer = one(stream).writeStream.foreachBatch(twice).option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    batch = forecasts(one(events).withColumnRenamed("value", "grid_measurement"), GRID, ["k"], ORDER)
    assert len(done) == PARTS and min(cuts[: 2 * PARTS]) >= 8
    assert sorted((r for b in done.values() for r in b), key=repr) == rows(batch, columns)


def test_forecast_in_pieces_of_many_keys(spark, events, stream, tmp_path):
    columns = ["event_id", "seq", "estimate", "horizon_mean"]
    done = []
    step = forecast_in_pieces("value", ["user_id"], ORDER, str(tmp_path / "state"), lambda b, i: done.extend(rows(b, columns)))
    writer = stream.drop("props").writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "c"))
    writer.trigger(availableNow=True).start().awaitTermination()
    batch = forecasts(events.withColumnRenamed("value", "grid_measurement"), GRID, ["user_id"], ORDER)
    assert sorted(done, key=repr) == rows(batch, columns)


def test_block_stats(spark, events, stream):
    columns = ["user_id", "block", "rows", "event_id", "mean", "distinct_values"]
    what = (["user_id"], ORDER, "value", "event_type")
    live = drain(stream_block_stats(stream.drop("props"), *what), "b", lambda c: block_stats_open(spark, c, *what))
    batch = block_stats(events, ["user_id"], ORDER, "value", "event_type")
    assert rows(live, columns) == rows(batch, columns)


def test_latest_average(spark, events, stream):
    live = drain(stream_latest_average(stream.drop("props"), "value", ["user_id", "event_type"], ORDER), "l")
    batch = latest_block_mean(sequence(events, ["user_id", "event_type"], ORDER), "value", "average")
    assert rows(live, ["event_id", "average"]) == rows(batch, ["event_id", "average"])


def test_clean(spark, events, stream):
    packed = lambda df: grid_of(df).select("event_id", "ts", to_pack(GRID).alias("pack"))
    live = drain(clean_stream(packed(stream), GRID, ORDER), "c", lambda c: clean_open(spark, c, GRID))
    columns = ["event_id", "id", "grid_measurement", "timestamp", "house_id", "ownerFullName"]
    batch = clean(packed(events), GRID, ORDER)
    assert rows(live, columns) == rows(batch, columns)


def test_statistics_streams_start(spark, stream):
    parts = statistics_streams(grid_of(stream), GRID, ORDER)
    assert set(parts) == {"blocks", "forecast"} and all(p.isStreaming for p in parts.values())


def test_open_blocks_are_flushed_and_numbers_stay_unique(spark, tmp_path):
    schema = "k int, t int, v double, at timestamp, n int, name string"
    source, out = tmp_path / "in", tmp_path / "out"
    columns = ["k", "t", "v", "to_timestamp('2024-01-01') as at", "if(t % 3 = 0, t, null) as n", "if(t % 2 = 0, 'x', null) as name"]

    def put(times):
        rows = spark.createDataFrame([(1, i, float(i) if i else None) for i in times], "k int, t int, v double")
        rows.selectExpr(*columns).coalesce(1).write.mode("append").parquet(str(source))

    def until(count):
        for _ in range(90):
            query.awaitTermination(1)
            done = spark.read.schema(live.schema).parquet(str(out)) if out.exists() else None
            if done is not None and done.count() >= count:
                return done
        raise AssertionError("no block was flushed")

    put(range(7))
    rows = spark.readStream.schema(schema).parquet(str(source))
    live = stream_block_stats(rows, ["k"], ["t"], "v", "name", flush_after_ms=100)
    query = (
        live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
        .trigger(processingTime="200 milliseconds").start(str(out))
    )
    try:
        assert {(r.block, r.rows) for r in until(2).collect()} == {(0, 5), (1, 2)}
        put(range(7, 10))  # the key speaks again
        done = until(3).collect()
    finally:
        query.stop()
    assert sorted((r.block, r.rows, r.t, r["mean"]) for r in done) == [(0, 5, 4, 2.0), (1, 2, 6, 5.5), (2, 3, 9, 8.0)]


def test_open_rows_keep_types_and_nulls(spark, tmp_path):
    schema = "k string, t int, v double, at timestamp, n int, name string, tags array<string>"
    rows = [(None, i, 0.5 * i if i % 2 else None, None, i if i % 3 else None, None if i % 2 else "x", ["a", "b"]) for i in range(8)]
    spark.createDataFrame(rows, schema).selectExpr("*", "timestamp_seconds(t) as due").drop("at").withColumnRenamed("due", "at").coalesce(1).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).parquet(f"{tmp_path}/in")
    filled = stream_interpolate(live, ["v"], ["k"], ["t"])
    writer = filled.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True)
    writer.start(f"{tmp_path}/o").awaitTermination()
    held = open_rows(spark, f"{tmp_path}/c", ["k"])
    assert held.drop("block").schema.simpleString() == live.schema.simpleString()
    want = spark.read.parquet(f"{tmp_path}/in").where("t >= 5").withColumn("block", F.lit(1).cast("long"))
    assert sorted(map(str, held.collect())) == sorted(map(str, want.select(held.columns).collect()))


def test_replay_stream(spark, tmp_path):
    pack = '[{"n":"id","v":"1|2"}]'
    lines = spark.createDataFrame([(1.0, pack), (3.0, pack)], "d double, p string")
    path = str(tmp_path / "replay")
    lines.select(replay_line(F.col("d"), F.col("p")).alias("value")).union(
        spark.createDataFrame([("delay|string",)], "value string")
    ).coalesce(1).write.text(path)
    batch = read_replay(spark, path, 1000)
    assert sorted((r["delay"], r["pack"]) for r in batch.collect()) == [(1, pack), (3, pack)]
    live = drain(stream_replay(spark, path, 1000), "r")
    assert sorted(r["delay"] for r in live.collect()) == [1, 3]
    assert sorted(r[0] for r in live.select(F.unix_millis("event_time")).collect()) == [1001, 1003]


def test_documents_are_stored_once(spark, tmp_path):
    sink = store_documents("c", str(tmp_path))
    batch = spark.createDataFrame([("a",), ("b",)], "pack string")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch, 1)
    assert read_documents(spark, "c", str(tmp_path)).count() == 4


def test_topic_rows(spark):
    raw = spark.createDataFrame(
        [(bytearray(b"k"), bytearray(b"[]"), 0, 7), (None, bytearray(b"[1]"), 1, 7)],
        "key binary, value binary, partition int, offset long",
    )
    out = stamp_arrival(message_ids(messages(raw)), every=2).collect()
    assert {r["value"] for r in out} == {"[]", "[1]"} and len({r["msgid"] for r in out}) == 2
    assert all((r["arrival"] is None) == (r["msgid"] % 2 == 1) for r in out)


def test_train_stream(spark, events, tmp_path):
    source = tmp_path / "requests"
    start = 1704067200000
    text = [(f"1,{start},{start + 10 * 86400000}",), (f"1,{start + 86400000},{start + 20 * 86400000}",)]
    spark.createDataFrame(text, "value string").coalesce(1).write.text(str(source))
    history = sys_of(with_event_numbers(events)).withColumn("time_ms", F.unix_millis(F.col("ts").cast("timestamp")))
    registry = Registry(str(tmp_path / "registry"))
    sent = []
    train_stream(
        spark.readStream.text(str(source)), history, SYS, "time_ms", registry,
        lambda batch, i: sent.extend(batch.collect()), str(tmp_path / "check"),
    ).awaitTermination()
    assert len(sent) == 4
    latest = registry.latest(spark).collect()
    assert {(r["kind"], r["name"]) for r in latest} == {(r["kind"], r["name"]) for r in sent}
    weights = [r["weights"] for r in latest if r["kind"] == "MLR"]
    assert all(len(w) == 4 for w in weights)
