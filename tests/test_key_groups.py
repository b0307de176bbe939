"""Count blocks of streams: keys share the state of their group and keep their own blocks."""

import pytest

from tideline.operators.blocks import block_stats
from tideline.streaming import stateful
from tideline.streaming.stateful import block_stats_open, open_rows, stream_block_stats
from tideline.workload.streams import drain

SCHEMA = "k long, name string, t long, v double"


def put(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def found(df):
    columns = ["k", "name", "block", "rows", "t", "mean", "distinct_values"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_many_keys_have_the_state_of_few_groups(spark, monkeypatch, tmp_path):
    """Keys are whole numbers beside nulls, values too; each of three micro-batches has part of the keys."""
    monkeypatch.setattr(stateful, "KEY_GROUPS", 8)
    key = lambda i: None if i % 17 == 0 else i % 60
    rows = [(key(i), None if i % 5 == 0 else f"n{i % 2}", i, None if i % 7 == 0 else i / 4) for i in range(900)]
    for part in (0, 1, 2):
        put(spark, tmp_path / "in", [r for r in rows if r[2] // 300 == part and (part != 1 or (r[0] or 0) < 30)])
    sent = spark.read.schema(SCHEMA).parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    what, kept = (["k", "name"], ["t"], "v", "v"), []

    def at_end(checkpoint):
        kept.append(checkpoint)
        return block_stats_open(spark, checkpoint, *what)

    out = drain(stream_block_stats(live, *what), "groups", at_end)
    want = block_stats(sent, ["k", "name"], ["t"], "v", "v")
    assert found(out) == found(want)
    state = lambda name: spark.read.format("statestore").option("stateVarName", name).load(kept[0]).count()
    assert 0 < state("held") <= 8 and 0 < state("place") <= 8
    held = open_rows(spark, kept[0], ["k", "name"])
    assert held.columns == ["k", "name", "t", "v", "block"] and held.count() == want.filter("rows < 5").selectExpr("sum(rows)").first()[0]


@pytest.mark.parametrize("groups", (1, 1024))
def test_silent_keys_of_a_group_are_flushed_alone(spark, monkeypatch, tmp_path, groups):
    monkeypatch.setattr(stateful, "KEY_GROUPS", groups)
    source, out = tmp_path / "in", tmp_path / "out"
    put(spark, source, [(k, "a", t, float(t)) for k, n in ((1, 7), (2, 5), (None, 3)) for t in range(n)])
    live = stream_block_stats(spark.readStream.schema(SCHEMA).parquet(str(source)), ["k"], ["t"], "v", "v", flush_after_ms=100)
    writer = live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check"))
    query = writer.trigger(processingTime="200 milliseconds").start(str(out))

    def until(count):
        for _ in range(90):
            query.awaitTermination(1)
            done = spark.read.schema(live.schema).parquet(str(out)) if out.exists() else None
            if done is not None and done.count() >= count:
                return sorted(((r["k"], r["block"], r["rows"], r["t"], r["mean"]) for r in done.collect()), key=repr)
        raise AssertionError("no block was flushed")

    try:
        first = [(1, 0, 5, 4, 2.0), (1, 1, 2, 6, 5.5), (2, 0, 5, 4, 2.0), (None, 0, 3, 2, 1.0)]
        assert until(4) == first
        put(spark, source, [(1, "a", 9, 9.0)])  # one key speaks again, into a block of its own
        assert until(5) == sorted([*first, (1, 2, 1, 9, 9.0)], key=repr)
    finally:
        query.stop()
