"""Models swapped by control messages on a running stream."""

import json

from pyspark.sql import functions as F

from tideline.operators.scoring import Split, tree_score
from tideline.streaming.versions import regression_model, still_waiting, swap_stream, tree_nodes, tree_walk
from tideline.workload.streams import drain


def put(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).selectExpr("timestamp_seconds(t) as at", "* except (t)").coalesce(1).write.mode("append").parquet(path)


def test_rows_wait_for_the_version_of_their_time(spark, tmp_path):
    rows, control = f"{tmp_path}/rows", f"{tmp_path}/control"
    kinds = ["MLR", "DTC"]
    schema, messages = "t long, id int, note string", "t long, kind string, model string"
    put(spark, rows, [(1000 + i, i, None if i % 2 else "x") for i in range(10)], schema)
    put(spark, rows, [(1100 + i, 100 + i, None) for i in range(5)], schema)
    put(spark, rows, [(1200, 200, "last")], schema)
    # the first files of both streams come together; versions of 1005 come a batch after their rows
    put(spark, control, [(1002, "MLR", "first"), (1002, "MLR", "a lesser text")], messages)
    put(spark, control, [(1005, "MLR", "second"), (1005, "DTC", "tree"), (1103, "DTC", "later tree")], messages)
    put(spark, control, [(1103, "MLR", "third"), (1110, None, "no kind")], messages)

    def stream(path):
        files = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", 1)
        return files.parquet(path)

    live = swap_stream(stream(rows), stream(control).withColumnRenamed("at", "since"), "at", kinds, "120 seconds", shards=3)
    out = drain(live, "swap", lambda c: still_waiting(spark, c, kinds)).collect()

    def want(t):
        regression = [(1103, "third"), (1005, "second"), (1002, "first"), (0, None)]
        tree = [(1103, "later tree"), (1005, "tree"), (0, None)]
        return tuple(next(m for since, m in known if since <= t) for known in (regression, tree))

    times = {**{i: 1000 + i for i in range(10)}, **{100 + i: 1100 + i for i in range(5)}, 200: 1200}
    assert {r.id: (r.model_MLR, r.model_DTC) for r in out} == {i: want(t) for i, t in times.items()}
    assert len(out) == len(times) and {r.note for r in out} == {None, "x", "last"}


def test_each_row_walks_its_own_tree(spark):
    trees = [Split("a", 1.0, Split("b", 0.5, 0, 1), Split("a", 2.0, 2, Split("b", -1.0, 3, 4))), Split("b", 0.0, 1, 0), 7]
    values = [None, -2.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, float("nan")]
    rows = spark.createDataFrame([(a, b, i) for a in values for b in values for i in range(4)], "a double, b double, i int")
    texts = F.create_map(*[F.lit(x) for i, t in enumerate(trees) for x in (i, json.dumps(tree_nodes(t, ["a", "b"])))])
    fixed = F.coalesce(*[F.when(F.col("i") == i, tree_score(t)) for i, t in enumerate(trees)])
    out = rows.select("i", tree_walk(texts[F.col("i")], ["a", "b"]).alias("walked"), fixed.alias("fixed"))
    assert out.where("NOT walked <=> fixed").isEmpty() and out.where("walked IS NOT NULL").count() > 150
    intercept, weights = regression_model(F.lit('{"intercept": 1.5, "weights": [2.0, 3.0]}'))
    assert tuple(spark.range(1).select(intercept, weights).first()) == (1.5, [2.0, 3.0])
    assert spark.range(1).select(regression_model(F.lit("not json"))[0]).first()[0] is None
