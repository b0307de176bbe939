import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators.scoring import Split, error_estimate, linear_score, tree_fields, tree_score
from tideline.operators.training import (
    annotate_quartiles,
    fit_linear,
    fit_tree,
    quartile_bounds,
    train_linear,
)
from tideline.operators.trees import score_trees, train_trees
from tideline.sources.registry import Registry, latest_models


def test_percentile_rule(spark):
    """Positions p (n + 1): the first quartile of 1..4 is 1.25."""
    rows = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "v double")
    b = quartile_bounds(rows, [], "v").first()
    assert (b["q25"], b["q50"], b["q75"], b["q100"]) == (1.25, 2.5, 3.75, 4.0)


def test_percentile_of_few_values(spark):
    rows = spark.createDataFrame([("a", 5.0), ("b", 1.0), ("b", 2.0)], "k string, v double")
    out = {r["k"]: (r["q25"], r["q50"], r["q75"]) for r in quartile_bounds(rows, ["k"], "v").collect()}
    assert out == {"a": (5.0, 5.0, 5.0), "b": (1.0, 1.5, 2.0)}


def test_labels_and_ties(spark):
    rows = spark.createDataFrame(
        [("a", float(v)) for v in range(1, 9)] + [("t", 7.0)] * 3, "k string, v double"
    )
    out = annotate_quartiles(rows, ["k"], "v")
    by = {(r["k"], r["v"]): r["result"] for r in out.collect()}
    assert [by["a", float(v)] for v in range(1, 9)] == ["BAD"] * 4 + ["GOOD"] * 2 + ["VERYGOOD", "EXCELLENT"]
    assert by["t", 7.0] == "EXCELLENT"


def test_linear_training_matches_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 3)) * [1, 10, 100] + 5
    y = 2 + x @ [0.5, -1.5, 0.25] + rng.normal(size=300)
    data = [(int(i % 2), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))]
    rows = spark.createDataFrame(data, "k int, a double, b double, c double, y double")
    for m in train_linear(rows, ["k"], ["a", "b", "c"], "y").collect():
        own = [d for d in data if d[0] == m["k"]]
        design = np.array([[1, *d[1:4]] for d in own])
        expected = np.linalg.lstsq(design, np.array([d[4] for d in own]), rcond=None)[0]
        assert [m["intercept"], *m["weights"]] == pytest.approx(expected.tolist(), rel=1e-7)


def test_collinear_features_still_fit(spark):
    rows = spark.createDataFrame([(1, float(i), 2.0 * i, 3.0 * i + 1) for i in range(20)], "k int, a double, b double, y double")
    m = train_linear(rows, ["k"], ["a", "b"], "y").first()
    assert m["intercept"] + m["weights"][0] * 5 + m["weights"][1] * 10 == pytest.approx(16.0)


def plain_elimination(x, y):
    """By fitting every set of features anew."""
    n, kept = len(y), []

    def left(of):
        design = np.column_stack([np.ones(n), *[x[:, k] for k in of]])
        w = np.linalg.lstsq(design, y, rcond=None)[0]
        return ((y - design @ w) ** 2).sum(), w[1:]

    for k in range(x.shape[1]):
        design = np.column_stack([np.ones(n), *[x[:, j] for j in kept]])
        open_part = x[:, k] - design @ np.linalg.lstsq(design, x[:, k], rcond=None)[0]
        if x[:, k].var() > 0 and open_part.var() > 1e-9 * x[:, k].var():
            kept.append(k)
    most, whole = len(kept) + 1, left(kept)[0]
    best = n + most
    while kept:
        sizes = np.abs(left(kept)[1] * x[:, kept].std(axis=0))
        fewer = [k for k in kept if k != kept[int(np.argmin(sizes))]]
        criterion = (n - most) * left(fewer)[0] / whole + 2 * (len(fewer) + 1)
        if criterion >= best:
            break
        kept, best = fewer, criterion
    return {k: w for k, w in zip(kept, left(kept)[1])}


def test_elimination_like_fitting_every_set_anew(spark):
    rng = np.random.default_rng(12)
    data, want = [], {}
    for key in range(40):
        n = int(rng.integers(12, 80))
        x = rng.normal(size=(n, 5)) * [1, 100, 0.01, 1, 5] + [0, 1000, 5, 0, 0]
        x[:, 4] = 2 * x[:, 0] - x[:, 3] + 3 if key % 3 == 0 else x[:, 4]  # collinear
        x[:, 2] = 7.0 if key % 5 == 0 else x[:, 2]  # constant
        y = 1 + x @ (rng.choice([0, 0, 1, -2], 5) / [1, 100, 0.01, 1, 5]) + rng.normal(size=n)
        want[key] = plain_elimination(x, y)
        data += [(key, *map(float, r), float(t)) for r, t in zip(x, y)]
    rows = spark.createDataFrame(data, "k int, a double, b double, c double, d double, e double, y double")
    sizes = set()
    for m in train_linear(rows, ["k"], list("abcde"), "y", select=True).collect():
        got = {i: w for i, w in enumerate(m["weights"]) if w}
        assert set(got) == set(want[m["k"]]) and all(got[i] == pytest.approx(w, rel=1e-6) for i, w in want[m["k"]].items())
        sizes.add(len(got))
    assert len(sizes) > 2


def test_whole_table_models(spark):
    rows = spark.range(200).select(
        F.col("id").cast("double").alias("a"),
        (F.col("id") % 7).cast("double").alias("b"),
        (F.col("id") * 2.0 + (F.col("id") % 7) + 1).alias("y"),
        F.when(F.col("id") < 90, "low").otherwise("high").alias("label"),
    )
    linear = fit_linear(rows, ["a", "b"], "y").stages[-1]
    assert linear.coefficients.toArray().tolist() == pytest.approx([2.0, 1.0])
    tree = fit_tree(rows, ["a", "b"], "label", depth=2)
    assert tree.transform(rows).filter("prediction != label_index").count() == 0


def entropy(labels):
    return -sum(c / len(labels) * math.log2(c / len(labels)) for c in Counter(labels).values())


def best_root(rows, features):
    best = None
    for i, name in enumerate(features):
        for cut in sorted({r[i] for r in rows})[:-1]:
            left = [r[-1] for r in rows if r[i] <= cut]
            right = [r[-1] for r in rows if r[i] > cut]
            n = len(rows)
            gain = entropy([r[-1] for r in rows]) - len(left) / n * entropy(left) - len(right) / n * entropy(right)
            if gain <= 1e-9:
                continue
            ratio = gain / entropy([0] * len(left) + [1] * len(right))
            if best is None or ratio > best[0] + 1e-12:
                best = (ratio, name, cut)
    return best


def test_tree_roots_by_brute_force(spark):
    rng = np.random.default_rng(5)
    data = []
    for k in range(4):
        for _ in range(40):
            a, b = float(rng.integers(0, 8)), float(rng.integers(0, 8))
            label = ("x", "y", "z")[int((a > 2 + k) + (b > 4))] if rng.random() > 0.1 else "x"
            data.append((k, a, b, label))
    rows = spark.createDataFrame(data, "k int, a double, b double, label string")
    nodes = train_trees(rows, ["k"], ["a", "b"], "label", ("x", "y", "z"), depth=3, min_rows=1, bins=64)
    roots = {r["k"]: r for r in nodes.filter("node = 1").collect()}
    for k in range(4):
        own = [d[1:] for d in data if d[0] == k]
        ratio, name, cut = best_root(own, ["a", "b"])
        chosen = roots[k]
        left = [r for r in own if r[["a", "b"].index(chosen["feature"])] <= chosen["threshold"]]
        again = best_root(own, [name])
        assert chosen["rows"] == 40 and 0 < len(left) < 40
        assert (chosen["feature"], chosen["threshold"]) == (name, cut) or again[0] == pytest.approx(ratio)
    scored = score_trees(rows.drop("label").withColumn("id", F.monotonically_increasing_id()), nodes, ["k"], ["a", "b"], 3)
    assert scored.count() == 160 and scored.filter("label IS NULL").count() == 0


def test_tree_without_split_is_a_leaf(spark):
    rows = spark.createDataFrame([(1, 1.0, "x"), (1, 2.0, "x")], "k int, a double, label string")
    nodes = train_trees(rows, ["k"], ["a"], "label", ("x", "y")).collect()
    assert len(nodes) == 1 and nodes[0]["feature"] is None and nodes[0]["label"] == "x"


def test_scores_cut_towards_zero(spark):
    rows = spark.createDataFrame([(1.0,), (-1.0,), (None,)], "a double")
    out = [r[0] for r in rows.select(linear_score(["a"], F.lit(0.0), [F.lit(2.9)])).collect()]
    assert out == [2.0, -2.0, None]


def test_tree_score(spark):
    tree = Split("a", 1.0, 0, Split("b", 5.0, 1, 2))
    rows = spark.createDataFrame([(1.0, 9.0), (2.0, 5.0), (2.0, 6.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in rows.select(tree_score(tree)).collect()] == [0.0, 1.0, 2.0, None]
    assert tree_fields(tree) == {"a", "b"}


def test_error_without_average_is_null(spark):
    rows = spark.createDataFrame([(5.0, 3.0, 2.0), (5.0, 3.0, 0.0), (5.0, 3.0, None)], "o double, p double, a double")
    out = [r[0] for r in rows.select(error_estimate(F.col("o"), F.col("p"), F.col("a"))).collect()]
    assert out == [1.0, None, None]


def test_registry_latest(spark, tmp_path):
    registry = Registry(str(tmp_path))
    schema = "name string, kind string, created_at long, intercept double, weights array<double>"
    registry.append(spark.createDataFrame([("m", "MLR", 1, 1.0, [1.0]), ("n", "DTC", 1, 9.0, [])], schema))
    registry.append(spark.createDataFrame([("m", "MLR", 2, 2.0, [2.0])], schema))
    assert registry.latest_named(spark, "m")["intercept"] == 2.0
    assert registry.latest_named(spark, "none") is None
    assert latest_models(registry.read(spark)).count() == 2


def test_registry_keeps_pipelines(spark, tmp_path):
    rows = spark.range(50).select(F.col("id").cast("double").alias("a"), (F.col("id") * 3.0).alias("y"))
    registry = Registry(str(tmp_path))
    registry.save_pipeline(spark, fit_linear(rows, ["a"], "y"), "whole", "MLR")
    back = registry.load_pipeline(spark, "whole")
    assert back.transform(rows).first()["prediction"] == pytest.approx(0.0, abs=1e-6)
    with pytest.raises(KeyError):
        registry.load_pipeline(spark, "other")
