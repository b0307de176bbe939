"""C4.5 decision trees for many training requests at once, without a limit of depth or cuts.

Numeric features, exact thresholds: every value of a node is a candidate cut. The cut with the
greatest information gain is taken per feature (after the description-length charge for the
number of candidates), and the feature with the greatest gain ratio among those with at
least the average gain. Rows that lack a feature go both ways with parts of their weight.
Trees are pruned by the upper bound of their errors.

A node with more than LOCAL_ROWS rows is split by Spark: its attribute lists (feature, value,
class weights) are summed before the shuffle, sorted over range partitions and summed up by
partition, so a request with a third of all rows is split by all tasks. Smaller nodes are
grown to their end, one task for each, and pruned there; the nodes above are pruned level by
level from the estimates of their children.
"""

from __future__ import annotations

import json
from collections.abc import Sequence as Seq
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideline.operators.joins import lookup_join
from tideline.session import discard, materialise

#: Rows (different feature values and label) up to which a node is grown by one task.
LOCAL_ROWS = 200_000
#: Attribute list entries per range partition.
SLICE_ENTRIES = 1_000_000
# Fixed values of the method.
MIN_ROWS = 2
CONFIDENCE = 0.25
MOST_MIN_SPLIT = 25.0
_PRUNE_SLACK = 0.1
_SAME = 1e-3

LEFT, RIGHT = "L", "R"


def extra_errors(n, e, confidence: float = CONFIDENCE):
    """Errors to add to ``e`` of ``n`` for the upper bound at ``confidence``; arrays."""
    n, e = np.asarray(n, float), np.asarray(e, float)
    z = NormalDist().inv_cdf(1 - confidence)
    with np.errstate(divide="ignore", invalid="ignore"):
        none = n * (1 - confidence ** (1 / n))

        def beyond(e):
            f = (e + 0.5) / n
            bound = (f + z * z / (2 * n) + z * np.sqrt(np.maximum(f / n - f * f / n + z * z / (4 * n * n), 0))) / (1 + z * z / n)
            return np.where(e + 0.5 >= n, np.maximum(n - e, 0), bound * n - e)

        return np.where(n <= 0, 0.0, np.where(e < 1, none + e * (beyond(np.ones_like(e)) - none), beyond(e)))


def _extra_errors(n: Column, e: Column, confidence: float) -> Column:
    z = NormalDist().inv_cdf(1 - confidence)

    def beyond(e: Column) -> Column:
        f = (e + 0.5) / n
        bound = (f + z * z / (2 * n) + z * F.sqrt(F.greatest(f / n - f * f / n + z * z / (4 * n * n), F.lit(0.0)))) / (1 + z * z / n)
        return F.when(e + 0.5 >= n, F.greatest(n - e, F.lit(0.0))).otherwise(bound * n - e)

    none = n * (1 - F.pow(F.lit(confidence), 1 / n))
    return F.when(n <= 0, 0.0).when(e < 1, none + e * (beyond(F.lit(1.0)) - none)).otherwise(beyond(e))


def _entropy(parts: np.ndarray) -> np.ndarray:
    """Bits times weight of class weights along the last axis."""
    total = parts.sum(-1)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(parts > 0, parts * np.log2(np.where(parts > 0, parts, 1)), 0.0)
    return np.where(total > 0, total * np.log2(np.where(total > 0, total, 1)), 0.0) - terms.sum(-1)


def _best_cut(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, min_rows: float):
    """(gain, ratio, cut, left share) of one feature of a node, or None."""
    known = ~np.isnan(x)
    order = np.argsort(x[known], kind="stable")
    v, c, wk = x[known][order], y[known][order], w[known][order]
    if not len(v):
        return None
    each = np.zeros((len(v), classes))
    each[np.arange(len(v)), c] = wk
    upto = np.cumsum(each, 0)
    last = np.flatnonzero(np.append(v[1:] != v[:-1], False))
    left, whole = upto[last], upto[-1]
    return _judged(left, whole, v[last], w.sum(), classes, min_rows)


def _judged(left, whole, cuts, total, classes, min_rows):
    known = whole.sum()
    n_left = left.sum(1)
    least = min(max(0.1 * known / classes, min_rows), max(MOST_MIN_SPLIT, min_rows))
    good = (n_left >= least - 1e-9) & (known - n_left >= least - 1e-9)
    if not good.any():
        return None
    left, cuts, n_left = left[good], cuts[good], n_left[good]
    gains = np.round((_entropy(whole) - _entropy(left) - _entropy(whole - left)) / total, 12)
    best = int(np.argmax(gains))
    gain = gains[best] - np.log2(len(cuts)) / total
    if gain <= 1e-12:
        return None
    parts = np.array([n_left[best], known - n_left[best], total - known])
    info = _entropy(parts) / total
    return gain, round(float(gain / info), 12), float(cuts[best]), float(n_left[best] / known)


def _chosen(found: list) -> int | None:
    """Index of the feature to split by."""
    gains = [f[0] for f in found if f]
    if not gains:
        return None
    enough = sum(gains) / len(gains) - _SAME
    return max((i for i, f in enumerate(found) if f and f[0] >= enough), key=lambda i: (found[i][1], -i))


def grow(x: np.ndarray, y: np.ndarray, w: np.ndarray, classes: int, min_rows: float, confidence: float | None) -> list[dict]:
    """Nodes of a pruned tree (path, feature, cut, weights, error estimates), the root first."""
    nodes: list[dict] = []
    todo = [("", np.arange(len(y)), w)]
    while todo:
        path, rows, weight = todo.pop()
        weights = np.bincount(y[rows], weight, classes)
        node = {"path": path, "feature": None, "cut": None, "weights": weights, "children": ()}
        nodes.append(node)
        total = weights.sum()
        if total < 2 * min_rows or weights.max() >= total - 1e-9:
            continue
        found = [_best_cut(x[rows, i], y[rows], weight, classes, min_rows) for i in range(x.shape[1])]
        at = _chosen(found)
        if at is None:
            continue
        _, _, cut, share = found[at]
        node["feature"], node["cut"] = at, cut
        value = x[rows, at]
        for side, part, inside in ((LEFT, share, value <= cut), (RIGHT, 1 - share, value > cut)):
            lacks = np.isnan(value)
            own = inside | lacks
            todo.append((path + side, rows[own], np.where(lacks, weight * part, weight)[own]))
    by_path = {n["path"]: n for n in nodes}
    for node in sorted(nodes, key=lambda n: -len(n["path"])):
        total = node["weights"].sum()
        wrong = total - node["weights"].max(initial=0)
        estimate = wrong + float(extra_errors(total, wrong, confidence)) if confidence else wrong
        if node["feature"] is not None:
            kids = [by_path[node["path"] + s] for s in (LEFT, RIGHT)]
            errors = sum(k["errors"] for k in kids)
            below = sum(k["estimate"] for k in kids)
            if confidence and (wrong <= errors + _SAME or estimate <= below + _PRUNE_SLACK):
                node["feature"] = node["cut"] = None
                node["errors"] = min(wrong, errors) if wrong > errors + _SAME else wrong
                node["estimate"] = estimate
            else:
                node["errors"], node["estimate"] = errors, below
        else:
            node["errors"], node["estimate"] = wrong, estimate
    kept, todo = [], [""]
    while todo:
        node = by_path[todo.pop()]
        kept.append(node)
        if node["feature"] is not None:
            todo += [node["path"] + RIGHT, node["path"] + LEFT]
    return kept


def _total(columns: Seq[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _bits(parts: Seq[Column]) -> Column:
    each = [F.when(p > 0, p * F.log2(p)).otherwise(0.0) for p in parts]
    total = _total(parts)
    return F.when(total > 0, total * F.log2(total)).otherwise(0.0) - _total(each)


def _running(lists: DataFrame, group: Seq[str], names: Seq[str]) -> DataFrame:
    """Class weights up to each value of a (node, feature), over range partitions."""
    shuffle = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(shuffle, -(-lists.count() // SLICE_ENTRIES))
    ranged = lists.repartitionByRange(slices, *group, "value").withColumn("slice", F.spark_partition_id())
    ranged = materialise(ranged)
    within = Window.partitionBy(*group, "slice").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(*group).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    # a row for each node, feature and slice
    sums = ranged.groupBy(*group, "slice").agg(*[F.sum(n).alias(n) for n in names])
    before = sums.select(*group, "slice", *[F.coalesce(F.sum(n).over(earlier), F.lit(0.0)).alias(f"{n}_before") for n in names])
    upto = ranged.select(*group, "slice", "value", *[F.sum(n).over(within).alias(n) for n in names]).join(before, [*group, "slice"])
    return upto.select(*group, "value", *[(F.col(n) + F.col(f"{n}_before")).alias(n) for n in names])


def _split_large(rows: DataFrame, keys: Seq[str], features: Seq[str], classes: Seq[str], min_rows: float) -> DataFrame:
    """One row per large node: class weights ``t*``, and feature, cut and left share where it is split."""
    names, totals = [f"c{i}" for i in range(len(classes))], [f"t{i}" for i in range(len(classes))]
    node = [*keys, "node"]
    per_class = [F.sum(F.when(F.col("label") == i, F.col("weight")).otherwise(0.0)) for i in range(len(classes))]
    whole = rows.groupBy(*node).agg(*[c.alias(t) for c, t in zip(per_class, totals)])
    entries = F.explode(F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).alias("value")) for i, f in enumerate(features)])).alias("e")
    lists = rows.select(*node, "label", "weight", entries).select(*node, "label", "weight", "e.feature", "e.value").where("value IS NOT NULL")
    lists = materialise(lists.groupBy(*node, "feature", "value").agg(*[c.alias(n) for c, n in zip(per_class, names)]))
    group = [*node, "feature"]
    known = lists.groupBy(*group).agg(*[F.sum(n).alias(f"k{i}") for i, n in enumerate(names)])
    cuts = _running(lists, group, names).join(known, group).join(whole, node)
    left, all_known = [F.col(n) for n in names], [F.col(f"k{i}") for i in range(len(names))]
    right = [k - c for k, c in zip(all_known, left)]
    n_left, n_known, total = _total(left), _total(all_known), _total([F.col(t) for t in totals])
    least = F.least(F.greatest(n_known * 0.1 / len(classes), F.lit(float(min_rows))), F.lit(max(MOST_MIN_SPLIT, float(min_rows))))
    good = cuts.where((n_left >= least - 1e-9) & (n_known - n_left >= least - 1e-9) & (n_known > n_left))
    gain = F.round((_bits(all_known) - _bits(left) - _bits(right)) / total, 12)
    best = good.groupBy(*group).agg(
        F.count(F.lit(1)).alias("tried"),
        F.max(F.struct(gain.alias("gain"), (-F.col("value")).alias("low"), n_left.alias("n_left"), n_known.alias("known"), total.alias("total"))).alias("b"),
    )
    gained = F.col("b.gain") - F.log2(F.col("tried")) / F.col("b.total")
    info = _bits([F.col("b.n_left"), F.col("b.known") - F.col("b.n_left"), F.col("b.total") - F.col("b.known")]) / F.col("b.total")
    per_feature = best.select(*group, gained.alias("gain"), F.round(gained / info, 12).alias("ratio"), (-F.col("b.low")).alias("cut"), (F.col("b.n_left") / F.col("b.known")).alias("share"))
    per_feature = per_feature.where("gain > 1e-12").withColumn("mean", F.avg("gain").over(Window.partitionBy(*node)))
    top = F.max(F.struct("ratio", (-F.col("feature")).alias("f"), "cut", "share")).alias("m")
    chosen = per_feature.where(F.col("gain") >= F.col("mean") - _SAME).groupBy(*node).agg(top)
    chosen = chosen.select(*node, (-F.col("m.f")).alias("feature"), "m.cut", "m.share")
    most = F.greatest(*[F.col(t) for t in totals]) if len(totals) > 1 else F.col(totals[0])
    open_ones = (total >= 2 * min_rows) & (most < total - 1e-9)
    out = whole.join(chosen, node, "left")
    return out.select(*node, *totals, *[F.when(open_ones, F.col(c)).alias(c) for c in ("feature", "cut", "share")])


def train_c45(
    df: DataFrame,
    keys: Seq[str],
    features: Seq[str],
    label: str,
    classes: Seq[str],
    min_rows: int = MIN_ROWS,
    confidence: float | None = CONFIDENCE,
) -> DataFrame:
    """Node table (keys, node, feature, threshold, label, rows, errors) of one tree per key.

    ``node`` is the path from the root ('', 'L', 'LR', …); rows with ``feature`` <=
    ``threshold`` go left, and the threshold is a value of the node's rows. ``feature`` is null
    at a leaf. ``rows`` is the weight of the rows there, ``errors`` that of other classes than
    ``label``. Rows without a key, or with a label that is none of ``classes``, are left out; NaN
    counts as missing. ``confidence`` None keeps the whole tree. Subtrees are replaced by leaves, never
    raised.
    """
    keys, features = list(keys), list(features)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    values = [F.when(~F.isnan(F.col(f).cast("double")), F.col(f).cast("double")).alias(f) for f in features]
    rows = df.dropna(subset=keys).select(*keys, *values, code.alias("label")).where("label >= 0")
    rows = rows.groupBy(*keys, *features, "label").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    rows = materialise(rows.withColumn("node", F.lit("")))
    node = [*keys, "node"]
    totals = [f"t{i}" for i in range(len(classes))]
    key_fields = [rows.schema[k] for k in keys]
    fields = [("node", "string"), ("feature", "int"), ("cut", "double"), ("errors", "double"), ("estimate", "double"), *[(t, "double") for t in totals]]
    schema = T.StructType([*key_fields, *T._parse_datatype_string(", ".join(f"{n} {t}" for n, t in fields)).fields])

    def small(frame: pd.DataFrame) -> pd.DataFrame:
        at = frame["node"].iloc[0]
        order = frame.sort_values([*features, "label"], kind="stable")
        x, y = order[features].to_numpy(float), order["label"].to_numpy(int)
        out = grow(x, y, order["weight"].to_numpy(float), len(classes), min_rows, confidence)
        found = pd.DataFrame([(at + n["path"], n["feature"], n["cut"], n["errors"], n["estimate"], *n["weights"]) for n in out], columns=[n for n, _ in fields])
        found["feature"] = found["feature"].astype("Int32")
        for k in keys:
            found[k] = frame[k].iloc[0]
        return found[schema.names]

    done: list[DataFrame] = []  # grown by tasks, with their subtrees
    above: list[DataFrame] = []  # by level
    while True:
        sizes = rows.groupBy(*node).agg((F.count(F.lit(1)) > LOCAL_ROWS).alias("large"))
        dealt = lookup_join(rows, sizes.where("large").select(*node), node, "left_semi") if not sizes.where("large").isEmpty() else None
        rest = rows if dealt is None else rows.join(sizes.where("NOT large").select(*node), node, "left_semi")
        done.append(materialise(rest.groupBy(*node).applyInPandas(small, schema)))
        if dealt is None:
            break
        split = materialise(_split_large(dealt, keys, features, classes, min_rows))
        above.append(split)
        moved = lookup_join(dealt, split.where("feature IS NOT NULL").select(*node, "feature", "cut", "share"), node, "inner")
        value = F.coalesce(*[F.when(F.col("feature") == i, F.col(f)) for i, f in enumerate(features)])
        both = F.array(F.struct(F.lit(LEFT).alias("side"), F.col("share").alias("part")), F.struct(F.lit(RIGHT).alias("side"), (1 - F.col("share")).alias("part")))
        one = lambda side: F.array(F.struct(F.lit(side).alias("side"), F.lit(1.0).alias("part")))
        to = F.explode(F.when(value.isNull(), both).when(value <= F.col("cut"), one(LEFT)).otherwise(one(RIGHT)))
        moved = moved.withColumn("to", to).withColumns({"node": F.concat("node", "to.side"), "weight": F.col("weight") * F.col("to.part")})
        moved = materialise(moved.select(*node, *features, "label", "weight"))
        discard(rows)
        rows = moved
    nodes = reduce(DataFrame.unionByName, done)
    for split in reversed(above):
        nodes = materialise(_join_above(split, nodes, keys, totals, confidence, schema))
    ranking = F.array_max(F.array(*[F.struct(F.col(t).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("label")) for i, (t, c) in enumerate(zip(totals, classes))]))
    total = _total([F.col(t) for t in totals])
    feature = F.get(F.array(*[F.lit(f) for f in features]), F.col("feature")).alias("feature")
    return nodes.select(*keys, "node", feature, F.col("cut").alias("threshold"), ranking["label"].alias("label"), total.alias("rows"), (total - ranking["n"]).alias("errors"))


def _join_above(split: DataFrame, nodes: DataFrame, keys: Seq[str], totals: Seq[str], confidence: float | None, schema: T.StructType) -> DataFrame:
    """Nodes of one more level: split by Spark, pruned by the estimates of the two children."""
    node = [*keys, "node"]
    total = _total([F.col(t) for t in totals])
    most = F.greatest(*[F.col(t) for t in totals]) if len(totals) > 1 else F.col(totals[0])
    wrong = total - most
    kids = nodes.select(*keys, F.expr("substring(node, 1, length(node) - 1)").alias("node"), "errors", "estimate", F.length("node").alias("depth"))
    # the children alone, not the nodes below them
    level = split.select(F.length("node").alias("n")).first()
    kids = kids.where(F.col("depth") == (level.n if level else 0) + 1).groupBy(*node).agg(F.sum("errors").alias("errors"), F.sum("estimate").alias("below"))
    joined = split.join(kids, node, "left").withColumns({"wrong": wrong, "own": wrong + (_extra_errors(total, wrong, confidence) if confidence else F.lit(0.0))})
    inner = F.col("feature").isNotNull()
    leaf = ~inner if confidence is None else ~inner | (F.col("wrong") <= F.col("errors") + _SAME) | (F.col("own") <= F.col("below") + _PRUNE_SLACK)
    level_nodes = joined.withColumn("leaf", leaf).select(
        *node,
        F.when(~F.col("leaf"), F.col("feature")).alias("feature"),
        F.when(~F.col("leaf"), F.col("cut")).alias("cut"),
        F.when(~inner, F.col("wrong")).otherwise(F.least("wrong", "errors")).alias("errors"),
        F.when(F.col("leaf"), F.col("own")).otherwise(F.col("below")).alias("estimate"),
        *totals,
        "leaf",
    )
    cut_off = level_nodes.where("leaf").select(*keys, F.col("node").alias("top"))
    size = (level.n if level else 0)
    below = nodes.withColumn("top", F.substring("node", 1, size))
    below = lookup_join(below, cut_off.withColumn("gone", F.lit(True)), [*keys, "top"]).where("gone IS NULL OR length(node) <= " + str(size))
    return below.select(*schema.names).unionByName(level_nodes.select(*schema.names))


def tree_texts(nodes: DataFrame, keys: Seq[str], features: Seq[str], classes: Seq[str]) -> DataFrame:
    """One row per key: ``model``, the tree as the text that a stream's ``tree_walk`` reads.

    Labels are indexes of ``classes``. A model is read whole by whoever scores with it, so a
    tree is one row.
    """
    keys, names = list(keys), list(classes)

    def text(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node", kind="stable")
        at = {p: i for i, p in enumerate(frame["node"])}
        table = []
        for r in frame.itertuples(index=False):
            leaf = not isinstance(r.feature, str)
            table.append(
                {
                    "field": -1 if leaf else list(features).index(r.feature),
                    "threshold": None if leaf else float(r.threshold),
                    "left": -1 if leaf else at[r.node + LEFT],
                    "right": -1 if leaf else at[r.node + RIGHT],
                    "label": names.index(r.label),
                }
            )
        out = {k: [frame[k].iloc[0]] for k in keys}
        return pd.DataFrame({**out, "model": [json.dumps({"depth": max(map(len, at)), "nodes": table})]})

    schema = T.StructType([*[nodes.schema[k] for k in keys], T.StructField("model", T.StringType())])
    return nodes.select(*keys, "node", "feature", "threshold", "label").groupBy(*keys).applyInPandas(text, schema)
