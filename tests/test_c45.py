"""C4.5 trees: split by Spark as by one task, exact cuts, missing values, pruning."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tideline.operators import c45
from tideline.operators.c45 import extra_errors, train_c45, tree_texts
from tideline.streaming.versions import tree_walk

CLASSES = ["a", "b", "c"]
FEATURES = ["x", "y", "z"]


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(4)
    out = []
    for i in range(420):
        key = 0 if i % 3 else 1 + i % 4  # one key has two thirds
        x, y, z = rnd.randrange(40) / 4, round(rnd.random(), 2), rnd.randrange(3) * 1.0
        label = "a" if x < 4 else "b" if y < 0.5 else "c"
        if rnd.random() < 0.1:
            label = rnd.choice(CLASSES)
        gaps = [None if rnd.random() < 0.06 else v for v in (x, y, z)]
        out.append((key, *gaps, label))
    out += [(9, 1.0, 1.0, 1.0, "a")] * 3 + [(10, None, None, None, "b"), (10, None, float("nan"), None, "c")]
    out += [(k, float(i), 0.0, 0.0, "ab"[i // 5]) for i in range(10) for k in (8, None)] + [(11, 1.0, 1.0, 1.0, None), (11, 1.0, 1.0, 1.0, "other")]
    return spark.createDataFrame(out, "k int, x double, y double, z double, label string").cache()


def table(nodes):
    return {(r.k, r.node): (r.feature, r.threshold, r.label, round(r.rows, 6), round(r.errors, 6)) for r in nodes.collect()}


@pytest.mark.parametrize("confidence", (None, 0.25))
def test_spark_splits_like_one_task(spark, rows, monkeypatch, confidence):
    whole = table(train_c45(rows, ["k"], FEATURES, "label", CLASSES, confidence=confidence))
    monkeypatch.setattr(c45, "LOCAL_ROWS", 60)
    monkeypatch.setattr(c45, "SLICE_ENTRIES", 50)
    split = table(train_c45(rows, ["k"], FEATURES, "label", CLASSES, confidence=confidence))
    assert split == whole
    assert whole[8, ""][:2] == ("x", 4.0) and whole[9, ""][0] is None and whole[10, ""][0] is None
    assert max(len(n) for k, n in whole if k == 0) > (1 if confidence else 3) and not any(k in (None, 11) for k, _ in whole)


def test_root_has_the_greatest_gain_ratio(spark, rows):
    """Against a plain search over all cuts of all features."""
    nodes = table(train_c45(rows, ["k"], FEATURES, "label", CLASSES, confidence=None))
    bits = lambda ns: sum(-n / sum(ns) * math.log2(n / sum(ns)) for n in ns if n) if sum(ns) else 0.0
    for key in (0, 1, 3):
        data = [(r.x, r.y, r.z, r.label) for r in rows.where(F.col("k") == key).collect()]
        found = []
        for i in range(3):
            known = [r for r in data if r[i] is not None]
            least = min(max(0.1 * len(known) / 3, 2), 25)
            tried = []
            for cut in sorted({r[i] for r in known}):
                left, right = [r for r in known if r[i] <= cut], [r for r in known if r[i] > cut]
                if len(left) >= least and len(right) >= least:
                    of = lambda part: [sum(r[3] == c for r in part) for c in CLASSES]
                    inside = (len(left) * bits(of(left)) + len(right) * bits(of(right))) / len(known)
                    tried.append((len(known) / len(data) * (bits(of(known)) - inside), cut, [len(left), len(right), len(data) - len(known)]))
            if tried:
                gain, cut, parts = max(tried, key=lambda t: (round(t[0], 12), -t[1]))
                gain -= math.log2(len(tried)) / len(data)
                if gain > 0:
                    found.append((gain, gain / bits(parts), FEATURES[i], cut))
        mean = sum(f[0] for f in found) / len(found) - 1e-3
        best = max((f for f in found if f[0] >= mean), key=lambda f: f[1])
        assert nodes[key, ""][:2] == best[2:]


def test_pruning_makes_smaller_trees_that_still_fit(spark, rows):
    full = train_c45(rows, ["k"], FEATURES, "label", CLASSES, confidence=None)
    pruned = train_c45(rows, ["k"], FEATURES, "label", CLASSES)
    sizes = lambda t: dict(t.groupBy("k").count().collect())
    a, b = sizes(full), sizes(pruned)
    assert all(b[k] <= a[k] for k in a) and b[0] < a[0]
    leaves = pruned.where("feature IS NULL").groupBy("k").agg(F.sum("errors").alias("e"), F.sum("rows").alias("n")).collect()
    share = {r.k: r.e / r.n for r in leaves}
    assert 0.03 < share[0] < 0.15 and share[8] == 0
    # the stored text scores rows without gaps as the node table says
    texts = tree_texts(pruned, ["k"], FEATURES, CLASSES)
    done = rows.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND label IN ('a', 'b', 'c') AND k < 9").join(texts, "k")
    done = done.withColumn("got", F.element_at(F.array(*map(F.lit, CLASSES)), tree_walk(F.col("model"), FEATURES).cast("int") + 1))
    assert done.where("got IS NULL").isEmpty() and done.where("got = label").count() > 0.85 * done.count()


def test_error_bound():
    assert abs(float(extra_errors(6, 0)) - 6 * (1 - 0.25 ** (1 / 6))) < 1e-12  # 1.2378
    assert abs(float(extra_errors(16, 1)) - 1.512) < 0.05  # the binomial limit, here by its normal form
    assert float(extra_errors(2, 2)) == 0 and 0 < float(extra_errors(10, 0.5)) < float(extra_errors(10, 1)) + 1
