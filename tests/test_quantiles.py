"""Exact quantiles by narrowing brackets."""

import math
import random

import pytest

from tideline.operators import quantiles
from tideline.operators.quantiles import exact_quantiles

PLACES = {"a": 0.1, "b": 0.5, "c": 0.75}


def plain(values, p):
    place = min(max((len(values) + 1) * p, 1.0), float(len(values)))
    low, high = values[math.floor(place) - 1], values[math.ceil(place) - 1]
    return low + (place - math.floor(place)) * (high - low)


@pytest.mark.parametrize("few,grid", ((50_000, 256), (4, 6)))
def test_quantiles_like_sorting(spark, monkeypatch, few, grid):
    monkeypatch.setattr(quantiles, "FEW", few)
    monkeypatch.setattr(quantiles, "GRID", grid)
    rnd = random.Random(3)
    values = {
        0: [rnd.gauss(0, 100) for _ in range(400)],  # a third of the rows
        1: [float(rnd.randrange(4)) for _ in range(150)],  # ties
        2: [rnd.choice([1.0, 1e9, -1e9]) * rnd.random() ** 9 for _ in range(150)],  # far from even
        3: [5.0] * 90,
        4: [1.0],
        5: [2.0, 1.0],
        None: [float(i) for i in range(5)],
    }
    rows = [(k, "x", v) for k, vs in values.items() for v in vs] + [(0, "x", None), (6, "x", None)]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "k int, s string, v double").repartition(5)
    out = exact_quantiles(df, ["k", "s"], "v", PLACES)
    got = {r.k: r for r in out.collect()}
    assert set(got) == set(values)
    for k, vs in values.items():
        vs = sorted(vs)
        assert (got[k].n, got[k].most) == (len(vs), vs[-1])
        for name, p in PLACES.items():
            assert got[k][name] == pytest.approx(plain(vs, p), rel=1e-12, abs=1e-12), (k, name)
    assert "Window" not in out._jdf.queryExecution().toString()
