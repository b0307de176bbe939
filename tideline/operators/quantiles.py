"""Exact order statistics per key by narrowing brackets, without numbering the rows.

For every wanted place the rows of a key are counted below and inside a bracket of values
that holds it, together with a mergeable sketch of the values inside; the sketch proposes a
narrower bracket. When at most FEW rows are inside, or all are equal, their values are
counted and the place is read off. Each pass is one aggregation that combines before its
shuffle, and a bracket shrinks some GRID / 4 times a pass: three or four passes for any size.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.joins import lookup_join
from tideline.session import materialise

#: Rows inside a bracket from which its values are counted one by one.
FEW = 50_000
#: Steps of the sketch of a bracket.
GRID = 256

_KEY = "__key"


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """Lower and upper rank at position p (n + 1), clamped, and the share of the upper one."""
    place = F.least(F.greatest((n + 1) * p, F.lit(1.0)), n.cast("double"))
    return F.floor(place), F.ceil(place), place - F.floor(place)


def exact_quantiles(df: DataFrame, keys: Seq[str], value: str, places: dict[str, float]) -> DataFrame:
    """Per key: ``n``, ``most`` (the maximum) and the value at position p (n + 1) for each place.

    Values between two rows are interpolated; null values do not count, and a key without
    others has no row.
    """
    keys = list(keys)
    ranks = {f"{q}_{i}": _ranks(F.col("n"), p)[i] for q, p in places.items() for i in (0, 1)}
    rows = df.where(F.col(value).isNotNull()).select(F.struct(*keys).alias(_KEY), F.col(value).alias("v"))
    state = rows.groupBy(_KEY).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    for t in ranks:
        # counts are of the whole key at first, so that small keys need no pass of their own
        state = state.withColumns({f"{t}_lo": F.col("least"), f"{t}_hi": F.col("most"), f"{t}_below": F.lit(0).cast("long"), f"{t}_in": F.col("n")})
    state = materialise(state)
    many = F.lit(False)
    for t in ranks:
        many = many | ((F.col(f"{t}_in") > FEW) & (F.col(f"{t}_lo") < F.col(f"{t}_hi")))
    while not state.where(many).isEmpty():
        found = materialise(_narrowed(rows, state.where(many), ranks))
        state = materialise(state.where(~many).unionByName(found))

    joined = lookup_join(rows, state, [_KEY], "inner")
    within = F.explode(F.array(*[F.when((F.col("v") >= F.col(f"{t}_lo")) & (F.col("v") <= F.col(f"{t}_hi")), F.lit(t)) for t in ranks]))
    counted = joined.select(_KEY, "v", within.alias("t")).where("t IS NOT NULL").groupBy(_KEY, "t", "v").agg(F.count(F.lit(1)).alias("c"))
    lists = counted.groupBy(_KEY).agg(*[F.array_sort(F.collect_list(F.when(F.col("t") == t, F.struct("v", "c")))).alias(f"{t}_list") for t in ranks])
    out = lookup_join(state, materialise(lists), [_KEY], "inner")
    values = []
    for q, p in places.items():
        low, high = (_at(F.col(f"{q}_{i}_list"), ranks[f"{q}_{i}"] - F.col(f"{q}_{i}_below")) for i in (0, 1))
        values.append((low + _ranks(F.col("n"), p)[2] * (high - low)).alias(q))
    return out.select(*[F.col(f"{_KEY}.{k}").alias(k) for k in keys], "n", "most", *values)


def _at(values: Column, rank: Column) -> Column:
    """The value of a rank in an ordered list of (value, count)."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.element_at(values, 1)["v"].alias("v"))

    def step(seen: Column, x: Column) -> Column:
        return F.struct((seen["upto"] + x["c"]).alias("upto"), F.when(seen["upto"] < rank, x["v"]).otherwise(seen["v"]).alias("v"))

    return F.aggregate(values, start, step)["v"]


def _narrowed(rows: DataFrame, state: DataFrame, ranks: dict[str, Column]) -> DataFrame:
    """One pass: brackets from sketches of the values inside the present ones, with exact counts.

    The ends of a proposed bracket are judged on their own, so that a bracket gets narrower
    even where most rows share one value.
    """
    v = F.col("v")
    inside = lambda t: (v >= F.col(f"{t}_lo")) & (v <= F.col(f"{t}_hi"))
    grid = [i / GRID for i in range(GRID + 1)]
    sketches = [F.percentile_approx(F.when(inside(t), v), grid, 100 * GRID).alias(f"{t}_grid") for t in ranks]
    sketched = lookup_join(state, materialise(lookup_join(rows, state, [_KEY], "inner").groupBy(_KEY).agg(*sketches)), [_KEY], "inner")
    new = {}
    for t, rank in ranks.items():
        step = (rank - F.col(f"{t}_below")) * GRID / F.col(f"{t}_in")
        first, last = F.greatest(F.floor(step) - 1, F.lit(0)), F.least(F.ceil(step) + 1, F.lit(GRID))
        new[f"{t}_a"], new[f"{t}_b"] = F.get(f"{t}_grid", first.cast("int")), F.get(f"{t}_grid", last.cast("int"))
    proposed = sketched.withColumns(new).drop(*[f"{t}_grid" for t in ranks])
    counts = []
    for t in ranks:
        lo, hi, low, high = (F.col(f"{t}_{x}") for x in ("a", "b", "lo", "hi"))
        times = lambda c: F.sum(c.cast("long"))
        counts += [times(v < lo).alias(f"{t}_n0"), times(v <= lo).alias(f"{t}_n1"), times(v < hi).alias(f"{t}_n2"), times(v <= hi).alias(f"{t}_n3")]
        counts += [F.max(F.when((v < lo) & (v >= low), v)).alias(f"{t}_before"), F.min(F.when((v > hi) & (v <= high), v)).alias(f"{t}_after")]
        counts += [F.min(F.when((v > lo) & (v < hi), v)).alias(f"{t}_from"), F.max(F.when((v > lo) & (v < hi), v)).alias(f"{t}_to")]
    counted = lookup_join(proposed, materialise(lookup_join(rows, proposed, [_KEY], "inner").groupBy(_KEY).agg(*counts)), [_KEY], "inner")
    out = {}
    for t, rank in ranks.items():
        c = {x: F.col(f"{t}_{x}") for x in ("lo", "hi", "a", "b", "below", "in", "n0", "n1", "n2", "n3", "before", "after", "from", "to")}
        # before the bracket, its first value, between, its last value, or (a sketch may miss) after it
        cases = (
            (rank <= c["n0"], (c["lo"], c["before"], c["below"], c["n0"])),
            (rank <= c["n1"], (c["a"], c["a"], c["n0"], c["n1"])),
            (rank <= c["n2"], (c["from"], c["to"], c["n1"], c["n2"])),
            (rank <= c["n3"], (c["b"], c["b"], c["n2"], c["n3"])),
            (F.lit(True), (c["after"], c["hi"], c["n3"], c["below"] + c["in"])),
        )
        for i, name in enumerate(("lo", "hi", "below", "end")):
            value = F.when(cases[0][0], cases[0][1][i])
            for test, found in cases[1:]:
                value = value.when(test, found[i])
            out[f"{t}_{name}"] = value
        out[f"{t}_in"] = out.pop(f"{t}_end") - out[f"{t}_below"]
    return counted.select(_KEY, "n", "least", "most", *[c.alias(n) for n, c in out.items()]).select(*state.columns)
