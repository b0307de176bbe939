"""Joins that hold with one hot key: lookup, trip/fare, time range, as-of."""

from __future__ import annotations

from collections.abc import Callable
from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.sequence import (
    CHUNK_ROWS,
    SEQ,
    heavy_keys,
    heavy_row_limit,
    null_safe_join,
    sequence,
)

# Narrow rows; a million of them stay well below the 8 GB broadcast limit.
BROADCAST_ROWS = 1_000_000
BROADCAST_ROWS_CONF = "tideline.broadcastRows"


def fits_broadcast(df: DataFrame, rows: int | None = None) -> bool:
    """Count ``df``, but no further than the limit."""
    if rows is None:
        rows = int(df.sparkSession.conf.get(BROADCAST_ROWS_CONF, str(BROADCAST_ROWS)))
    return df.limit(rows + 1).count() <= rows


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    keys: Seq[str],
    how: str = "left",
    broadcast_rows: int | None = None,
) -> DataFrame:
    """Join with a table that has at most one row per key (``left``, ``inner``, ``left_semi``).

    A small table is broadcast (``broadcast_rows`` lowers the limit for wide rows). A large one is joined by shuffle for ordinary keys;
    rows of heavy keys meet a broadcast of only those keys' entries, so no task gets
    a whole heavy key. On a stream a large table is joined by shuffle for all keys.
    """
    keys = list(keys)
    # Null-safe equality against non-null keys is plain equality, without the not-null
    # filter that would be pushed into whatever computes the keys of ``df``.
    table = table.dropna(subset=keys)
    if fits_broadcast(table, broadcast_rows):
        return null_safe_join(df, table, keys, how, small=True)
    # A stream's keys cannot be counted before it runs.
    heavy = None if df.isStreaming else heavy_keys(df, keys)
    if heavy is None:
        return null_safe_join(df, table, keys, how)
    light = null_safe_join(df, heavy, keys, "left_anti", small=True)
    light = null_safe_join(light, table, keys, how)
    few = null_safe_join(table, heavy, keys, "left_semi", small=True)
    dense = null_safe_join(df, heavy, keys, "left_semi", small=True)
    return light.unionByName(null_safe_join(dense, few, keys, how, small=True))


def join_trips_fares(
    trips: DataFrame, fares: DataFrame, keys: Seq[str], order: Seq[str] | None = None
) -> DataFrame:
    """Pair each trip with its fare.

    With ``order`` rows that share a key are paired first with first, second with
    second, as two files written in the same order would be; otherwise the key is
    taken as unique.
    """
    if order is None:
        return trips.join(fares, list(keys))
    left = sequence(trips, keys, order).rows
    right = sequence(fares, keys, [c for c in order if c in fares.columns] or keys).rows
    return left.join(right, [*keys, SEQ]).drop(SEQ)


def pair_by_position(left: DataFrame, right: DataFrame, left_order: Seq[str], right_order: Seq[str]) -> DataFrame:
    """Pair row n of one side with row n of the other, each in its own order."""
    a = sequence(left, [], left_order).rows.drop("all_rows")
    b = sequence(right, [], right_order).rows.drop("all_rows")
    return a.join(b, SEQ)


#: Levels of the cells of a range join are this many times as wide as the one below.
CELL_STEP = 4
_LEVEL, _CELL = "__level", "__cell"


def range_cells(requests: DataFrame, start: str, end: str) -> tuple[DataFrame, int, list[int]]:
    """``requests`` once per cell that covers a part of [start, end), with its level and number.

    Cells of level n are CELL_STEP^n times the finest width, which fits the median request.
    A range takes the largest cells inside it and smaller ones to both sides, so a request
    has about 3 log4(length / width) cells to each side, however long it is. Also returns the
    width of level 0 and the levels that occur.
    """
    length = F.col(end) - F.col(start)
    size = requests.agg(F.percentile_approx(length, 0.5).alias("median"), F.max(length).alias("most")).first()
    if size["most"] is None:
        return requests.withColumns({_LEVEL: F.lit(0), _CELL: F.lit(0).cast("long")}), 1, [0]
    width = 1
    while width * 2 <= size["median"]:
        width *= 2
    levels = 1
    while width * CELL_STEP**levels <= size["most"]:
        levels += 1
    low, high = F.floor(F.col(start) / width), F.ceil(F.col(end) / width)
    up, down = (lambda n: F.ceil(low / CELL_STEP**n)), (lambda n: F.floor(high / CELL_STEP**n))
    none = F.array().cast("array<bigint>")
    between = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)

    def cells(n: int) -> Column:
        a, b, inner, outer = up(n), down(n), up(n + 1), down(n + 1)
        sides = F.concat(between(a, inner * CELL_STEP), between(outer * CELL_STEP, b))
        return F.transform(F.when(inner < outer, sides).otherwise(between(a, b)), lambda c: F.struct(F.lit(n).alias("level"), c.alias("cell")))

    every = F.explode(F.concat(*[cells(n) for n in range(levels + 1)])).alias("at")
    pieces = requests.select("*", every).select(*requests.columns, F.col("at.level").alias(_LEVEL), F.col("at.cell").alias(_CELL))
    used = [r[0] for r in pieces.select(_LEVEL).distinct().collect()]
    return pieces, width, sorted(used)


def range_join(
    requests: DataFrame,
    history: DataFrame,
    time: str,
    start: str = "row_start",
    end: str = "row_end",
    keys: Seq[str] = (),
) -> DataFrame:
    """History rows with ``start <= time < end`` for every request.

    Requests are cut into nested cells (``range_cells``), so one of ten years among such of
    half an hour costs some tens of rows; a history row is looked up once per level that
    occurs, and the join is an equality on level and cell. Requests that fit are broadcast
    and the history is not shuffled. Otherwise rows of a crowded cell are spread over salts,
    and its requests repeated per salt.
    """
    requests = requests.filter(F.col(end) > F.col(start))
    pieces, width, levels = range_cells(requests, start, end)
    at = lambda n: F.struct(F.lit(n).alias("level"), F.floor(F.col(time) / (width * CELL_STEP**n)).alias("cell"))
    rows = history.withColumn("__at", F.explode(F.array(*[at(n) for n in levels]))).select(
        *history.columns, F.col("__at.level").alias(_LEVEL), F.col("__at.cell").alias(_CELL)
    )
    inside = (F.col(time) >= F.col(start)) & (F.col(time) < F.col(end))
    on = [_LEVEL, _CELL, *keys]
    if fits_broadcast(pieces):
        return rows.join(F.broadcast(pieces), on).filter(inside).drop(_LEVEL, _CELL)

    # Every crowded cell, however many: at most a row per CHUNK_ROWS of the history.
    crowded = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy_row_limit(rows))
    salts = crowded.select(*on, F.ceil(F.col("n") / CHUNK_ROWS).alias("salts"))
    salted_rows = (
        lookup_join(rows, salts, on)
        .withColumn("salts", F.coalesce("salts", F.lit(1)))
        .withColumn("salt", F.monotonically_increasing_id() % F.col("salts"))
        .drop("salts")
    )
    salted_requests = (
        lookup_join(pieces, salts, on)
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
        .drop("salts")
    )
    joined = salted_rows.join(salted_requests, [*on, "salt"])
    return joined.filter(inside).drop(_LEVEL, _CELL, "salt")


def asof_join(
    df: DataFrame,
    changes: DataFrame,
    keys: Seq[str],
    time: str,
    columns: Seq[str],
    since: str = "since",
) -> DataFrame:
    """For every row the ``columns`` of the latest change with ``since <= time``; null before the first.

    Changes are (keys, since, columns) with one row per key and instant. Few changes
    are cut at time bins and broadcast; otherwise both sides are put in one order per
    key and the last change is carried forward, over chunks where a key was split.
    Times are numbers, timestamps or dates, of one kind on both sides; a change without
    ``since`` is never in force.
    """
    keys = list(keys)
    at = _instants(dict(df.dtypes)[time], dict(changes.dtypes)[since])
    rows = df.withColumn("__time", at(F.col(time)))
    known = changes.select(*keys, *columns, at(F.col(since)).alias("__since")).where("__since IS NOT NULL")
    join = _asof_broadcast if fits_broadcast(known, 10_000) else _asof_ordered
    return join(rows, known, keys, "__time", columns, "__since").drop("__time")


def _instants(*types: str) -> Callable[[Column], Column]:
    """How times of these types become whole numbers, or doubles where one has fractions."""
    if set(types) <= {"timestamp", "timestamp_ntz"}:
        return lambda c: F.unix_micros(c.cast("timestamp"))
    if set(types) == {"date"}:
        return F.unix_date
    whole = set(types) <= {"tinyint", "smallint", "int", "bigint"}
    return lambda c: c.cast("long" if whole else "double")


def _asof_broadcast(df, changes, keys, time, columns, since):
    span = changes.agg(
        F.min(since).alias("lo"),
        F.max(since).alias("hi"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct(F.struct(*keys) if keys else F.lit(0)).alias("series"),
    ).first()
    if not span["n"]:
        return df.withColumns({c: F.lit(None).cast(dict(changes.dtypes)[c]) for c in columns})
    # Every series is cut at every bin, so all pieces together are at most 2 n.
    bins = max(1, span["n"] // span["series"])
    width = max(1, -(-(span["hi"] - span["lo"] + 1) // bins))
    nth = lambda t: F.greatest(F.lit(-1), F.least(F.lit(bins), F.floor((t - F.lit(span["lo"])) / width)))
    # The changes fit a broadcast, so a window over them is small.
    order = Window.partitionBy(*keys).orderBy(since) if keys else Window.partitionBy(F.lit(0)).orderBy(since)
    until = F.lead(since).over(order)
    pieces = (
        changes.select(*keys, F.col(since).alias("__from"), *columns, until.alias("__until"))
        .withColumn(
            "__bin",
            F.explode(
                F.sequence(nth(F.col("__from")), F.coalesce(nth(F.col("__until") - 1), F.lit(bins)))
            ),
        )
    )
    on = [F.col("l.__bin") == F.col("r.__bin")]
    on += [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys]
    on += [
        F.col(f"l.{time}") >= F.col("r.__from"),
        F.col("r.__until").isNull() | (F.col(f"l.{time}") < F.col("r.__until")),
    ]
    left = df.withColumn("__bin", nth(F.col(time))).alias("l")
    return left.join(F.broadcast(pieces.alias("r")), on, "left").select(
        *[F.col(f"l.{c}") for c in df.columns], *[F.col(f"r.{c}") for c in columns]
    )


def _asof_ordered(df, changes, keys, time, columns, since):
    payload = F.struct(*columns)
    types = df.schema
    left = df.withColumns({"__at": F.col(time), "__side": F.lit(1)}).withColumn(
        "__value", F.lit(None)
    )
    right = changes.select(
        *keys,
        F.col(since).alias("__at"),
        F.lit(0).alias("__side"),
        payload.alias("__value"),
    )
    left = left.withColumn("__value", F.lit(None).cast(right.schema["__value"].dataType))
    both = left.unionByName(right, allowMissingColumns=True)
    numbered = sequence(both, keys, ["__at", "__side"])
    keys = list(numbered.keys)
    running = lambda w: F.last("__value", ignorenulls=True).over(w)
    upto = (Window.unboundedPreceding, Window.currentRow)
    if not numbered.split:
        w = Window.partitionBy(*keys).orderBy(SEQ).rowsBetween(*upto)
        known = numbered.rows.withColumn("__value", running(w))
    else:
        chunked = numbered.blocks(CHUNK_ROWS)
        inner = Window.partitionBy(*keys, "block").orderBy(SEQ).rowsBetween(*upto)
        before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        ends = (
            chunked.groupBy(*keys, "block")
            .agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), F.col(SEQ))).alias("__end"))
            .withColumn("__carry", F.last("__end", ignorenulls=True).over(before))
            .drop("__end")
        )
        known = chunked.withColumn("__value", running(inner))
        known = null_safe_join(known, ends, [*keys, "block"], "left")
        known = known.withColumn("__value", F.coalesce("__value", "__carry"))
    kept = known.filter(F.col("__side") == 1)
    return kept.select(*types.names, *[F.col("__value")[c].alias(c) for c in columns])
