"""Aggregates over blocks of consecutive rows of a key."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.sequence import BLOCK, SEQ, Sequenced, sequence
from tideline.specs import BLOCK_SIZE, SERIES_SIZE


def distinct_with_missing(c: Column) -> Column:
    """Number of different values, a missing value being one of them."""
    return F.count_distinct(c) + F.max(c.isNull().cast("int"))


def block_stats(
    df: DataFrame,
    keys: Seq[str],
    order: Seq[str],
    mean_of: str | Seq[str] | None = None,
    distinct_of: str | None = None,
    size: int = BLOCK_SIZE,
    full_only: bool = False,
) -> DataFrame:
    """Per block: row count, last order values, mean (null counts as 0.0), distinct count.

    ``mean_of`` names a column, averaged as ``mean``, or several, each averaged under its own name.
    The distinct count collects a block's values in an array of at most ``size``
    entries rather than ``count(distinct)``, which would shuffle once more.
    """
    numbered = sequence(df, keys, order)
    aggregates = [F.count(F.lit(1)).alias("rows"), F.max(SEQ).alias("last_seq")]
    aggregates += [F.max_by(c, SEQ).alias(c) for c in order]
    means = {"mean": mean_of} if isinstance(mean_of, str) else {c: c for c in mean_of or ()}
    aggregates += [F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(name) for name, c in means.items()]
    if distinct_of is not None:
        aggregates.append(
            (
                F.size(F.collect_set(distinct_of))
                + F.max(F.col(distinct_of).isNull().cast("int"))
            )
            .cast("bigint")
            .alias("distinct_values")
        )
    out = numbered.blocks(size).groupBy(*numbered.keys, BLOCK).agg(*aggregates)
    return out.filter(F.col("rows") == size) if full_only else out


def series(
    df: DataFrame, keys: Seq[str], position: str, time: Seq[str], value: str, size: int = SERIES_SIZE
) -> DataFrame:
    """Per ``size`` consecutive values (position from 0): the ordered (time, value) list."""
    point = F.struct(F.col(position).alias("at"), *time, F.col(value).alias("value"))
    return (
        df.withColumn("series", F.expr(f"{position} div {size}"))
        .groupBy(*keys, "series")
        .agg(F.array_sort(F.collect_list(point)).alias("points"))
    )


def latest_block_mean(numbered: Sequenced, value: str, out: str, size: int = BLOCK_SIZE) -> DataFrame:
    """For every row the mean of the last whole block of its key, null before the first.

    A block ends within the last ``size`` rows, so a frame of ``2 size - 2`` rows
    before the current one is enough, whatever the length of the key.
    """
    rows, window, own = numbered.lookback(2 * size - 2)
    trailing = F.avg(F.coalesce(F.col(value), F.lit(0.0))).over(window.rowsBetween(1 - size, 0))
    ended = F.when(F.col(SEQ) % size == 0, trailing)
    latest = F.last("__ended", ignorenulls=True).over(window.rowsBetween(1 - size, 0))
    return (
        rows.withColumn("__ended", ended).withColumn(out, latest).filter(own).drop("__ended", "chunk")
    )


def observations(df: DataFrame, types: Seq[str], keep: Seq[str]) -> DataFrame:
    """One row per (message, observation type) of a wide row.

    A message has every type, null or not, so the n-th message of a sensor is the n-th observation of
    each type, and blocks may be formed of wide rows and taken apart when they are summarised.
    """
    return df.unpivot(list(keep), list(types), "obs_type", "value")


def block_sketches(
    df: DataFrame, keys: Seq[str], order: Seq[str], value: str, buckets: int = 1024, size: int = BLOCK_SIZE
) -> DataFrame:
    """Per block: row count and a sketch of the distinct values of ``value``, to be stored.

    ``buckets`` registers (16 to 2 097 152, the next power of two) give a relative standard error
    of about 1.04 / sqrt(buckets). Null is no value.
    """
    bits = max(4, (buckets - 1).bit_length())
    numbered = sequence(df, keys, order)
    return numbered.blocks(size).groupBy(*numbered.keys, BLOCK).agg(
        F.count(F.lit(1)).alias("rows"), F.hll_sketch_agg(value, bits).alias("sketch")
    )


def united_distinct(sketches: DataFrame, keys: Seq[str], sketch: str = "sketch") -> DataFrame:
    """Approximate distinct values over all given sketches of a key, of any blocks or streams."""
    united = F.hll_sketch_estimate(F.hll_union_agg(sketch))
    return sketches.groupBy(*keys).agg(united.alias("distinct_values"))
