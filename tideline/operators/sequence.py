"""Row numbers per key that hold when one key has a third of all rows.

Count blocks, filters with memory and moving windows all need the position of a
row in its key's order. ``Window.partitionBy(key)`` gives it, but puts a key into
one task. So keys are split in two:

* ordinary keys: one hash shuffle on the key and ``row_number``;
* heavy keys (at most ``HEAVY_KEYS``, found by one pre-aggregated count): their
  rows are range-partitioned on (key, order), which cuts a key anywhere, and the
  count of the key's rows in earlier partitions is added.

Once the position is known, whatever follows groups on (key, position div n), so
no later group is larger than n rows.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tideline.session import materialise

# The n-th largest key holds at most 1/n of the rows, so after the 10 000 largest
# keys are set apart no other key exceeds 1/10 000 of the input.
HEAVY_KEYS = 10_000
# A key below this many rows is always left to one task.
HEAVY_ROWS = 5_000_000
HEAVY_ROWS_CONF = "tideline.heavyKeyRows"
# Rows per range partition of heavy keys, and per window of a split key.
SLICE_ROWS = 1_000_000
CHUNK_ROWS = 1 << 18

SEQ = "seq"
BLOCK = "block"


def heavy_row_limit(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HEAVY_ROWS_CONF, str(HEAVY_ROWS)))


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Seq[str], how: str, small: bool = False
) -> DataFrame:
    """Join on ``keys`` with null equal to null: a missing sensor id is a key like any other."""
    names = {k: f"__right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in names.items()])
    joined = left.join(F.broadcast(right) if small else right, on, how)
    return joined.drop(*names.values())


def heavy_keys(df: DataFrame, keys: Seq[str]) -> DataFrame | None:
    """Keys with too many rows for one task, with their counts; None if there are none.

    The count is combined before its shuffle and at most ``HEAVY_KEYS`` rows come
    back, so the result may be broadcast whatever the input.
    """
    rows = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > heavy_row_limit(df))
        .orderBy(F.desc("rows"))
        .limit(HEAVY_KEYS)
        .collect()
    )
    if not rows:
        return None
    schema = T.StructType([df.schema[k] for k in keys] + [T.StructField("rows", T.LongType())])
    return df.sparkSession.createDataFrame(rows, schema)


@dataclass(frozen=True)
class Sequenced:
    """Rows with ``seq`` = 1, 2, … per key in the asked order."""

    rows: DataFrame
    keys: tuple[str, ...]
    split: bool

    def blocks(self, size: int) -> DataFrame:
        """Add ``block``: ``size`` consecutive rows of a key share a number from 0."""
        return self.rows.withColumn(BLOCK, F.expr(f"({SEQ} - 1) div {size}"))

    def lookback(self, rows: int) -> tuple[DataFrame, WindowSpec, Column]:
        """Input, window and keep-condition for a frame of ``rows`` preceding rows.

        A split key is cut into chunks; the last ``rows`` rows of a chunk are also
        handed to the next one, so every frame is whole. Keep the rows that match
        the condition once the window functions are applied.
        """
        if not self.split:
            return self.rows, Window.partitionBy(*self.keys).orderBy(SEQ), F.lit(True)
        own = F.expr(f"({SEQ} - 1) div {CHUNK_ROWS}")
        tail = F.expr(f"({SEQ} - 1) % {CHUNK_ROWS}") >= CHUNK_ROWS - rows
        chunks = F.when(tail, F.array(own, own + 1)).otherwise(F.array(own))
        spread = self.rows.withColumn("chunk", F.explode(chunks))
        window = Window.partitionBy(*self.keys, "chunk").orderBy(SEQ)
        return spread, window, F.col("chunk") == own


def sequence(df: DataFrame, keys: Seq[str], order: Seq[str]) -> Sequenced:
    """Number the rows of every key by ``order``. No keys means one global order."""
    keys = tuple(keys)
    whole = not keys
    if whole:
        keys = ("all_rows",)
        df = df.withColumn("all_rows", F.lit(0))
    window = Window.partitionBy(*keys).orderBy(*order)
    number = F.row_number().over(window).cast("long")
    heavy = heavy_keys(df, keys)
    if heavy is None:
        return Sequenced(df.withColumn(SEQ, number), keys, split=False)

    light = null_safe_join(df, heavy, keys, "left_anti", small=True).withColumn(SEQ, number)
    of_heavy = null_safe_join(df, heavy, keys, "left_semi", small=True)
    dense = _number_by_range(of_heavy, heavy, keys, order)
    return Sequenced(dense if whole else light.unionByName(dense), keys, split=True)


def _number_by_range(
    rows: DataFrame, heavy: DataFrame, keys: tuple[str, ...], order: Seq[str]
) -> DataFrame:
    total = heavy.agg(F.sum("rows")).first()[0]
    shuffle = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(shuffle, -(-total // SLICE_ROWS))
    columns = rows.columns
    # The arrival id splits copies that are equal in key and order.
    ranged = (
        rows.withColumn("arrival", F.monotonically_increasing_id())
        .repartitionByRange(slices, *keys, *order, "arrival")
        .sortWithinPartitions(*keys, *order, "arrival")
        .withColumn("place", F.monotonically_increasing_id())
        .withColumn("slice", F.spark_partition_id())
    )
    stored = materialise(ranged)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("slice")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # One row per (slice, key): at most slices + HEAVY_KEYS rows.
    starts = (
        stored.groupBy("slice", *keys)
        .agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        .select("slice", *keys, (F.col("before") - F.col("first") + 1).alias("shift"))
    )
    placed = null_safe_join(stored, starts, ["slice", *keys], "inner", small=True)
    return placed.select(*columns, (F.col("place") + F.col("shift")).alias(SEQ))
