"""Range filters, gap filling, incomplete rows, annotation."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence as Seq

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.joins import lookup_join
from tideline.operators.sequence import BLOCK, SEQ, sequence
from tideline.specs import BLOCK_SIZE, Dataset, Range


def null_out_of_range(df: DataFrame, ranges: Mapping[str, Range]) -> DataFrame:
    """Values outside their range become null; the row stays."""

    def kept(name: str, r: Range) -> Column:
        c = F.col(name)
        inside = c.between(r.low, r.high) if r.closed else (c > r.low) & (c < r.high)
        return F.when(inside, c)

    return df.withColumns({name: kept(name, r) for name, r in ranges.items()})


def interpolate_blocks(
    df: DataFrame,
    columns: Iterable[str],
    keys: Seq[str],
    order: Seq[str],
    size: int = BLOCK_SIZE,
) -> DataFrame:
    """Fill nulls by the mean of the ``size``-row block of the key, else by 0.0."""
    blocks = sequence(df, keys, order).blocks(size)
    return fill_from_blocks(blocks, columns, tuple(keys) or ("all_rows",)).select(*df.columns)


def fill_from_blocks(blocks: DataFrame, columns: Iterable[str], keys: Seq[str]) -> DataFrame:
    window = Window.partitionBy(*keys, BLOCK)
    return blocks.withColumns(
        {c: F.coalesce(F.col(c), F.avg(c).over(window), F.lit(0.0)) for c in columns}
    )


def drop_incomplete(
    df: DataFrame, columns: Seq[str], observation: Observation | None = None
) -> DataFrame:
    """Drop rows with a null or NaN in ``columns``; the observation counts them."""
    types = dict(df.dtypes)

    def absent(c: str) -> Column:
        null = F.col(c).isNull()
        return null | F.isnan(c) if types[c] in ("double", "float") else null

    incomplete = absent(columns[0])
    for c in columns[1:]:
        incomplete = incomplete | absent(c)
    if observation is not None:
        df = df.observe(observation, F.count(F.when(incomplete, 1)).alias("skipped"))
    return df.filter(~incomplete)


def gate(df: DataFrame, column: str, allowed: Iterable[str]) -> DataFrame:
    """Rows whose observation type is configured."""
    return df.filter(F.col(column).isin(*allowed))


def suppress_empty(df: DataFrame, result: str) -> DataFrame:
    return df.filter(F.col(result).isNotNull())


def annotate(df: DataFrame, dimension: DataFrame, keys: Seq[str]) -> DataFrame:
    """Add the columns of a dimension table with one row per key; unknown keys get null."""
    return lookup_join(df, dimension, keys, how="left")


def annotate_by_choice(df: DataFrame, spec: Dataset, key: str) -> DataFrame:
    """Annotation without a dimension table: a fixed pick per key and column.

    The pick is a number from the MD5 of column name and key, so a sensor keeps its
    annotation over runs and engines.
    """
    picks = {}
    for column, values in spec.choices.items():
        digest = F.md5(F.concat(F.lit(f"{column}:"), F.col(key).cast("string")).cast("binary"))
        number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
        at = (number % len(values) + 1).cast("int")
        picks[column] = F.element_at(F.array(*[F.lit(v) for v in values]), at)
    return df.withColumns(picks)
