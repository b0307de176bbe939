"""Scalar Kalman filter per key, in parallel within a key.

The filter is x_n = x_{n-1} + k_n (z_n - x_{n-1}). Its gain does not depend on the
data and settles within some 30 steps, so with a = 1 - k

    x_n = P_n (x_start + sum of k_m z_m / P_m),   P_m = product of a up to m,

a running sum. P shrinks fast, so the sum is taken over blocks of 128 rows. A row
at least 64 rows into its block no longer feels what came before (a^64 is about
1e-17); blocks are laid twice, shifted by 64 rows, and every row reads the laying
in which it is far enough in, or which begins with the key.
"""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.sequence import SEQ, Sequenced, sequence

# Fixed values of the filter.
PROCESS_NOISE = 0.125
SENSOR_NOISE = 0.32

_BLOCK = 128
_HALF = _BLOCK // 2


def gains(count: int) -> list[float]:
    """The first ``count`` gains from a zero start."""
    out, p = [], 0.0
    for _ in range(count):
        p += PROCESS_NOISE
        k = p / (p + SENSOR_NOISE)
        p *= 1 - k
        out.append(k)
    return out


def _tables() -> tuple[list[float], list[float]]:
    k = gains(_BLOCK)
    decay, product = [], 1.0
    for gain in k:
        product *= 1 - gain
        decay.append(product)
    return k, decay


def _estimate(z: Column, keys: Seq[str], shift: int) -> tuple[Column, Column]:
    """(estimate, rows before this one in its block) for one laying of the blocks."""
    k, decay = _tables()
    block = F.expr(f"({SEQ} - 1 + {shift}) div {_BLOCK}")
    first = block == 0
    inside = (F.col(SEQ) - 1 + shift) % _BLOCK
    n = F.least(F.col(SEQ), F.lit(_BLOCK)).cast("int")
    lookup = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), n)
    gain = F.when(first, lookup(k)).otherwise(F.lit(k[-1]))
    p = F.when(first, lookup(decay)).otherwise(F.pow(F.lit(1 - k[-1]), inside + 1))
    window = (
        Window.partitionBy(*keys, block)
        .orderBy(SEQ)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return p * F.sum(gain * z / p).over(window), inside


def kalman_sequenced(numbered: Sequenced, value: str, out: str) -> DataFrame:
    z = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    plain, inside = _estimate(z, numbered.keys, 0)
    shifted, _ = _estimate(z, numbered.keys, _HALF)
    use_plain = (inside >= _HALF) | (F.col(SEQ) <= _HALF)
    return (
        numbered.rows.withColumns({"__plain": plain, "__shifted": shifted})
        .withColumn(out, F.when(use_plain, F.col("__plain")).otherwise(F.col("__shifted")))
        .drop("__plain", "__shifted")
    )


def kalman(
    df: DataFrame, value: str, keys: Seq[str], order: Seq[str], out: str | None = None
) -> DataFrame:
    """Replace ``value`` (or add ``out``) by its filtered value; a missing one counts as 0.0."""
    return kalman_sequenced(sequence(df, keys, order), value, out or value)
