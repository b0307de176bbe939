"""Statistics job over cleaned rows: block means, distinct counts, filtered forecasts."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.blocks import block_stats, series
from tideline.operators.kalman import kalman_sequenced
from tideline.operators.regression import PREDICTIONS, horizon_mean, sliding_regression
from tideline.operators.sequence import BLOCK, SEQ, Sequenced, sequence
from tideline.specs import BLOCK_SIZE, Dataset


def averages(rows: DataFrame, spec: Dataset, keys: Seq[str], order: Seq[str]) -> DataFrame:
    return block_stats(rows, keys, order, mean_of=spec.average_field)


def distinct_counts(rows: DataFrame, spec: Dataset, keys: Seq[str], order: Seq[str]) -> DataFrame:
    return block_stats(rows, keys, order, distinct_of=spec.distinct_field)


def forecasts(rows: DataFrame, spec: Dataset, keys: Seq[str], order: Seq[str]) -> DataFrame:
    """Filtered value, ten predictions and their mean for every row."""
    numbered = sequence(rows, keys, order)
    filtered = kalman_sequenced(numbered, spec.kalman_field, "estimate")
    again = Sequenced(filtered, numbered.keys, numbered.split)
    return sliding_regression(again, "estimate").withColumn(
        "horizon_mean", horizon_mean(F.col(PREDICTIONS))
    )


def report(rows: DataFrame, spec: Dataset, keys: Seq[str], order: Seq[str]) -> dict[str, DataFrame]:
    """The three plotted series of the job."""
    time = list(order)
    mean = averages(rows, spec, keys, order)
    distinct = distinct_counts(rows, spec, keys, order)
    ahead = forecasts(rows, spec, keys, order).withColumn("at", F.col(SEQ) - 1)
    keys = list(keys) or ["all_rows"]
    return {
        "average": series(mean, keys, BLOCK, time, "mean"),
        "distinct": series(distinct, keys, BLOCK, time, "distinct_values"),
        "forecast": series(ahead, keys, "at", time, "horizon_mean"),
    }


def block_report(rows: DataFrame, spec: Dataset, keys: Seq[str], order: Seq[str]) -> DataFrame:
    """Mean and distinct count of every block from one pass."""
    return block_stats(
        rows, keys, order, mean_of=spec.average_field, distinct_of=spec.distinct_field, size=BLOCK_SIZE
    )
