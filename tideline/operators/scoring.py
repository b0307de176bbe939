"""Scoring of live rows: regression, decision tree, error estimate, result messages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence as Seq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.senml import joined
from tideline.specs import Dataset

REGRESSION = "MLR"
TREE = "DTC"
INT_RANGE = (-(2.0**31), 2.0**31 - 1)
AVERAGE = "AVG"
ERROR = "ERR"


def linear_score(features: Seq[str], intercept: Column, weights: Seq[Column]) -> Column:
    """b0 + sum of b_i x_i, cut to a whole number towards zero; beyond the int range its nearest end."""
    total = intercept
    for name, weight in zip(features, weights, strict=True):
        total = total + weight * F.col(name)
    within = F.greatest(F.lit(INT_RANGE[0]), F.least(F.lit(INT_RANGE[1]), total.cast("double")))
    return F.when(total.isNotNull() & ~F.isnan(total.cast("double")), within).try_cast("int").cast("float")


@dataclass(frozen=True)
class Split:
    """Inner node: rows with ``field <= threshold`` go left."""

    field: str
    threshold: float
    left: Split | int
    right: Split | int


def tree_score(node: Split | int) -> Column:
    """A decision tree as nested conditions; leaves are class indexes. Null in, null out."""
    if isinstance(node, int):
        return F.lit(float(node)).cast("float")
    c = F.col(node.field)
    return F.when(c <= node.threshold, tree_score(node.left)).when(
        c > node.threshold, tree_score(node.right)
    )


def tree_fields(node: Split | int) -> set[str]:
    if isinstance(node, int):
        return set()
    return {node.field} | tree_fields(node.left) | tree_fields(node.right)


def class_name(index: Column, classes: Seq[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index.cast("int"))


def error_estimate(observed: Column, predicted: Column, average: Column) -> Column:
    """(observed - predicted) / average; null until there is an average, or if it is 0."""
    return F.try_divide(observed - predicted, average)


RESULT_COLUMNS = ("msgid", "sensor_id", "meta", "analytic_type", "obs", "res", "error", "arrival")


def results(
    df: DataFrame, spec: Dataset, kind: str, res: Column, error: Column | None = None
) -> DataFrame:
    """Rows of the one long result table."""
    none = F.lit(None).cast("double")
    return df.select(
        "msgid",
        F.col(spec.id_field).cast("string").alias("sensor_id"),
        joined(spec.meta_fields).alias("meta"),
        F.lit(kind).alias("analytic_type"),
        joined(spec.observed_fields).alias("obs"),
        res.cast("double").alias("res"),
        (none if error is None else error.cast("double")).alias("error"),
        "arrival",
    )


def result_message(df: DataFrame) -> Column:
    """Published text: regression rows carry ERROR, tree rows RES, all else is empty."""
    head = lambda value, tag: F.concat_ws(
        ",",
        F.col("msgid").cast("string"),
        "meta",
        "analytic_type",
        F.concat(F.lit("obsVal:"), "obs"),
        F.concat(F.lit(f"{tag}:"), F.coalesce(F.col(value).cast("string"), F.lit("null"))),
    )
    return (
        F.when(F.col("analytic_type") == REGRESSION, head("error", "ERROR"))
        .when(F.col("analytic_type") == TREE, head("res", "RES"))
        .otherwise(F.lit(""))
    )


def latency_ms(sink: Column, arrival: Column) -> Column:
    """Sink time minus arrival time in ms; null for rows without an arrival stamp."""
    return F.unix_millis(sink) - F.unix_millis(arrival)


def latency_summary(df: DataFrame, latency: str) -> DataFrame:
    return df.agg(
        F.count(latency).alias("measured"),
        F.min(latency).alias("min_ms"),
        F.max(latency).alias("max_ms"),
        F.avg(latency).alias("mean_ms"),
    )


def select_model(models: Mapping[str, Mapping], name: str) -> Mapping:
    if name not in models:
        raise KeyError(f"no model named {name}")
    return models[name]
