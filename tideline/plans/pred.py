"""Scoring job: envelope -> roles -> regression, tree and average -> error -> messages."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.senml import parse_envelope, wrap_envelope
from tideline.operators.blocks import block_stats, latest_block_mean, observations
from tideline.operators.joins import asof_join
from tideline.operators.scoring import (
    REGRESSION,
    TREE,
    Split,
    error_estimate,
    linear_score,
    result_message,
    results,
    tree_score,
)
from tideline.operators.sequence import SEQ, sequence
from tideline.specs import BLOCK_SIZE, Dataset


def parse_messages(packs: DataFrame, spec: Dataset) -> DataFrame:
    """Packs -> typed wide rows by way of the envelope, with its base time as ``timestamp``."""
    wrapped = packs.withColumn("envelope", wrap_envelope(spec, F.col("pack"))).drop("pack")
    names = [n for n in spec.schema_line if n != "timestamp"]
    rows = parse_envelope(wrapped, names)
    numbers = [f.name for f in spec.fields if f.kind == "number" and f.name in names]
    return rows.withColumns({n: F.col(n).try_cast("double") for n in numbers})


def block_averages(
    rows: DataFrame, spec: Dataset, order: Seq[str], keep: Seq[str] = ()
) -> DataFrame:
    """Mean of every full block of 5 values per sensor and configured observation type."""
    long = observations(rows, spec.averaged_types, [spec.id_field, *order, *keep])
    return block_stats(
        long, [spec.id_field, "obs_type"], order, mean_of="value", size=BLOCK_SIZE, full_only=True
    )


def score(
    rows: DataFrame,
    spec: Dataset,
    order: Seq[str],
    intercept: Column,
    weights: Seq[Column],
    tree: Split | int | None = None,
) -> DataFrame:
    """Result table for parsed rows (with msgid and arrival).

    The error compares with the latest block mean of the compared field of the
    row's own sensor.
    """
    numbered = sequence(rows, [spec.id_field], order)
    with_average = latest_block_mean(numbered, spec.error_field, "average").drop(SEQ)
    return score_averaged(with_average, spec, intercept, weights, tree)


def score_averaged(
    with_average: DataFrame,
    spec: Dataset,
    intercept: Column,
    weights: Seq[Column],
    tree: Split | int | Column | None = None,
) -> DataFrame:
    """As ``score`` for rows that carry their sensor's ``average``; has no memory of its own."""
    *features, _ = spec.training_fields
    predicted = with_average.withColumn("predicted", linear_score(features, intercept, weights))
    error = error_estimate(F.col(spec.error_field), F.col("predicted"), F.col("average"))
    regression = results(predicted, spec, REGRESSION, F.col("predicted"), error)
    regression = regression.filter(F.col("res").isNotNull())
    if tree is None:
        return regression
    classified = results(with_average, spec, TREE, tree if isinstance(tree, Column) else tree_score(tree))
    return regression.unionByName(classified.filter(F.col("res").isNotNull()))


def with_models(
    rows: DataFrame, changes: DataFrame, time: str, kind: str = REGRESSION
) -> DataFrame:
    """Rows with the intercept and weights of the model in force at their time."""
    of_kind = changes.filter(F.col("kind") == kind).select("since", "intercept", "weights")
    return asof_join(rows, of_kind, [], time, ["intercept", "weights"])


def published(results_table: DataFrame) -> DataFrame:
    return results_table.select("msgid", result_message(results_table).alias("value"))
