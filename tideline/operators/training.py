"""Training: projections, quartile labels, regression and tree models per request."""

from __future__ import annotations

from collections.abc import Sequence as Seq
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.operators.joins import lookup_join
from tideline.operators.quantiles import exact_quantiles
from tideline.session import materialise
from tideline.specs import QUARTILE_LABELS, Dataset

# Candidate cuts per feature; the default of 32 misses cuts that matter.
TREE_BINS = 256


def training_projection(df: DataFrame, spec: Dataset, keep: Seq[str] = ()) -> DataFrame:
    return df.select(*keep, *spec.training_fields)


def quartile_bounds(df: DataFrame, keys: Seq[str], value: str) -> DataFrame:
    """Per key: n, the quartiles at position p (n + 1) of the sorted values, and the maximum.

    Positions below the first or beyond the last value are clamped, others are
    interpolated between their neighbours. No rows are numbered: brackets of values are
    narrowed by counts, so a request with a third of all rows is no task's alone.
    """
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("all_rows", F.lit(0)), ["all_rows"]
    found = exact_quantiles(df, keys, value, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return found.select(*keys, "n", F.col("most").alias("q100"), "q25", "q50", "q75")


def quartile_label(value: Column, q50: Column, q75: Column, q100: Column) -> Column:
    """Label by quarter; where bounds coincide the higher label counts."""
    bad, good, very_good, excellent = QUARTILE_LABELS
    return (
        F.when(value.isNull(), None)
        .when(value >= q100, excellent)
        .when(value >= q75, very_good)
        .when(value >= q50, good)
        .otherwise(bad)
    )


def annotate_quartiles(df: DataFrame, keys: Seq[str], value: str, out: str = "result") -> DataFrame:
    # One row per key; written, so that checking its size does not rank everything twice.
    bounds = materialise(quartile_bounds(df, keys, value))
    if not keys:
        df = df.withColumn("all_rows", F.lit(0))
        keys = ["all_rows"]
    labelled = lookup_join(df, bounds, keys, how="left").withColumn(
        out, quartile_label(F.col(value), F.col("q50"), F.col("q75"), F.col("q100"))
    )
    return labelled.drop("n", "q25", "q50", "q75", "q100", "all_rows")


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _solve(moments: pd.Series) -> pd.Series:
    """Weights from one request's moments: p² covariances, then p covariances with the target."""

    def weights(m):
        m = np.asarray(m, dtype=float)
        p = int((np.sqrt(1 + 4 * len(m)) - 1) / 2)
        return np.linalg.lstsq(m[: p * p].reshape(p, p), m[p * p :], rcond=1e-12)[0]

    return moments.map(weights)


# Share of a feature's variance that the features before it leave open, below which it is collinear.
COLLINEAR = 1e-9
# Residual variance, as a share of the target's, below which a fit is exact.
EXACT = 1e-12


def _sweep(r: np.ndarray, k: int) -> np.ndarray:
    """Bring feature ``k`` into the fit, or take it out again."""
    d, out = r[k, k], r - np.outer(r[:, k], r[k]) / r[k, k]
    out[k], out[:, k] = r[k] / d, -r[:, k] / d
    out[k, k] = 1 / d
    return out


def eliminate(n: float, cov: np.ndarray, cov_y: np.ndarray, var_y: float) -> np.ndarray:
    """Weights with the features that an information criterion does not want set to 0.

    A feature that those before it explain is left out. Then the feature with the smallest
    standardised weight goes as long as (n - p) S / S_all + 2 q falls, where S is the sum of
    squares left, p the number of parameters of all features and q that of those kept.
    """
    sd, sd_y = np.sqrt(np.maximum(np.diag(cov), 0)), np.sqrt(max(var_y, 0))
    weights = np.zeros(len(cov_y))
    if not sd_y > 0:
        return weights
    safe = np.where(sd > 0, sd, 1)
    r = np.block([[cov / np.outer(safe, safe), (cov_y / safe / sd_y)[:, None]], [(cov_y / safe / sd_y)[None], np.ones((1, 1))]])
    kept = []
    for k in range(len(cov_y)):
        if sd[k] > 0 and r[k, k] > COLLINEAR:
            r = _sweep(r, k)
            kept.append(k)
    most = len(kept) + 1
    whole, best = max(r[-1, -1], EXACT), n + most
    while kept:
        least = min(kept, key=lambda k: (abs(r[k, -1]), -k))
        fewer = _sweep(r, least)
        criterion = (n - most) * max(fewer[-1, -1], EXACT) / whole + 2 * len(kept)
        if criterion >= best:
            break
        r, best = fewer, criterion
        kept.remove(least)
    weights[kept] = r[kept, -1] * sd_y / sd[kept]
    return weights


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _eliminated(moments: pd.Series) -> pd.Series:
    """As ``_solve``, after the number of rows and the variance of the target."""

    def weights(m):
        n, var_y, *rest = np.asarray(m, dtype=float)
        p = int((np.sqrt(1 + 4 * len(rest)) - 1) / 2)
        return eliminate(n, np.reshape(rest[: p * p], (p, p)), np.array(rest[p * p :]), var_y)

    return moments.map(weights)


def train_linear(
    df: DataFrame, keys: Seq[str], features: Seq[str], target: str, select: bool = False
) -> DataFrame:
    """Least squares per key: ``rows``, ``intercept``, ``weights`` (in feature order).

    The rows are reduced to means and covariances by one partial aggregation; only
    one small system per key is solved in Python. Collinear features get the
    smallest weights that fit; with ``select`` only the first of them is kept, and features
    are dropped by an information criterion (weight 0), see ``eliminate``.
    """
    whole = df.dropna(subset=[*features, target])
    x = [F.col(f).cast("double") for f in features]
    y = F.col(target).cast("double")
    aggregates = [F.count(F.lit(1)).alias("rows"), F.avg(y).alias("mean_y"), F.var_pop(y).alias("var_y")]
    aggregates += [F.avg(c).alias(f"mean_{i}") for i, c in enumerate(x)]
    aggregates += [F.covar_pop(c, y).alias(f"cov_{i}_y") for i, c in enumerate(x)]
    pairs = list(combinations_with_replacement(range(len(x)), 2))
    aggregates += [F.covar_pop(x[i], x[j]).alias(f"cov_{i}_{j}") for i, j in pairs]
    moments = whole.groupBy(*keys).agg(*aggregates)
    matrix = [
        F.col(f"cov_{min(i, j)}_{max(i, j)}") for i in range(len(x)) for j in range(len(x))
    ]
    matrix += [F.col(f"cov_{i}_y") for i in range(len(x))]
    if select:
        weights = _eliminated(F.array(F.col("rows").cast("double"), F.col("var_y"), *matrix))
    else:
        weights = _solve(F.array(*matrix))
    solved = moments.withColumn("weights", weights)
    fitted = F.lit(0.0)
    for i in range(len(x)):
        fitted = fitted + F.get("weights", F.lit(i)) * F.col(f"mean_{i}")
    return solved.select(
        *keys, "rows", (F.col("mean_y") - fitted).alias("intercept"), "weights"
    )


def train_linear_1f(df: DataFrame, keys: Seq[str], feature: str, target: str) -> DataFrame:
    """One-feature least squares per key, all in one aggregation."""
    y, x = F.col(target).cast("double"), F.col(feature).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(y, x).alias("rows"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
    )


def fit_linear(df: DataFrame, features: Seq[str], target: str) -> PipelineModel:
    """One model over one large table."""
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    regression = LinearRegression(
        featuresCol="features", labelCol=target, predictionCol="prediction", solver="normal"
    )
    return Pipeline(stages=[assemble, regression]).fit(df.dropna(subset=[*features, target]))


def fit_tree(
    df: DataFrame, features: Seq[str], label: str, depth: int = 5
) -> PipelineModel:
    """Entropy decision tree over one labelled table."""
    index = StringIndexer(
        inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip"
    )
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    tree = DecisionTreeClassifier(
        featuresCol="features",
        labelCol="label_index",
        impurity="entropy",
        maxDepth=depth,
        maxBins=TREE_BINS,
        seed=1,
    )
    return Pipeline(stages=[index, assemble, tree]).fit(df.dropna(subset=[*features, label]))


def model_name(dataset: str, kind: str, row_end: Column) -> Column:
    """``<dataset>-<kind>-<end of range>.model``"""
    return F.concat(F.concat_ws("-", F.lit(dataset), F.lit(kind), row_end.cast("string")), F.lit(".model"))
