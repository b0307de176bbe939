"""Sliding linear regression over the last rows of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.sequence import SEQ, Sequenced
from tideline.specs import HORIZON, REGRESSION_WINDOW

PREDICTIONS = "predictions"


def sliding_regression(
    numbered: Sequenced,
    value: str,
    window_rows: int = REGRESSION_WINDOW,
    horizon: int = HORIZON,
    out: str = PREDICTIONS,
) -> DataFrame:
    """Fit a line to the last ``window_rows`` values, predict the next ``horizon`` ones.

    Null while there is a single value. The line is written around the mean of its
    window, so large row numbers cost no digits.
    """
    rows, window, own = numbered.lookback(window_rows - 1)
    frame = window.rowsBetween(1 - window_rows, 0)
    y = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    fitted = rows.withColumns(
        {
            "__slope": F.regr_slope(y, F.col(SEQ).cast("double")).over(frame),
            "__mean": F.avg(y).over(frame),
            "__n": F.count(F.lit(1)).over(frame),
        }
    ).filter(own)
    ahead = F.sequence(F.lit(1), F.lit(horizon))
    predictions = F.transform(ahead, lambda h: _line_at(h))
    return fitted.withColumn(
        out, F.when(F.col("__slope").isNotNull(), predictions)
    ).drop("__slope", "__mean", "__n", "chunk")


def _line_at(h: Column) -> Column:
    return F.col("__mean") + F.col("__slope") * (h + (F.col("__n") - 1) / 2)


def horizon_mean(predictions: Column) -> Column:
    """Mean of a row's predictions; null without predictions."""
    total = F.aggregate(predictions, F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(total, F.size(predictions))
