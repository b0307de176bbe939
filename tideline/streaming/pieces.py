"""Filter and forecast on a stream when one key has too many rows for one task.

A keyed state of the state store gives all rows of a key and micro-batch to one task. Here a
micro-batch is a table: its rows are numbered as in batch, heavy keys cut into ranges that
any task takes, and what is left of earlier micro-batches is a state that pieces can be
composed with. The Kalman step x -> (1 - k) x + k z is affine, so a piece of consecutive rows
is one affine map and the estimate after row n stands for all rows up to n: put back as a
row of its own (the value whose step from zero gives that estimate), it lets the parallel
running sums of the batch filter go on where the stream stopped. The sliding regression
needs the last window's estimates. So the state of a key is its last ``window_rows - 1``
(position, estimate) pairs, and no row waits for the row before it.

States are tables in the shared folder named by the micro-batch. A micro-batch reads those
before it, writes the keys it saw and, every COMPACT-th time, all keys; one that is run again
writes the same tables again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence as Seq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.joins import lookup_join
from tideline.operators.kalman import gains, kalman_sequenced
from tideline.operators.regression import PREDICTIONS, horizon_mean, sliding_regression
from tideline.operators.sequence import SEQ, Sequenced, sequence
from tideline.session import discard, folder_names, materialise
from tideline.specs import HORIZON, REGRESSION_WINDOW

Batch = Callable[[DataFrame, int], None]

#: Every so many micro-batches the states of all keys are written anew.
COMPACT = 16
_SETTLED = 128  # rows after which the gain does not change
_KEY, _OLD = "__key", "__old"


class TailState:
    """The last (position, estimate) pairs of every key, by micro-batch."""

    def __init__(self, path: str, rows: int) -> None:
        self.path, self.rows = path.rstrip("/"), rows

    def _last(self, tails: DataFrame) -> DataFrame:
        """Each key's last pairs; those that several micro-batches wrote are equal."""
        top = tails.groupBy(_KEY).agg(F.max(SEQ).alias("top"))
        each = tails.groupBy(_KEY, SEQ).agg(F.first("estimate").alias("estimate"))
        return lookup_join(each, top, [_KEY], "inner").where(F.col(SEQ) > F.col("top") - self.rows).select(_KEY, SEQ, "estimate")

    def before(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        names = folder_names(spark, self.path)
        known = {kind: sorted(int(n[len(kind) + 1 :]) for n in names if n.startswith(kind)) for kind in ("batch", "whole")}
        whole = [i for i in known["whole"] if i < batch_id][-1:]
        parts = [i for i in known["batch"] if i < batch_id and (not whole or i > whole[0])]
        paths = [f"{self.path}/whole-{i}" for i in whole] + [f"{self.path}/batch-{i}" for i in parts]
        return self._last(spark.read.parquet(*paths)) if paths else None

    def put(self, tails: DataFrame, batch_id: int) -> None:
        spark = tails.sparkSession
        tails.write.mode("overwrite").parquet(f"{self.path}/batch-{batch_id}")
        if batch_id % COMPACT == COMPACT - 1:
            whole = self.before(spark, batch_id + 1)
            whole.write.mode("overwrite").parquet(f"{self.path}/whole-{batch_id}")


def _seed(last: DataFrame, value: str) -> DataFrame:
    """The key's last estimate as the row from which the filter goes on."""
    gain = F.element_at(F.array(*[F.lit(g) for g in gains(_SETTLED)]), F.least(F.col(SEQ), F.lit(_SETTLED)).cast("int"))
    return last.select(_KEY, SEQ, (F.col("estimate") / gain).alias(value), F.lit(True).alias(_OLD))


def forecast_in_pieces(
    value: str,
    keys: Seq[str],
    order: Seq[str],
    state_path: str,
    sink: Batch,
    window_rows: int = REGRESSION_WINDOW,
    horizon: int = HORIZON,
) -> Batch:
    """A ``foreachBatch`` function: rows with ``seq``, ``estimate`` and ``horizon_mean`` to ``sink``.

    Results are those of ``stream_forecast``: a missing value counts as 0.0, rows of a later
    micro-batch come after all earlier ones. The sink must be idempotent per batch id.
    """
    state = TailState(state_path, window_rows - 1)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({_KEY: F.struct(*keys), _OLD: F.lit(False)})
        numbered = sequence(rows, [_KEY], order)
        new, old = numbered.rows, state.before(spark, batch_id)
        if old is not None:
            last = old.groupBy(_KEY).agg(F.max_by("estimate", SEQ).alias("estimate"), F.max(SEQ).alias(SEQ))
            seen = last.select(_KEY, F.col(SEQ).alias("seen"))
            new = lookup_join(new, seen, [_KEY]).withColumn(SEQ, F.col(SEQ) + F.coalesce("seen", F.lit(0))).drop("seen")
            touched = lookup_join(old, rows.select(_KEY).distinct(), [_KEY], "left_semi")
            new = new.unionByName(_seed(lookup_join(last, rows.select(_KEY).distinct(), [_KEY], "left_semi"), value), allowMissingColumns=True)
        filtered = kalman_sequenced(Sequenced(new, (_KEY,), numbered.split), value, "estimate").where(~F.col(_OLD))
        if old is not None:
            filtered = filtered.unionByName(touched.withColumn(_OLD, F.lit(True)), allowMissingColumns=True)
        fitted = sliding_regression(Sequenced(filtered, (_KEY,), numbered.split), "estimate", window_rows, horizon)
        done = materialise(fitted.withColumn("horizon_mean", horizon_mean(F.col(PREDICTIONS))).drop(PREDICTIONS))
        sink(done.where(~F.col(_OLD)).drop(_KEY, _OLD), batch_id)
        top = done.groupBy(_KEY).agg(F.max(SEQ).alias("top"))
        tails = lookup_join(done.select(_KEY, SEQ, "estimate"), top, [_KEY], "inner")
        state.put(tails.where(F.col(SEQ) > F.col("top") - state.rows).drop("top"), batch_id)
        discard(done)

    return step
