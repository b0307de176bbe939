"""The four jobs on streams. Sources and sinks are the caller's choice."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence as Seq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators.scoring import REGRESSION, TREE, Split
from tideline.plans.etl import add_annotation, before_blocks, packed
from tideline.plans.pred import parse_messages, published, score_averaged
from tideline.plans.train import run as run_training
from tideline.sources.files import training_requests
from tideline.sources.registry import Registry
from tideline.sources.topics import message_ids, stamp_arrival
from tideline.specs import Dataset
from tideline.streaming.stateful import (
    interpolate_open,
    stream_block_stats,
    stream_forecast,
    stream_interpolate,
    stream_latest_average,
)
from tideline.streaming.versions import model_column, regression_model, tree_walk

Batch = Callable[[DataFrame, int], None]


def clean_stream(
    packs: DataFrame,
    spec: Dataset,
    order: Seq[str],
    members: DataFrame | None = None,
    dimension: DataFrame | None = None,
    flush_after_ms: int | None = None,
) -> DataFrame:
    rows = before_blocks(packs, spec, members)
    filled = stream_interpolate(
        rows, spec.interpolated, [spec.id_field], order, flush_after_ms=flush_after_ms
    )
    return add_annotation(filled, spec, dimension)


def clean_open(
    spark: SparkSession, checkpoint: str, spec: Dataset, dimension: DataFrame | None = None
) -> DataFrame:
    """At the end of the input: the cleaned rows of the blocks that ``clean_stream`` left open."""
    rows = interpolate_open(spark, checkpoint, spec.interpolated, [spec.id_field])
    return add_annotation(rows, spec, dimension)


def cleaned_packs(rows: DataFrame, spec: Dataset, keep: Seq[str] = ()) -> DataFrame:
    return packed(rows, spec, keep)


def statistics_streams(rows: DataFrame, spec: Dataset, order: Seq[str]) -> dict[str, DataFrame]:
    keys = [spec.id_field]
    return {
        "blocks": stream_block_stats(rows, keys, order, spec.average_field, spec.distinct_field),
        "forecast": stream_forecast(rows, spec.kalman_field, keys, order),
    }


def score_stream(
    packs: DataFrame,
    spec: Dataset,
    order: Seq[str],
    registry: Registry,
    model: str,
    sink: Batch,
    checkpoint: str,
    tree: Split | int | None = None,
) -> StreamingQuery:
    """Score with the newest version of ``model``, looked up anew in every micro-batch.

    The sink gets (msgid, value) batches; it must be idempotent per batch id.
    """
    with_ids = packs if "msgid" in packs.columns else message_ids(packs)
    rows = parse_messages(stamp_arrival(with_ids), spec)
    averaged = stream_latest_average(rows, spec.error_field, [spec.id_field], order)

    def score(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        current = registry.latest_named(spark, model)
        if current is None:
            raise LookupError(f"no model named {model}; rows wait until there is one")
        weights = [F.lit(w) for w in current["weights"]]
        table = score_averaged(batch, spec, F.lit(current["intercept"]), weights, tree)
        sink(published(table), batch_id)

    return (
        averaged.writeStream.foreachBatch(score)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def score_swapped(with_models: DataFrame, spec: Dataset) -> DataFrame:
    """Result table for rows with ``average`` and the models in force (``swap_stream``), of both kinds.

    Has no memory, so it works on a stream and on the rows left at its end. A row before
    the first version of a kind has no result of that kind.
    """
    *features, _ = spec.training_fields
    intercept, weights = regression_model(F.col(model_column(REGRESSION)))
    return score_averaged(
        with_models,
        spec,
        intercept,
        [F.get(weights, i) for i in range(len(features))],
        tree_walk(F.col(model_column(TREE)), features),
    )


def train_stream(
    messages: DataFrame,
    history: DataFrame,
    spec: Dataset,
    time: str,
    registry: Registry,
    sink: Batch,
    checkpoint: str,
) -> StreamingQuery:
    """Train for every request message; the sink gets (msgid, name, kind) batches.

    Models are stored under the stream (its checkpoint) and batch, once if a batch is repeated.
    """
    requests = training_requests(message_ids(messages))
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def train(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            sink(run_training(batch, history, spec, time, registry, batch=f"{stream}-{batch_id}"), batch_id)

    return (
        requests.writeStream.foreachBatch(train)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
