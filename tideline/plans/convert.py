"""Offline conversion of raw dataset rows to replay lines ``relative_ms|pack``."""

from __future__ import annotations

from collections.abc import Sequence as Seq

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tideline.functions.senml import to_pack
from tideline.functions.times import (
    epoch_millis,
    fixed_rate_offset,
    scaled_offset,
    timecode_offset,
    timecode_seconds,
)
from tideline.operators.clean import drop_incomplete
from tideline.operators.joins import join_trips_fares
from tideline.operators.sequence import SEQ, sequence
from tideline.session import materialise
from tideline.sources.files import TRIP_FARE_KEYS
from tideline.specs import FIT, GRID, SYS, TAXI


def first_of(df: DataFrame, column: str) -> int | None:
    """The earliest time of the whole input, one aggregated value."""
    return df.agg(F.min(column)).first()[0]


def convert_taxi(
    trips: DataFrame, fares: DataFrame, scale: float = 1.0, observation: Observation | None = None
) -> DataFrame:
    joined = join_trips_fares(trips, fares, TRIP_FARE_KEYS).withColumn(
        "taxi_identifier", F.col("medallion").cast("string")
    )
    complete = drop_incomplete(joined, TAXI.field_names, observation)
    # Written once: the first time and the lines would each run the join.
    rows = materialise(
        complete.select(
            *TAXI.field_names, epoch_millis(F.col("pickup_datetime")).alias("time")
        )
    )
    first = first_of(rows, "time")
    return rows.select(
        scaled_offset(F.col("time"), F.lit(first), scale).alias("delay"),
        to_pack(TAXI).alias("pack"),
    )


def convert_fit(rows: DataFrame, order: Seq[str], scale: float = 1.0) -> DataFrame:
    """All subjects one after the other, an event every 2 ms. ``order`` is the file order."""
    numbered = sequence(rows, [], order).rows
    return numbered.select(
        fixed_rate_offset(F.col(SEQ) - 1, scale).alias("delay"), to_pack(FIT).alias("pack")
    )


def convert_fit_logs(logs: DataFrame, scale: float = 1.0) -> DataFrame:
    """Numbered logs (``file``, ``line``): every file starts at 0, an event every 2 ms in file order."""
    return logs.select(
        "file", fixed_rate_offset(F.col("line"), scale).alias("delay"), to_pack(FIT).alias("pack")
    )


def convert_grid(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Elapsed seconds since the first reading, scaled; values are JSON numbers."""
    first = first_of(rows, "timestamp")
    return rows.select(
        scaled_offset(F.col("timestamp"), F.lit(first), scale).alias("delay"),
        to_pack(GRID, quoted=False).alias("pack"),
    )


def convert_meters(rows: DataFrame, scale: float = 1.0) -> DataFrame:
    """Meter readings by time code. ``rows`` has id, timecode and the measured SYS columns."""
    timed = rows.withColumn("time", timecode_seconds(F.col("timecode")))
    first = first_of(timed, "time")
    return timed.withColumn(
        "source", F.concat(F.lit("ci4lrerertvs"), F.col("id").cast("string"))
    ).select(
        timecode_offset(F.col("time"), F.lit(first), scale).alias("delay"),
        to_pack(SYS).alias("pack"),
    )
