"""Raw dataset files, replay files and training requests.

Every reader takes a declared schema, so no file is read twice to infer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.session import materialise
from tideline.specs import FIT

TRIP_SCHEMA = (
    "medallion bigint, hack_license bigint, vendor_id string, rate_code bigint, "
    "store_and_fwd_flag string, pickup_datetime string, dropoff_datetime string, "
    "passenger_count int, trip_time_in_secs bigint, trip_distance double, "
    "pickup_longitude double, pickup_latitude double, dropoff_longitude double, "
    "dropoff_latitude double"
)
FARE_SCHEMA = (
    "medallion bigint, hack_license bigint, vendor_id string, pickup_datetime string, "
    "payment_type string, fare_amount double, surcharge double, mta_tax double, "
    "tip_amount double, tolls_amount double, total_amount double"
)
# The columns both files have.
TRIP_FARE_KEYS = ("medallion", "hack_license", "vendor_id", "pickup_datetime")
FIT_SCHEMA = ", ".join(f"{name} double" for name in FIT.field_names[1:-1]) + ", label int"
GRID_SCHEMA = "timestamp bigint, id double, grid_measurement double"
TIMECODE_SCHEMA = "id bigint, timecode string, value double"


def read_trips(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRIP_SCHEMA).csv(path, header=True, ignoreLeadingWhiteSpace=True)


def read_fares(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FARE_SCHEMA).csv(path, header=True, ignoreLeadingWhiteSpace=True)


def read_fitness_logs(
    spark: SparkSession, path: str, subject_in_path: str = r"(\d+)\.[A-Za-z]+$", numbered: bool = False
) -> DataFrame:
    """Tab-separated logs, one file (or folder) per subject, whose number is in the path.

    ``numbered`` adds a column ``line``: the row's place in its file, from 0.
    """
    number = F.regexp_extract(F.col("_metadata.file_path"), subject_in_path, 1)
    logs = spark.read.schema(FIT_SCHEMA).csv(path, sep="\t", recursiveFileLookup=True)
    subject = F.concat(F.lit("subject"), number).alias("subjectId")
    if not numbered:
        return logs.select("*", subject)
    return in_file_order(logs, subject)


def in_file_order(rows: DataFrame, *more: Column) -> DataFrame:
    """Rows of text files, all columns and ``more``, with ``file`` and ``line``, the place in the file from 0.

    ``rows`` must come straight from the reader. The rows of a split follow each other in one
    task, so their running ids give the place in the split; the counts of the earlier splits of
    the file are added. Rows are written once, so that both steps see the same splits. Only the
    table of splits is ordered, each file for itself; it is broadcast as far as Spark finds it small.
    """
    split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_split")]
    placed = materialise(rows.select("*", *more, *split, F.monotonically_increasing_id().alias("_id")))
    counts = placed.groupBy("file", "_split").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy("file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offset = (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset")
    starts = counts.select("file", "_split", offset)
    return (
        placed.join(starts, ["file", "_split"])
        .withColumn("line", F.col("_id") + F.col("_offset"))
        .select(*[c for c in placed.columns if c not in ("file", "_split", "_id")], "file", "line")
    )


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GRID_SCHEMA).csv(path, sep=" ")


def read_meter_timecodes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TIMECODE_SCHEMA).csv(path, sep=" ")


def replay_events(lines: DataFrame, start_ms: int = 0) -> DataFrame:
    """``delay|pack`` lines (column ``value``) -> delay, pack, event_time. A header line is dropped.

    Works on streams. The pack may hold any character but a line end.
    """
    delay = F.trim(F.substring_index("value", "|", 1)).try_cast("double").cast("bigint")
    pack = F.expr("substring(value, instr(value, '|') + 1)")
    return (
        lines.select(delay.alias("delay"), F.trim(pack).alias("pack"))
        .filter(F.col("delay").isNotNull())
        .withColumn("event_time", F.timestamp_millis(F.col("delay") + F.lit(start_ms)))
    )


def read_replay(spark: SparkSession, path: str, start_ms: int = 0) -> DataFrame:
    return replay_events(spark.read.text(path), start_ms)


def stream_replay(
    spark: SparkSession, path: str, start_ms: int = 0, files_per_trigger: int = 64
) -> DataFrame:
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return replay_events(lines, start_ms)


def replay_line(delay: Column, pack: Column) -> Column:
    return F.concat_ws("|", delay.cast("string"), pack)


def write_replay(df: DataFrame, path: str, delay: str = "delay", pack: str = "pack") -> None:
    """Replay file(s) in delay order: part files follow each other in time."""
    ordered = df.select(delay, pack).orderBy(delay)
    ordered.select(replay_line(F.col(delay), F.col(pack)).alias("value")).write.text(path)


def training_requests(messages: DataFrame, value: str = "value") -> DataFrame:
    """``timestamp,rowstart,rowend`` messages -> typed request columns."""
    part = lambda i: F.get(F.split(F.trim(F.col(value)), ","), i).try_cast("bigint")
    others = [c for c in messages.columns if c != value]
    return messages.select(
        *others, part(0).alias("ts"), part(1).alias("row_start"), part(2).alias("row_end")
    )


def range_scan(
    df: DataFrame, time: str, start: int, end: int, partition: tuple[str, object] | None = None
) -> DataFrame:
    """``partition = value and start <= time < end``; on a partitioned table it reads only that part."""
    if partition is not None:
        df = df.filter(F.col(partition[0]) == F.lit(partition[1]))
    return df.filter((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))
