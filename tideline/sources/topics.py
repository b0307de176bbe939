"""Message topics and document collections.

The topic functions need the public Kafka connector on the class path; everything
behind them takes any stream with a ``value`` column, so file streams work as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def topic_options(servers: str, topic: str, extra: dict[str, str] | None = None) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "kafka.isolation.level": "read_committed",
        **(extra or {}),
    }


def messages(raw: DataFrame) -> DataFrame:
    """Topic rows -> message text with its place in the topic; the key is dropped."""
    keep = [c for c in ("topic", "partition", "offset", "timestamp") if c in raw.columns]
    return raw.select(*keep, F.col("value").cast("string").alias("value"))


def stream_topic(
    spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None
) -> DataFrame:
    extra = {"startingOffsets": "earliest"}
    if max_offsets is not None:
        extra["maxOffsetsPerTrigger"] = str(max_offsets)
    reader = spark.readStream.format("kafka").options(**topic_options(servers, topic, extra))
    return messages(reader.load())


def read_topic(
    spark: SparkSession, servers: str, topic: str, start: str = "earliest", end: str = "latest"
) -> DataFrame:
    """Bounded read between two offset positions."""
    extra = {"startingOffsets": start, "endingOffsets": end}
    reader = spark.read.format("kafka").options(**topic_options(servers, topic, extra))
    return messages(reader.load())


def take_messages(df: DataFrame, count: int) -> DataFrame:
    """The bounded read of N messages."""
    return df.limit(count)


def write_topic(df: DataFrame, servers: str, topic: str, checkpoint: str, value: str = "value"):
    """Start the query that sends text to a topic."""
    return (
        df.select(F.col(value).cast("string").alias("value"))
        .writeStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("topic", topic)
        .option("checkpointLocation", checkpoint)
        .start()
    )


def message_ids(df: DataFrame, out: str = "msgid") -> DataFrame:
    """Ids without a shuffle: the offset where there is one, else a row id.

    A stream without offsets has no stable row id; there it is a hash of the message,
    so equal messages share it.
    """
    if "offset" in df.columns and "partition" in df.columns:
        place = F.shiftleft(F.col("partition").cast("bigint"), 40) + F.col("offset")
        return df.withColumn(out, place)
    if df.isStreaming:
        return df.withColumn(out, F.xxhash64(*df.columns))
    return df.withColumn(out, F.monotonically_increasing_id())


def stamp_arrival(df: DataFrame, every: int = 1, out: str = "arrival") -> DataFrame:
    """Processing time on every ``every``-th message, null on the others."""
    stamped: Column = F.current_timestamp()
    if every > 1:
        stamped = F.when(F.col("msgid") % every == 0, stamped)
    return df.withColumn(out, stamped)


def store_documents(collection: str, root: str, column: str = "entry") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` sink: one ``{entry: text}`` row per message, appended to a collection.

    A batch has its own folder and replaces it, so a repeated batch stores nothing twice.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        only = batch.columns[0] if column not in batch.columns else column
        batch.select(F.col(only).cast("string").alias("entry")).write.mode("overwrite").parquet(
            f"{root}/{collection}/batch={batch_id}"
        )

    return store


def read_documents(spark: SparkSession, collection: str, root: str) -> DataFrame:
    return spark.read.schema("entry string, batch int").parquet(f"{root}/{collection}")
