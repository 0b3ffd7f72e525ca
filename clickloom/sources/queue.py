"""The click-event queue: JSON bodies from files or Kafka, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from clickloom.schemas import INGEST_INTERVAL

TOPIC = "link-clicks"


def read_bodies(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """All bodies below ``path``, or in some files, one per line: column ``body``."""
    return spark.read.text(path).select(F.col("value").alias("body"))


def stream_bodies(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.load(path).select(F.col("value").alias("body"))


def kafka_options(servers: str, topic: str = TOPIC, max_offsets: int | None = None, min_offsets: int | None = None,
                  max_delay: str | None = None) -> dict[str, str]:
    """Reader options. Without ``max_offsets`` a batch takes all that has arrived, so throughput has no bound of its own.

    With ``min_offsets`` a batch waits for so many events, at most ``max_delay``.
    """
    options = {
        "kafka.bootstrap.servers": servers, "subscribe": topic, "maxOffsetsPerTrigger": max_offsets,
        "minOffsetsPerTrigger": min_offsets, "maxTriggerDelay": max_delay,
    }
    return {key: str(value) for key, value in options.items() if value is not None}


def stream_bodies_kafka(spark: SparkSession, servers: str, topic: str = TOPIC, max_offsets: int | None = None,
                        min_offsets: int | None = None, max_delay: str | None = None) -> DataFrame:
    """Kafka form. Bytes that are not UTF-8 give a NULL body, which the parser dead-letters."""
    options = kafka_options(servers, topic, max_offsets, min_offsets, max_delay)
    raw = spark.readStream.format("kafka").options(**options).load()
    return raw.select(F.try_validate_utf8(F.col("value").cast("string")).alias("body"))


def without_redeliveries(bodies: DataFrame, seconds: int) -> DataFrame:
    """Streamed bodies without those that came, letter for letter, at most ``seconds`` before; opt-in.

    The time is that of the batch, so no body comes late and none is lost for
    being so; the state holds a hash per body of that time, and drops it with the
    first batch that starts later, until which a body still counts as come. Clicks of one visitor
    on one link in one second have equal bodies and count once. NULL bodies all stay.
    """
    key = F.coalesce(F.sha2("body", 256), F.expr("uuid()"))
    arrived = bodies.withColumns({"_body": key, "_arrived": F.expr("current_timestamp")}).withWatermark("_arrived", f"{seconds} seconds")
    return arrived.dropDuplicatesWithinWatermark(["_body"]).drop("_body", "_arrived")


def write_bodies(bodies: DataFrame, path: str) -> None:
    """Append bodies to a folder, one line each.

    Line breaks inside a body become blanks: in JSON they only stand between
    values, as inside strings they must be escaped.
    """
    one_line = F.translate("body", "\r\n", "  ")
    bodies.select(one_line.alias("value")).write.mode("append").text(path)


def ingest_trigger(writer: DataStreamWriter, available_now: bool = False, interval: str = INGEST_INTERVAL) -> DataStreamWriter:
    if available_now:
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=interval)
