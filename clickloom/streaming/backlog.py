"""The depth of a file queue: bodies that have arrived and that no batch of a stream has taken.

A stream notes in its checkpoint which files each batch takes, before it loads
them. What is listed in the queue and not there is waiting; files that were
taken are not read again for it. A sample is written with each batch, in a
folder of its own, so a batch that is run again leaves one.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickloom.functions.timeutil import instant
from clickloom.schemas import METRIC_SAMPLES
from clickloom.sources.batches import BATCH, replace_batch
from clickloom.sources.queue import read_bodies
from clickloom.streaming.retry import Load

QUEUE_DEPTH = "queue_depth"


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def _plain(path):
    """A path without scheme and with no escapes, as listings and checkpoints write it differently."""
    return F.try_url_decode(F.replace(F.regexp_replace(path, "^[a-z0-9]+:/+", "/"), F.lit("+"), F.lit("%2B")))


def waiting_files(spark: SparkSession, queue: str, checkpoint: str) -> DataFrame:
    """(path, length) of the files below ``queue`` that the stream with this checkpoint has not taken."""
    listed = spark.read.format("binaryFile").load(queue).select("path", "length")
    log = f"{checkpoint}/sources/0"
    if not _exists(spark, log):
        return listed
    # A first line with a version, then an object per file; a later file repeats what it gathers.
    taken = spark.read.text(log).select(F.get_json_object("value", "$.path").alias("path")).filter("path is not null")
    taken = taken.select(_plain(F.col("path")).alias("_taken")).distinct()
    return listed.join(taken, _plain(F.col("path")) == F.col("_taken"), "left_anti")


def queue_depth(spark: SparkSession, queue: str, checkpoint: str) -> int:
    """Bodies that are waiting. The driver holds the names of the waiting files, as each reader of files does."""
    paths = waiting_files(spark, queue, checkpoint).agg(F.collect_list("path")).first()[0]
    return read_bodies(spark, paths).count() if paths else 0


def sampled(load: Load, queue: str, checkpoint: str, samples: str, name: str) -> Load:
    """``load``, with a sample of the depth that the queue ``name`` has after it, as batch of the table ``samples``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        load(batch, batch_id)
        spark = batch.sparkSession
        row = spark.range(1).select(
            F.lit(QUEUE_DEPTH).alias("metric"), F.create_map(F.lit("queue"), F.lit(name)).alias("labels"),
            instant(datetime.now(timezone.utc)).alias("ts"),
            F.lit(float(queue_depth(spark, queue, checkpoint))).alias("value"))
        replace_batch(row, samples, batch_id, [])

    return run


def read_samples(spark: SparkSession, samples: str) -> DataFrame:
    return spark.read.schema(T.StructType([*METRIC_SAMPLES.fields, BATCH])).parquet(samples)
