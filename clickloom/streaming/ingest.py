"""Continuous click ingest: bodies in, monthly click table and dead letters out.

Each micro-batch runs the same ``prepare`` step as the batch job. All its output
goes to folders of its own, which are replaced as a whole: a batch that is run
again after a failure leaves nothing of its first attempt, even if links
registered since have moved rows between the outputs. There is no watermark: a
late click is loaded into its month.

``compact`` gathers the batches so far in few files by month and token; readers
take what is gathered and the batches after it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.clicks import loadable, prepare
from clickloom.operators.reports import rollup_daily
from clickloom.schemas import CLICKS
from clickloom.sources.batches import BATCH, read_batches, replace_batch, ungathered
from clickloom.sources.queue import TOPIC, ingest_trigger
from clickloom.sources.tables import with_month
from clickloom.streaming.backlog import sampled
from clickloom.streaming.retry import Load, retrying

STORED = T.StructType([*CLICKS.fields, T.StructField("year", T.IntegerType()), T.StructField("month", T.IntegerType()), BATCH])


def loader(links: Callable[[], DataFrame], out: str) -> Load:
    """The load of one batch of bodies below ``out``; ``links`` is called per batch, so links registered since are known."""

    def load(batch: DataFrame, batch_id: int) -> None:
        prepared = prepare(batch, links()).persist()
        try:
            good = loadable(prepared).select(*CLICKS.fieldNames())
            months = with_month(good).hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "short_token")
            replace_batch(months, f"{out}/clicks", batch_id, ["year", "month"])
            dead = prepared.filter(F.col("reason").isNotNull()).select("body", "reason")
            replace_batch(dead, f"{out}/dead_letters", batch_id, [])
            replace_batch(rollup_daily(good), f"{out}/rollup", batch_id, [])
        finally:
            prepared.unpersist()

    return load


def start_ingest(bodies: DataFrame, links: Callable[[], DataFrame], out: str, checkpoint: str,
                 available_now: bool = False, queue: str | None = None, **retry) -> StreamingQuery:
    """Load ``bodies`` below ``out``: ``clicks``, ``dead_letters``, ``rollup``, and ``set_aside`` for batches that fail for their data.

    With ``queue``, the folder that the bodies come from, the number of bodies
    still waiting there is sampled after each batch, to ``samples``. A failed load is tried again after a pause, for ever unless ``attempts`` is given; ``retry`` as for ``retrying``.
    """
    load = loader(links, out)
    if queue:
        load = sampled(load, queue, checkpoint, f"{out}/samples", TOPIC)
    load = retrying(load, **{"aside": f"{out}/set_aside", **retry})
    writer = bodies.writeStream.foreachBatch(load).option("checkpointLocation", checkpoint)
    return ingest_trigger(writer, available_now).start()


def read_ingested(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark, f"{out}/clicks", STORED)


def read_dead_letters(spark: SparkSession, out: str) -> DataFrame:
    schema = T.StructType([T.StructField("body", T.StringType()), T.StructField("reason", T.StringType()), BATCH])
    return spark.read.schema(schema).parquet(f"{out}/dead_letters")


ROLLUP = T.StructType(
    [
        T.StructField("short_token", T.StringType()),
        T.StructField("day", T.DateType()),
        T.StructField("country", T.StringType()),
        T.StructField("clicks", T.LongType()),
        BATCH,
    ]
)


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """Current counts by link, day and country: the sum of what each batch added."""
    return read_batches(spark, path, ROLLUP).groupBy("short_token", "day", "country").agg(F.sum("clicks").alias("clicks"))


def compact(spark: SparkSession, out: str, upto: int) -> None:
    """Gather the finished batches up to ``upto`` that are not gathered yet.

    Clicks go to files by month, sorted by token; rollup counts are summed. A
    run writes one folder named after its last batch, so it can be repeated;
    batches that may still be run again must not be included.
    """
    fresh = ungathered(spark, f"{out}/clicks", STORED, upto)
    if fresh is not None:
        fresh = fresh.drop("batch_id").hint("rebalance", "year", "month").sortWithinPartitions("year", "month", "short_token", "clicked_at")
        replace_batch(fresh, f"{out}/clicks_gathered", upto, ["year", "month"])
    compact_rollup(spark, f"{out}/rollup", upto)


def compact_rollup(spark: SparkSession, path: str, upto: int) -> None:
    fresh = ungathered(spark, path, ROLLUP, upto)
    if fresh is not None:
        fresh = fresh.groupBy("short_token", "day", "country").agg(F.sum("clicks").alias("clicks"))
        replace_batch(fresh, f"{path}_gathered", upto, [])
