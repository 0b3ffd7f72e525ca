"""Redirects as a stream: requests in, answers and click bodies out.

Each micro-batch is joined with the registry as it is then. An answer that was
given stays: a batch whose answers are stored is not resolved anew when it is
run again, even if links were registered or ran out since, and its click bodies
come from the stored answers. A batch whose bodies are stored does not write
them a second time, so their files keep their names and a stream that reads the
queue takes each once. (If a run dies between the last file of a batch and the
mark that it is finished, the batch is delivered again; see
``queue.without_redeliveries``.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.resolve import emit_clicks, resolve, resolve_known
from clickloom.sources.batches import BATCH, finished, replace_batch
from clickloom.sources.filters import probe_layers
from clickloom.sources.queue import ingest_trigger
from clickloom.streaming.retry import retrying

ANSWER = [T.StructField("status", T.IntegerType()), T.StructField("long_url", T.StringType())]


def answers_schema(requests: DataFrame) -> T.StructType:
    return T.StructType([*(f for f in requests.schema if f.name not in ("status", "long_url")), *ANSWER])


def start_redirects(requests: DataFrame, links: Callable[[], DataFrame], out: str, checkpoint: str, known: Callable[[], DataFrame] | None = None,
                    available_now: bool = False, **retry) -> StreamingQuery:
    """Answer streamed ``requests`` below ``out``: ``answers`` (Parquet) and ``bodies`` (a queue folder, one JSON body per line).

    ``links`` and ``known``, a stored filter that is asked first, are called per
    batch; the filter must know all links, as only what it may know is looked up.
    ``retry`` as for ``retrying``.
    """
    schema = answers_schema(requests)

    def answer(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if not finished(spark, f"{out}/answers", batch_id):
            asked = batch.drop("status", "long_url")
            found = resolve_known(probe_layers(asked, known()), links()) if known else resolve(asked, links())
            replace_batch(found.select(schema.names), f"{out}/answers", batch_id, [])
        if not finished(spark, f"{out}/bodies", batch_id):
            stored = spark.read.schema(schema).parquet(f"{out}/answers/batch_id={batch_id}")
            bodies = emit_clicks(stored).select(F.col("body").alias("value"))
            bodies.write.mode("overwrite").text(f"{out}/bodies/batch_id={batch_id}")

    writer = requests.writeStream.foreachBatch(retrying(answer, **retry)).option("checkpointLocation", checkpoint)
    return ingest_trigger(writer, available_now).start()


def read_answers(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, BATCH])).parquet(f"{out}/answers")
