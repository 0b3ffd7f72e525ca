"""Loads that are tried again: a batch is kept until its sink has taken it.

A batch is acknowledged by the checkpoint only after its load has returned, so
one that fails is first tried again here after a pause, and after ``attempts``
by whoever starts the query anew from its checkpoint. As each load replaces its
own folders, a batch that was partly written leaves every row once.

A batch that fails because of its data would fail for ever. It is set aside: its
rows are written as they came, with the error, and the stream goes on.
``reload`` loads such a batch again once the cause is mended.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.errors import ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException, SparkRuntimeException
from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.schemas import RETRY_SECONDS
from clickloom.sources.batches import replace_batch

Load = Callable[[DataFrame, int], None]

#: Errors that the rows themselves cause; all others may pass by themselves.
DATA_ERRORS = (ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException, PythonException, SparkRuntimeException)


def retrying(load: Load, pause_seconds: float = RETRY_SECONDS, attempts: int | None = None, aside: str | None = None) -> Load:
    """``load`` for ``foreachBatch``, tried again after a pause: ``attempts`` times in all, or for ever.

    With ``aside`` a batch that fails twice by one of ``DATA_ERRORS`` goes below that
    path. Without it, or when the attempts are used up, the error ends the query,
    which can be started again from its checkpoint.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        tried, by_data = 0, 0
        while True:
            try:
                return load(batch, batch_id)
            except Exception as error:
                tried, by_data = tried + 1, by_data + isinstance(error, DATA_ERRORS)
                if aside and by_data > 1:
                    kept = batch.withColumn("error", F.lit(str(error)[:1_000]))
                    return replace_batch(kept, aside, batch_id, [])
                if tried == attempts:
                    raise
            time.sleep(pause_seconds)

    return run


def reload(spark: SparkSession, aside: str, batch_id: int, load: Load) -> None:
    """Load a batch that was set aside, under its own number; its folder stays, for the record."""
    load(spark.read.parquet(f"{aside}/batch_id={batch_id}").drop("error"), batch_id)
