"""Live report refresh: a rollup maintained from a stream of clicks.

A batch adds its own counts as one folder and a reader sums them, so no state
grows with the number of links and days, and a repeated batch replaces itself.
``ingest.compact_rollup`` sums the folders of finished batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.reports import rollup_daily
from clickloom.schemas import REFRESH_INTERVAL


def start_rollup(clicks: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    def add(batch: DataFrame, batch_id: int) -> None:
        (
            rollup_daily(batch)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "static")
            .parquet(f"{path}/batch_id={batch_id}")
        )

    writer = clicks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": REFRESH_INTERVAL}
    return writer.trigger(**trigger).start()
