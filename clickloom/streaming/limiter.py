"""The rate limiter on a stream: the state of a client is its log, at most ``limit`` instants.

Requests are decided micro-batch after micro-batch, and by time and id within
one, so the source must deliver them in time order across batches, as a live
service does; a request before its client's last accepted instant is decided as
of that instant. A batch is bounded by the source's options. The log is a list
state that lives for ``idle_seconds`` of the running job after a client's last
request, which must be longer than a window and the job's largest lag together.

State that lives for a time makes Spark want another batch always, so an
``availableNow`` run would never end. ``start_rate_limit`` therefore starts the
query without batches of no data: idle state goes with the next batch that has
data.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from clickloom.functions.timeutil import epoch_micros
from clickloom.operators.limiter import IDLE_SECONDS, UNKNOWN_CLIENT, decide, log_after
from clickloom.schemas import RATE_LIMIT, RATE_WINDOW_SECONDS
from clickloom.session import settings

#: What a query with the limiter's state has to be started with.
SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}

ANSWER = Row("client_key", "request_id", "allowed")


class Limiter(StatefulProcessor):
    """Decides the requests of one client in a micro-batch from the log of those before."""

    def __init__(self, limit: int, window: int, idle_ms: int) -> None:
        self.limit, self.window, self.idle_ms = limit, window, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._log = handle.getListState("log", "us bigint", ttlDurationMs=self.idle_ms)

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        asked = []
        for row in rows:
            if row.us is None:
                yield ANSWER(key[0], row.request_id, None)
            else:
                asked.append((row.us, row.request_id is None, row.request_id or 0))
        if asked:
            asked.sort()
            for (_, no_id, request_id), allowed in zip(asked, self._decided([us for us, _, _ in asked])):
                yield ANSWER(key[0], None if no_id else request_id, allowed)

    def _decided(self, asked: list[int]) -> list[bool]:
        if self.limit < 1:
            return [False] * len(asked)
        log = np.array([row[0] for row in self._log.get()], dtype=np.int64)
        instants = np.maximum(np.array(asked, dtype=np.int64), log[-1] if len(log) else 0)
        allowed = decide(instants, log, self.limit, self.window)
        self._log.put([(us,) for us in log_after(instants, log, self.limit, self.window).tolist()])
        return allowed.tolist()

    def close(self) -> None:
        pass


def stream_rate_limit(requests: DataFrame, limit: int = RATE_LIMIT, window_seconds: float = RATE_WINDOW_SECONDS,
                      idle_seconds: float = IDLE_SECONDS) -> DataFrame:
    """``client_key``, ``request_id``, ``allowed`` for streamed requests; a request without time gets NULL.

    Start the query by ``start_rate_limit``, or with ``SETTINGS``.
    """
    keyed = requests.select(
        F.coalesce("client_key", F.lit(UNKNOWN_CLIENT)).alias("client_key"),
        "request_id",
        epoch_micros(F.col("requested_at")).alias("us"),
    )
    idle = int(max(idle_seconds, 2 * window_seconds) * 1_000)
    # Most clients ask seldom, so a batch has few rows of each: plain rows cost a fraction of a data frame per client.
    return keyed.groupBy("client_key").transformWithState(
        Limiter(limit, int(window_seconds * 1_000_000), idle),
        "client_key string, request_id bigint, allowed boolean",
        "append",
        "processingTime",
    )


def start_rate_limit(decided: DataFrame, path: str, checkpoint: str, available_now: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Write the decisions of ``stream_rate_limit`` to Parquet files below ``path``."""
    writer = decided.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    # A query keeps the settings that it is started with.
    with settings(decided.sparkSession, SETTINGS):
        return writer.start()
