"""A batch of registration requests, in the order of the service's checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.operators.limiter import CHUNK_ROWS, LOG, client_key, rate_limit_after
from clickloom.operators.links import allocate_ids, has_http_scheme, merge_links, normalize_expiry, with_tokens
from clickloom.schemas import RATE_LIMIT, RATE_WINDOW_SECONDS
from clickloom.session import materialize
from clickloom.sources.batches import last_batch, replace_batch
from clickloom.sources.registry import append_links

CREATED, BAD_REQUEST, UNREADABLE, THROTTLED, FAILED = 200, 400, 422, 429, 500


def register(requests: DataFrame, base_url: str, naive_zone: str, first_id: int = 1, **options) -> DataFrame:
    """Outcome of every request of one batch that stands alone; ``options`` as for ``register_after``."""
    return register_after(requests, None, base_url, naive_zone, first_id, **options)[0]


def register_after(requests: DataFrame, log: DataFrame | None, base_url: str, naive_zone: str, first_id: int = 1,
                   limit: int = RATE_LIMIT, window_seconds: float = RATE_WINDOW_SECONDS,
                   chunk_rows: int = CHUNK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(outcome of every request, the limiter's log for the next batch), after batches that left ``log``.

    A request whose expiry text cannot be read is refused before anything else
    and uses no quota. Then comes the limiter, so bad URLs use up quota and
    throttled requests use up no ids. Input: ``request_id``, ``api_key``, ``ip_address``,
    ``requested_at``, ``long_url``, ``expires_text``.
    """
    keyed = normalize_expiry(requests, naive_zone).select(
        "request_id",
        client_key(F.col("api_key"), F.col("ip_address")).alias("client_key"),
        "requested_at",
        "long_url",
        "expires_at",
        "expiry_unreadable",
    )
    refused = keyed.filter("expiry_unreadable").withColumn("status", F.lit(UNREADABLE)).drop("expiry_unreadable")
    keyed = keyed.filter("NOT expiry_unreadable").drop("expiry_unreadable")
    limited, log = rate_limit_after(keyed, log, limit, window_seconds, chunk_rows=chunk_rows)
    status = (
        F.when(~F.col("allowed"), THROTTLED)
        .when(F.col("allowed").isNull() | ~has_http_scheme(F.col("long_url")), BAD_REQUEST)
        .otherwise(CREATED)
    )
    checked = materialize(limited.withColumn("status", status).drop("allowed"), "registration")
    accepted = allocate_ids(
        checked.filter(F.col("status") == CREATED), ["requested_at", "request_id"], first_id
    )
    created = (
        with_tokens(accepted, base_url)
        .withColumn("status", F.when(F.col("reason").isNull(), F.col("status")).otherwise(FAILED))
        .drop("reason")
    )
    rest = checked.filter(F.col("status") != CREATED).unionByName(refused)
    return created.unionByName(rest, allowMissingColumns=True), log


def registered_links(outcomes: DataFrame) -> DataFrame:
    """Registry rows of the created links."""
    return outcomes.filter(F.col("status") == CREATED).select(
        "id", "short_token", "long_url", F.col("requested_at").alias("created_at"), "expires_at"
    )


def register_batch(registry: DataFrame, requests: DataFrame, base_url: str, naive_zone: str, log: DataFrame | None = None,
                   **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(outcomes, registry with the created links, log): ids go on after the highest one stored, the limiter after ``log``.

    The outcomes are written once, so that all results see the same ids. One
    batch runs at a time.
    """
    highest = registry.agg(F.max("id")).first()[0] or 0
    outcomes, log = register_after(requests, log, base_url, naive_zone, highest + 1, **options)
    outcomes = materialize(outcomes, "outcomes")
    return outcomes, merge_links(registry, registered_links(outcomes)), log


OUTCOMES = (
    "request_id bigint, client_key string, requested_at timestamp_ntz, long_url string, expires_at timestamp_ntz, status int, "
    "id bigint, short_token string, short_url string"
)
COMMIT = "highest_id bigint"


def run_batch(spark: SparkSession, root: str, batch_id: int, requests: DataFrame, base_url: str, naive_zone: str, **options) -> DataFrame:
    """Register one batch (numbered from 0) in the tables below ``root``, and return its outcomes.

    ``links`` (a registry), ``outcomes``, ``limiter`` (the log after each batch)
    and ``commits`` (the highest id) each get one folder. A batch reads what the
    one before it left and replaces its own folders, so it can be run again until
    the next one is committed, and what it writes does not grow with the registry.
    """
    if last_batch(spark, f"{root}/commits") < batch_id - 1:
        raise ValueError(f"batch {batch_id - 1} is not finished")
    log, highest = None, 0
    if batch_id:
        log = spark.read.schema(LOG).parquet(f"{root}/limiter/batch_id={batch_id - 1}")
        highest = spark.read.schema(COMMIT).parquet(f"{root}/commits/batch_id={batch_id - 1}").first()["highest_id"]
    outcomes, log = register_after(requests, log, base_url, naive_zone, highest + 1, **options)
    replace_batch(outcomes.select(*(c.split(" ")[0] for c in OUTCOMES.split(", "))), f"{root}/outcomes", batch_id, [])
    stored = spark.read.schema(OUTCOMES).parquet(f"{root}/outcomes/batch_id={batch_id}")
    append_links(spark, f"{root}/links", batch_id, registered_links(stored))
    replace_batch(log, f"{root}/limiter", batch_id, [])
    highest = stored.agg(F.max("id")).first()[0] or highest
    replace_batch(spark.range(1).select(F.lit(highest).cast("bigint").alias("highest_id")), f"{root}/commits", batch_id, [])
    return stored
