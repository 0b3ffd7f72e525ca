"""Resolve requests against the registry and emit clicks for the redirected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from clickloom.functions.timeutil import epoch_micros
from clickloom.operators.links import is_expired

FOUND, MISSING, GONE = 302, 404, 410


def resolve(requests: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``status`` (302, 404, 410) and ``long_url`` (for 302).

    Tokens are unique in ``links``, so the join never multiplies rows. No side
    is forced to broadcast: adaptive execution does so for a registry that is
    measured small, and otherwise splits the partition of a hot token.
    """
    target = links.select("short_token", F.col("long_url").alias("_url"), "expires_at", F.lit(True).alias("_known"))
    status = (
        F.when(F.col("_known").isNull(), MISSING)
        .when(is_expired(F.col("expires_at"), F.col("requested_at")), GONE)
        .otherwise(FOUND)
    )
    return (
        requests.join(target, "short_token", "left")
        .withColumn("status", status)
        .withColumn("long_url", F.when(F.col("status") == FOUND, F.col("_url")))
        .drop("_url", "expires_at", "_known")
    )


def resolve_known(probed: DataFrame, links: DataFrame) -> DataFrame:
    """``resolve`` for requests with a filter's answer ``maybe``: what was certainly never registered is 404 without a lookup."""
    certain = probed.filter(~F.col("maybe")).withColumns({"status": F.lit(MISSING), "long_url": F.lit(None).cast("string")})
    return resolve(probed.filter("maybe"), links).unionByName(certain).drop("maybe")


def status_counts(resolved: DataFrame) -> DataFrame:
    return resolved.groupBy("status").agg(F.count(F.lit(1)).alias("requests"))


def emit_clicks(resolved: DataFrame) -> DataFrame:
    """One JSON body per redirected request, with defaults for absent headers."""
    event = F.struct(
        F.col("short_token"),
        F.call_function("div", epoch_micros(F.col("requested_at")), F.lit(1_000_000)).alias("timestamp"),
        F.coalesce("ip_address", F.lit("0.0.0.0")).alias("ip_address"),
        F.coalesce("user_agent", F.lit("unknown")).alias("user_agent"),
    )
    return resolved.filter(F.col("status") == FOUND).select("request_id", F.to_json(event).alias("body"))
