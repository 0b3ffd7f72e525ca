"""The link registry: validate, number, tokenise, audit, merge."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions import base62
from clickloom.functions.timeutil import instant, offset_text_to_utc
from clickloom.schemas import LINKS, MAX_TOKEN_CHARS, REDIRECT_PATH
from clickloom.session import materialize

ROW_BITS = 33


def has_http_scheme(url: Column) -> Column:
    """Case-sensitive prefix test; nothing else about the URL is checked."""
    return F.coalesce(F.startswith(url, F.lit("http://")) | F.startswith(url, F.lit("https://")), F.lit(False))


def check_urls(requests: DataFrame) -> DataFrame:
    """Add ``reason``: ``bad_scheme`` or NULL."""
    return requests.withColumn("reason", F.when(~has_http_scheme(F.col("long_url")), F.lit("bad_scheme")))


def valid_requests(requests: DataFrame) -> DataFrame:
    return requests.filter(has_http_scheme(F.col("long_url")))


def rejected_requests(requests: DataFrame) -> DataFrame:
    return check_urls(requests).filter(F.col("reason").isNotNull())


def normalize_expiry(requests: DataFrame, naive_zone: str, text_col: str = "expires_text") -> DataFrame:
    """Replace ISO expiry text by ``expires_at`` in UTC; ``expiry_unreadable`` marks text that is none.

    Read are dates with times, with ``Z``, ``+hh:mm`` or ``+hhmm``, or without
    an offset (then local to ``naive_zone``), and dates alone.
    """
    parsed = offset_text_to_utc(F.col(text_col), naive_zone)
    requests = requests.withColumn("expiry_unreadable", F.col(text_col).isNotNull() & parsed.isNull())
    return requests.withColumn("expires_at", offset_text_to_utc(F.col(text_col), naive_zone)).drop(text_col)


def allocate_ids(rows: DataFrame, order_by: list[str], first_id: int = 1) -> DataFrame:
    """Dense ids in the given order (which must be unique), without a global window.

    Rows are range-partitioned and sorted, each takes its place within its
    partition, and the written result is numbered by adding the sizes of the
    earlier partitions: a table with one row per partition.
    """
    placed = materialize(
        rows.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumns(
            {
                "_part": F.spark_partition_id(),
                "_row": F.monotonically_increasing_id().bitwiseAND(F.lit(2**ROW_BITS - 1)),
            }
        ),
        "ids",
    )
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    # At most one row per shuffle partition.
    return (
        placed.join(F.broadcast(offsets), "_part")
        .withColumn("id", F.col("_offset") + F.col("_row") + first_id)
        .drop("_part", "_row", "_offset")
    )


def with_tokens(rows: DataFrame, base_url: str, id_col: str = "id") -> DataFrame:
    """Add ``short_token``, ``short_url`` and ``reason`` (negative id, or token too long to store)."""
    token = base62.encode(F.col(id_col))
    return rows.withColumn("short_token", token).withColumns(
        {
            "short_url": F.concat(F.lit(base_url + REDIRECT_PATH), F.col("short_token")),
            "reason": F.when(F.col(id_col) < 0, F.lit("negative_id")).when(
                F.length("short_token") > MAX_TOKEN_CHARS, F.lit("token_too_long")
            ),
        }
    )


def audit_tokens(rows: DataFrame, token_col: str = "short_token", id_col: str = "id") -> DataFrame:
    """Decode a token column and compare it with the stored id."""
    token = F.col(token_col)
    return rows.withColumns({"is_valid": base62.is_valid(token), "decoded_id": base62.decode(token)}).withColumns(
        {
            "is_canonical": F.coalesce(base62.encode(F.col("decoded_id")) == token, F.lit(False)),
            "matches_id": F.coalesce(F.col("decoded_id") == F.col(id_col), F.lit(False)),
            "reason": F.when(~F.col("is_valid"), F.lit("foreign_character")).when(
                F.col("decoded_id").isNull(), F.lit("overflow")
            ),
        }
    )


def is_expired(expires_at: Column, at: Column) -> Column:
    """Strictly past its expiry; links without one never expire."""
    return F.coalesce(expires_at < at, F.lit(False))


def link_status(links: DataFrame, as_of: str | datetime | date) -> DataFrame:
    expired = is_expired(F.col("expires_at"), instant(as_of))
    return links.withColumn("status", F.when(expired, F.lit("Expired")).otherwise(F.lit("Active")))


def link_status_counts(links: DataFrame, as_of: str | datetime | date) -> DataFrame:
    return link_status(links, as_of).groupBy("status").agg(F.count(F.lit(1)).alias("links"))


def bad_token(token: Column) -> Column:
    """Why a token cannot be stored, or NULL: the registry's rules on ``short_token``."""
    return F.when(token.isNull(), F.lit("missing_token")).when(F.char_length(token) > MAX_TOKEN_CHARS, F.lit("token_too_long"))


def rejected_links(incoming: DataFrame) -> DataFrame:
    """Incoming rows that the registry's rules refuse, with the ``reason``."""
    return incoming.withColumn("reason", bad_token(F.col("short_token"))).filter(F.col("reason").isNotNull())


def new_links(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming rows that may be stored and whose token is not; of equal tokens the lowest id wins.

    The lowest id is found by a hash aggregate, before the shuffle, so repeats of
    one token shrink to a row per task. Equal rows are one link.
    """
    fresh = incoming.filter(bad_token(F.col("short_token")).isNull()).select(*LINKS.fieldNames())
    least = fresh.groupBy(F.col("short_token").alias("_token")).agg(F.min("id").alias("_id"))
    least = least.join(existing.select("short_token"), F.col("_token") == F.col("short_token"), "left_anti")
    winner = fresh.join(least, (F.col("short_token") == F.col("_token")) & (F.col("id") == F.col("_id"))).drop("_token", "_id")
    return winner.distinct()


def merge_links(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.select(*LINKS.fieldNames()).unionByName(new_links(existing, incoming))


def recent_links(links: DataFrame, n: int = 10) -> DataFrame:
    return links.orderBy(F.desc("created_at"), F.desc("id")).limit(n)
