"""The stored link registry: a log of batches in buckets by token.

A batch appends only the links it adds. To know which tokens are new it reads
the buckets that its own tokens fall into, and no others; files are sorted by
token and carry Parquet's filters on it, so point reads skip most of them.
Compaction gathers finished batches into larger files, again without touching
what is gathered already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clickloom.operators.links import new_links
from clickloom.schemas import LINKS
from clickloom.sources.batches import BATCH, read_batches, replace_batch, ungathered

#: Buckets by token. A table keeps the number that it was begun with.
BUCKETS = 64
STORED = T.StructType([*LINKS.fields, T.StructField("bucket", T.IntegerType(), True), BATCH])
FILTERS = {"parquet.bloom.filter.enabled#short_token": "true"}


def bucket_of(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _write(links: DataFrame, path: str, batch_id: int) -> None:
    """Sorted within buckets; adaptive execution makes few files of a small batch and several of a large bucket."""
    rows = links.hint("rebalance", "bucket").sortWithinPartitions("bucket", "short_token")
    replace_batch(rows, path, batch_id, ["bucket"], FILTERS)


def read_registry(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """All links, those of one token first by id; with ``before``, as they were before that batch."""
    return read_batches(spark, path, STORED, before)


def read_link(spark: SparkSession, path: str, token: str, buckets: int = BUCKETS) -> DataFrame:
    """The link of one token, read from its bucket alone."""
    bucket = spark.range(1).select(bucket_of(F.lit(token), buckets)).first()[0]
    return read_registry(spark, path).filter((F.col("bucket") == bucket) & (F.col("short_token") == token)).select(*LINKS.fieldNames())


def append_links(spark: SparkSession, path: str, batch_id: int, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Add the incoming links whose tokens are new, as batch ``batch_id``; a repeated run replaces it."""
    token = F.when(F.col("short_token").isNotNull(), bucket_of(F.col("short_token"), buckets))
    hit = incoming.agg(F.collect_set(token)).first()[0]  # at most ``buckets`` numbers
    known = read_registry(spark, path, batch_id).filter(F.col("bucket").isin(hit))
    fresh = new_links(known.select("short_token"), incoming)
    _write(fresh.withColumn("bucket", bucket_of(F.col("short_token"), buckets)), path, batch_id)


def compact_registry(spark: SparkSession, path: str, upto: int) -> None:
    """Gather the batches up to ``upto``, which must not be run again."""
    fresh = ungathered(spark, path, STORED, upto)
    if fresh is not None:
        _write(fresh.drop("batch_id"), f"{path}_gathered", upto)
