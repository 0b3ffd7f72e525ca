"""Parquet tables: the link registry and the monthly click table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from clickloom.schemas import CLICKS, LINKS

PARTITIONS = ["year", "month"]


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LINKS).parquet(path)


def write_links(links: DataFrame, path: str, mode: str = "append") -> None:
    """Rows are clustered by token so that row-group statistics serve point reads."""
    (
        links.select(*LINKS.fieldNames())
        .repartitionByRange("short_token")
        .sortWithinPartitions("short_token")
        .write.mode(mode)
        .parquet(path)
    )


def read_clicks(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType(
        [
            *CLICKS.fields,
            T.StructField("year", T.IntegerType(), True),
            T.StructField("month", T.IntegerType(), True),
        ]
    )
    return spark.read.schema(schema).parquet(path)


def with_month(clicks: DataFrame) -> DataFrame:
    return clicks.withColumns({"year": F.year("clicked_at"), "month": F.month("clicked_at")})


def write_clicks(clicks: DataFrame, path: str, mode: str = "append") -> None:
    """Append into ``year=/month=`` folders, sorted by token within files.

    Rows are rebalanced by month first, so that a month gets few files of a
    sensible size, and a large month several.
    """
    (
        with_month(clicks.select(*CLICKS.fieldNames()))
        .hint("rebalance", "year", "month")
        .sortWithinPartitions("year", "month", "short_token", "clicked_at")
        .write.mode(mode)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def months_since(lower: datetime) -> Column:
    """Predicate on the partition columns alone, so whole folders are skipped."""
    year, month = F.col("year"), F.col("month")
    return (year > lower.year) | ((year == lower.year) & (month >= lower.month))
