"""Ordered steps over long series, split by time so no series is one task.

A running total or a previous value needs order within a series. Rows are
windowed per (series, chunk of time); one edge row per chunk carries the state
across. The per-series window then sees only edge rows, whose number depends on
the time span and not on the number of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.timeutil import epoch_micros, floor_micros, from_epoch_micros

CHUNK_SECONDS = 86_400


def tick_after(ts: Column, seconds: int) -> Column:
    """First scrape instant at or after ``ts``."""
    step = seconds * 1_000_000
    return from_epoch_micros(floor_micros(epoch_micros(ts) + (step - 1), step))


def _chunk(ts: str, seconds: int) -> Column:
    return floor_micros(epoch_micros(F.col(ts)), seconds * 1_000_000)


def _attach(df: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Edge rows beside the rows of their series and chunk; NULL keys match each other."""
    named = edges.select(*(F.col(k).alias(f"_edge_{k}") for k in [*keys, "_chunk"]), "_before")
    same = [F.col(k).eqNullSafe(F.col(f"_edge_{k}")) for k in [*keys, "_chunk"]]
    return df.join(named, same).drop(*(f"_edge_{k}" for k in [*keys, "_chunk"]))


def running_total(df: DataFrame, keys: list[str], ts: str, value: str, out: str,
                  chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Cumulative sum of ``value`` per series in time order (one row per instant)."""
    cut = df.withColumn("_chunk", _chunk(ts, chunk_seconds))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    edges = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.sum(value).alias("_total"))
        .withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0)))
        .drop("_total")
    )
    within = (
        Window.partitionBy(*keys, "_chunk").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    )
    inner = cut.withColumn("_inner", F.sum(value).over(within))
    return (
        _attach(inner, edges, keys)
        .withColumn(out, F.col("_inner") + F.col("_before"))
        .drop("_chunk", "_inner", "_before")
    )


def previous_value(df: DataFrame, keys: list[str], ts: str, value: str, out: str,
                   chunk_seconds: int = CHUNK_SECONDS) -> DataFrame:
    """Value of the preceding sample of the series, NULL for its first sample.

    Samples of one instant follow each other by value, so that the result does
    not depend on the order of rows.
    """
    cut = df.withColumn("_chunk", _chunk(ts, chunk_seconds))
    edges = (
        cut.groupBy(*keys, "_chunk")
        .agg(F.max(F.struct(ts, value))[value].alias("_last"))
        .withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("_chunk")))
        .drop("_last")
    )
    within = Window.partitionBy(*keys, "_chunk").orderBy(ts, value)
    inner = cut.withColumns(
        {"_inner": F.lag(value).over(within), "_row": F.row_number().over(within)}
    )
    return (
        _attach(inner, edges, keys)
        .withColumn(out, F.when(F.col("_row") == 1, F.col("_before")).otherwise(F.col("_inner")))
        .drop("_chunk", "_inner", "_row", "_before")
    )
