"""Chart numbers derived from report rows: shares, top slices, axis bounds, ticks.

Inputs are already aggregated: one row per country or per day (and link), so a
window over the whole input sees at most that many rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.window import WindowSpec

TOP_SLICES = 6
GRID_LINES = 4
MIN_BOUND = 5
MAX_TICKS = 6


def _over(by: list[str]) -> WindowSpec:
    return Window.partitionBy(*by)


def geo_share(geo: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Whole percent of each country among rows with clicks; halves round up."""
    total = F.sum("clicks").over(_over(by or []))
    return geo.filter(F.col("clicks") > 0).withColumn(
        "share_pct", F.round(F.col("clicks") / total * 100, 0).cast("bigint")
    )


def top_slices(geo: DataFrame, by: list[str] | None = None, n: int = TOP_SLICES) -> DataFrame:
    """The ``n`` largest countries with their share of all rows."""
    shared = geo_share(geo, by)
    if not by:
        return shared.orderBy(F.desc("clicks"), F.asc("country")).limit(n)
    ranked = _over(by).orderBy(F.desc("clicks"), F.asc("country"))
    return shared.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= n).drop("rank")


def _bound(peak: Column) -> Column:
    return (F.ceil(F.greatest(peak, F.lit(MIN_BOUND)) / MIN_BOUND) * MIN_BOUND).cast("bigint")


def timeline_bounds(timeline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Upper axis bound and the value of each grid line."""
    peak = F.coalesce(F.max("clicks"), F.lit(0))
    bounds = timeline.groupBy(*(by or [])).agg(_bound(peak).alias("bound"))
    line = F.explode(F.sequence(F.lit(0), F.lit(GRID_LINES))).alias("line")
    return bounds.select("*", line).withColumn(
        "grid_value", F.round(F.col("bound") / GRID_LINES * F.col("line"), 0).cast("bigint")
    )


def timeline_chart(timeline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Each day with its label, position in the unit square and whether it is a tick."""
    keys = by or []
    everything = _over(keys)
    n = F.count(F.lit(1)).over(everything)
    index = F.row_number().over(_over(keys).orderBy("day")) - 1
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.least(F.col("n"), F.lit(MAX_TICKS))))
    return (
        timeline.withColumns(
            {
                "n": n,
                "idx": index.cast("bigint"),
                "bound": _bound(F.max("clicks").over(everything)),
            }
        )
        .withColumns(
            {
                "label": F.date_format("day", "MM/dd"),
                "x": F.col("idx") / F.greatest(F.lit(1), F.col("n") - 1),
                "y": F.col("clicks") / F.col("bound"),
                "is_tick": F.col("idx") % step == 0,
            }
        )
        .drop("n")
    )


def timeline_ticks(timeline: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Days that carry an axis label."""
    return timeline_chart(timeline, by).filter("is_tick").select(*(by or []), "idx", "day", "label")
