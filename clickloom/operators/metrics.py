"""Operational metrics from request logs and scraped samples.

Definitions: the increase of a counter between two samples is their
difference, or the later value after a restart; a rate at ``ts`` is the sum of
increases in ``(ts - window, ts]`` divided by the window. There is no
extrapolation to the window's edges.
"""

from __future__ import annotations

from math import inf

from pyspark.sql import Column, DataFrame, Window, functions as F

from clickloom.functions.timeutil import epoch_micros, floor_micros, from_epoch_micros
from clickloom.operators.timeseries import previous_value, tick_after
from clickloom.schemas import ROUTE_TEMPLATES

LATENCY_BUCKETS = "http_request_duration_seconds_bucket"

# Usual latency bucket bounds in seconds.
LATENCY_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0]


def route_template(path: Column) -> Column:
    """Path with its variable part replaced; other paths are unchanged."""
    result = None
    for part, template in ROUTE_TEMPLATES:
        test = F.contains(path, F.lit(part))
        result = F.when(test, F.lit(template)) if result is None else result.when(test, F.lit(template))
    return result.otherwise(path)


def with_route(log: DataFrame) -> DataFrame:
    return log.withColumn("handler", route_template(F.col("path")))


def latency_histogram(log: DataFrame, by: list[str], bounds: list[float] | None = None,
                      value: str = "latency_s") -> DataFrame:
    """Cumulative buckets: keys, ``le``, ``cum_count``, and the group's ``obs_count``, ``obs_sum``.

    One aggregation with a counter per bound; rows are then made from its few
    output rows. The sum is decimal, so it does not depend on row order.
    """
    limits = [*(bounds or LATENCY_BOUNDS), inf]
    exact = F.col(value).cast("decimal(18,6)")
    wide = log.groupBy(*by).agg(
        *[F.count_if(F.col(value) <= F.lit(float(le))).alias(f"_le{i}") for i, le in enumerate(limits)],
        F.count(value).alias("obs_count"),
        F.sum(exact).cast("double").alias("obs_sum"),
    )
    buckets = F.array(
        *[F.struct(F.lit(float(le)).alias("le"), F.col(f"_le{i}").alias("cum_count")) for i, le in enumerate(limits)]
    )
    return wide.select(*by, F.inline(buckets), "obs_count", "obs_sum")


def histogram_quantile(histogram: DataFrame, quantiles: list[float], by: list[str]) -> DataFrame:
    """Quantiles per group from cumulative buckets, linear inside a bucket.

    The lowest bucket starts at 0; a quantile in the last, open bucket gives the
    highest finite bound; a group without observations gives NULL.
    """
    merged = histogram.groupBy(*by, "le").agg(F.sum("cum_count").alias("cum"))
    order = Window.partitionBy(*by).orderBy("le")
    edges = merged.withColumns(
        {
            "low": F.coalesce(F.lag("le").over(order), F.lit(0.0)),
            "below": F.coalesce(F.lag("cum").over(order), F.lit(0)),
            "total": F.max("cum").over(Window.partitionBy(*by)),
        }
    )
    wanted = F.explode(F.array(*[F.lit(float(q)) for q in quantiles])).alias("quantile")
    rank = F.col("quantile") * F.col("total")
    inside = F.col("low") + (F.col("le") - F.col("low")) * F.try_divide(rank - F.col("below"), F.col("cum") - F.col("below"))
    value = F.when(F.col("total") == 0, F.lit(None).cast("double")).when(
        F.col("le") == F.lit(inf), F.col("low")
    ).otherwise(inside)
    return (
        edges.select("*", wanted)
        .filter(F.col("cum") >= rank)
        .groupBy(*by, "quantile")
        .agg(F.min_by(value, "le").alias("value"))
    )


def latency_quantiles(log: DataFrame, quantiles: list[float], by: list[str] | None = None,
                      bounds: list[float] | None = None) -> DataFrame:
    return histogram_quantile(latency_histogram(log, by or [], bounds), quantiles, by or [])


def series_key(labels: Column) -> Column:
    """Label map as text with sorted keys, usable as a grouping key."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels))))


def counter_increase(samples: DataFrame) -> DataFrame:
    """Add ``series`` and ``increase`` since the previous sample (0 for the first)."""
    keyed = samples.withColumn("series", series_key(F.col("labels")))
    prior = previous_value(keyed, ["metric", "series"], "ts", "value", "_prior")
    step = F.when(F.col("value") < F.col("_prior"), F.col("value")).otherwise(F.col("value") - F.col("_prior"))
    return prior.withColumn("increase", F.coalesce(step, F.lit(0.0))).drop("_prior")


def _at_ticks(rows: DataFrame, keys: list[str], sums: dict[str, Column], window_seconds: int, step_seconds: int) -> DataFrame:
    """Sums over the window before each evaluation instant, by ``keys`` and ``at``.

    Rows are summed per step first; only these sums are repeated under the
    instants whose window contains them.
    """
    if window_seconds % step_seconds:
        raise ValueError("the window must be a multiple of the step")
    times = window_seconds // step_seconds
    steps = rows.groupBy(*keys, tick_after(F.col("ts"), step_seconds).alias("at")).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
    if times == 1:
        return steps
    moved = from_epoch_micros(epoch_micros(F.col("at")) + F.col("_k").cast("bigint") * (step_seconds * 1_000_000))
    spread = steps.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumn("at", moved)
    return spread.groupBy(*keys, "at").agg(*(F.sum(n).alias(n) for n in sums))


def counter_rate(samples: DataFrame, metric: str, window_seconds: int = 60, step_seconds: int = 60) -> DataFrame:
    """Per-second rate of each series of a counter at each evaluation instant."""
    grown = counter_increase(samples.filter(F.col("metric") == metric))
    found = _at_ticks(grown, ["series"], {"increase": F.col("increase")}, window_seconds, step_seconds)
    return found.select("series", "at", (F.col("increase") / window_seconds).alias("rate"))


def hit_ratio(samples: DataFrame, metric: str = "cache_requests_total", window_seconds: int = 60,
              step_seconds: int = 60) -> DataFrame:
    """Percent of lookups that hit, at each evaluation instant; NULL without lookups."""
    grown = counter_increase(samples.filter(F.col("metric") == metric))
    hits = F.when(F.col("labels")["result"] == "hit", F.col("increase")).otherwise(0.0)
    found = _at_ticks(grown, [], {"hits": hits, "lookups": F.col("increase")}, window_seconds, step_seconds)
    return found.select("at", (F.try_divide("hits", "lookups") * 100).alias("hit_ratio_pct"))


def latency_quantiles_at(samples: DataFrame, quantiles: list[float], metric: str = LATENCY_BUCKETS, by: list[str] | None = None,
                         window_seconds: int = 60, step_seconds: int = 60) -> DataFrame:
    """Quantiles of the rates of scraped histogram buckets at each evaluation instant: ``by`` labels, ``at``, ``quantile``, ``value``.

    Each bucket series (a label ``le`` beside the others) grows on its own, with
    its own restarts. Growth is summed by bucket and step first, so what is
    repeated under the instants of a window is a row per bucket and step,
    however many series were scraped. Buckets of several series that restart
    apart may fall with rising ``le``; the largest so far counts. An instant in
    whose window nothing grew gives NULL.
    """
    by = by or []
    grown = counter_increase(samples.filter(F.col("metric") == metric))
    le = F.when(F.col("labels")["le"] == "+Inf", F.lit(inf)).otherwise(F.col("labels")["le"].try_cast("double"))
    grown = grown.select(le.alias("le"), *(F.col("labels")[k].alias(k) for k in by), "ts", "increase").filter(F.col("le").isNotNull())
    found = _at_ticks(grown, [*by, "le"], {"cum_count": F.col("increase")}, window_seconds, step_seconds)
    rising = Window.partitionBy(*by, "at").orderBy("le").rowsBetween(Window.unboundedPreceding, 0)
    return histogram_quantile(found.withColumn("cum_count", F.max("cum_count").over(rising)), quantiles, [*by, "at"])


def gauge_last(samples: DataFrame, metric: str, seconds: int) -> DataFrame:
    """Last value of each gauge series per interval (start inclusive)."""
    start = from_epoch_micros(floor_micros(epoch_micros(F.col("ts")), seconds * 1_000_000))
    return (
        samples.filter(F.col("metric") == metric)
        .groupBy(series_key(F.col("labels")).alias("series"), start.alias("interval_start"))
        .agg(F.max(F.struct("ts", "value"))["value"].alias("value"))
    )


def request_rate_by_route(log: DataFrame, seconds: int = 60) -> DataFrame:
    """Requests per second by route and tumbling window."""
    return (
        with_route(log)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "handler")
        .agg((F.count(F.lit(1)) / seconds).alias("rate"))
        .select(F.col("w.start").alias("window_start"), "handler", "rate")
    )
