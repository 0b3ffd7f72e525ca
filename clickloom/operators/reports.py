"""Totals, timelines and country counts, per link and over all links.

Totals and country counts cover all time; timelines cover the trailing horizon
from an instant (so the first day may be partial) and skip days without clicks.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions.timeutil import days_before, instant, utc_day
from clickloom.schemas import REPORT_DAYS
from clickloom.sources.tables import PARTITIONS, months_since


def _as_datetime(as_of: str | datetime | date) -> datetime:
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    elif not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    if as_of.tzinfo is not None:
        as_of = as_of.astimezone(timezone.utc).replace(tzinfo=None)
    return as_of


def in_horizon(as_of: str | datetime | date, days: int = REPORT_DAYS, backdated: bool = False) -> Column:
    """``clicked_at`` no older than ``days``, inclusive; ``backdated`` also drops later clicks."""
    recent = F.col("clicked_at") >= days_before(_as_datetime(as_of), days)
    return recent & (F.col("clicked_at") < instant(_as_datetime(as_of))) if backdated else recent


def recent_clicks(clicks: DataFrame, as_of: str | datetime | date, days: int = REPORT_DAYS,
                  backdated: bool = False) -> DataFrame:
    """Clicks in the horizon; months that lie wholly before it are never read."""
    kept = clicks.filter(in_horizon(as_of, days, backdated))
    if set(PARTITIONS) <= set(clicks.columns):
        kept = kept.filter(months_since(_as_datetime(as_of) - timedelta(days=days)))
    return kept


def total_links(links: DataFrame) -> DataFrame:
    return links.agg(F.count("id").alias("total_links"))


def total_clicks(clicks: DataFrame) -> DataFrame:
    return clicks.agg(F.count(F.lit(1)).alias("total_clicks"))


def clicks_per_link(clicks: DataFrame) -> DataFrame:
    return clicks.groupBy("short_token").agg(F.count(F.lit(1)).alias("total_clicks"))


def timeline(clicks: DataFrame, as_of: str | datetime | date, days: int = REPORT_DAYS,
             per_link: bool = False, backdated: bool = False) -> DataFrame:
    keys = ["short_token"] if per_link else []
    return (
        recent_clicks(clicks, as_of, days, backdated)
        .groupBy(*keys, utc_day(F.col("clicked_at")).alias("day"))
        .agg(F.count(F.lit(1)).alias("clicks"))
    )


def geo_distribution(clicks: DataFrame, per_link: bool = False) -> DataFrame:
    keys = ["short_token"] if per_link else []
    return clicks.groupBy(*keys, F.col("country_code").alias("country")).agg(
        F.count(F.lit(1)).alias("clicks")
    )


def click_rollup(clicks: DataFrame, as_of: str | datetime | date, days: int = REPORT_DAYS,
                 per_link: bool = True) -> DataFrame:
    """One scan of the clicks: counts by (link,) day and country.

    Every report number is a sum over this table. Partial counts are formed
    before the shuffle, so a link with a third of all clicks sends only its
    (day, country) cells.
    """
    keys = ["short_token"] if per_link else []
    return clicks.groupBy(
        *keys,
        utc_day(F.col("clicked_at")).alias("day"),
        F.col("country_code").alias("country"),
    ).agg(
        F.count(F.lit(1)).alias("clicks"),
        F.count_if(in_horizon(as_of, days)).alias("recent_clicks"),
    )


def link_report(links: DataFrame, clicks: DataFrame, as_of: str | datetime | date,
                days: int = REPORT_DAYS) -> DataFrame:
    """One flat row per link; links without clicks report zeros."""
    per_day = (
        click_rollup(clicks.withColumn("country_code", F.lit(None).cast("string")), as_of, days)
        .groupBy("short_token")
        .agg(
            F.sum("clicks").alias("total_clicks"),
            F.sum("recent_clicks").alias("recent_clicks"),
            F.count_if(F.col("recent_clicks") > 0).alias("active_days"),
        )
    )
    counts = ["total_clicks", "recent_clicks", "active_days"]
    return links.join(per_day, "short_token", "left").select(
        "short_token", "long_url", "created_at", "expires_at",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counts],
    )


def _days_and_countries(rollup: DataFrame) -> DataFrame:
    """Each rollup row twice: as clicks of its recent day and as clicks of its country.

    ``part`` is ``day`` or ``country`` and ``label`` the value. Expanding by a
    generator keeps the rows' partitioning.
    """
    day = F.struct(
        F.lit("day").alias("part"),
        F.date_format("day", "yyyy-MM-dd").alias("label"),
        F.col("recent_clicks").alias("n"),
    )
    country = F.struct(F.lit("country").alias("part"), F.col("country").alias("label"), F.col("clicks").alias("n"))
    return rollup.select("*", F.inline(F.array(day, country))).filter(
        (F.col("part") == "country") | (F.col("n") > 0)
    )


def _packed() -> list[Column]:
    """Arrays from (part, label, n) rows; sorting needs no comparator as counts are negated."""
    is_day = F.col("part") == "day"
    days = F.sort_array(F.collect_list(F.when(is_day, F.struct(F.col("label").alias("date"), F.col("n").alias("clicks")))))
    ranked = F.sort_array(F.collect_list(F.when(~is_day, F.struct((-F.col("n")).alias("less"), F.col("label")))))
    countries = F.transform(ranked, lambda c: F.struct(c["label"].alias("country"), (-c["less"]).alias("clicks")))
    return [
        F.coalesce(F.sum(F.when(~is_day, F.col("n"))), F.lit(0)).alias("total_clicks"),
        days.alias("clicks_over_time"),
        countries.alias("geo_distribution"),
    ]


def link_report_nested(links: DataFrame, clicks: DataFrame, as_of: str | datetime | date,
                       days: int = REPORT_DAYS) -> DataFrame:
    """One document per link: totals, daily array (ascending), country array (most first).

    The rollup is shuffled by link once; regrouping by day and by country, the
    packing and the join then stay within that partitioning. A link's rollup has
    at most one row per day and country, however many clicks it has.
    """
    cells = click_rollup(clicks, as_of, days).repartition("short_token")
    per_link = (
        _days_and_countries(cells)
        .groupBy("short_token", "part", "label")
        .agg(F.sum("n").alias("n"))
        .groupBy("short_token")
        .agg(*_packed())
    )
    empty_days = F.array().cast("array<struct<date:string,clicks:bigint>>")
    empty_geo = F.array().cast("array<struct<country:string,clicks:bigint>>")
    return links.join(per_link, "short_token", "left").select(
        "short_token", "long_url", "created_at", "expires_at",
        F.coalesce("total_clicks", F.lit(0)).cast("bigint").alias("total_clicks"),
        F.coalesce("clicks_over_time", empty_days).alias("clicks_over_time"),
        F.coalesce("geo_distribution", empty_geo).alias("geo_distribution"),
    )


def link_report_one(links: DataFrame, clicks: DataFrame, token: str, as_of: str | datetime | date,
                    days: int = REPORT_DAYS) -> DataFrame:
    """The document of one link; both scans filter on the token. No row if unknown."""
    chosen = F.col("short_token") == token
    return link_report_nested(links.filter(chosen), clicks.filter(chosen), as_of, days)


def report_grouping_sets(clicks: DataFrame, as_of: str | datetime | date, days: int = REPORT_DAYS) -> DataFrame:
    """Total, daily and country counts over all links as one table.

    ``part`` tells the rows apart (NULL is a country of its own). The grouping
    sets expand the small rollup, never the clicks.
    """
    rollup = click_rollup(clicks, as_of, days, per_link=False)
    grouped = rollup.sparkSession.sql(
        """
        SELECT day, country,
               CASE WHEN grouping(day) = 0 THEN 'day'
                    WHEN grouping(country) = 0 THEN 'country'
                    ELSE 'total' END AS part,
               coalesce(sum(clicks), 0) AS clicks,
               coalesce(sum(recent_clicks), 0) AS recent_clicks
        FROM {rollup}
        GROUP BY GROUPING SETS ((day), (country), ())
        """,
        rollup=rollup,
    )
    return grouped.filter((F.col("part") != "day") | (F.col("recent_clicks") > 0))


def global_report(links: DataFrame, clicks: DataFrame, as_of: str | datetime | date,
                  days: int = REPORT_DAYS) -> DataFrame:
    """One document over all links, from a single scan of the clicks."""
    cells = click_rollup(clicks, as_of, days, per_link=False)
    packed = _days_and_countries(cells).groupBy("part", "label").agg(F.sum("n").alias("n")).agg(*_packed())
    return links.sparkSession.sql(
        """
        SELECT (SELECT count(id) FROM {links}) AS total_urls,
               total_clicks, clicks_over_time, geo_distribution
        FROM {packed}
        """,
        links=links,
        packed=packed,
    )


def flatten_report(report: DataFrame) -> DataFrame:
    """Report documents with their arrays as text, for flat files."""
    days = F.array_join(
        F.transform("clicks_over_time", lambda d: F.concat_ws("=", d["date"], d["clicks"].cast("string"))), "|"
    )
    countries = F.array_join(
        F.transform(
            "geo_distribution",
            lambda c: F.concat_ws("=", F.coalesce(c["country"], F.lit("")), c["clicks"].cast("string")),
        ),
        "|",
    )
    return report.withColumns({"clicks_over_time": days, "geo_distribution": countries})


def rollup_daily(clicks: DataFrame) -> DataFrame:
    """Counts by link, day and country: the table the live report maintains."""
    return clicks.groupBy(
        "short_token", utc_day(F.col("clicked_at")).alias("day"), F.col("country_code").alias("country")
    ).agg(F.count(F.lit(1)).alias("clicks"))


def timeline_from_rollup(rollup: DataFrame, clicks: DataFrame, as_of: str | datetime | date,
                         days: int = REPORT_DAYS, per_link: bool = False) -> DataFrame:
    """Exact timeline from a daily rollup.

    The horizon starts inside a day, which the rollup cannot split, so that one
    day is counted from the clicks and all later days come from the rollup.
    """
    lower = _as_datetime(as_of) - timedelta(days=days)
    next_day = datetime(lower.year, lower.month, lower.day) + timedelta(days=1)
    keys = ["short_token"] if per_link else []
    edge = recent_clicks(clicks, as_of, days).filter(F.col("clicked_at") < instant(next_day))
    edge = edge.select(*keys, utc_day(F.col("clicked_at")).alias("day"), F.lit(1).cast("bigint").alias("clicks"))
    whole = rollup.filter(F.col("day") >= F.lit(next_day.date())).select(*keys, "day", "clicks")
    return whole.unionByName(edge).groupBy(*keys, "day").agg(F.sum("clicks").alias("clicks"))
