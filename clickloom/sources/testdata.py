"""Link, request, click and metric tables derived from the given Parquet files.

``events`` stands for traffic (a user's events hit the link ``user_id + 1``) and
``pages`` for registered links.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clickloom.functions import base62
from clickloom.functions.hashing import country_of
from clickloom.functions.timeutil import epoch_micros, instant
from clickloom.operators import metrics as M
from clickloom.operators.timeseries import running_total, tick_after

START = "2024-01-01 00:00:00"
COUNTER_RESET = "2024-01-15 00:00:00"
NAIVE_ZONE = "Asia/Kolkata"


# Columns used here; a given schema saves the job that reads one from the files.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def _ip(user: Column) -> Column:
    return (
        F.when(user % 10 == 0, F.lit("127.0.0.1"))
        .when(user % 11 == 0, F.lit(None).cast("string"))
        .otherwise(
            F.concat(
                F.lit("203."),
                F.call_function("div", user, F.lit(256)).cast("string"),
                F.lit("."),
                (user % 256).cast("string"),
                F.lit(".7"),
            )
        )
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    start = instant(START)
    return table(spark, sf_dir, "pages").select(
        (page + 1).alias("id"),
        base62.encode(page + 1).alias("short_token"),
        F.col("url").alias("long_url"),
        (start + F.make_dt_interval((page % 5).cast("int"))).alias("created_at"),
        F.when(page % 4 == 0, start + F.make_dt_interval((page % 25 + 5).cast("int"))).alias(
            "expires_at"
        ),
    )


def _visitor(user: Column, event: Column) -> Column:
    """Visitors of a user's link come from many addresses."""
    part = lambda n: n.cast("string")
    return (
        F.when((user % 10 == 0) & (event % 3 != 1), F.lit("127.0.0.1"))
        .when((user % 11 == 0) & (event % 5 == 0), F.lit(None).cast("string"))
        .otherwise(F.concat_ws(".", F.lit("203"), part(F.call_function("div", user, F.lit(256))), part(user % 256), part(event % 23)))
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    event, user = F.col("event_id"), F.col("user_id")
    target = F.when(event % 10 == 0, event + 1_000_000).otherwise(user + 1)
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"),
        base62.encode(target).alias("short_token"),
        F.col("ts").alias("requested_at"),
        _visitor(user, event).alias("ip_address"),
        F.when(event % 13 != 0, F.col("event_type")).alias("user_agent"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    ip = _visitor(user, F.col("event_id"))
    return table(spark, sf_dir, "events").select(
        (F.col("event_id") + 1).alias("id"),
        base62.encode(user + 1).alias("short_token"),
        F.col("ts").alias("clicked_at"),
        ip.alias("ip_address"),
        F.col("event_type").alias("user_agent"),
        country_of(ip).alias("country_code"),
    )


def clicks_over_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The clicks, three of four moved back by weeks, over a turn of the year."""
    moved = F.timestamp_add("DAY", -(F.col("id") % 4) * 25, F.col("clicked_at"))
    return clicks(spark, sf_dir).withColumn("clicked_at", moved)


def click_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON bodies, some of them broken in a known way by ``event_id % 50``."""
    event, user, kind = F.col("event_id"), F.col("user_id"), F.col("kind")

    def quoted(value: Column) -> Column:
        return F.concat(F.lit('"'), value, F.lit('"'))

    target = F.when(kind == 6, event + 1_000_000).otherwise(user + 1)
    based = (
        table(spark, sf_dir, "events")
        .withColumns({"kind": event % 50, "us": epoch_micros(F.col("ts"))})
        .withColumns(
            {
                "token": quoted(base62.encode(target)),
                "seconds": F.call_function("div", F.col("us"), F.lit(1_000_000)).cast("string"),
            }
        )
    )
    micros = F.lpad((F.col("us") % 1_000_000).cast("string"), 6, "0")
    epoch = (
        F.when(event % 3 == 0, F.call_function("div", F.col("us"), F.lit(1_000)).cast("string"))
        .when(event % 3 == 1, F.concat("seconds", F.lit("."), micros))
        .otherwise(F.col("seconds"))
    )
    fields = based.select(
        "event_id",
        "kind",
        F.when(kind == 4, F.lit("null")).when(kind == 5, F.lit('"overlongtoken"')).otherwise(F.col("token")).alias("token"),
        epoch.alias("epoch"),
        F.when(kind == 3, F.lit("2130706433"))
        .otherwise(F.coalesce(quoted(_visitor(user, event)), F.lit("null")))
        .alias("ip"),
        F.when(kind != 1, F.concat(F.lit(', "user_agent": '), quoted(F.col("event_type"))))
        .otherwise(F.lit(""))
        .alias("agent"),
    )
    stamp = F.when(kind == 2, quoted(F.col("epoch"))).when(kind == 9, F.lit("9e17")).otherwise(F.col("epoch"))
    whole = fields.select(
        "event_id",
        "kind",
        F.concat(
            F.lit('{"short_token": '), "token",
            F.lit(', "timestamp": '), stamp,
            F.lit(', "ip_address": '), "ip",
            "agent",
            F.lit("}"),
        ).alias("body"),
    )
    body = (
        F.when(kind == 0, F.substr("body", F.lit(1), F.length("body") - 3))
        .when(kind == 8, F.concat("body", F.lit(" x")))
        .when(kind == 10, F.concat(F.lit("["), "body", F.lit("]")))
        .otherwise(F.col("body"))
    )
    return whole.select("event_id", body.alias("body"))


def link_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registration requests: the page of the user, some with a wrong scheme."""
    event, user = F.col("event_id"), F.col("user_id")
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("user_id"), "url")
    joined = table(spark, sf_dir, "events").join(pages, "user_id")
    day = F.lpad((event % 28 + 1).cast("string"), 2, "0")
    local = F.concat(F.lit("2024-02-"), day, F.lit("T06:30:00"))
    expires = (
        F.when(event % 4 == 0, F.concat(local, F.lit("+02:00")))
        .when(event % 4 == 1, F.concat(local, F.lit("Z")))
        .when(event % 4 == 2, local)
    )
    return joined.select(
        event.alias("request_id"),
        F.when(event % 50 == 7, F.lit(""))
        .when(user % 4 == 0, F.concat(F.lit("key-"), (user % 20).cast("string")))
        .alias("api_key"),
        _ip(user).alias("ip_address"),
        F.col("ts").alias("requested_at"),
        F.when(event % 20 == 0, F.regexp_replace("url", "^https?", "ftp"))
        .otherwise(F.col("url"))
        .alias("long_url"),
        expires.alias("expires_text"),
    )


def limiter_requests(spark: SparkSession, sf_dir: str, hot: bool = False) -> DataFrame:
    """One request per event; with ``hot`` a third of all rows share one client.

    Hot rows are cut to whole hours so that many fall on one instant.
    """
    event = F.col("event_id")
    client = F.col("user_id").cast("string")
    ts = F.col("ts")
    if hot:
        is_hot = event % 3 == 0
        client = F.when(is_hot, F.lit("hot")).otherwise(client)
        ts = F.when(is_hot & (event % 2 == 0), F.date_trunc("hour", ts)).otherwise(ts).cast("timestamp_ntz")
    return table(spark, sf_dir, "events").select(
        event.alias("request_id"), client.alias("client_key"), ts.alias("requested_at")
    )


def http_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    token = base62.encode(F.col("user_id") + 1)
    path = (
        F.when(kind == "click", F.concat(F.lit("/api/v1/redirect/"), token))
        .when(kind == "purchase", F.concat(F.lit("/api/v1/analytics/"), token))
        .when(kind == "view", F.lit("/api/v1/analytics"))
        .when(kind == "signup", F.lit("/api/v1/shorten"))
        .otherwise(F.lit("/metrics"))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.when(kind == "signup", F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        path.alias("path"),
        (F.col("value") / 100).alias("latency_s"),
    )


def _scrape_counter(events: DataFrame, keys: list[str], ts: str, seconds: int) -> DataFrame:
    """Counter samples: events seen per series up to each scrape instant.

    Columns: keys, ``ts``, ``value``. Instants without new events are left out.
    """
    per_tick = (
        events.groupBy(*keys, tick_after(F.col(ts), seconds).alias("ts"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    total = running_total(per_tick, keys, "ts", "_n", "_value")
    return total.select(*keys, "ts", F.col("_value").cast("double").alias("value"))


def _scrape_gauge(events: DataFrame, keys: list[str], ts: str, value: str, seconds: int,
                 tiebreak: str) -> DataFrame:
    """Gauge samples: last value set before each scrape instant."""
    return (
        events.groupBy(*keys, tick_after(F.col(ts), seconds).alias("_tick"))
        .agg(F.max_by(value, F.struct(ts, tiebreak)).alias("value"))
        .select(*keys, F.col("_tick").alias("ts"), F.col("value").cast("double").alias("value"))
    )


def metric_samples(spark: SparkSession, sf_dir: str, scrape_seconds: int = 5) -> DataFrame:
    """Scraped samples: a hit/miss counter that restarts once, and a queue gauge."""
    events = table(spark, sf_dir, "events").select(
        "ts",
        "event_id",
        F.when(F.col("event_type").isin("click", "view"), F.lit("hit")).otherwise(F.lit("miss")).alias("result"),
        F.get_json_object("props", "$.k").cast("double").alias("depth"),
    )
    restarted = F.col("ts") >= instant(COUNTER_RESET)
    counter = _scrape_counter(
        events.withColumn("run", restarted.cast("int")), ["result", "run"], "ts", scrape_seconds
    ).select(
        F.lit("cache_requests_total").alias("metric"),
        F.create_map(F.lit("result"), F.col("result")).alias("labels"),
        "ts",
        "value",
    )
    gauge = _scrape_gauge(events, [], "ts", "depth", scrape_seconds, tiebreak="event_id").select(
        F.lit("rabbitmq_queue_depth").alias("metric"),
        F.create_map(F.lit("queue"), F.lit("link-clicks")).alias("labels"),
        "ts",
        "value",
    )
    return counter.unionByName(gauge)


def latency_samples(spark: SparkSession, sf_dir: str, scrape_seconds: int = 5) -> DataFrame:
    """Scraped latency buckets by method and route: every bucket at each instant with new requests; all restart once."""
    log = M.with_route(http_log(spark, sf_dir)).withColumns(
        {"run": (F.col("ts") >= instant(COUNTER_RESET)).cast("int"), "tick": tick_after(F.col("ts"), scrape_seconds)}
    )
    per_tick = M.latency_histogram(log, ["method", "handler", "run", "tick"])
    total = running_total(per_tick, ["method", "handler", "run", "le"], "tick", "cum_count", "total")
    bound = F.when(F.col("le") == F.lit(float("inf")), F.lit("+Inf")).otherwise(F.col("le").cast("string"))
    labels = F.create_map(F.lit("method"), F.col("method"), F.lit("handler"), F.col("handler"), F.lit("le"), bound)
    return total.select(F.lit(M.LATENCY_BUCKETS).alias("metric"), labels.alias("labels"), F.col("tick").alias("ts"), F.col("total").cast("double").alias("value"))
