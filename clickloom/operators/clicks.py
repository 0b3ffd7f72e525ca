"""Click events from JSON body to table row: parse, date, enrich, check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from clickloom.functions import clickjson as J
from clickloom.functions.hashing import country_of, is_local
from clickloom.functions.timeutil import from_epoch_micros
from clickloom.schemas import CLICKS, EPOCH_MILLIS_ABOVE, LOCAL_COUNTRY, MAX_COUNTRY_CHARS, MAX_IP_CHARS, MAX_TOKEN_CHARS
from clickloom.sources.tables import with_month

REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"
KEYS = ["short_token", "timestamp", "ip_address", "user_agent"]
FIRST_SECOND, END_SECOND = -62_135_596_800, 253_402_300_800


def epoch_seconds(epoch: Column) -> Column:
    """Seconds from a number that is milliseconds when above 1e11."""
    return F.when(epoch > EPOCH_MILLIS_ABOVE, epoch / 1000).otherwise(epoch)


def epoch_to_instant(epoch: Column) -> Column:
    return from_epoch_micros(F.round(epoch_seconds(epoch) * 1_000_000).cast("bigint"))


def parse_bodies(bodies: DataFrame) -> DataFrame:
    """Add the four event fields and ``reason``, NULL for a usable body.

    An absent key is an error; an explicit null is a value. A repeated key keeps
    its last value, for which the session must allow repeated keys.
    """
    if bodies.sparkSession.conf.get(REPEATED_KEYS) != "true":
        raise ValueError(f"set {REPEATED_KEYS} to true (session.tune does)")
    kinds = {key: f"_type_{key}" for key in KEYS}
    typed = bodies.withColumn("_v", J.parse_body(F.col("body"))).withColumns(
        {name: J.type_at(F.col("_v"), key) for key, name in kinds.items()}
    )
    read = typed.withColumns(
        {
            "_top": F.schema_of_variant("_v"),
            "epoch": F.when(J.is_numeric_type(F.col(kinds["timestamp"])), J.number_at(F.col("_v"), "timestamp")),
        }
    )

    def is_text_or_null(key: str) -> Column:
        return F.col(kinds[key]).isin("STRING", "VOID")

    absent = F.lit(False)
    for name in kinds.values():
        absent = absent | F.col(name).isNull()
    seconds = epoch_seconds(F.col("epoch"))
    reason = (
        F.when(F.col("_v").isNull(), F.lit("malformed_json"))
        .when(~F.startswith("_top", F.lit("OBJECT")), F.lit("not_an_object"))
        .when(absent, F.lit("missing_key"))
        .when(F.col("epoch").isNull(), F.lit("timestamp_not_numeric"))
        .when((seconds < FIRST_SECOND) | (seconds >= END_SECOND), F.lit("timestamp_out_of_range"))
        .when(~is_text_or_null("ip_address"), F.lit("ip_not_text"))
        .when(~is_text_or_null("short_token"), F.lit("token_not_text"))
        .when(~is_text_or_null("user_agent"), F.lit("agent_not_text"))
    )
    event = F.struct(
        *[
            F.col("epoch") if key == "timestamp" else J.text_at(F.col("_v"), key).alias(key)
            for key in KEYS
        ],
        reason.alias("reason"),
    )
    # Generator outputs are plain columns to the optimizer. Otherwise a filter on
    # ``reason`` is pushed down with the parse copied into each of its uses.
    return read.select(*bodies.columns, F.inline(F.array(event)))


def good_events(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNull()).drop("reason", "body")


def dead_letters(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reason").isNotNull()).drop(
        "short_token", "epoch", "ip_address", "user_agent", "clicked_at", "country_code"
    )


def normalize_epoch(events: DataFrame) -> DataFrame:
    return events.withColumn("clicked_at", epoch_to_instant(F.col("epoch")))


def enrich_country(clicks: DataFrame) -> DataFrame:
    return clicks.withColumn("country_code", country_of(F.col("ip_address")))


def enrich_country_from(clicks: DataFrame, addresses: DataFrame) -> DataFrame:
    """Country from an address table (``ip_address`` unique, ``country_code``) instead of the hash.

    Local addresses keep their tag; unknown ones become NULL. The address table
    is broadcast only if Spark measures it small.
    """
    known = addresses.select("ip_address", F.col("country_code").alias("_known"))
    return (
        clicks.drop("country_code").join(known, "ip_address", "left")
        .withColumn("country_code", F.when(is_local(F.col("ip_address")), F.lit(LOCAL_COUNTRY)).otherwise(F.col("_known")))
        .drop("_known")
    )


def check_constraints(clicks: DataFrame, links: DataFrame) -> DataFrame:
    """Add ``reason``: the first stored-table rule the row breaks, else NULL."""
    known = links.select("short_token", F.lit(True).alias("_known"))
    reason = (
        F.when(F.col("short_token").isNull(), F.lit("token_null"))
        .when(F.length("short_token") > MAX_TOKEN_CHARS, F.lit("token_too_long"))
        .when(F.col("clicked_at").isNull(), F.lit("clicked_at_null"))
        .when(F.length("ip_address") > MAX_IP_CHARS, F.lit("ip_too_long"))
        .when(F.length("country_code") > MAX_COUNTRY_CHARS, F.lit("country_too_long"))
        .when(F.col("_known").isNull(), F.lit("unknown_token"))
    )
    return clicks.join(known, "short_token", "left").withColumn("reason", reason).drop("_known")


def prepare(bodies: DataFrame, links: DataFrame) -> DataFrame:
    """The whole ingest step for a batch: every body once, with its row or its reason."""
    parsed = parse_bodies(bodies).withColumnRenamed("reason", "_parse")
    dated = normalize_epoch(parsed.withColumn("epoch", F.when(F.col("_parse").isNull(), F.col("epoch"))))
    checked = check_constraints(enrich_country(dated), links)
    return checked.withColumn("reason", F.coalesce("_parse", "reason")).drop("_parse", "epoch")


def loadable(prepared: DataFrame) -> DataFrame:
    return prepared.filter(F.col("reason").isNull()).select(*CLICKS.fieldNames())


def orphan_clicks(clicks: DataFrame, links: DataFrame) -> DataFrame:
    return clicks.join(links.select("short_token"), "short_token", "left_anti")


def cascade_purge(clicks: DataFrame, removed: DataFrame) -> DataFrame:
    """Clicks left after their links in ``removed`` are deleted."""
    return clicks.join(removed.select("short_token"), "short_token", "left_anti")


def partition_manifest(clicks: DataFrame) -> DataFrame:
    """Monthly partitions present: name, bounds [lower, upper) and row count."""
    months = with_month(clicks).groupBy("year", "month").agg(F.count(F.lit(1)).alias("clicks"))
    lower = F.make_date("year", "month", F.lit(1))
    return months.select(
        F.concat(
            F.lit("click_analytics_y"), F.lpad(F.col("year").cast("string"), 4, "0"),
            F.lit("m"), F.lpad(F.col("month").cast("string"), 2, "0"),
        ).alias("partition_name"),
        lower.alias("lower_bound"),
        F.add_months(lower, 1).alias("upper_bound"),
        "clicks",
    )
