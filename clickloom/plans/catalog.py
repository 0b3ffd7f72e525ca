"""Every operator as a query over the given tables."""

from __future__ import annotations

import math
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F

from clickloom.operators import bloom, charts, clicks as C, limiter, links as L, metrics as M, reports as R
from clickloom.operators import registration, resolve as V
from clickloom.session import materialize, scratch_path
from clickloom.sources import filters, queue, registry as stored, tables, testdata as D, versions
from clickloom.streaming import backlog, ingest, limiter as stream_limiter, redirect, rollup

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-20 12:00:00"
DAYS = 7
BASE_URL = "http://localhost:8000/"
ONE_TOKEN = "f"
SPARSE_LIMIT, SPARSE_WINDOW = 5, 3 * 86_400
HOT_LIMIT, HOT_WINDOW = 10, 6 * 3_600
HOT_CHUNK = 100
INGEST_FILES = 3
STREAM_FILES = 4
#: Rows of a file that a stream takes, about: batches keep their number, and their files grow with the input.
FILE_ROWS = 250_000
SMALL_BLOOM = 4_000
FIRST_LAYER, FILTER_RATE = 20, 0.02
QUANTILES = [0.95, 0.99]
GAUGE_SECONDS = 3_600
REDELIVERY_SECONDS = 86_400
DEPTH_EVENTS = 300


def _text_days(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


def _month_removed(links: DataFrame) -> DataFrame:
    return links.filter(F.col("expires_at") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz"))


# -- sources, sinks, ingest --------------------------------------------------------------


def src_click_json(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "bodies")
    queue.write_bodies(D.click_payloads(spark, sf), path)
    return queue.read_bodies(spark, path)


def click_parse_good(spark: SparkSession, sf: str) -> DataFrame:
    return C.good_events(C.parse_bodies(D.click_payloads(spark, sf)))


def click_dead_letter(spark: SparkSession, sf: str) -> DataFrame:
    return C.dead_letters(C.parse_bodies(D.click_payloads(spark, sf)))


def click_epoch_normalized(spark: SparkSession, sf: str) -> DataFrame:
    return C.normalize_epoch(click_parse_good(spark, sf)).select("event_id", "clicked_at")


def click_country_enriched(spark: SparkSession, sf: str) -> DataFrame:
    return C.enrich_country(click_parse_good(spark, sf)).select("event_id", "ip_address", "country_code")


def click_country_dimension(spark: SparkSession, sf: str) -> DataFrame:
    clicks = D.clicks(spark, sf)
    addresses = clicks.filter(F.col("id") % 2 == 0).groupBy("ip_address").agg(
        F.max("country_code").alias("country_code")
    )
    return C.enrich_country_from(clicks, addresses).select("id", "ip_address", "country_code")


def click_constraint_violations(spark: SparkSession, sf: str) -> DataFrame:
    events = C.enrich_country(C.normalize_epoch(click_parse_good(spark, sf)))
    checked = C.check_constraints(events, D.links(spark, sf))
    return checked.filter(F.col("reason").isNotNull()).select("event_id", "short_token", "reason")


def _files(rows: DataFrame, batches: int) -> int:
    """How many files each of so many equal batches of the rows gets."""
    return max(1, math.ceil(rows.count() / (batches * FILE_ROWS)))


def _run_ingest(spark: SparkSession, sf: str) -> str:
    bodies, out = scratch_path(spark, "bodies"), scratch_path(spark, "ingest")
    payloads = D.click_payloads(spark, sf)
    files = _files(payloads, INGEST_FILES)
    queue.write_bodies(payloads.repartition(INGEST_FILES * files), bodies)
    links = D.links(spark, sf)
    query = ingest.start_ingest(
        queue.stream_bodies(spark, bodies, max_files=files), lambda: links, out, f"{out}/checkpoint", available_now=True
    )
    query.awaitTermination()
    return out


def ingest_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.read_ingested(spark, _run_ingest(spark, sf)).drop("batch_id")


def clicks_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """The ingested clicks after all but the last batch were gathered."""
    out = _run_ingest(spark, sf)
    ingest.compact(spark, out, INGEST_FILES - 2)
    return ingest.read_ingested(spark, out).drop("batch_id")


def ingest_dead_letters(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.read_dead_letters(spark, _run_ingest(spark, sf)).drop("batch_id")


def queue_depth(spark: SparkSession, sf: str) -> DataFrame:
    """The queue's depth after each batch of a run that takes one file at a time, oldest first."""
    bodies, out, links = scratch_path(spark, "bodies"), scratch_path(spark, "ingest"), D.links(spark, sf)
    payloads = D.click_payloads(spark, sf)
    for part in range(INGEST_FILES):
        queue.write_bodies(payloads.filter(F.least(F.call_function("div", F.col("event_id"), F.lit(DEPTH_EVENTS)), F.lit(INGEST_FILES - 1)) == part).coalesce(1), bodies)
    stream = queue.stream_bodies(spark, bodies, max_files=1)
    ingest.start_ingest(stream, lambda: links, out, f"{out}/checkpoint", available_now=True, queue=bodies).awaitTermination()
    return backlog.read_samples(spark, f"{out}/samples").select("batch_id", "metric", M.series_key(F.col("labels")).alias("series"), "value")


def partition_manifest(spark: SparkSession, sf: str) -> DataFrame:
    manifest = C.partition_manifest(D.clicks_over_months(spark, sf))
    return manifest.withColumns(
        {c: F.date_format(c, "yyyy-MM-dd") for c in ("lower_bound", "upper_bound")}
    )


def clicks_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "clicks")
    tables.write_clicks(D.clicks_over_months(spark, sf), path)
    return tables.read_clicks(spark, path)


def _stored(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Links and clicks as written tables."""
    links, clicks = scratch_path(spark, "links"), scratch_path(spark, "clicks")
    tables.write_links(D.links(spark, sf), links)
    tables.write_clicks(D.clicks(spark, sf), clicks)
    return tables.read_links(spark, links), tables.read_clicks(spark, clicks)


def link_report_stored(spark: SparkSession, sf: str) -> DataFrame:
    """One link's document from the written tables; the token reaches both scans."""
    return R.flatten_report(R.link_report_one(*_stored(spark, sf), ONE_TOKEN, AS_OF, DAYS))


def timeline_stored_7d(spark: SparkSession, sf: str) -> DataFrame:
    """The last days from the written clicks; older months' folders are not opened."""
    recent = _stored(spark, sf)[1].filter(tables.months_since(datetime.fromisoformat(AS_OF) - timedelta(days=DAYS)))
    return _text_days(R.timeline(recent, AS_OF, DAYS)).orderBy("day")


def links_table(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "links")
    tables.write_links(D.links(spark, sf), path)
    return tables.read_links(spark, path)


def emit_clicks(spark: SparkSession, sf: str) -> DataFrame:
    return V.emit_clicks(V.resolve(D.requests(spark, sf), D.links(spark, sf)))


def _run_redirects(spark: SparkSession, sf: str) -> tuple[str, DataFrame]:
    """Requests answered as a stream, behind a stored filter and the bucketed registry."""
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "redirects")
    requests = D.requests(spark, sf)
    files = _files(requests, INGEST_FILES)
    requests.repartition(INGEST_FILES * files).write.parquet(source)
    links = D.links(spark, sf)
    stored.append_links(spark, f"{out}/links", 0, links)
    filters.add_tokens(spark, f"{out}/filter", 0, links, links.count())
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(source)
    registered = lambda: stored.read_registry(spark, f"{out}/links").drop("batch_id")
    known = lambda: filters.read_filter(spark, f"{out}/filter")
    redirect.start_redirects(stream, registered, out, f"{out}/checkpoint", known, available_now=True).awaitTermination()
    return out, stream


def resolve_stream(spark: SparkSession, sf: str) -> DataFrame:
    out, stream = _run_redirects(spark, sf)
    return redirect.read_answers(spark, out, redirect.answers_schema(stream)).select("request_id", "short_token", "status", "long_url")


def emit_clicks_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The bodies that answered requests put into the queue, taken from there by a second stream."""
    out, _ = _run_redirects(spark, sf)
    files = len(queue.read_bodies(spark, f"{out}/bodies/*").inputFiles())
    bodies = queue.stream_bodies(spark, f"{out}/bodies/*", max_files=max(2, math.ceil(files / 2)))
    writer = bodies.writeStream.format("parquet").option("path", f"{out}/taken").option("checkpointLocation", f"{out}/taken-checkpoint")
    queue.ingest_trigger(writer, available_now=True).start().awaitTermination()
    return spark.read.schema("body string").parquet(f"{out}/taken")


def bodies_once(spark: SparkSession, sf: str) -> DataFrame:
    """Bodies that the queue delivers twice, in several batches, taken once."""
    path, out = scratch_path(spark, "bodies"), scratch_path(spark, "once")
    payloads = D.click_payloads(spark, sf)
    files = _files(payloads, INGEST_FILES)
    for _ in range(2):
        queue.write_bodies(payloads.repartition(INGEST_FILES * files), path)
    once = queue.without_redeliveries(queue.stream_bodies(spark, path, max_files=(INGEST_FILES - 1) * files), REDELIVERY_SECONDS)
    writer = once.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
    queue.ingest_trigger(writer, available_now=True).start().awaitTermination()
    return spark.read.schema("body string").parquet(f"{out}/table")


def clicks_purged(spark: SparkSession, sf: str) -> DataFrame:
    """A stored table over several months, after two purges of which one was run twice."""
    path, links = scratch_path(spark, "clicks"), D.links(spark, sf)
    versions.create(D.clicks_over_months(spark, sf), path)
    removed = _month_removed(links)
    for version, odd in ((1, 0), (1, 0), (2, 1)):
        versions.purge(spark, path, version, removed.filter(F.col("id") % 2 == odd))
    return versions.read_version(spark, path).drop("generation")


# -- links -------------------------------------------------------------------------------


def links_tokenized(spark: SparkSession, sf: str) -> DataFrame:
    pages = D.table(spark, sf, "pages").select("page_id", F.col("url").alias("long_url"))
    numbered = L.allocate_ids(pages, ["long_url", "page_id"])
    return L.with_tokens(numbered, BASE_URL).select("page_id", "id", "short_token", "short_url")


def token_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of requests next to the id they should have, every seventh one damaged."""
    n = F.col("event_id")
    damaged = (
        F.when(n % 7 == 0, F.concat(F.col("short_token"), F.lit("-")))
        .when(n % 7 == 1, F.concat(F.lit("a"), F.col("short_token")))
        .when(n % 7 == 2, F.lit("99999999999"))
        .otherwise(F.col("short_token"))
    )
    issued = L.with_tokens(
        D.table(spark, sf, "events").select("event_id", (n * 1_000_003 + F.col("user_id")).alias("id")), BASE_URL
    )
    return L.audit_tokens(issued.select("event_id", "id", damaged.alias("short_token")))


def link_requests_clean(spark: SparkSession, sf: str) -> DataFrame:
    clean = L.normalize_expiry(D.link_requests(spark, sf), D.NAIVE_ZONE)
    key = limiter.client_key(F.col("api_key"), F.col("ip_address"))
    return clean.select("request_id", key.alias("client_key"), "long_url", "expires_at")


def link_requests_valid(spark: SparkSession, sf: str) -> DataFrame:
    return L.valid_requests(D.link_requests(spark, sf)).select("request_id", "long_url")


def link_requests_rejected(spark: SparkSession, sf: str) -> DataFrame:
    return L.rejected_requests(D.link_requests(spark, sf)).select("request_id", "long_url", "reason")


def links_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Half of the links are stored; requested tokens arrive as new links, many times each."""
    links = D.links(spark, sf)
    incoming = D.requests(spark, sf).select(
        F.col("request_id").alias("id"),
        "short_token",
        F.concat(F.lit("https://new.example/"), F.col("short_token")).alias("long_url"),
        F.col("requested_at").alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("expires_at"),
    )
    request = F.col("id")
    bad = F.when(request % 17 == 0, F.lit(None).cast("string")).when(request % 19 == 0, F.lit("tokentoolong"))
    incoming = incoming.withColumn("short_token", F.when((request % 17 == 0) | (request % 19 == 0), bad).otherwise(F.col("short_token")))
    return L.merge_links(links.filter(F.col("id") % 2 == 0), incoming)


def recent_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.recent_links(D.links(spark, sf))


# -- limiter, registration ---------------------------------------------------------------


def rate_limit_decisions(spark: SparkSession, sf: str) -> DataFrame:
    decided = limiter.rate_limit(D.limiter_requests(spark, sf), SPARSE_LIMIT, SPARSE_WINDOW)
    return decided.select("request_id", "client_key", "allowed")


def rate_limit_by_client(spark: SparkSession, sf: str) -> DataFrame:
    return limiter.limit_by_client(rate_limit_decisions(spark, sf))


def rate_limit_hot_client(spark: SparkSession, sf: str) -> DataFrame:
    """A third of all requests from one client, which is split by time."""
    requests = D.limiter_requests(spark, sf, hot=True)
    decided = limiter.rate_limit(requests, HOT_LIMIT, HOT_WINDOW, chunk_rows=HOT_CHUNK)
    return decided.select("request_id", "client_key", "allowed")


def rate_limit_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The limiter on a stream that brings the requests in three batches, in order of time."""
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "decided")
    requests = D.limiter_requests(spark, sf)
    cuts = ["2024-01-10 00:00:00", "2024-01-20 00:00:00"]
    at, parts = F.col("requested_at"), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        some = requests if low is None else requests.filter(at >= F.lit(low).cast("timestamp_ntz"))
        parts.append(some if high is None else some.filter(at < F.lit(high).cast("timestamp_ntz")))
    # A batch takes the files of one part, so all parts have equally many, and the smallest enough rows for each.
    files = max(STREAM_FILES, min(_files(some, 1) for some in parts))
    for some in parts:
        some.repartition(files).write.mode("append").parquet(source)
    stream = spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", files).parquet(source)
    decided = stream_limiter.stream_rate_limit(stream, SPARSE_LIMIT, SPARSE_WINDOW)
    stream_limiter.start_rate_limit(decided, f"{out}/table", f"{out}/checkpoint", available_now=True).awaitTermination()
    return spark.read.schema(decided.schema).parquet(f"{out}/table").select("request_id", "client_key", "allowed")


def rate_limit_repeats(spark: SparkSession, sf: str) -> DataFrame:
    """Requests delivered twice and requests without a time, in chunks of few instants."""
    requests = D.limiter_requests(spark, sf, hot=True)
    event = F.col("request_id")
    twice = requests.union(requests.filter(event % 7 == 0))
    timeless = F.when(event % 11 != 0, F.col("requested_at"))
    decided = limiter.rate_limit(twice.withColumn("requested_at", timeless), HOT_LIMIT, HOT_WINDOW, chunk_rows=HOT_CHUNK)
    return decided.groupBy("request_id", "client_key", "allowed").agg(F.count("*").alias("requests"))


def registration_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    done = registration.register(
        D.link_requests(spark, sf), BASE_URL, D.NAIVE_ZONE, limit=SPARSE_LIMIT, window_seconds=SPARSE_WINDOW
    )
    return done.select("request_id", "client_key", "status", "id", "short_token", "short_url", "expires_at")


def _two_batches(spark: SparkSession, sf: str) -> list[DataFrame]:
    """Registration requests in two batches, the second with some unreadable expiries."""
    requests = D.link_requests(spark, sf)
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    late = requests.filter(F.col("requested_at") >= cut)
    late = late.withColumn("expires_text", F.when(F.col("request_id") % 9 == 0, F.lit("soon")).otherwise(F.col("expires_text")))
    return [requests.filter(F.col("requested_at") < cut), late]


def registration_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The registry after two batches in a row, under one limiter."""
    registry, log = D.links(spark, sf), None
    for batch in _two_batches(spark, sf):
        _, registry, log = registration.register_batch(
            registry, batch, BASE_URL, D.NAIVE_ZONE, log, limit=SPARSE_LIMIT, window_seconds=SPARSE_WINDOW)
        registry, log = materialize(registry, "registry"), materialize(log, "limiter-log")
    return registry


def registration_stored(spark: SparkSession, sf: str) -> DataFrame:
    """The stored registry after two batches that only add to it, the first of them gathered."""
    root = scratch_path(spark, "registration")
    for batch_id, batch in enumerate(_two_batches(spark, sf)):
        registration.run_batch(spark, root, batch_id, batch, BASE_URL, D.NAIVE_ZONE, limit=SPARSE_LIMIT, window_seconds=SPARSE_WINDOW)
    stored.compact_registry(spark, f"{root}/links", 0)
    return stored.read_registry(spark, f"{root}/links").select("id", "short_token", "long_url", "created_at", "expires_at")


# -- metrics -----------------------------------------------------------------------------


def latency_histogram(spark: SparkSession, sf: str) -> DataFrame:
    hist = M.latency_histogram(M.with_route(D.http_log(spark, sf)), ["method", "handler"])
    return hist.withColumn("obs_sum", F.round("obs_sum", 4))


def latency_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = M.latency_quantiles(D.http_log(spark, sf), QUANTILES)
    return found.withColumn("value", F.round("value", 6))


def latency_quantiles_by_route(spark: SparkSession, sf: str) -> DataFrame:
    found = M.latency_quantiles(M.with_route(D.http_log(spark, sf)), QUANTILES, ["handler"])
    return found.withColumn("value", F.round("value", 6))


def latency_quantiles_1m(spark: SparkSession, sf: str) -> DataFrame:
    """Quantiles at every minute, from the growth of all bucket series within it."""
    found = M.latency_quantiles_at(D.latency_samples(spark, sf), QUANTILES)
    return found.withColumn("value", F.round("value", 6))


def latency_quantiles_sliding(spark: SparkSession, sf: str) -> DataFrame:
    found = M.latency_quantiles_at(D.latency_samples(spark, sf), QUANTILES, by=["handler"], window_seconds=3_600, step_seconds=900)
    return found.withColumn("value", F.round("value", 6))


def counter_rate(spark: SparkSession, sf: str) -> DataFrame:
    found = M.counter_rate(D.metric_samples(spark, sf), "cache_requests_total")
    return found.withColumn("rate", F.round("rate", 6))


def counter_rate_sliding(spark: SparkSession, sf: str) -> DataFrame:
    found = M.counter_rate(D.metric_samples(spark, sf), "cache_requests_total", 3_600, 900)
    return found.withColumn("rate", F.round("rate", 6))


def hit_ratio(spark: SparkSession, sf: str) -> DataFrame:
    found = M.hit_ratio(D.metric_samples(spark, sf), window_seconds=3_600, step_seconds=3_600)
    return found.withColumn("hit_ratio_pct", F.round("hit_ratio_pct", 6))


def request_rate_by_route(spark: SparkSession, sf: str) -> DataFrame:
    found = M.request_rate_by_route(D.http_log(spark, sf))
    return found.withColumn("rate", F.round("rate", 6))


def metric_samples(spark: SparkSession, sf: str) -> DataFrame:
    return D.metric_samples(spark, sf).select(
        "metric", M.series_key(F.col("labels")).alias("series"), "ts", "value"
    )


# -- streaming rollup --------------------------------------------------------------------


def rollup_daily_stream(spark: SparkSession, sf: str) -> DataFrame:
    source, out = scratch_path(spark, "clicks"), scratch_path(spark, "rollup")
    clicks = D.clicks(spark, sf)
    clicks.write.parquet(source)
    stream = spark.readStream.schema(clicks.schema).parquet(source)
    rollup.start_rollup(stream, f"{out}/table", f"{out}/checkpoint", available_now=True).awaitTermination()
    return _text_days(ingest.read_rollup(spark, f"{out}/table"))


def timeline_from_rollup(spark: SparkSession, sf: str) -> DataFrame:
    clicks = D.clicks(spark, sf)
    return _text_days(R.timeline_from_rollup(R.rollup_daily(clicks), clicks, AS_OF, DAYS))


def bloom_probe(spark: SparkSession, sf: str) -> DataFrame:
    requests = D.requests(spark, sf).select("request_id", "short_token")
    return bloom.probe(requests, materialize(bloom.build(D.links(spark, sf)), "bloom"))


def bloom_fpr(spark: SparkSession, sf: str) -> DataFrame:
    links = D.links(spark, sf)
    stored = materialize(bloom.build(links, SMALL_BLOOM), "bloom")
    probed = bloom.probe(D.requests(spark, sf).select("short_token"), stored)
    return bloom.false_positives(probed, links)


def resolve_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """Requests resolved behind a stored filter that four batches of links have outgrown, one of them run twice."""
    path, links = scratch_path(spark, "filter"), D.links(spark, sf)
    for batch_id in (0, 1, 1, 2, 3):
        filters.add_tokens(spark, path, batch_id, links.filter(F.col("id") % 4 == batch_id), FIRST_LAYER, FILTER_RATE)
    filters.compact_filter(spark, path, 2)
    stored = materialize(filters.read_filter(spark, path), "filter")
    return V.resolve_known(filters.probe_layers(D.requests(spark, sf), stored), links).select("request_id", "short_token", "status", "long_url")


def bloom_merge(spark: SparkSession, sf: str) -> DataFrame:
    links = D.links(spark, sf)
    stored = materialize(bloom.build(links.filter(F.col("id") % 2 == 0)), "bloom")
    added = materialize(bloom.build(links.filter(F.col("id") % 2 == 1)), "bloom")
    return bloom.set_bits(bloom.merge(stored, added))


def _links(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(D.links(spark, sf))


def _clicks(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(D.clicks(spark, sf))


def _both(fn: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(D.links(spark, sf), D.clicks(spark, sf))


def _resolved(fn: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: fn(V.resolve(D.requests(spark, sf), D.links(spark, sf)))


def queries() -> dict[str, Query]:
    key = ["short_token"]
    return {
        # sources and sinks
        "src_click_json": src_click_json,
        "click_parse_good": click_parse_good,
        "click_dead_letter": click_dead_letter,
        "ingest_clicks": ingest_clicks,
        "ingest_dead_letters": ingest_dead_letters,
        "clicks_compacted": clicks_compacted,
        "partition_manifest": partition_manifest,
        "clicks_table": clicks_table,
        "links_table": links_table,
        "link_report_stored": link_report_stored,
        "timeline_stored_7d": timeline_stored_7d,
        "metric_samples": metric_samples,
        "emit_clicks": emit_clicks,
        "emit_clicks_stream": emit_clicks_stream,
        "resolve_stream": resolve_stream,
        "bodies_once": bodies_once,
        "queue_depth": queue_depth,
        "clicks_purged": clicks_purged,
        # derivations
        "click_epoch_normalized": click_epoch_normalized,
        "click_country_enriched": click_country_enriched,
        "click_country_dimension": click_country_dimension,
        "links_tokenized": links_tokenized,
        "token_audit": token_audit,
        "link_requests_clean": link_requests_clean,
        "route_templates": lambda spark, sf: M.with_route(D.http_log(spark, sf)).select("event_id", "path", "handler"),
        # filters
        "link_requests_valid": link_requests_valid,
        "link_requests_rejected": link_requests_rejected,
        "link_status": _links(lambda l: L.link_status(l, AS_OF).select("id", "short_token", "expires_at", "status")),
        "link_status_counts": _links(lambda l: L.link_status_counts(l, AS_OF)),
        "link_report_one": _both(lambda l, c: R.flatten_report(R.link_report_one(l, c, ONE_TOKEN, AS_OF, DAYS))),
        "click_constraint_violations": click_constraint_violations,
        # joins
        "resolve_requests": _resolved(lambda r: r.select("request_id", "short_token", "status", "long_url")),
        "resolve_status_counts": _resolved(V.status_counts),
        "link_report_all": _both(lambda l, c: R.link_report(l, c, AS_OF, DAYS)),
        "orphan_clicks": lambda spark, sf: C.orphan_clicks(
            D.requests(spark, sf), D.links(spark, sf)
        ).select("request_id", "short_token"),
        "cascade_purge": _both(lambda l, c: C.cascade_purge(c, _month_removed(l)).select("id", "short_token")),
        "bloom_offsets": _links(lambda l: bloom.offsets(l.select("short_token"))),
        "bloom_probe": bloom_probe,
        "bloom_fpr": bloom_fpr,
        "bloom_merge": bloom_merge,
        "resolve_filtered": resolve_filtered,
        "links_merge": links_merge,
        # reports
        "total_links": _links(R.total_links),
        "total_clicks": _clicks(R.total_clicks),
        "clicks_per_link": _clicks(R.clicks_per_link),
        "timeline_global": _clicks(lambda c: _text_days(R.timeline(c, AS_OF)).orderBy("day")),
        "timeline_global_7d": _clicks(lambda c: _text_days(R.timeline(c, AS_OF, DAYS)).orderBy("day")),
        "timeline_backdated": _clicks(lambda c: _text_days(R.timeline(c, AS_OF, DAYS, backdated=True)).orderBy("day")),
        "timeline_per_link": _clicks(lambda c: _text_days(R.timeline(c, AS_OF, DAYS, per_link=True))),
        "geo_global": _clicks(lambda c: R.geo_distribution(c).orderBy(F.desc("clicks"), "country")),
        "geo_per_link": _clicks(lambda c: R.geo_distribution(c, per_link=True)),
        "link_report_nested": _both(lambda l, c: R.flatten_report(R.link_report_nested(l, c, AS_OF, DAYS))),
        "global_report": _both(lambda l, c: R.flatten_report(R.global_report(l, c, AS_OF, DAYS))),
        "report_grouping_sets": _clicks(lambda c: _text_days(R.report_grouping_sets(c, AS_OF, DAYS))),
        "geo_share": _clicks(lambda c: charts.geo_share(R.geo_distribution(c))),
        "geo_share_per_link": _clicks(lambda c: charts.geo_share(R.geo_distribution(c, per_link=True), key)),
        "geo_top6": _clicks(lambda c: charts.top_slices(R.geo_distribution(c))),
        "geo_top6_per_link": _clicks(lambda c: charts.top_slices(R.geo_distribution(c, per_link=True), key)),
        "recent_links": recent_links,
        "timeline_bounds": _clicks(lambda c: charts.timeline_bounds(R.timeline(c, AS_OF, DAYS))),
        "timeline_bounds_per_link": _clicks(
            lambda c: charts.timeline_bounds(R.timeline(c, AS_OF, DAYS, per_link=True), key)
        ),
        "timeline_ticks": _clicks(lambda c: _text_days(charts.timeline_ticks(R.timeline(c, AS_OF)))),
        "timeline_chart": _clicks(lambda c: _text_days(_rounded_xy(charts.timeline_chart(R.timeline(c, AS_OF, DAYS))))),
        "timeline_chart_per_link": _clicks(
            lambda c: _text_days(_rounded_xy(charts.timeline_chart(R.timeline(c, AS_OF, DAYS, per_link=True), key)))
        ),
        # metrics
        "latency_histogram": latency_histogram,
        "counter_rate": counter_rate,
        "counter_rate_sliding": counter_rate_sliding,
        "latency_quantiles": latency_quantiles,
        "latency_quantiles_by_route": latency_quantiles_by_route,
        "latency_quantiles_1m": latency_quantiles_1m,
        "latency_quantiles_sliding": latency_quantiles_sliding,
        "hit_ratio": hit_ratio,
        "gauge_last": lambda spark, sf: M.gauge_last(D.metric_samples(spark, sf), "rabbitmq_queue_depth", GAUGE_SECONDS),
        "request_rate_by_route": request_rate_by_route,
        # limiter, registration, live rollup
        "registration_merge": registration_merge,
        "registration_stored": registration_stored,
        "rate_limit_decisions": rate_limit_decisions,
        "rate_limit_by_client": rate_limit_by_client,
        "rate_limit_hot_client": rate_limit_hot_client,
        "rate_limit_repeats": rate_limit_repeats,
        "rate_limit_stream": rate_limit_stream,
        "registration_outcomes": registration_outcomes,
        "rollup_daily": _clicks(lambda c: _text_days(R.rollup_daily(c))),
        "rollup_daily_stream": rollup_daily_stream,
        "timeline_from_rollup": timeline_from_rollup,
    }


def _rounded_xy(chart: DataFrame) -> DataFrame:
    return chart.withColumns({"x": F.round("x", 6), "y": F.round("y", 6)})
