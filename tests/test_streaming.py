import random
import time
from datetime import datetime, timedelta

from clickloom.operators import clicks as C, reports as R
from clickloom.plans import catalog
from clickloom.session import scratch_path
from clickloom.sources import queue, testdata as D
from clickloom.streaming import ingest
from clickloom.streaming.limiter import start_rate_limit, stream_rate_limit
from test_limiter import replay

SF = "/root/testdata/sf0.001"


def canon(df):
    return sorted(map(str, df.collect()))


def test_ingest_equals_batch_and_resumes(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out = scratch_path(spark, "bodies"), scratch_path(spark, "out")

    def run():
        stream = queue.stream_bodies(spark, bodies, max_files=1)
        ingest.start_ingest(stream, lambda: links, out, f"{out}/checkpoint", available_now=True).awaitTermination()

    queue.write_bodies(payloads.filter("event_id < 600").repartition(3), bodies)
    run()
    queue.write_bodies(payloads.filter("event_id >= 600").repartition(2), bodies)
    run()
    run()
    prepared = C.prepare(payloads, links)
    loaded = ingest.read_ingested(spark, out)
    assert loaded.select("batch_id").distinct().count() == 5
    columns = ["short_token", "clicked_at", "ip_address", "user_agent", "country_code"]
    assert canon(loaded.select(*columns)) == canon(C.loadable(prepared).select(*columns))
    dead = ingest.read_dead_letters(spark, out).select("body", "reason")
    assert canon(dead) == canon(prepared.filter("reason is not null").select("body", "reason"))
    assert canon(ingest.read_rollup(spark, f"{out}/rollup")) == canon(R.rollup_daily(C.loadable(prepared)))


def test_repeated_batch_replaces_itself(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out = scratch_path(spark, "bodies"), scratch_path(spark, "out")
    queue.write_bodies(payloads, bodies)
    for attempt in ("first", "second"):
        # A new checkpoint runs batch 0 again, as after a crash before its commit.
        stream = queue.stream_bodies(spark, bodies)
        ingest.start_ingest(stream, lambda: links, out, f"{out}/{attempt}", available_now=True).awaitTermination()
    assert ingest.read_ingested(spark, out).count() == C.loadable(C.prepare(payloads, links)).count()


def test_replay_with_other_links_leaves_each_body_once(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out = scratch_path(spark, "bodies"), scratch_path(spark, "out")
    queue.write_bodies(payloads, bodies)
    for attempt, known in (("first", links.limit(0)), ("second", links)):
        stream = queue.stream_bodies(spark, bodies)
        ingest.start_ingest(stream, lambda known=known: known, out, f"{out}/{attempt}", available_now=True).awaitTermination()
    loaded, dead = ingest.read_ingested(spark, out).count(), ingest.read_dead_letters(spark, out).count()
    assert loaded == C.loadable(C.prepare(payloads, links)).count()
    assert loaded + dead == payloads.count()


def test_compaction_changes_no_row(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out = scratch_path(spark, "bodies"), scratch_path(spark, "out")
    queue.write_bodies(payloads.repartition(4), bodies)
    stream = queue.stream_bodies(spark, bodies, max_files=1)
    ingest.start_ingest(stream, lambda: links, out, f"{out}/checkpoint", available_now=True).awaitTermination()
    rows, counts = ingest.read_ingested(spark, out).drop("batch_id"), ingest.read_rollup(spark, f"{out}/rollup")
    before = canon(rows), canon(counts)
    for upto in (1, 1, 2):
        ingest.compact(spark, out, upto)
        assert (canon(ingest.read_ingested(spark, out).drop("batch_id")), canon(ingest.read_rollup(spark, f"{out}/rollup"))) == before
    assert ingest.read_ingested(spark, out).select("batch_id").distinct().count() == 3


def test_kafka_options_have_no_bound_by_default():
    assert queue.kafka_options("host:1") == {"kafka.bootstrap.servers": "host:1", "subscribe": queue.TOPIC}
    assert queue.kafka_options("host:1", max_offsets=5)["maxOffsetsPerTrigger"] == "5"


ASKED = "request_id bigint, client_key string, requested_at timestamp_ntz"


def ask(spark, source, rows):
    start = datetime(2024, 1, 1)
    rows = [(i, c, None if t is None else start + timedelta(microseconds=t)) for i, c, t in rows]
    spark.createDataFrame(rows, ASKED).coalesce(1).write.mode("append").parquet(source)


def answer(spark, source, out, idle=3_600):
    """One run over what has arrived, which must end by itself."""
    decided = stream_rate_limit(spark.readStream.schema(ASKED).parquet(source), 3, 200 / 1e6, idle)
    query = start_rate_limit(decided, out, f"{out}-ckpt", available_now=True)
    assert query.awaitTermination(120)


def test_stream_limiter_keeps_its_log(spark):
    """Three runs from one checkpoint, cut between equal instants; requests without time are answered by NULL."""
    rng = random.Random(11)
    times = sorted(rng.randrange(5_000) for _ in range(600))
    requests = [(i, "hot" if i % 3 else "cold", t) for i, t in enumerate(times)]
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "decided")
    before = spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None)
    for part in (requests[:100], [*requests[100:350], (1_000, "hot", None), (1_001, None, None)], requests[350:]):
        ask(spark, source, part)
        answer(spark, source, out)
    got = spark.read.parquet(out).collect()
    assert len(got) == 602
    assert {r.request_id for r in got if r.allowed} == replay(requests, 3, 200)
    assert {r.request_id for r in got if r.allowed is None} == {1_000, 1_001}
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled", None) == before


def test_stream_limiter_drops_idle_clients(spark):
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "decided")
    ask(spark, source, [(1, "idle", 1), (2, "idle", 2), (3, "busy", 3)])
    answer(spark, source, out, idle=1)
    kept = lambda: spark.read.format("statestore").option("path", f"{out}-ckpt").option("stateVarName", "log").load()
    assert {r.key.client_key for r in kept().select("key").collect()} == {"idle", "busy"}
    time.sleep(2)
    ask(spark, source, [(4, "busy", 500)])
    answer(spark, source, out, idle=1)
    assert {r.key.client_key for r in kept().select("key").collect()} == {"busy"}


def test_stream_limiter_keeps_ids_as_they_are(spark):
    """A request without id leaves the ids beside it whole numbers, however large."""
    source, out = scratch_path(spark, "asked"), scratch_path(spark, "decided")
    ask(spark, source, [(2**53 + 1, "a", 1), (None, "a", 1), (None, None, None), (7, "a", 2)])
    answer(spark, source, out)
    got = sorted((str(r.request_id), r.client_key, r.allowed) for r in spark.read.parquet(out).collect())
    assert got == [("7", "a", True), (str(2**53 + 1), "a", True), ("None", "a", True), ("None", "unknown_client", None)]


def files_of(monkeypatch, name):
    """The folders that queries make under this name; few rows count as a file's."""
    made = []

    def path(spark, asked):
        found = scratch_path(spark, asked)
        made.extend([found] if asked == name else [])
        return found

    monkeypatch.setattr(catalog, "scratch_path", path)
    monkeypatch.setattr(catalog, "FILE_ROWS", 60)
    return lambda spark: [len(spark.read.parquet(p).inputFiles()) for p in made]


def test_limiter_stream_has_more_files_of_more_rows(spark, monkeypatch):
    files = files_of(monkeypatch, "asked")
    got, want = catalog.rate_limit_stream(spark, SF), catalog.rate_limit_decisions(spark, SF)
    assert canon(got) == canon(want)
    assert files(spark)[0] > 3 * catalog.STREAM_FILES


def test_redirect_stream_has_more_files_of_more_rows(spark, monkeypatch):
    files = files_of(monkeypatch, "asked")
    got = catalog.resolve_stream(spark, SF)
    assert {f.split("batch_id=")[1].split("/")[0] for f in got.inputFiles()} == {"0", "1", "2"}
    assert canon(got) == canon(catalog.queries()["resolve_requests"](spark, SF))
    assert files(spark) == [3 * 6]


def test_bodies_are_taken_in_few_batches(spark, monkeypatch):
    """However many files the bodies are in, the second stream has as many batches."""
    monkeypatch.setattr(catalog, "_run_redirects", lambda s, sf: (out, None))
    out = scratch_path(spark, "redirects")
    spark.range(60).selectExpr("cast(id as string) as value").repartition(30).write.text(f"{out}/bodies/batch_id=0")
    got = catalog.emit_clicks_stream(spark, SF)
    assert sorted(int(r.body) for r in got.collect()) == list(range(60))
    assert spark.read.text(f"{out}/taken-checkpoint/commits/*").select("_metadata.file_name").distinct().count() <= 3
