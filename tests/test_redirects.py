"""Redirects as a stream, loads that are tried again, and bodies that come twice."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from clickloom.operators import clicks as C, resolve as V
from clickloom.session import scratch_path
from clickloom.sources import queue, testdata as D
from clickloom.streaming import backlog, ingest, redirect, retry

SF = "/root/testdata/sf0.001"


def canon(df):
    return sorted(map(str, df.collect()))


def files(spark, path):
    return {r.path for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").collect()}


def test_given_answers_stay(spark):
    """A batch that is run again with other links gives the first answers, and its body files keep their names."""
    links, requests, out = D.links(spark, SF), D.requests(spark, SF), scratch_path(spark, "redirects")
    source = scratch_path(spark, "asked")
    requests.repartition(2).write.parquet(source)
    stream = lambda: spark.readStream.schema(requests.schema).option("maxFilesPerTrigger", 1).parquet(source)
    redirect.start_redirects(stream(), lambda: links, out, f"{out}/first", available_now=True).awaitTermination()
    written = files(spark, f"{out}/bodies")
    redirect.start_redirects(stream(), lambda: links.limit(0), out, f"{out}/second", available_now=True).awaitTermination()
    assert files(spark, f"{out}/bodies") == written
    resolved = V.resolve(requests, links)
    answers = redirect.read_answers(spark, out, redirect.answers_schema(requests))
    columns = ["request_id", "short_token", "status", "long_url"]
    assert canon(answers.select(columns)) == canon(resolved.select(columns))
    assert canon(queue.read_bodies(spark, f"{out}/bodies/*")) == canon(V.emit_clicks(resolved).select("body"))


def _ingest(spark, bodies, links, out, **retries):
    stream = queue.stream_bodies(spark, bodies, max_files=1)
    return ingest.start_ingest(stream, links, out, f"{out}/checkpoint", available_now=True, pause_seconds=0.1, **retries)


def _loaded(spark, payloads, links, out):
    prepared = C.prepare(payloads, links)
    assert ingest.read_ingested(spark, out).count() == C.loadable(prepared).count()
    assert ingest.read_dead_letters(spark, out).count() == prepared.filter("reason is not null").count()


def test_failed_loads_are_tried_again(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out, calls = scratch_path(spark, "bodies"), scratch_path(spark, "out"), []
    queue.write_bodies(payloads.repartition(2), bodies)

    def known():
        calls.append(1)
        if len(calls) in (1, 2, 4):
            raise ConnectionError("the registry is away")
        return links

    _ingest(spark, bodies, known, out).awaitTermination()
    assert len(calls) == 5
    _loaded(spark, payloads, links, out)


def test_restart_after_all_attempts(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out, away = scratch_path(spark, "bodies"), scratch_path(spark, "out"), [True]
    queue.write_bodies(payloads.repartition(2), bodies)

    def known():
        if away[0]:
            raise ConnectionError("the registry is away")
        return links

    with pytest.raises(StreamingQueryException):
        _ingest(spark, bodies, known, out, attempts=2).awaitTermination()
    away[0] = False
    _ingest(spark, bodies, known, out, attempts=2).awaitTermination()
    _loaded(spark, payloads, links, out)


def test_batch_that_fails_for_its_data_is_set_aside(spark):
    links, payloads = D.links(spark, SF), D.click_payloads(spark, SF)
    bodies, out, calls = scratch_path(spark, "bodies"), scratch_path(spark, "out"), []
    queue.write_bodies(payloads.repartition(2), bodies)

    def known():
        calls.append(1)
        return links.withColumn("short_token", F.raise_error(F.lit("bad row")).cast("string")) if len(calls) < 3 else links

    _ingest(spark, bodies, known, out).awaitTermination()
    aside = spark.read.parquet(f"{out}/set_aside/batch_id=0")
    assert "bad row" in aside.first().error
    assert aside.count() + ingest.read_ingested(spark, out).count() + ingest.read_dead_letters(spark, out).count() == payloads.count()
    retry.reload(spark, f"{out}/set_aside", 0, ingest.loader(lambda: links, out))
    _loaded(spark, payloads, links, out)


def test_bodies_that_come_twice(spark):
    """Equal bodies in one batch, in two, and after a restart count once."""
    path, out = scratch_path(spark, "bodies"), scratch_path(spark, "once")

    def run(bodies, seconds=3_600):
        queue.write_bodies(spark.createDataFrame([(b,) for b in bodies], "body string").coalesce(1), path)
        once = queue.without_redeliveries(queue.stream_bodies(spark, path), seconds)
        writer = once.writeStream.format("parquet").option("path", f"{out}/table").option("checkpointLocation", f"{out}/checkpoint")
        queue.ingest_trigger(writer, available_now=True).start().awaitTermination()
        return sorted(r.body for r in spark.read.schema("body string").parquet(f"{out}/table").collect())

    assert run(["a", "a", "b", ""]) == ["", "a", "b"]
    assert run(["b", "c", "A", "a "]) == ["", "A", "a", "a ", "b", "c"]


def test_depth_of_the_queue(spark):
    """All bodies wait before a stream has begun; a stream that died in a batch has taken its files, and a new file waits."""
    path, out = scratch_path(spark, "bodies"), scratch_path(spark, "out")
    put = lambda rows: queue.write_bodies(spark.createDataFrame([(b,) for b in rows], "body string").coalesce(1), path)
    put(["a", "b"])
    assert backlog.queue_depth(spark, path, f"{out}/checkpoint") == 2

    def failing():
        raise ConnectionError("the registry is away")

    with pytest.raises(StreamingQueryException):
        _ingest(spark, path, failing, out, attempts=1).awaitTermination()
    assert backlog.queue_depth(spark, path, f"{out}/checkpoint") == 0
    put(["c"])
    assert backlog.queue_depth(spark, path, f"{out}/checkpoint") == 1
    _ingest(spark, path, lambda: D.links(spark, SF), out, queue=path).awaitTermination()
    assert {r.batch_id: r.value for r in backlog.read_samples(spark, f"{out}/samples").collect()}[1] == 0.0
