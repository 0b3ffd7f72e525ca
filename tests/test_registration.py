"""Registration batch after batch: one limiter, one sequence of ids, tables that only grow by what a batch adds."""

from datetime import datetime, timedelta

import pytest

from clickloom.operators import registration as R
from clickloom.session import scratch_path
from clickloom.sources import registry

START = datetime(2024, 1, 1)
REQUESTS = "request_id bigint, api_key string, ip_address string, requested_at timestamp_ntz, long_url string, expires_text string"


def requests(spark, ids, clients=3):
    rows = [(i, f"k{i % clients}", None, START + timedelta(seconds=i), "ftp://x" if i % 11 == 0 else f"http://x/{i}", "soon" if i % 13 == 0 else None) for i in ids]
    return spark.createDataFrame(rows, REQUESTS)


def run(spark, root, batch_id, rows):
    return R.run_batch(spark, root, batch_id, rows, "http://h/", "UTC", limit=4, window_seconds=30)


def canon(df):
    return sorted(map(str, df.collect()))


def sizes(spark, path):
    names = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length").collect()
    return {r.path.split("/links")[1]: r.length for r in names}


def test_batches_equal_one_batch_also_when_repeated(spark):
    root, whole = scratch_path(spark, "reg"), R.register(requests(spark, range(160)), "http://h/", "UTC", limit=4, window_seconds=30)
    with pytest.raises(ValueError):
        run(spark, root, 1, requests(spark, range(3)))
    got = []
    for batch_id, ids in enumerate((range(60), range(60, 61), range(61, 160))):
        for _ in range(2):  # as after a crash before the commit
            out = run(spark, root, batch_id, requests(spark, ids))
        got += canon(out.select("request_id", "status", "id", "short_token"))
    assert sorted(got) == canon(whole.select("request_id", "status", "id", "short_token"))
    links = registry.read_registry(spark, f"{root}/links")
    assert canon(links.select("id", "short_token", "long_url")) == canon(R.registered_links(whole).select("id", "short_token", "long_url"))
    token = links.filter("id = 5").first().short_token
    assert [r.id for r in registry.read_link(spark, f"{root}/links", token).collect()] == [5]


def test_what_a_batch_writes_does_not_grow(spark):
    root, written, before = scratch_path(spark, "reg"), [], {}
    for batch_id in range(5):
        run(spark, root, batch_id, requests(spark, range(batch_id * 40, batch_id * 40 + 40), clients=40))
        now = sizes(spark, f"{root}/links")
        assert before.items() <= now.items()
        written.append(sum(now.values()) - sum(before.values()))
        before = now
    assert max(written) < 1.3 * min(written)
    rows = canon(registry.read_registry(spark, f"{root}/links").drop("batch_id"))
    for upto in (1, 1, 3):
        registry.compact_registry(spark, f"{root}/links", upto)
        assert canon(registry.read_registry(spark, f"{root}/links").drop("batch_id")) == rows
    with pytest.raises(ValueError):
        registry.read_registry(spark, f"{root}/links", before=2)


def test_tokens_stay_unique(spark):
    path = scratch_path(spark, "links")
    link = lambda i, t, u: (i, t, u, START, None)
    schema = "id bigint, short_token string, long_url string, created_at timestamp_ntz, expires_at timestamp_ntz"
    registry.append_links(spark, path, 0, spark.createDataFrame([link(1, "a", "x"), link(2, "b", "y"), link(3, "b", "z"), link(4, None, "n")], schema))
    registry.append_links(spark, path, 1, spark.createDataFrame([link(5, "a", "w"), link(6, "c", "v"), link(6, "c", "v")], schema))
    registry.append_links(spark, path, 2, spark.createDataFrame([], schema))
    assert sorted((r.id, r.short_token) for r in registry.read_registry(spark, path).collect()) == [(1, "a"), (2, "b"), (6, "c")]
    registry.compact_registry(spark, path, 2)
    assert sorted((r.id, r.short_token) for r in registry.read_registry(spark, path).collect()) == [(1, "a"), (2, "b"), (6, "c")]
