import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from clickloom.operators import metrics as M, timeseries as TS

T0 = datetime(2024, 1, 1)
SAMPLE = "metric string, labels map<string,string>, ts timestamp_ntz, value double"


def samples(spark, rows, metric="m", label="hit"):
    return spark.createDataFrame([(metric, {"result": label}, T0 + timedelta(seconds=s), float(v)) for s, v in rows], SAMPLE)


def test_reset_and_first_sample(spark):
    df = samples(spark, [(5, 10), (10, 16), (15, 4), (60, 9), (61, 10)])
    rows = {r.at: r.rate for r in M.counter_rate(df, "m").collect()}
    assert rows == {T0 + timedelta(seconds=60): pytest.approx(15 / 60), T0 + timedelta(seconds=120): pytest.approx(1 / 60)}


def test_sliding_windows(spark):
    df = samples(spark, [(0, 0), (10, 6), (70, 12)])
    rows = {(r.at - T0).seconds: r.rate for r in M.counter_rate(df, "m", 60, 30).collect() if r.rate}
    assert rows == {30: 0.1, 60: 0.1, 90: 0.1, 120: 0.1}
    with pytest.raises(ValueError):
        M.counter_rate(df, "m", 60, 25)


def test_hit_ratio(spark):
    df = samples(spark, [(1, 0), (2, 3)]).union(samples(spark, [(1, 0), (2, 1)], label="miss")).union(
        samples(spark, [(100, 3)])).union(samples(spark, [(100, 1)], label="miss"))
    rows = {(r.at - T0).seconds: r.hit_ratio_pct for r in M.hit_ratio(df, "m").collect()}
    assert rows == {60: 75.0, 120: None}


def test_histogram_and_quantiles(spark):
    log = spark.createDataFrame([(v,) for v in (0.5, 1.0, 1.5, 3.0)], "latency_s double")
    hist = {r.le: (r.cum_count, r.obs_count, r.obs_sum) for r in M.latency_histogram(log, [], [1.0, 2.0]).collect()}
    assert hist == {1.0: (2, 4, 6.0), 2.0: (3, 4, 6.0), float("inf"): (4, 4, 6.0)}
    got = {r.quantile: r.value for r in M.latency_quantiles(log, [0.25, 0.75, 0.99], bounds=[1.0, 2.0]).collect()}
    assert got == {0.25: 0.5, 0.75: 2.0, 0.99: 2.0}
    nothing = M.latency_quantiles(log.filter("false"), [0.5], bounds=[1.0]).collect()
    assert [r.value for r in nothing] == [None]
    over = M.latency_quantiles(log, [0.95], bounds=[0.1]).collect()
    assert [r.value for r in over] == [0.1]


def test_quantiles_near_exact(spark):
    rng = random.Random(3)
    log = spark.createDataFrame([(rng.expovariate(1.0),) for _ in range(4000)], "latency_s double")
    exact = log.agg(F.percentile("latency_s", 0.95)).first()[0]
    found = M.latency_quantiles(log, [0.95]).first().value
    assert 2.5 <= exact <= 5.0 and 2.5 <= found <= 5.0


def test_gauge(spark):
    df = samples(spark, [(0, 1), (59, 2), (60, 3), (119, 0)])
    rows = {(r.interval_start - T0).seconds: r.value for r in M.gauge_last(df, "m", 60).collect()}
    assert rows == {0: 2.0, 60: 0.0}


def test_route_templates(spark):
    paths = {"/api/v1/redirect/abc": "/api/v1/redirect/{short_token}", "/api/v1/analytics/abc": "/api/v1/analytics/{short_token}",
             "/api/v1/analytics": "/api/v1/analytics", "/x": "/x",
             "/api/v1/analytics//api/v1/redirect/": "/api/v1/redirect/{short_token}"}
    df = spark.createDataFrame([(p,) for p in paths], "path string")
    assert {r.path: r.handler for r in M.with_route(df).collect()} == paths


def test_chunked_steps_equal_whole_series(spark):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), T0 + timedelta(seconds=s), rng.randrange(9)) for s in rng.sample(range(100_000), 800)]
    df = spark.createDataFrame(rows, "k string, ts timestamp_ntz, v bigint")
    total = TS.running_total(df, ["k"], "ts", "v", "total", 500)
    out = TS.previous_value(total, ["k"], "ts", "v", "prior", 500).collect()
    for key in "ab":
        running, prior = 0, None
        for r in sorted((r for r in out if r.k == key), key=lambda r: r.ts):
            running += r.v
            assert (r.total, r.prior) == (running, prior)
            prior = r.v
    assert len(out) == 800


def test_null_labels_and_equal_instants(spark):
    """A series without labels is a series; samples of one instant follow by value."""
    schema = "metric string, labels map<string,string>, ts timestamp_ntz, value double"
    from datetime import datetime, timedelta

    at = [datetime(2024, 1, 1) + timedelta(seconds=s) for s in (0, 5, 5, 10)]
    rows = [("m", labels, t, v) for labels in (None, {"a": "b"}) for t, v in zip(at, (1.0, 4.0, 3.0, 9.0))]
    for order in (rows, rows[::-1]):
        found = M.counter_rate(spark.createDataFrame(order, schema), "m", 60, 60).collect()
        assert {r["series"] for r in found} == {None, '{"a":"b"}'}
        assert {round(sum(r["rate"] * 60 for r in found if r["series"] == s)) for s in (None, '{"a":"b"}')} == {8}


def test_quantiles_at_instants_with_restarts_apart(spark):
    """Two series; one restarts between scrapes, one bucket of it seems to go on. Buckets never fall with rising bounds."""
    t = lambda s: datetime(2024, 1, 1) + timedelta(seconds=s)
    rows = []
    for route, scrapes in {"a": [(5, (0, 4, 4)), (30, (2, 8, 10)), (70, (3, 9, 20)), (100, (4, 1, 5))], "b": [(10, (1, 1, 1)), (50, (1, 1, 1))]}.items():
        rows += [("lat", {"route": route, "le": le}, t(s), float(v)) for s, counts in scrapes for le, v in zip(("0.1", "1.0", "+Inf"), counts)]
    rows += [("lat", {"route": "a", "le": "odd"}, t(30), 9.0), ("lat", {"route": "a"}, t(30), 9.0), ("other", {"le": "0.1"}, t(30), 9.0)]
    samples = spark.createDataFrame(rows, "metric string, labels map<string,string>, ts timestamp_ntz, value double")
    got = {(r["at"], r["quantile"]): r["value"] for r in M.latency_quantiles_at(samples, [0.5, 1.0], "lat").collect()}
    # Growth to the first minute: 2, 4 and 6; to the second: 1 + 1, 1 + 1 (restart) and 10 + 5 (restart).
    assert got == {
        (t(60), 0.5): pytest.approx(0.1 + 0.9 * (3 - 2) / (4 - 2)), (t(60), 1.0): pytest.approx(1.0),
        (t(120), 0.5): pytest.approx(1.0), (t(120), 1.0): pytest.approx(1.0),
    }
    none = M.latency_quantiles_at(samples.filter("labels['route'] = 'b'"), [0.5], "lat").collect()
    assert [(r["at"], r["value"]) for r in none] == [(t(60), None)]
    assert M.latency_quantiles_at(samples.limit(0), [0.5], "lat").collect() == []
