from datetime import date, datetime, timedelta

from pyspark.sql import functions as F

from clickloom.operators import charts, reports as R
from clickloom.sources import tables

AS_OF = datetime(2024, 3, 31, 12)
CLICK = "short_token string, clicked_at timestamp_ntz, country_code string"


def clicks(spark, rows):
    return spark.createDataFrame(rows, CLICK)


def links(spark, tokens):
    rows = [(i, t, "http://x", AS_OF, None) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "id bigint, short_token string, long_url string, created_at timestamp_ntz, expires_at timestamp_ntz")


def test_horizon_is_inclusive_and_open_above(spark):
    edge = AS_OF - timedelta(days=30)
    rows = [("b", edge, "US"), ("b", edge - timedelta(microseconds=1), "US"), ("b", AS_OF + timedelta(days=2), "US")]
    got = {r.day: r.clicks for r in R.timeline(clicks(spark, rows), AS_OF).collect()}
    assert got == {date(2024, 3, 1): 1, date(2024, 4, 2): 1}
    back = R.timeline(clicks(spark, rows), AS_OF, backdated=True).collect()
    assert [(r.day, r.clicks) for r in back] == [(date(2024, 3, 1), 1)]


def test_nested_report(spark):
    day = datetime(2024, 3, 30, 23, 30)
    rows = [("b", day, "US")] * 2 + [("b", day, "DE")] * 2 + [("b", day, None)] + [("b", datetime(2023, 1, 1), "FR")]
    out = {r.short_token: r for r in R.link_report_nested(links(spark, ["b", "c"]), clicks(spark, rows), AS_OF).collect()}
    b, c = out["b"], out["c"]
    assert b.total_clicks == 6
    assert [(d.date, d.clicks) for d in b.clicks_over_time] == [("2024-03-30", 5)]
    # Ties by name; NULL is a country of its own and comes first among equals.
    assert [(g.country, g.clicks) for g in b.geo_distribution] == [("DE", 2), ("US", 2), (None, 1), ("FR", 1)]
    assert (c.total_clicks, c.clicks_over_time, c.geo_distribution) == (0, [], [])


def test_unknown_link_has_no_report(spark):
    assert R.link_report_one(links(spark, ["b"]), clicks(spark, []), "zz", AS_OF).collect() == []


def test_empty_global_report(spark):
    row = R.global_report(links(spark, []), clicks(spark, []), AS_OF).first()
    assert (row.total_urls, row.total_clicks, row.clicks_over_time, row.geo_distribution) == (0, 0, [], [])


def test_totals_agree(spark):
    rows = [(f"t{i % 7}", AS_OF - timedelta(hours=i * 5), ["US", "DE", None][i % 3]) for i in range(400)]
    df = clicks(spark, rows)
    parts = {(r.part, r.day, r.country): r for r in R.report_grouping_sets(df, AS_OF).collect()}
    total = parts[("total", None, None)]
    assert total.clicks == 400
    assert sum(r.clicks for k, r in parts.items() if k[0] == "country") == 400
    assert sum(r.recent_clicks for k, r in parts.items() if k[0] == "day") == total.recent_clicks < 400
    exact = {(r.day, r.clicks) for r in R.timeline(df, AS_OF).collect()}
    assert {(r.day, r.clicks) for r in R.timeline_from_rollup(R.rollup_daily(df), df, AS_OF).collect()} == exact


def geo(spark, rows):
    return spark.createDataFrame(rows, "country string, clicks bigint")


def test_shares(spark):
    out = {r.country: r.share_pct for r in charts.geo_share(geo(spark, [("A", 1), ("B", 7), ("C", 0)])).collect()}
    assert out == {"A": 13, "B": 88}
    assert charts.geo_share(geo(spark, [])).collect() == []
    top = charts.top_slices(geo(spark, [(c, 5) for c in "hgfedcba"])).collect()
    assert [r.country for r in top] == list("abcdef")
    assert all(r.share_pct == 13 for r in top)


def days(spark, counts):
    rows = [(date(2024, 1, 1) + timedelta(days=i), n) for i, n in enumerate(counts)]
    return spark.createDataFrame(rows, "day date, clicks bigint")


def test_axis_bounds(spark):
    for counts, bound, grid in [([], 5, [0, 1, 3, 4, 5]), ([0], 5, [0, 1, 3, 4, 5]), ([5], 5, [0, 1, 3, 4, 5]),
                                ([6, 2], 10, [0, 3, 5, 8, 10]), ([101], 105, [0, 26, 53, 79, 105])]:
        rows = charts.timeline_bounds(days(spark, counts)).orderBy("line").collect()
        assert [r.grid_value for r in rows] == grid and {r.bound for r in rows} == {bound}


def test_ticks(spark):
    assert charts.timeline_ticks(days(spark, [])).collect() == []
    assert [r.label for r in charts.timeline_ticks(days(spark, [3])).collect()] == ["01/01"]
    assert charts.timeline_ticks(days(spark, [1] * 11)).count() == 11
    assert sorted(r.idx for r in charts.timeline_ticks(days(spark, [1] * 12)).collect()) == [0, 2, 4, 6, 8, 10]
    one = charts.timeline_chart(days(spark, [3])).first()
    assert (one.x, one.y) == (0.0, 0.6)


def test_month_folders_are_pruned(spark, tmp_path):
    rows = [("b", datetime(2024, m, 5), "US") for m in range(1, 5)]
    df = clicks(spark, rows).withColumns({"ip_address": F.lit("8.8.8.8"), "user_agent": F.lit("ua")})
    path = str(tmp_path / "clicks")
    tables.write_clicks(df, path)
    stored = tables.read_clicks(spark, path)
    recent = R.recent_clicks(stored, datetime(2024, 4, 20))
    assert recent.count() == 1
    assert len(recent.inputFiles()) == 4
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [((year" in plan and "GreaterThanOrEqual(clicked_at" in plan
