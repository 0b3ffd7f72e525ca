import json
from datetime import datetime

from pyspark.sql import functions as F

from clickloom.operators import clicks as C
from clickloom.session import tune

OK = {"short_token": "b", "timestamp": 1700000000, "ip_address": "8.8.8.8", "user_agent": "ua"}


def reasons(spark, bodies):
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    return [r.reason for r in C.parse_bodies(df).orderBy("n").collect()]


def test_body_shapes(spark):
    text = json.dumps(OK)
    assert reasons(spark, [text, f" {text}\n", "{bad", f"[{text}]", "5", '"x"', "null", "", None]) == [
        None, None, "malformed_json", "not_an_object", "not_an_object", "not_an_object", "not_an_object",
        "malformed_json", "malformed_json",
    ]


def test_trailing_text(spark):
    text = json.dumps(OK)
    nested = json.dumps({**OK, "extra": {"deep": "}"}})
    assert reasons(spark, [text + "x", text + "}", text + "]", text + text, text + ", " + text, nested, nested + "}"]) == [
        *["malformed_json"] * 5, None, "malformed_json"
    ]


def test_keys_and_types(spark):
    def but(**change):
        return json.dumps({**OK, **change})

    absent = [json.dumps({k: v for k, v in OK.items() if k != key}) for key in OK]
    assert reasons(spark, absent) == ["missing_key"] * 4
    bodies = [but(ip_address=None), but(short_token=None), but(user_agent=None), but(timestamp=None),
              but(timestamp="1700000000"), but(ip_address=5), but(ip_address=["x"]), but(short_token=7),
              but(user_agent={}), but(timestamp=9e17), but(timestamp=-7e10), but(timestamp=True)]
    assert reasons(spark, bodies) == [
        None, None, None, "timestamp_not_numeric", "timestamp_not_numeric", "ip_not_text", "ip_not_text",
        "token_not_text", "agent_not_text", "timestamp_out_of_range", "timestamp_out_of_range", None,
    ]


def test_repeated_key_keeps_last(spark):
    tune(spark)
    body = json.dumps(OK)[:-1] + ', "user_agent": "last"}'
    df = spark.createDataFrame([(body,)], "body string")
    assert C.parse_bodies(df).first().user_agent == "last"


def test_constraints_and_prepare(spark):
    links = spark.createDataFrame([("b",)], "short_token string")
    bodies = [json.dumps({**OK, **c}) for c in (
        {}, {"short_token": None}, {"short_token": "x" * 11}, {"ip_address": "1" * 46}, {"short_token": "zz"},
        {"timestamp": "1"})]
    df = spark.createDataFrame(list(enumerate(bodies)), "n int, body string")
    rows = C.prepare(df, links).orderBy("n").collect()
    assert [r.reason for r in rows] == [
        None, "token_null", "token_too_long", "ip_too_long", "unknown_token", "timestamp_not_numeric"
    ]
    assert rows[0].clicked_at == datetime(2023, 11, 14, 22, 13, 20) and len(rows[0].country_code) == 2


def test_month_bounds(spark):
    times = [datetime(2023, 12, 31, 23, 59, 59, 999999), datetime(2024, 1, 1)]
    df = spark.createDataFrame([(t,) for t in times], "clicked_at timestamp_ntz")
    rows = {r.partition_name: (str(r.lower_bound), str(r.upper_bound), r.clicks) for r in C.partition_manifest(df).collect()}
    assert rows == {
        "click_analytics_y2023m12": ("2023-12-01", "2024-01-01", 1),
        "click_analytics_y2024m01": ("2024-01-01", "2024-02-01", 1),
    }


def test_address_table(spark):
    clicks = spark.createDataFrame([("8.8.8.8",), ("1.1.1.1",), ("::1",), (None,)], "ip_address string")
    known = spark.createDataFrame([("8.8.8.8", "US")], "ip_address string, country_code string")
    got = {r.ip_address: r.country_code for r in C.enrich_country_from(clicks, known).collect()}
    assert got == {"8.8.8.8": "US", "1.1.1.1": None, "::1": "LCL", None: "LCL"}


def test_purge_and_orphans(spark):
    clicks = spark.createDataFrame([("b",), ("b",), ("c",), ("zz",)], "short_token string")
    links = spark.createDataFrame([("b",), ("c",)], "short_token string")
    assert [r[0] for r in C.orphan_clicks(clicks, links).collect()] == ["zz"]
    left = C.cascade_purge(clicks, links.filter(F.col("short_token") == "b"))
    assert sorted(r[0] for r in left.collect()) == ["c", "zz"]
