from datetime import datetime, timedelta

from clickloom.operators import links as L, registration, resolve as V

AT = datetime(2024, 1, 20)
LINK = "id bigint, short_token string, long_url string, created_at timestamp_ntz, expires_at timestamp_ntz"


def test_expiry_is_strict(spark):
    rows = [(1, "b", "u", AT, None), (2, "c", "u", AT, AT), (3, "d", "u", AT, AT - timedelta(microseconds=1))]
    df = spark.createDataFrame(rows, LINK)
    assert {r.id: r.status for r in L.link_status(df, AT).collect()} == {1: "Active", 2: "Active", 3: "Expired"}
    asked = spark.createDataFrame(
        [(i, t, AT, None, None) for i, t in enumerate(["b", "c", "d", "zz", None])],
        "request_id bigint, short_token string, requested_at timestamp_ntz, ip_address string, user_agent string")
    resolved = V.resolve(asked, df)
    assert [r.status for r in resolved.orderBy("request_id").collect()] == [302, 302, 410, 404, 404]
    bodies = [r.body for r in V.emit_clicks(resolved).orderBy("request_id").collect()]
    assert bodies[0] == '{"short_token":"b","timestamp":1705708800,"ip_address":"0.0.0.0","user_agent":"unknown"}'
    assert len(bodies) == 2


def test_dense_ids(spark):
    df = spark.range(0, 5000, 1, 7).selectExpr("id AS k", "concat(if(id % 3 = 0, 'same', uuid()), '') AS u")
    fixed = spark.createDataFrame(df.collect(), df.schema).repartition(5)
    got = L.allocate_ids(fixed, ["u", "k"], first_id=10).collect()
    want = {(r.u, r.k): i for i, r in enumerate(sorted(got, key=lambda r: (r.u, r.k)), 10)}
    assert all(want[(r.u, r.k)] == r.id for r in got) and len(got) == 5000


def test_merge_keeps_stored_and_lowest_id(spark):
    stored = spark.createDataFrame([(1, "b", "old", AT, None)], LINK)
    incoming = spark.createDataFrame(
        [(5, "b", "new", AT, None), (7, "c", "late", AT, None), (6, "c", "early", None, None)], LINK)
    assert {(r.id, r.long_url) for r in L.merge_links(stored, incoming).collect()} == {(1, "old"), (6, "early")}


def test_registration_order_of_checks(spark):
    def ask(i, key, url, at):
        return (i, key, "9.9.9.9", AT + timedelta(seconds=at), url, None)

    rows = [ask(0, "k", "ftp://x", 0), ask(1, "k", "http://x", 1), ask(2, "k", "http://y", 2),
            ask(3, "k", "bad", 3), ask(4, "", "http://z", 4), ask(5, None, "https://w", 5)]
    df = spark.createDataFrame(rows, "request_id bigint, api_key string, ip_address string, requested_at timestamp_ntz, long_url string, expires_text string")
    out = registration.register(df, "http://h/", "UTC", limit=2, window_seconds=60)
    got = {r.request_id: (r.status, r.id, r.client_key) for r in out.collect()}
    assert got == {0: (400, None, "k"), 1: (200, 1, "k"), 2: (429, None, "k"), 3: (429, None, "k"),
                   4: (200, 2, ""), 5: (200, 3, "9.9.9.9")}
    assert {(r.id, r.short_token) for r in registration.registered_links(out).collect()} == {(1, "b"), (2, "c"), (3, "d")}


def test_bad_tokens_are_refused(spark):
    schema = "id bigint, short_token string, long_url string, created_at timestamp_ntz, expires_at timestamp_ntz"
    incoming = spark.createDataFrame([(1, None, "u", None, None), (2, "elevenchars", "u", None, None), (3, "ok", "u", None, None), (3, "ok", "u", None, None)], schema)
    assert [r.id for r in L.merge_links(incoming.limit(0), incoming).collect()] == [3]
    assert {(r.id, r.reason) for r in L.rejected_links(incoming).collect()} == {(1, "missing_token"), (2, "token_too_long")}


def test_unreadable_expiry_is_refused(spark):
    from clickloom.operators import registration as G

    schema = "request_id bigint, api_key string, ip_address string, requested_at timestamp_ntz, long_url string, expires_text string"
    at = datetime(2024, 1, 1)
    texts = ["soon", "2024-02-01T06:30+02", None, "2024-02-01T06:30:00Z", ""]
    rows = [(i, "k", None, at, "http://a", text) for i, text in enumerate(texts)]
    out = {r.request_id: r for r in G.register(spark.createDataFrame(rows, schema), "http://b/", "UTC", limit=5).collect()}
    assert [out[i].status for i in range(5)] == [422, 422, 200, 200, 422]
    assert out[2].expires_at is None and out[3].expires_at == datetime(2024, 2, 1, 6, 30)
