import hashlib
import random
from datetime import datetime

from pyspark.sql import functions as F

from clickloom.functions import base62, hashing
from clickloom.functions.timeutil import epoch_micros, from_epoch_micros, offset_text_to_utc
from clickloom.operators import links as L
from clickloom.operators.clicks import epoch_to_instant
from clickloom.schemas import BASE62_ALPHABET, COUNTRIES


def token_of(n):
    text = ""
    while n:
        n, digit = divmod(n, 62)
        text = BASE62_ALPHABET[digit] + text
    return text or "a"


def test_codec_round_trip(spark):
    rng = random.Random(62)
    ids = sorted({62**p + d for p in range(11) for d in (-1, 0, 1)} | {rng.randrange(2**63) >> rng.randrange(62) for _ in range(60)} | {2**63 - 1})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint").withColumn("t", base62.encode(F.col("id")))
    rows = df.select("id", "t", base62.decode(F.col("t")).alias("back")).collect()
    assert {r.id: r.t for r in rows} == {i: token_of(i) for i in ids}
    assert all(r.id == r.back for r in rows)


def test_codec_rejects(spark):
    # A sign that is no digit, at each place of a token; signs next to the digits' ranges; nothing.
    good = "Qm4Z"
    bad = [good[:i] + sign + good[i:] for i in range(len(good) + 1) for sign in "/:@[`{~ ß"] + [None]
    df = spark.createDataFrame([(b, 1) for b in bad], "short_token string, id bigint")
    rows = L.audit_tokens(df).collect()
    assert not any(r.is_valid for r in rows) and all(r.decoded_id is None for r in rows)
    over = spark.createDataFrame([("99999999999",), ("k9viXaIfiWi",), ("baaaaaaaaaaa",)], "t string")
    assert [r[0] for r in over.select(base62.decode(F.col("t"))).collect()] == [None, None, None]
    same = spark.createDataFrame([("", 0), ("ab", 1), ("b", 1), ("aaaaaaaaaaaaaaaab", 1)], "t string, n bigint")
    assert all(r[0] == r[1] for r in same.select(base62.decode(F.col("t")), "n").collect())


def test_negative_and_too_long_ids(spark):
    df = spark.createDataFrame([(-1,), (62**10 - 1,), (62**10,)], "id bigint")
    rows = {r.id: (r.short_token, r.reason) for r in L.with_tokens(df, "http://x/").collect()}
    assert rows[-1] == (None, "negative_id")
    assert rows[62**10 - 1] == ("9999999999", None)
    assert rows[62**10] == ("baaaaaaaaaa", "token_too_long")


def test_country(spark):
    local = [None, "", "127.0.0.1", "localhost", "::1", "0.0.0.0"]
    public = ["2001:db8::1", "8.8.8.8", *[f"203.0.113.{i}" for i in range(60)]]
    df = spark.createDataFrame([(ip,) for ip in local + public], "ip string")
    for ip, country in df.select("ip", hashing.country_of(F.col("ip"))).collect():
        want = "LCL" if ip in local else COUNTRIES[int(hashlib.md5(ip.encode()).hexdigest(), 16) % 14]
        assert country == want, ip


def test_wide_remainder(spark):
    for modulus in (1, 2, 7, 1_000_000, 2**31 - 1):
        df = spark.range(50).select(F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("h"))
        for digest, rest in df.select("h", hashing.hex_mod(F.col("h"), 64, modulus)).collect():
            assert rest == int(digest, 16) % modulus


def test_epoch_units(spark):
    values = [1e11, 1e11 + 1, 0.0, 1700000000.5, -1.5, 1700000000123.0, 1704067207.179575]
    df = spark.createDataFrame([(v,) for v in values], "e double").select("e", epoch_to_instant(F.col("e")))
    got = dict(df.collect())
    assert got[1e11] == datetime(5138, 11, 16, 9, 46, 40)
    assert got[1e11 + 1] == datetime(1973, 3, 3, 9, 46, 40, 1000)
    assert got[0.0] == datetime(1970, 1, 1)
    assert got[1700000000.5] == datetime(2023, 11, 14, 22, 13, 20, 500000)
    assert got[-1.5] == datetime(1969, 12, 31, 23, 59, 58, 500000)
    assert got[1700000000123.0] == datetime(2023, 11, 14, 22, 13, 20, 123000)
    assert got[1704067207.179575] == datetime(2024, 1, 1, 0, 0, 7, 179575)


def test_micros_ignore_session_zone(spark):
    # 02:30 does not exist in the session zone on this day.
    times = [datetime(2024, 3, 10, 2, 30), datetime(2024, 11, 3, 1, 30, 0, 7), datetime(1960, 1, 1, 0, 0, 0, 5)]
    df = spark.createDataFrame([(t,) for t in times], "t timestamp_ntz")
    us = epoch_micros(F.col("t"))
    for t, n, back in df.select("t", us, from_epoch_micros(us)).collect():
        assert n == round((t - datetime(1970, 1, 1)).total_seconds() * 1e6) and back == t


def test_expiry_text(spark):
    cases = {
        "2024-02-01T06:30:00+02:00": datetime(2024, 2, 1, 4, 30),
        "2024-02-01T06:30:00Z": datetime(2024, 2, 1, 6, 30),
        "2024-02-01T06:30:00.25-0530": datetime(2024, 2, 1, 12, 0, 0, 250000),
        "2024-03-10T02:30:00": datetime(2024, 3, 9, 21, 0),
        "nonsense": None,
        None: None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert dict(df.select("t", offset_text_to_utc(F.col("t"), "Asia/Kolkata")).collect()) == cases


def test_url_prefix(spark):
    rest = ["a", "Ω.test/ü", "[2001:db8::9]:81/?q#f", ""]
    good = [scheme + tail for scheme in ("http://", "https://") for tail in rest]
    bad = [cut + "a" for cut in ("http:/", "https", "ttp://", " http://", "Http://", "http//:")] + ["", None]
    df = spark.createDataFrame([(u,) for u in good + bad], "long_url string")
    assert {r.long_url for r in L.valid_requests(df).collect()} == set(good)
    assert {r.long_url for r in L.rejected_requests(df).collect()} == set(bad)
