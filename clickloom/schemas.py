"""Table schemas and fixed values shared by all jobs.

Every timestamp is ``TimestampNTZType`` holding UTC, so no result depends on
the session time zone.
"""

from __future__ import annotations

from pyspark.sql import types as T

LINKS = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField("short_token", T.StringType(), False),
        T.StructField("long_url", T.StringType(), False),
        T.StructField("created_at", T.TimestampNTZType(), True),
        T.StructField("expires_at", T.TimestampNTZType(), True),
    ]
)

CLICKS = T.StructType(
    [
        T.StructField("short_token", T.StringType(), False),
        T.StructField("clicked_at", T.TimestampNTZType(), False),
        T.StructField("ip_address", T.StringType(), True),
        T.StructField("user_agent", T.StringType(), True),
        T.StructField("country_code", T.StringType(), True),
    ]
)

METRIC_SAMPLES = T.StructType(
    [
        T.StructField("metric", T.StringType(), False),
        T.StructField("labels", T.MapType(T.StringType(), T.StringType()), False),
        T.StructField("ts", T.TimestampNTZType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)

# Column limits of the stored tables.
MAX_TOKEN_CHARS = 10
MAX_IP_CHARS = 45
MAX_COUNTRY_CHARS = 3

# Token alphabet, most significant digit first, 'a' is zero.
BASE62_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

# Country list in hash order, and addresses tagged as local.
COUNTRIES = ["US", "GB", "DE", "CA", "IN", "FR", "JP", "AU", "SG", "BR", "ZA", "NL", "AE", "KR"]
LOCAL_ADDRESSES = ["127.0.0.1", "localhost", "::1", "0.0.0.0"]
LOCAL_COUNTRY = "LCL"

# Bloom filter size and hash salts.
BLOOM_BITS = 1_000_000
BLOOM_SALTS = ["salt_engine_alpha", "salt_engine_beta", "salt_engine_gamma"]

# Write limiter, report horizon, ingest batching and its pause after a failure.
RATE_LIMIT = 10
RATE_WINDOW_SECONDS = 60
REPORT_DAYS = 30
INGEST_INTERVAL = "2 seconds"
REFRESH_INTERVAL = "5 seconds"
RETRY_SECONDS = 3.0

# Epoch numbers above this are milliseconds, others are seconds.
EPOCH_MILLIS_ABOVE = 1e11

# Route templates, tested in this order.
ROUTE_TEMPLATES = [
    ("/api/v1/redirect/", "/api/v1/redirect/{short_token}"),
    ("/api/v1/analytics/", "/api/v1/analytics/{short_token}"),
]
REDIRECT_PATH = "api/v1/redirect/"
