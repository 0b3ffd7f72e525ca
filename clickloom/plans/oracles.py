"""Independent SQL for the registered queries, in the dialect of DuckDB.

Each text starts from the given tables and shares no code with the Spark jobs.
"""

from __future__ import annotations

from clickloom.plans import catalog as Q

# Fixed values, written out here as well: the SQL is to find a wrong one in the jobs.
BASE62_ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
BLOOM_BITS = 1_000_000
BLOOM_SALTS = ["salt_engine_alpha", "salt_engine_beta", "salt_engine_gamma"]
COUNTRIES = ["US", "GB", "DE", "CA", "IN", "FR", "JP", "AU", "SG", "BR", "ZA", "NL", "AE", "KR"]
LOCAL_ADDRESSES = ["127.0.0.1", "localhost", "::1", "0.0.0.0"]

AS_OF = f"timestamp '{Q.AS_OF}'"


def _token(n: str) -> str:
    digits = ", ".join(f"substr('{BASE62_ALPHABET}', (({n}) // {62**p}) % 62 + 1, 1)" for p in range(10, -1, -1))
    return f"(CASE WHEN ({n}) = 0 THEN 'a' ELSE ltrim(concat({digits}), 'a') END)"


def _hex_mod(digest: str, n_chars: int, modulus: int) -> str:
    rest = "0::BIGINT"
    for start in range(1, n_chars, 8):
        rest = f"(({rest}) * {2**32 % modulus} + ('0x' || substr({digest}, {start}, 8))::BIGINT) % {modulus}"
    return f"({rest})"


def _country(ip: str) -> str:
    local = ", ".join(f"'{a}'" for a in ["", *LOCAL_ADDRESSES])
    names = ", ".join(f"'{c}'" for c in COUNTRIES)
    return (
        f"(CASE WHEN {ip} IS NULL OR {ip} IN ({local}) THEN 'LCL' "
        f"ELSE list_extract([{names}], ({_hex_mod(f'md5({ip})', 32, len(COUNTRIES))} + 1)::INTEGER) END)"
    )


IP = """(CASE WHEN user_id % 10 = 0 THEN '127.0.0.1' WHEN user_id % 11 = 0 THEN NULL
    ELSE '203.' || (user_id // 256) || '.' || (user_id % 256) || '.7' END)"""
# Visitors of a user's link come from many addresses.
VISITOR = """(CASE WHEN user_id % 10 = 0 AND event_id % 3 <> 1 THEN '127.0.0.1' WHEN user_id % 11 = 0 AND event_id % 5 = 0 THEN NULL
    ELSE '203.' || (user_id // 256) || '.' || (user_id % 256) || '.' || (event_id % 23) END)"""

LINKS = f"""links AS (
  SELECT page_id + 1 AS id, {_token('page_id + 1')} AS short_token, url AS long_url,
         timestamp '2024-01-01' + to_days((page_id % 5)::INTEGER) AS created_at,
         CASE WHEN page_id % 4 = 0 THEN timestamp '2024-01-01' + to_days((page_id % 25 + 5)::INTEGER) END AS expires_at
  FROM pages)"""

REQUESTS = f"""requests AS (
  SELECT event_id AS request_id,
         {_token('CASE WHEN event_id % 10 = 0 THEN event_id + 1000000 ELSE user_id + 1 END')} AS short_token,
         ts AS requested_at, {VISITOR} AS ip_address,
         CASE WHEN event_id % 13 <> 0 THEN event_type END AS user_agent
  FROM events)"""

RESOLVED = f"""{LINKS}, {REQUESTS}, resolved AS (
  SELECT r.*, CASE WHEN l.short_token IS NULL THEN 404 WHEN l.expires_at < r.requested_at THEN 410 ELSE 302 END AS status,
         CASE WHEN l.short_token IS NOT NULL AND NOT coalesce(l.expires_at < r.requested_at, false) THEN l.long_url END AS long_url
  FROM requests r LEFT JOIN links l ON r.short_token = l.short_token)"""

CLICKS = f"""addressed AS (SELECT *, {VISITOR} AS ip FROM events),
clicks AS (
  SELECT event_id + 1 AS id, {_token('user_id + 1')} AS short_token, ts AS clicked_at, ip AS ip_address,
         event_type AS user_agent, {_country('ip')} AS country_code
  FROM addressed)"""

PAYLOADS = f"""stamped AS (SELECT *, epoch_us(ts) AS us, {VISITOR} AS ip, event_id % 50 AS kind FROM events),
fields AS (
  SELECT event_id, event_type, kind,
    CASE WHEN event_id % 3 = 0 THEN (us // 1000)::VARCHAR
         WHEN event_id % 3 = 1 THEN (us // 1000000)::VARCHAR || '.' || lpad((us % 1000000)::VARCHAR, 6, '0')
         ELSE (us // 1000000)::VARCHAR END AS epoch,
    CASE kind WHEN 4 THEN 'null' WHEN 5 THEN '"overlongtoken"'
         WHEN 6 THEN '"' || {_token('event_id + 1000000')} || '"'
         ELSE '"' || {_token('user_id + 1')} || '"' END AS token,
    CASE WHEN kind = 3 THEN '2130706433' ELSE coalesce('"' || ip || '"', 'null') END AS ip
  FROM stamped),
written AS (
  SELECT event_id, kind,
    '{{"short_token": ' || token || ', "timestamp": '
    || CASE kind WHEN 2 THEN '"' || epoch || '"' WHEN 9 THEN '9e17' ELSE epoch END
    || ', "ip_address": ' || ip
    || CASE WHEN kind <> 1 THEN ', "user_agent": "' || event_type || '"' ELSE '' END || '}}' AS body
  FROM fields),
payloads AS (
  SELECT event_id, CASE kind WHEN 0 THEN substr(body, 1, length(body) - 3) WHEN 8 THEN body || ' x'
    WHEN 10 THEN '[' || body || ']' ELSE body END AS body
  FROM written)"""

PARSED = f"""{PAYLOADS},
valid AS (SELECT event_id, body, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM payloads),
typed AS (
  SELECT event_id, body, j, json_type(j) AS top,
    json_type(j, '$.short_token') AS t_token, json_type(j, '$.timestamp') AS t_ts,
    json_type(j, '$.ip_address') AS t_ip, json_type(j, '$.user_agent') AS t_ua
  FROM valid),
numbered AS (
  SELECT *, CASE WHEN t_ts IN ('UBIGINT', 'BIGINT', 'DOUBLE') THEN (j ->> '$.timestamp')::DOUBLE END AS epoch FROM typed),
parsed AS (
  SELECT event_id, body, j ->> '$.short_token' AS short_token, epoch, j ->> '$.ip_address' AS ip_address,
    j ->> '$.user_agent' AS user_agent,
    CASE WHEN epoch > 1e11 THEN epoch / 1000 ELSE epoch END AS seconds,
    CASE WHEN j IS NULL THEN 'malformed_json'
         WHEN top <> 'OBJECT' THEN 'not_an_object'
         WHEN t_token IS NULL OR t_ts IS NULL OR t_ip IS NULL OR t_ua IS NULL THEN 'missing_key'
         WHEN epoch IS NULL THEN 'timestamp_not_numeric'
         WHEN (CASE WHEN epoch > 1e11 THEN epoch / 1000 ELSE epoch END) NOT BETWEEN -62135596800 AND 253402300799.9999999 THEN 'timestamp_out_of_range'
         WHEN t_ip NOT IN ('VARCHAR', 'NULL') THEN 'ip_not_text'
         WHEN t_token NOT IN ('VARCHAR', 'NULL') THEN 'token_not_text'
         WHEN t_ua NOT IN ('VARCHAR', 'NULL') THEN 'agent_not_text' END AS reason
  FROM numbered),
good AS (SELECT *, make_timestamp(round(seconds * 1000000)::BIGINT) AS clicked_at, {_country('ip_address')} AS country_code
         FROM parsed WHERE reason IS NULL),
checked AS (
  SELECT g.* EXCLUDE (reason),
    CASE WHEN g.short_token IS NULL THEN 'token_null' WHEN length(g.short_token) > 10 THEN 'token_too_long'
         WHEN length(ip_address) > 45 THEN 'ip_too_long' WHEN l.short_token IS NULL THEN 'unknown_token' END AS reason
  FROM good g LEFT JOIN links l ON g.short_token = l.short_token)"""

LINK_REQUESTS = f"""link_requests AS (
  SELECT e.event_id AS request_id,
    CASE WHEN e.event_id % 50 = 7 THEN '' WHEN e.user_id % 4 = 0 THEN 'key-' || (e.user_id % 20) END AS api_key,
    {IP.replace('user_id', 'e.user_id')} AS ip_address, e.ts AS requested_at,
    CASE WHEN e.event_id % 20 = 0 THEN regexp_replace(p.url, '^https?', 'ftp') ELSE p.url END AS long_url,
    CASE e.event_id % 4
      WHEN 0 THEN timestamp '2024-02-01 04:30:00' + to_days((e.event_id % 28)::INTEGER)
      WHEN 1 THEN timestamp '2024-02-01 06:30:00' + to_days((e.event_id % 28)::INTEGER)
      WHEN 2 THEN timestamp '2024-02-01 01:00:00' + to_days((e.event_id % 28)::INTEGER) END AS expires_at
  FROM events e JOIN pages p ON p.page_id = e.user_id),
clean AS (SELECT *, coalesce(api_key, ip_address, 'unknown_client') AS client_key FROM link_requests)"""


def _limiter(source: str, limit: int, window_seconds: int) -> str:
    window = window_seconds * 1_000_000
    return f"""ordered AS (
  SELECT request_id, client_key, epoch_us(requested_at) AS us,
         row_number() OVER (PARTITION BY client_key ORDER BY requested_at, request_id) AS rn
  FROM {source} WHERE requested_at IS NOT NULL),
walk AS (
  SELECT request_id, client_key, rn, [us]::BIGINT[] AS log, true AS allowed FROM ordered WHERE rn = 1
  UNION ALL
  SELECT request_id, client_key, rn,
         CASE WHEN len(live) < {limit} AND NOT list_contains(live, us) THEN list_append(live, us) ELSE live END,
         len(live) < {limit}
  FROM (SELECT o.request_id, o.client_key, o.rn, o.us, list_filter(w.log, lambda a: a > o.us - {window}) AS live
        FROM walk w JOIN ordered o ON o.client_key = w.client_key AND o.rn = w.rn + 1))"""


# Two batches under one limiter; the second one's requests with unreadable expiries are refused before it.
READABLE = f"""{LINK_REQUESTS},
readable AS (SELECT * FROM clean WHERE requested_at < timestamp '2024-01-15 00:00:00' OR request_id % 9 <> 0),
{_limiter('readable', Q.SPARSE_LIMIT, Q.SPARSE_WINDOW)},
made AS (SELECT c.*, row_number() OVER (ORDER BY c.requested_at, c.request_id) AS n
    FROM readable c JOIN walk w ON c.request_id = w.request_id
    WHERE allowed AND (long_url LIKE 'http://%' OR long_url LIKE 'https://%'))"""

LIMITED_EVENTS = """asked AS (
  SELECT event_id AS request_id, user_id::VARCHAR AS client_key, ts AS requested_at FROM events)"""

HOT_EVENTS = """asked AS (
  SELECT event_id AS request_id, CASE WHEN event_id % 3 = 0 THEN 'hot' ELSE user_id::VARCHAR END AS client_key,
         CASE WHEN event_id % 6 = 0 THEN date_trunc('hour', ts) ELSE ts END AS requested_at FROM events)"""

# Months before and after a turn of the year.
SPREAD = "clicked_at - to_days(((id % 4) * 25)::INTEGER)"

RECENT = f"clicked_at >= {AS_OF} - INTERVAL '{Q.DAYS}' DAY"
DAY = "strftime(clicked_at, '%Y-%m-%d')"

TIMELINE = f"timeline AS (SELECT {DAY} AS day, count(*) AS clicks FROM clicks WHERE {RECENT} GROUP BY 1)"
TIMELINE_LINK = (
    f"timeline AS (SELECT short_token, {DAY} AS day, count(*) AS clicks FROM clicks WHERE {RECENT} GROUP BY 1, 2)"
)
GEO = "geo AS (SELECT country_code AS country, count(*) AS clicks FROM clicks GROUP BY 1)"
GEO_LINK = "geo AS (SELECT short_token, country_code AS country, count(*) AS clicks FROM clicks GROUP BY 1, 2)"
SHARE = "round(clicks / sum(clicks) OVER ({over}) * 100)::BIGINT AS share_pct"

DAY_LIST = "string_agg(day || '=' || clicks, '|' ORDER BY day)"
GEO_LIST = "string_agg(coalesce(country, '') || '=' || clicks, '|' ORDER BY clicks DESC, country)"

NESTED = f"""{LINKS}, {CLICKS}, {TIMELINE_LINK}, {GEO_LINK},
days AS (SELECT short_token, {DAY_LIST} AS clicks_over_time FROM timeline GROUP BY 1),
places AS (SELECT short_token, {GEO_LIST} AS geo_distribution, sum(clicks)::BIGINT AS total FROM geo GROUP BY 1),
nested AS (
  SELECT l.short_token, long_url, created_at, expires_at, coalesce(total, 0) AS total_clicks,
         coalesce(clicks_over_time, '') AS clicks_over_time, coalesce(geo_distribution, '') AS geo_distribution
  FROM links l LEFT JOIN days USING (short_token) LEFT JOIN places USING (short_token))"""

HTTP = f"""http AS (
  SELECT event_id, ts, CASE WHEN event_type = 'signup' THEN 'POST' ELSE 'GET' END AS method,
    CASE event_type WHEN 'click' THEN '/api/v1/redirect/' || {_token('user_id + 1')}
      WHEN 'purchase' THEN '/api/v1/analytics/' || {_token('user_id + 1')}
      WHEN 'view' THEN '/api/v1/analytics' WHEN 'signup' THEN '/api/v1/shorten' ELSE '/metrics' END AS path,
    value / 100 AS latency_s
  FROM events),
routed AS (
  SELECT *, CASE WHEN path LIKE '%/api/v1/redirect/%' THEN '/api/v1/redirect/{{short_token}}'
                 WHEN path LIKE '%/api/v1/analytics/%' THEN '/api/v1/analytics/{{short_token}}' ELSE path END AS handler
  FROM http)"""

BOUNDS = "[0.005, 0.01, 0.025, 0.05, 0.075, 0.1, 0.25, 0.5, 0.75, 1.0, 2.5, 5.0, 7.5, 10.0, 'inf'::DOUBLE]::DOUBLE[]"


def _quantiles(keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys}" if keys else ""
    return f"""WITH {HTTP}, bounds AS (SELECT unnest({BOUNDS}) AS le),
hist AS (SELECT {lead}le, count(*) FILTER (WHERE latency_s <= le) AS cum FROM routed CROSS JOIN bounds GROUP BY ALL),
edges AS (
  SELECT *, coalesce(lag(le) OVER ({part} ORDER BY le), 0) AS low, coalesce(lag(cum) OVER ({part} ORDER BY le), 0) AS below,
         max(cum) OVER ({part}) AS total FROM hist),
ranked AS (SELECT *, q * total AS rank FROM edges, (SELECT unnest([0.95, 0.99]::DOUBLE[]) AS q) WHERE cum >= q * total)
SELECT {lead}q AS quantile,
  round(min_by(CASE WHEN le = 'inf'::DOUBLE THEN low ELSE low + (le - low) * (rank - below) / (cum - below) END, le), 6) AS value
FROM ranked GROUP BY {lead}q"""


def _quantiles_at(keys: str, step_seconds: int, times: int) -> str:
    """Quantiles per instant: growth of each bucket series in the ``times`` steps before it."""
    lead = f"{keys}, " if keys else ""
    return f"""WITH {HTTP}, bounds AS (SELECT unnest({BOUNDS}) AS le),
ticked AS (SELECT method, handler, latency_s, ts >= timestamp '2024-01-15' AS restarted, {_tick('ts', 5)} AS tick FROM routed),
counted AS (SELECT method, handler, restarted, tick, le, count(*) FILTER (WHERE latency_s <= le) AS n FROM ticked CROSS JOIN bounds GROUP BY ALL),
scraped AS (SELECT *, sum(n) OVER (PARTITION BY method, handler, restarted, le ORDER BY tick) AS value FROM counted),
before AS (SELECT *, lag(value) OVER (PARTITION BY method, handler, le ORDER BY tick, value) AS prior FROM scraped),
steps AS (
  SELECT {lead}le, {_tick('tick', step_seconds)} AS step, sum(coalesce(CASE WHEN value < prior THEN value ELSE value - prior END, 0)) AS n FROM before GROUP BY ALL),
slid AS (SELECT {lead}le, step + to_seconds(k * {step_seconds}) AS moment, sum(n)::DOUBLE AS n FROM steps, range({times}) t(k) GROUP BY ALL),
rising AS (SELECT {lead}moment, le, max(n) OVER (PARTITION BY {lead}moment ORDER BY le) AS cum FROM slid),
edges AS (
  SELECT *, coalesce(lag(le) OVER (PARTITION BY {lead}moment ORDER BY le), 0) AS low, coalesce(lag(cum) OVER (PARTITION BY {lead}moment ORDER BY le), 0) AS below,
         max(cum) OVER (PARTITION BY {lead}moment) AS total FROM rising),
ranked AS (SELECT *, q * total AS rank FROM edges, (SELECT unnest([0.95, 0.99]::DOUBLE[]) AS q) WHERE cum >= q * total)
SELECT {lead}moment AS at, q AS quantile, round(arg_min_null(CASE WHEN total = 0 THEN NULL WHEN le = 'inf'::DOUBLE THEN low
  ELSE low + (le - low) * (rank - below) / nullif(cum - below, 0) END, le), 6) AS value
FROM ranked GROUP BY {lead}moment, q"""


SAMPLES = """looked AS (
  SELECT CASE WHEN event_type IN ('click', 'view') THEN 'hit' ELSE 'miss' END AS result,
         ts >= timestamp '2024-01-15' AS restarted, event_id, ts, (props ->> '$.k')::DOUBLE AS depth,
         make_timestamp(((epoch_us(ts) + 4999999) // 5000000) * 5000000) AS tick FROM events),
ticks AS (SELECT result, restarted, tick, count(*) AS n FROM looked GROUP BY ALL),
counter AS (
  SELECT 'cache_requests_total' AS metric, '{"result":"' || result || '"}' AS series, result, tick AS ts,
         (sum(n) OVER (PARTITION BY result, restarted ORDER BY tick))::DOUBLE AS value FROM ticks),
gauge AS (
  SELECT 'rabbitmq_queue_depth' AS metric, '{"queue":"link-clicks"}' AS series, tick AS ts,
         arg_max(depth, (ts, event_id)) AS value FROM looked GROUP BY tick),
grown AS (
  SELECT *, coalesce(CASE WHEN value < prior THEN value ELSE value - prior END, 0) AS increase
  FROM (SELECT *, lag(value) OVER (PARTITION BY series ORDER BY ts) AS prior FROM counter))"""


def _tick(ts: str, seconds: int) -> str:
    step = seconds * 1_000_000
    return f"make_timestamp(((epoch_us({ts}) + {step - 1}) // {step}) * {step})"


def _offsets(token: str, bits: int) -> list[str]:
    return [_hex_mod(f"sha256('{salt}' || {token})", 64, bits) for salt in BLOOM_SALTS]


def _bloom(bits: int, links: str = "links") -> str:
    return f"set_at AS (SELECT DISTINCT unnest([{', '.join(_offsets('short_token', bits))}]) AS slot FROM {links})"


def _probed(bits: int) -> str:
    a, b, c = _offsets("short_token", bits)
    return f"""offsets AS (SELECT request_id, short_token, {a} AS o0, {b} AS o1, {c} AS o2 FROM requests),
probed AS (
  SELECT request_id, short_token, o0 IN (SELECT slot FROM set_at) AND o1 IN (SELECT slot FROM set_at)
         AND o2 IN (SELECT slot FROM set_at) AS maybe FROM offsets)"""


def _chart(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    return f"""placed AS (
  SELECT {lead}day, clicks, row_number() OVER ({part} ORDER BY day) - 1 AS idx, count(*) OVER ({part}) AS n,
         (ceil(greatest(max(clicks) OVER ({part}), 5) / 5) * 5)::BIGINT AS bound FROM timeline),
chart AS (
  SELECT {lead}day, clicks, idx, bound, substr(day, 6, 2) || '/' || substr(day, 9, 2) AS label,
         round(idx / greatest(1, n - 1), 6) AS x, round(clicks / bound, 6) AS y,
         idx % greatest(1, n // least(n, 6)) = 0 AS is_tick FROM placed)"""


def _bounds(keys: str) -> str:
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""bounds AS (SELECT {lead}(ceil(greatest(max(clicks), 5) / 5) * 5)::BIGINT AS bound FROM timeline {group})
SELECT {lead}bound, line, round(bound / 4 * line)::BIGINT AS grid_value
FROM bounds CROSS JOIN (SELECT unnest(range(0, 5))::INTEGER AS line)"""


EMITTED = """'{"short_token":"' || short_token || '","timestamp":' || (epoch_us(requested_at) // 1000000) || ',"ip_address":"'
    || coalesce(ip_address, '0.0.0.0') || '","user_agent":"' || coalesce(user_agent, 'unknown') || '"}'"""


def oracle_sql() -> dict[str, str]:
    decode = " + ".join(
        f"(instr('{BASE62_ALPHABET}', substr(p, {i + 1}, 1)) - 1)::HUGEINT * {62 ** (10 - i)}" for i in range(11)
    )
    days_30 = f"clicked_at >= {AS_OF} - INTERVAL '30' DAY"
    timeline_30 = f"timeline AS (SELECT {DAY} AS day, count(*) AS clicks FROM clicks WHERE {days_30} GROUP BY 1)"
    rollup = f"SELECT short_token, {DAY} AS day, country_code AS country, count(*) AS clicks FROM clicks GROUP BY ALL"
    ingested = f"WITH {LINKS}, {PARSED}"
    limited = f"{_limiter('asked', Q.SPARSE_LIMIT, Q.SPARSE_WINDOW)}"
    return {
        "src_click_json": f"WITH {PAYLOADS} SELECT body FROM payloads",
        "click_parse_good": f"{ingested} SELECT event_id, short_token, epoch, ip_address, user_agent FROM good",
        "click_dead_letter": f"{ingested} SELECT event_id, body, reason FROM parsed WHERE reason IS NOT NULL",
        "ingest_clicks": f"""{ingested} SELECT short_token, clicked_at, ip_address, user_agent, country_code,
            year(clicked_at)::INTEGER AS year, month(clicked_at)::INTEGER AS month FROM checked WHERE reason IS NULL""",
        "clicks_compacted": f"""{ingested} SELECT short_token, clicked_at, ip_address, user_agent, country_code,
            year(clicked_at)::INTEGER AS year, month(clicked_at)::INTEGER AS month FROM checked WHERE reason IS NULL""",
        "ingest_dead_letters": f"""{ingested} SELECT body, reason FROM parsed WHERE reason IS NOT NULL
            UNION ALL SELECT body, reason FROM checked WHERE reason IS NOT NULL""",
        "partition_manifest": f"""WITH {CLICKS} SELECT 'click_analytics_y' || strftime(m, '%Y') || 'm' || strftime(m, '%m') AS partition_name,
            strftime(m, '%Y-%m-%d') AS lower_bound, strftime(m + INTERVAL '1' MONTH, '%Y-%m-%d') AS upper_bound, clicks
            FROM (SELECT date_trunc('month', {SPREAD}) AS m, count(*) AS clicks FROM clicks GROUP BY 1)""",
        "clicks_table": f"""WITH {CLICKS}, spread AS (SELECT * REPLACE ({SPREAD} AS clicked_at) FROM clicks)
            SELECT short_token, clicked_at, ip_address, user_agent, country_code,
            year(clicked_at)::INTEGER AS year, month(clicked_at)::INTEGER AS month FROM spread""",
        "link_report_stored": f"WITH {NESTED} SELECT * FROM nested WHERE short_token = '{Q.ONE_TOKEN}'",
        "timeline_stored_7d": f"WITH {CLICKS}, {TIMELINE} SELECT * FROM timeline ORDER BY day",
        "links_table": f"WITH {LINKS} SELECT * FROM links",
        "metric_samples": f"""WITH {SAMPLES} SELECT metric, series, ts, value FROM counter
            UNION ALL SELECT metric, series, ts, value FROM gauge""",
        "emit_clicks": f"WITH {RESOLVED} SELECT request_id, {EMITTED} AS body FROM resolved WHERE status = 302",
        "emit_clicks_stream": f"WITH {RESOLVED} SELECT {EMITTED} AS body FROM resolved WHERE status = 302",
        "resolve_stream": f"WITH {RESOLVED} SELECT request_id, short_token, status, long_url FROM resolved",
        "clicks_purged": f"""WITH {LINKS}, {CLICKS}, spread AS (SELECT * REPLACE ({SPREAD} AS clicked_at) FROM clicks)
            SELECT short_token, clicked_at, ip_address, user_agent, country_code, year(clicked_at)::INTEGER AS year, month(clicked_at)::INTEGER AS month
            FROM spread WHERE short_token NOT IN (SELECT short_token FROM links WHERE expires_at < timestamp '2024-01-15')""",
        "queue_depth": f"""WITH {PAYLOADS}, parts AS (
              SELECT part::BIGINT AS batch_id, (SELECT count(*) FROM payloads WHERE least(event_id // {Q.DEPTH_EVENTS}, {Q.INGEST_FILES - 1}) > part)::DOUBLE AS value
              FROM range({Q.INGEST_FILES}) t(part))
            SELECT batch_id, 'queue_depth' AS metric, '{{"queue":"link-clicks"}}' AS series, value FROM parts""",
        "bodies_once": f"WITH {PAYLOADS} SELECT DISTINCT body FROM payloads",
        "click_epoch_normalized": f"{ingested} SELECT event_id, clicked_at FROM good",
        "click_country_enriched": f"{ingested} SELECT event_id, ip_address, country_code FROM good",
        "click_country_dimension": f"""WITH {CLICKS},
            dim AS (SELECT ip_address, max(country_code) AS known FROM clicks WHERE id % 2 = 0 GROUP BY 1)
            SELECT id, c.ip_address, CASE WHEN country_code = 'LCL' THEN 'LCL' ELSE known END AS country_code
            FROM clicks c LEFT JOIN dim d ON c.ip_address = d.ip_address""",
        "links_tokenized": f"""WITH n AS (SELECT page_id, row_number() OVER (ORDER BY url, page_id) AS id FROM pages)
            SELECT page_id, id, {_token('id')} AS short_token,
                   '{Q.BASE_URL}api/v1/redirect/' || {_token('id')} AS short_url FROM n""",
        "token_audit": f"""WITH n AS (SELECT event_id, event_id * 1000003 + user_id AS id FROM events),
            t AS (SELECT event_id, id, CASE event_id % 7 WHEN 0 THEN {_token('id')} || '-' WHEN 1 THEN 'a' || {_token('id')}
                  WHEN 2 THEN '99999999999' ELSE {_token('id')} END AS short_token FROM n),
            v AS (SELECT *, translate(short_token, '{BASE62_ALPHABET}', '') = '' AS is_valid,
                  lpad(ltrim(short_token, 'a'), 11, 'a') AS p FROM t),
            d AS (SELECT *, CASE WHEN is_valid AND length(ltrim(short_token, 'a')) <= 11
                  THEN TRY_CAST({decode} AS BIGINT) END AS decoded_id FROM v)
            SELECT event_id, id, short_token, is_valid, decoded_id,
                   coalesce({_token('decoded_id')} = short_token, false) AS is_canonical,
                   coalesce(decoded_id = id, false) AS matches_id,
                   CASE WHEN NOT is_valid THEN 'foreign_character' WHEN decoded_id IS NULL THEN 'overflow' END AS reason
            FROM d""",
        "link_requests_clean": f"WITH {LINK_REQUESTS} SELECT request_id, client_key, long_url, expires_at FROM clean",
        "route_templates": f"WITH {HTTP} SELECT event_id, path, handler FROM routed",
        "link_requests_valid": f"""WITH {LINK_REQUESTS} SELECT request_id, long_url FROM clean
            WHERE long_url LIKE 'http://%' OR long_url LIKE 'https://%'""",
        "link_requests_rejected": f"""WITH {LINK_REQUESTS} SELECT request_id, long_url, 'bad_scheme' AS reason FROM clean
            WHERE NOT (long_url LIKE 'http://%' OR long_url LIKE 'https://%')""",
        "link_status": f"""WITH {LINKS} SELECT id, short_token, expires_at,
            CASE WHEN expires_at < {AS_OF} THEN 'Expired' ELSE 'Active' END AS status FROM links""",
        "link_status_counts": f"""WITH {LINKS} SELECT CASE WHEN expires_at < {AS_OF} THEN 'Expired' ELSE 'Active' END AS status,
            count(*) AS links FROM links GROUP BY 1""",
        "link_report_one": f"WITH {NESTED} SELECT * FROM nested WHERE short_token = '{Q.ONE_TOKEN}'",
        "click_constraint_violations": f"{ingested} SELECT event_id, short_token, reason FROM checked WHERE reason IS NOT NULL",
        "resolve_requests": f"WITH {RESOLVED} SELECT request_id, short_token, status, long_url FROM resolved",
        "resolve_filtered": f"WITH {RESOLVED} SELECT request_id, short_token, status, long_url FROM resolved",
        "resolve_status_counts": f"WITH {RESOLVED} SELECT status, count(*) AS requests FROM resolved GROUP BY 1",
        "link_report_all": f"""WITH {LINKS}, {CLICKS}, per_link AS (
              SELECT short_token, count(*) AS total, count(*) FILTER (WHERE {RECENT}) AS recent,
                     count(DISTINCT {DAY}) FILTER (WHERE {RECENT}) AS active FROM clicks GROUP BY 1)
            SELECT l.*  EXCLUDE (id), coalesce(total, 0) AS total_clicks, coalesce(recent, 0) AS recent_clicks,
                   coalesce(active, 0) AS active_days FROM links l LEFT JOIN per_link USING (short_token)""",
        "orphan_clicks": f"""WITH {LINKS}, {REQUESTS} SELECT request_id, short_token FROM requests
            WHERE short_token NOT IN (SELECT short_token FROM links)""",
        "cascade_purge": f"""WITH {LINKS}, {CLICKS} SELECT id, short_token FROM clicks WHERE short_token NOT IN
            (SELECT short_token FROM links WHERE expires_at < timestamp '2024-01-15')""",
        "bloom_offsets": "WITH {} SELECT short_token, {} FROM links".format(
            LINKS, ", ".join(f"{o} AS offset_{i}" for i, o in enumerate(_offsets("short_token", BLOOM_BITS)))
        ),
        "bloom_probe": f"WITH {LINKS}, {REQUESTS}, {_bloom(BLOOM_BITS)}, {_probed(BLOOM_BITS)} SELECT * FROM probed",
        "bloom_fpr": f"""WITH {LINKS}, {REQUESTS}, {_bloom(Q.SMALL_BLOOM)}, {_probed(Q.SMALL_BLOOM)},
            c AS (SELECT maybe, short_token IN (SELECT short_token FROM links) AS known FROM probed)
            SELECT count(*) AS probed, count(*) FILTER (WHERE maybe) AS positives,
                   count(*) FILTER (WHERE maybe AND NOT known) AS false_positives,
                   count(*) FILTER (WHERE NOT maybe AND known) AS false_negatives FROM c""",
        "bloom_merge": f"WITH {LINKS}, {_bloom(BLOOM_BITS)} SELECT count(*) AS bits_set FROM set_at",
        "links_merge": f"""WITH {LINKS}, {REQUESTS}, stored AS (SELECT * FROM links WHERE id % 2 = 0),
            fresh AS (SELECT request_id AS id, short_token, 'https://new.example/' || short_token AS long_url,
                             requested_at AS created_at, NULL::TIMESTAMP AS expires_at FROM requests
                      WHERE request_id % 17 <> 0 AND request_id % 19 <> 0 AND short_token NOT IN (SELECT short_token FROM stored)
                      QUALIFY row_number() OVER (PARTITION BY short_token ORDER BY request_id) = 1)
            SELECT id, short_token, long_url, created_at, expires_at FROM stored UNION ALL
            SELECT id, short_token, long_url, created_at, expires_at FROM fresh""",
        "total_links": "SELECT count(*) AS total_links FROM pages",
        "total_clicks": "SELECT count(*) AS total_clicks FROM events",
        "clicks_per_link": f"WITH {CLICKS} SELECT short_token, count(*) AS total_clicks FROM clicks GROUP BY 1",
        "timeline_global": f"WITH {CLICKS}, {timeline_30} SELECT * FROM timeline ORDER BY day",
        "timeline_global_7d": f"WITH {CLICKS}, {TIMELINE} SELECT * FROM timeline ORDER BY day",
        "timeline_backdated": f"""WITH {CLICKS} SELECT {DAY} AS day, count(*) AS clicks FROM clicks
            WHERE {RECENT} AND clicked_at < {AS_OF} GROUP BY 1 ORDER BY 1""",
        "timeline_per_link": f"WITH {CLICKS}, {TIMELINE_LINK} SELECT * FROM timeline",
        "geo_global": f"WITH {CLICKS}, {GEO} SELECT * FROM geo ORDER BY clicks DESC, country",
        "geo_per_link": f"WITH {CLICKS}, {GEO_LINK} SELECT * FROM geo",
        "link_report_nested": f"WITH {NESTED} SELECT * FROM nested",
        "global_report": f"""WITH {CLICKS}, {TIMELINE}, {GEO}
            SELECT (SELECT count(*) FROM pages) AS total_urls, (SELECT count(*) FROM clicks) AS total_clicks,
                   (SELECT {DAY_LIST} FROM timeline) AS clicks_over_time, (SELECT {GEO_LIST} FROM geo) AS geo_distribution""",
        "report_grouping_sets": f"""WITH {CLICKS}, {TIMELINE}, {GEO}, d AS (
              SELECT {DAY} AS day, count(*) AS clicks, count(*) FILTER (WHERE {RECENT}) AS recent_clicks FROM clicks GROUP BY 1)
            SELECT day, NULL::VARCHAR AS country, 'day' AS part, clicks, recent_clicks FROM d WHERE recent_clicks > 0
            UNION ALL SELECT NULL, country_code, 'country', count(*), count(*) FILTER (WHERE {RECENT}) FROM clicks GROUP BY country_code
            UNION ALL SELECT NULL, NULL, 'total', count(*), count(*) FILTER (WHERE {RECENT}) FROM clicks""",
        "geo_share": f"WITH {CLICKS}, {GEO} SELECT *, {SHARE.format(over='')} FROM geo",
        "geo_share_per_link": f"WITH {CLICKS}, {GEO_LINK} SELECT *, {SHARE.format(over='PARTITION BY short_token')} FROM geo",
        "geo_top6": f"WITH {CLICKS}, {GEO} SELECT *, {SHARE.format(over='')} FROM geo ORDER BY clicks DESC, country LIMIT 6",
        "geo_top6_per_link": f"""WITH {CLICKS}, {GEO_LINK} SELECT *, {SHARE.format(over='PARTITION BY short_token')} FROM geo
            QUALIFY row_number() OVER (PARTITION BY short_token ORDER BY clicks DESC, country) <= 6""",
        "recent_links": f"WITH {LINKS} SELECT * FROM links ORDER BY created_at DESC, id DESC LIMIT 10",
        "timeline_bounds": f"WITH {CLICKS}, {TIMELINE}, {_bounds('')}",
        "timeline_bounds_per_link": f"WITH {CLICKS}, {TIMELINE_LINK}, {_bounds('short_token')}",
        "timeline_ticks": f"WITH {CLICKS}, {timeline_30}, {_chart('')} SELECT idx, day, label FROM chart WHERE is_tick",
        "timeline_chart": f"WITH {CLICKS}, {TIMELINE}, {_chart('')} SELECT * FROM chart",
        "timeline_chart_per_link": f"WITH {CLICKS}, {TIMELINE_LINK}, {_chart('short_token')} SELECT * FROM chart",
        "latency_histogram": f"""WITH {HTTP}, bounds AS (SELECT unnest({BOUNDS}) AS le)
            SELECT method, handler, le, count(*) FILTER (WHERE latency_s <= le) AS cum_count, count(*) AS obs_count,
                   round(sum(latency_s::DECIMAL(18,6))::DOUBLE, 4) AS obs_sum
            FROM routed CROSS JOIN bounds GROUP BY ALL""",
        "counter_rate": f"""WITH {SAMPLES} SELECT series, {_tick('ts', 60)} AS at, round(sum(increase) / 60, 6) AS rate
            FROM grown GROUP BY ALL""",
        "counter_rate_sliding": f"""WITH {SAMPLES} SELECT series, {_tick('ts', 900)} + to_minutes((15 * k)::INTEGER) AS at,
            round(sum(increase) / 3600, 6) AS rate FROM grown CROSS JOIN (SELECT unnest(range(0, 4)) AS k) GROUP BY 1, 2""",
        "latency_quantiles": _quantiles(""),
        "latency_quantiles_by_route": _quantiles("handler"),
        "latency_quantiles_1m": _quantiles_at("", 60, 1),
        "latency_quantiles_sliding": _quantiles_at("handler", 900, 4),
        "hit_ratio": f"""WITH {SAMPLES} SELECT {_tick('ts', 3600)} AS at,
            round(sum(CASE WHEN result = 'hit' THEN increase ELSE 0 END) / nullif(sum(increase), 0) * 100, 6) AS hit_ratio_pct
            FROM grown GROUP BY 1""",
        "gauge_last": f"""WITH {SAMPLES} SELECT series, date_trunc('hour', ts) AS interval_start, arg_max(value, ts) AS value
            FROM gauge GROUP BY 1, 2""",
        "request_rate_by_route": f"""WITH {HTTP} SELECT date_trunc('minute', ts) AS window_start, handler,
            round(count(*) / 60, 6) AS rate FROM routed GROUP BY 1, 2""",
        "rate_limit_decisions": f"WITH RECURSIVE {LIMITED_EVENTS}, {limited} SELECT request_id, client_key, allowed FROM walk",
        "rate_limit_stream": f"WITH RECURSIVE {LIMITED_EVENTS}, {limited} SELECT request_id, client_key, allowed FROM walk",
        "rate_limit_by_client": f"""WITH RECURSIVE {LIMITED_EVENTS}, {limited} SELECT client_key, count(*) AS requests,
            count(*) FILTER (WHERE allowed) AS allowed, count(*) FILTER (WHERE NOT allowed) AS throttled FROM walk GROUP BY 1""",
        "rate_limit_hot_client": f"""WITH RECURSIVE {HOT_EVENTS}, {_limiter('asked', Q.HOT_LIMIT, Q.HOT_WINDOW)}
            SELECT request_id, client_key, allowed FROM walk""",
        "rate_limit_repeats": f"""WITH RECURSIVE {HOT_EVENTS}, twice AS (
            SELECT request_id, client_key, CASE WHEN request_id % 11 <> 0 THEN requested_at END AS requested_at
            FROM (SELECT * FROM asked UNION ALL SELECT * FROM asked WHERE request_id % 7 = 0)),
            {_limiter('twice', Q.HOT_LIMIT, Q.HOT_WINDOW)}
            SELECT request_id, client_key, allowed, count(*) AS requests FROM (
              SELECT request_id, client_key, allowed FROM walk
              UNION ALL SELECT request_id, client_key, NULL FROM twice WHERE requested_at IS NULL) GROUP BY 1, 2, 3""",
        "registration_outcomes": f"""WITH RECURSIVE {LINK_REQUESTS}, {_limiter('clean', Q.SPARSE_LIMIT, Q.SPARSE_WINDOW)},
            judged AS (SELECT c.*, CASE WHEN NOT allowed THEN 429
                WHEN NOT (long_url LIKE 'http://%' OR long_url LIKE 'https://%') THEN 400 ELSE 200 END AS status
                FROM clean c JOIN walk w ON c.request_id = w.request_id),
            ids AS (SELECT request_id, row_number() OVER (ORDER BY requested_at, request_id) AS id FROM judged WHERE status = 200)
            SELECT j.request_id, client_key, status, id, CASE WHEN id IS NOT NULL THEN {_token('id')} END AS short_token,
                   CASE WHEN id IS NOT NULL THEN '{Q.BASE_URL}api/v1/redirect/' || {_token('id')} END AS short_url, expires_at
            FROM judged j LEFT JOIN ids i ON j.request_id = i.request_id""",
        "registration_merge": f"""WITH RECURSIVE {LINKS}, {READABLE}
            SELECT id, short_token, long_url, created_at, expires_at FROM links
            UNION ALL SELECT n + (SELECT max(id) FROM links), {_token('n + (SELECT max(id) FROM links)')}, long_url, requested_at, expires_at FROM made""",
        "registration_stored": f"""WITH RECURSIVE {READABLE}
            SELECT n AS id, {_token('n')} AS short_token, long_url, requested_at AS created_at, expires_at FROM made""",
        "rollup_daily": f"WITH {CLICKS} {rollup}",
        "rollup_daily_stream": f"WITH {CLICKS} {rollup}",
        "timeline_from_rollup": f"WITH {CLICKS}, {TIMELINE} SELECT * FROM timeline",
    }
