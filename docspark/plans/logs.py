"""Queries over request logs; events play requests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.operators import logs
from docspark.plans import oracle, views
from docspark.plans.registry import Tables, query

WITH = f"WITH {views.REQUEST_LOGS}"
NOW = dt.datetime(2024, 1, 20, 12, 0, 0)
LEVELS = """CASE WHEN status_code >= 500 THEN 'error' WHEN status_code >= 400 THEN 'warn' ELSE 'info' END"""
TEXTS = """CASE status_code WHEN 200 THEN 'OK' WHEN 201 THEN 'Created' WHEN 400 THEN 'Bad Request' WHEN 401 THEN
  'Unauthorized' WHEN 403 THEN 'Forbidden' WHEN 404 THEN 'Not Found' WHEN 500 THEN 'Internal Server Error'
  ELSE 'Unknown' END"""


@query(
    "status_distribution",
    WITH + f"\nSELECT status_code, CAST(count(*) AS BIGINT) AS n, {TEXTS} AS status_text FROM request_logs GROUP BY 1",
)
def status_distribution(t: Tables):
    return logs.status_distribution(views.request_logs(t))


@query("method_distribution", WITH + "\nSELECT method, CAST(count(*) AS BIGINT) AS n FROM request_logs GROUP BY 1")
def method_distribution(t: Tables):
    return logs.method_distribution(views.request_logs(t))


@query(
    "recent_activity",
    WITH
    + """
SELECT CAST(count(*) AS BIGINT) AS n FROM request_logs
WHERE created_at >= TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 24 HOURS""",
)
def recent_activity(t: Tables):
    return logs.recent_activity(views.request_logs(t), F.lit(NOW).cast("timestamp_ntz")).agg(F.count("*").alias("n"))


@query(
    "latest_logs",
    WITH + "\nSELECT * FROM request_logs ORDER BY created_at DESC, event_id DESC LIMIT 10",
)
def latest_logs(t: Tables):
    """The report's ten newest requests."""
    return logs.latest_logs(views.request_logs(t))


@query(
    "log_levels",
    WITH
    + f"""
SELECT method, {LEVELS} AS level, {TEXTS} AS status_text, CAST(count(*) AS BIGINT) AS n,
  round(avg(response_time), 6) AS avg_time FROM request_logs GROUP BY ALL""",
)
def log_levels(t: Tables):
    marked = views.request_logs(t).withColumn("level", logs.log_level(F.col("status_code"))).withColumn(
        "status_text", logs.http_status_text(F.col("status_code"))
    )
    return marked.groupBy("method", "level", "status_text").agg(
        F.count("*").alias("n"), F.round(F.avg("response_time"), 6).alias("avg_time")
    )


def raw_requests(t: Tables) -> DataFrame:
    """Events as raw requests with nested JSON bodies holding secrets, and forwarded addresses."""
    e = F.col("event_id")
    user = F.col("user_id").cast("string")
    body = F.concat(
        F.lit('{"user":"'), user, F.lit('","Password":"p'), user, F.lit('","nested":{"token":'), e.cast("string"),
        F.lit(',"list":[{"JWT":"a\\"b"},{"ok":true}]},"payload":'), F.col("body"), F.lit("}"),
    )
    forwarded = F.when(e % 3 == 0, F.concat(F.lit(" 10.0.0."), (e % 250).cast("string"), F.lit(", 172.16.0.1"))).when(
        e % 3 == 1, F.lit("")
    )
    return views.request_logs(t).select(
        e.alias("request_id"), "created_at", "method", "status_code", "user_id", "response_time", body.alias("body"),
        forwarded.alias("forwarded_for"), F.concat(F.lit("192.168.1."), (e % 200).cast("string")).alias("remote_ip"),
    )


MASKED = """'{"user":"' || user_id || '","Password":"[REDACTED]","nested":{"token":"[REDACTED]","list":[{"JWT":"[REDACTED]"},{"ok":true}]},"payload":' || body || '}'"""
IP = "CASE WHEN event_id % 3 = 0 THEN '10.0.0.' || (event_id % 250) ELSE '192.168.1.' || (event_id % 200) END"


@query("redact_json", WITH + f"\nSELECT event_id AS request_id, {MASKED} AS body FROM request_logs")
def redact_json(t: Tables):
    return raw_requests(t).select("request_id", logs.redact_sensitive_json(F.col("body")).alias("body"))


@query(
    "request_log_rows",
    WITH
    + f"""
SELECT event_id AS request_id, created_at, method, status_code, user_id, response_time, {MASKED} AS body, {IP} AS ip,
  {LEVELS} AS level, {TEXTS} AS status_text FROM request_logs""",
)
def request_log_rows(t: Tables):
    return logs.request_log_rows(raw_requests(t), max_body=fixed.MAX_BODY_CHARS)


@query(
    "sampled_logs",
    WITH
    + f"""
SELECT event_id AS request_id, method FROM request_logs WHERE {oracle.draw("'0'", 'event_id')} < 0.25""",
)
def sampled_logs(t: Tables):
    """A reproducible quarter of the requests, the sampling the log store applies."""
    return logs.sample_rows(raw_requests(t), 0.25, "request_id").select("request_id", "method")


@query(
    "truncate_body",
    """
SELECT conv_id, turn, CASE WHEN length(b) > 2000 THEN substr(b, 1, 2000) || '...(+' || (length(b) - 2000) || ' more)'
  WHEN turn % 4 <> 3 THEN b END AS body
FROM (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '{"text": broken ' || repeat(replace(text, chr(10), ' '), 3)
  ELSE '{"text":"' || repeat(replace(text, chr(10), ' '), 3) || '"}' END AS b FROM conversations)""",
)
def truncate_body(t: Tables):
    """Bodies over the limit cut, short ones kept when they parse; each turn's text three times over."""
    text = F.repeat(F.replace("text", F.lit("\n"), F.lit(" ")), 3)
    body = F.when(F.col("turn") % 4 == 3, F.concat(F.lit('{"text": broken '), text)).otherwise(
        F.concat(F.lit('{"text":"'), text, F.lit('"}'))
    )
    return t.conversations.select("conv_id", "turn", logs.truncate_body(body, fixed.MAX_BODY_CHARS).alias("body"))


@query(
    "first_headers",
    """
SELECT doc_id, CAST(n AS INTEGER) AS headers, CAST(least(n, 50) AS INTEGER) AS kept FROM (
  SELECT doc_id, len(list_distinct(regexp_extract_all(text, '[A-Za-z]+'))) AS n FROM documents)""",
)
def first_headers(t: Tables):
    """Header maps cut to 50 entries: each document's distinct words as header names."""
    words = F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)))
    heads = t.texts.select("doc_id", words.alias("w")).select(
        "doc_id", F.map_from_arrays("w", F.transform("w", F.length)).alias("h")
    )
    return heads.select(
        "doc_id", F.size("h").alias("headers"), F.size(logs.first_headers(F.col("h"), fixed.MAX_HEADERS)).alias("kept")
    )


@query(
    "rate_limit",
    """
SELECT time_bucket(INTERVAL 15 MINUTES, created_at) AS window_start, c AS client, CAST(count(*) AS BIGINT) AS requests
FROM (SELECT ts AS created_at, event_type AS c FROM events) GROUP BY 1, 2 HAVING count(*) > 1""",
)
def rate_limit(t: Tables):
    """Event types with more than one event in a quarter of an hour."""
    return logs.rate_limit_violations(
        t.events.select(F.col("ts").alias("created_at"), F.col("event_type").alias("client")), "client", limit=1
    )
