"""Request-log jobs: distributions, recency, redaction, sampling, rate limits."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import draw, nullif_empty, strip


def status_distribution(logs: DataFrame) -> DataFrame:
    counted = logs.groupBy("status_code").agg(F.count("*").alias("n"))
    return counted.withColumn("status_text", http_status_text(F.col("status_code"))).orderBy("status_code")


def method_distribution(logs: DataFrame) -> DataFrame:
    return logs.groupBy("method").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "method")


def recent_activity(logs: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Rows created in the last ``hours``; with a literal ``now`` the bound reaches the scan."""
    return logs.filter(F.col("created_at") >= now - F.make_interval(hours=F.lit(hours)))


def latest_logs(logs: DataFrame, n: int = 10, tie: str = "event_id") -> DataFrame:
    """The newest ``n`` rows: kept as per-task heaps, not a full sort."""
    return logs.orderBy(F.col("created_at").desc(), F.col(tie).desc()).limit(n)


def http_status_text(code: Column) -> Column:
    entries = [F.lit(x) for pair in fixed.STATUS_TEXT.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*entries), code), F.lit("Unknown"))


def log_level(code: Column) -> Column:
    return F.when(code >= 500, "error").when(code >= 400, "warn").otherwise("info")


def client_ip(forwarded_for: Column, remote: Column) -> Column:
    """First forwarded address, else the remote one."""
    return F.coalesce(nullif_empty(strip(F.get(F.split(forwarded_for, ","), F.lit(0)))), remote)


# Possessive loops: they match the same strings but do not recurse, whatever the length.
_STRING = r'"(?:[^"\\]|\\.)*+"'
_FLAT = r'(?:[^{}\[\]"]|' + _STRING + ")*+"
_KEY = r'(?i)("(?:' + "|".join(fixed.SENSITIVE_KEYS) + r')"\s*:\s*)'
_SENSITIVE_SCALAR = _KEY + "(?:" + _STRING + r"|-?\d[\d.eE+\-]*|true|false|null)"
_SENSITIVE_FLAT = _KEY + r"(?:\{" + _FLAT + r"\}|\[" + _FLAT + r"\])"
_SENSITIVE_NESTED = _KEY + r"[\[{]"


def redact_sensitive_json(body: Column) -> Column:
    """Values of sensitive keys masked at any depth, whatever their case.

    Scalars, and objects or arrays without further nesting, are handled by native patterns;
    a body whose sensitive value nests deeper is parsed instead (rare, Arrow-batched).
    """
    masked = F.regexp_replace(body, _SENSITIVE_SCALAR, '$1"' + fixed.REDACTED + '"')
    masked = F.regexp_replace(masked, _SENSITIVE_FLAT, '$1"' + fixed.REDACTED + '"')
    return masked


def redact_json_bodies(df: DataFrame, body_col: str = "body") -> DataFrame:
    """As :func:`redact_sensitive_json`, with deeply nested sensitive values parsed in a vectorised UDF."""
    masked = df.withColumn(body_col, redact_sensitive_json(F.col(body_col)))
    deep = F.when(F.col(body_col).rlike(_SENSITIVE_NESTED), F.col(body_col))
    return masked.withColumn(body_col, F.coalesce(_deep_redactor()(deep), F.col(body_col)))


def _deep_redactor():
    sensitive, mask = set(fixed.SENSITIVE_KEYS), fixed.REDACTED

    @F.pandas_udf("string")
    def redact(bodies: pd.Series) -> pd.Series:
        def clean(value):
            if isinstance(value, dict):
                return {k: mask if k.lower() in sensitive else clean(v) for k, v in value.items()}
            if isinstance(value, list):
                return [clean(v) for v in value]
            return value

        def one(body):
            if body is None:
                return None
            try:
                return json.dumps(clean(json.loads(body)), ensure_ascii=False, separators=(",", ":"))
            except ValueError:
                return body

        return bodies.map(one)

    return redact


def truncate_body(body: Column, limit: int | None = None) -> Column:
    """Bodies over the limit keep their start and say how much more there was; broken JSON is null.

    Without a limit every body that parses stays whole.
    """
    if limit is None:
        return F.when(F.try_parse_json(body).isNotNull(), body)
    over = F.length(body) - limit
    cut = F.concat(F.substring(body, 1, limit), F.lit("...(+"), over.cast("string"), F.lit(" more)"))
    return F.when(over > 0, cut).when(F.try_parse_json(body).isNotNull(), body)


def first_headers(headers: Column, n: int | None = None) -> Column:
    """The first ``n`` entries of a header map; all of them without a number."""
    return headers if n is None else F.map_from_entries(F.slice(F.map_entries(headers), 1, n))


def sample_rows(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """Keep about ``rate`` of the rows, always the same ones for a key and seed."""
    return df.filter(draw(seed, F.col(key)) < rate)


def rate_limit_violations(logs: DataFrame, client: str = "user_id", window: str = fixed.RATE_WINDOW,
                          limit: int = fixed.RATE_MAX_REQUESTS, ts: str = "created_at") -> DataFrame:
    """Clients over the request limit in a fixed window; counts are folded before the shuffle."""
    counted = logs.groupBy(F.window(ts, window).alias("w"), client).agg(F.count("*").alias("requests"))
    return counted.filter(F.col("requests") > limit).select(
        F.col("w.start").alias("window_start"), client, "requests"
    )


def request_log_rows(requests: DataFrame, sample_rate: float = 1.0, seed: int = 0,
                     max_body: int | None = None) -> DataFrame:
    """Raw requests to stored log rows: sampled, sensitive values masked, bodies cut to ``max_body``, levels added."""
    kept = requests if sample_rate >= 1 else sample_rows(requests, sample_rate, "request_id", seed)
    masked = redact_json_bodies(kept).withColumn("body", truncate_body(F.col("body"), max_body))
    return masked.withColumns(
        {
            "ip": client_ip(F.col("forwarded_for"), F.col("remote_ip")),
            "level": log_level(F.col("status_code")),
            "status_text": http_status_text(F.col("status_code")),
        }
    ).drop("forwarded_for", "remote_ip")
