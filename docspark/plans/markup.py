"""Queries over web pages and HTML wrapping."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import catalog
from docspark.plans import oracle
from docspark.plans.registry import Tables, query


@query(
    "extract_html_body",
    rf"""
SELECT page_id, CASE WHEN NOT regexp_matches(html, '\S') THEN ''
  WHEN regexp_matches(html, '(?is)<body[^>]*>.*</body>')
    THEN {oracle.strip("regexp_extract(html, '(?is)<body[^>]*>(.*)</body>', 1)")}
  WHEN regexp_matches(html, '(?i)<body[^>]*>') THEN {oracle.strip("regexp_extract(html, '(?is)<body[^>]*>(.*)$', 1)")}
  ELSE html END AS body FROM pages""",
)
def extract_html_body(t: Tables):
    return t.pages.select("page_id", catalog.extract_html_body(F.col("html")).alias("body"))


@query(
    "wrap_html",
    """
SELECT conv_id, turn, '<!DOCTYPE html>' || chr(10) || '<html lang="en">' || chr(10) || '<head>' || chr(10)
  || '  <meta charset="UTF-8">' || chr(10) || '  <meta name="viewport" content="width=device-width, initial-scale=1.0">'
  || chr(10) || '  <title>Document</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10) || text || chr(10)
  || '</body>' || chr(10) || '</html>' AS html, text AS unwrapped FROM conversations""",
)
def wrap_html(t: Tables):
    """Turns wrapped as documents and unwrapped again."""
    wrapped = t.conversations.select("conv_id", "turn", catalog.wrap_html(F.col("text")).alias("html"))
    return wrapped.withColumn("unwrapped", catalog.extract_html_body(F.col("html")))
