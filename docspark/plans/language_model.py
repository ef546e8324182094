"""Queries over the bigram models: observer fitted on ``benchmark``, performer on ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import cross_perplexity as cp
from docspark.plans import oracle
from docspark.plans.registry import Tables, query

WORDS = f"list_transform(regexp_extract_all(text, '{oracle.WORD}'), lambda x: lower(x))"
PAIRS = "unnest(list_transform(range(1, len(w) + 1), lambda i: {'ctx': w[i], 'tok': coalesce(w[i + 1], '')}))"

COUNTS = f"""
WITH dtok AS (SELECT doc_id, {PAIRS} AS b FROM (SELECT doc_id, {WORDS} AS w FROM documents)),
btok AS (SELECT {PAIRS} AS b FROM (SELECT {WORDS} AS w FROM benchmark)),
counts AS (SELECT ctx, tok, CAST(sum(p) AS BIGINT) AS np, CAST(sum(q) AS BIGINT) AS nq FROM (
  SELECT b.ctx AS ctx, b.tok AS tok, 1 AS p, 0 AS q FROM btok
  UNION ALL SELECT b.ctx, b.tok, 0, 1 FROM dtok) GROUP BY ctx, tok)"""


def model(a: str, k: str) -> str:
    return (
        COUNTS
        + f""",
v AS (SELECT count(DISTINCT ctx) AS v FROM counts),
ctx AS (SELECT ctx,
  v * pow({k}, {a}) + coalesce(sum(pow(np + {k}, {a}) - pow({k}, {a})) FILTER (WHERE tok <> ''), 0) AS zp,
  v * pow({k}, {a}) + coalesce(sum(pow(nq + {k}, {a}) - pow({k}, {a})) FILTER (WHERE tok <> ''), 0) AS zq,
  coalesce(sum(pow(np + {k}, {a}) * ln((nq + {k}) / {k})) FILTER (WHERE tok <> '' AND nq > 0), 0) AS g
  FROM counts, v GROUP BY ctx, v),
ctx2 AS (SELECT ctx, zq, ln(zq) - {a} * ln({k}) - {a} * g / zp AS x FROM ctx),
tokens AS (SELECT doc_id, d.b.tok AS tok, CASE WHEN d.b.tok <> '' THEN ln(zq) - {a} * ln(nq + {k}) END AS nll, x
  FROM dtok d JOIN counts c ON c.ctx = d.b.ctx AND c.tok = d.b.tok JOIN ctx2 ON ctx2.ctx = d.b.ctx)"""
    )


def scores(a: str, k: str, middle: str) -> str:
    return (
        model(a, k)
        + f""",
per AS (SELECT doc_id, count(*) AS n, {middle}(nll) AS ppl, {middle}(x) AS xp FROM tokens GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_tokens, round(ppl, 6) AS ppl, round(xp, 6) AS x_ppl,
  coalesce(n, 0) >= 64 AS scorable, CASE WHEN coalesce(n, 0) >= 64 THEN round(ppl / xp, 6) END AS score
FROM documents d LEFT JOIN per USING (doc_id)"""
    )


def _rounded(df):
    return df.select(
        "doc_id", "n_tokens", "scorable", *[F.round(c, 6).alias(c) for c in ("ppl", "x_ppl", "score")]
    )


@query("bigram_counts", COUNTS + "\nSELECT ctx, tok, np, nq FROM counts")
def bigram_counts(t: Tables):
    return cp.fit_counts(t.benchmark, t.texts)


@query("context_cross_entropy", model("1.0::DOUBLE", "1.0::DOUBLE") + "\nSELECT ctx, round(x, 6) AS x FROM ctx2")
def context_cross_entropy(t: Tables):
    return cp.context_table(cp.fit_counts(t.benchmark, t.texts)).select("ctx", F.round("x", 6).alias("x"))


@query("cross_perplexity", scores("1.0::DOUBLE", "1.0::DOUBLE", "avg"))
def cross_perplexity(t: Tables):
    return _rounded(cp.cross_perplexity(t.texts, t.benchmark))


@query("cross_perplexity_median", scores("0.5::DOUBLE", "0.5::DOUBLE", "median"))
def cross_perplexity_median(t: Tables):
    """Median variant with temperature 2."""
    return _rounded(cp.cross_perplexity(t.texts, t.benchmark, add_k=0.5, temperature=2.0, median=True))
