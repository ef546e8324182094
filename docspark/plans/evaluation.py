"""Queries over detector evaluation: documents labelled low quality play the machine class."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.operators import detect, evaluate
from docspark.plans import oracle
from docspark.plans.registry import Tables, query
from docspark.sources.tables import spread

THRESHOLD = 0.75

SCORED = f"""
WITH lab AS (SELECT doc_id, text, quality FROM documents JOIN labels USING (doc_id)),
{oracle.score_ctes('lab', 'doc_id, quality', 'text')},
frame AS (SELECT doc_id, {oracle.rounded('1.0::DOUBLE - s', 4)} AS score, CAST(1 - quality AS INTEGER) AS class FROM score),
grp AS (SELECT score, sum(class) AS pos, sum(1 - class) AS neg FROM frame GROUP BY score),
run AS (SELECT score, CAST(pos AS BIGINT) AS pos, CAST(neg AS BIGINT) AS neg,
  CAST(sum(pos) OVER (ORDER BY score) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score) AS BIGINT) AS fp,
  sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM grp),
roc AS (SELECT score, pos, neg, tp, fp, tp / p AS tpr, fp / n AS fpr FROM run),
conf AS (SELECT CAST(count(*) FILTER (WHERE score < {THRESHOLD} AND class = 1) AS BIGINT) AS tp,
  CAST(count(*) FILTER (WHERE score < {THRESHOLD} AND class = 0) AS BIGINT) AS fp,
  CAST(count(*) FILTER (WHERE score >= {THRESHOLD} AND class = 1) AS BIGINT) AS fn,
  CAST(count(*) FILTER (WHERE score >= {THRESHOLD} AND class = 0) AS BIGINT) AS tn FROM frame),
f1 AS (SELECT *, CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0.0::DOUBLE END AS f1 FROM conf),
steps AS (SELECT tpr, fpr, lag(tpr, 1, 0.0::DOUBLE) OVER (ORDER BY score) AS tpr0,
  lag(fpr, 1, 0.0::DOUBLE) OVER (ORDER BY score) AS fpr0 FROM roc),
area AS (SELECT sum((fpr - fpr0) * (tpr + tpr0) / 2) AS auc FROM steps),
below AS (SELECT coalesce(max(tpr), 0.0::DOUBLE) AS t FROM roc
  WHERE fpr = (SELECT coalesce(max(fpr), 0.0::DOUBLE) FROM roc WHERE fpr <= 0.0001)),
belowf AS (SELECT coalesce(max(fpr), 0.0::DOUBLE) AS f FROM roc WHERE fpr <= 0.0001),
above AS (SELECT min(fpr) AS f FROM roc WHERE fpr > 0.0001),
abovet AS (SELECT min(tpr) AS t FROM roc WHERE fpr = (SELECT f FROM above)),
interp AS (SELECT b.t + (0.0001::DOUBLE - bf.f) * (hi.t - b.t) / (a.f - bf.f) AS tpr_at_fpr
  FROM below b, belowf bf, above a, abovet hi)"""


def labelled_scores(t: Tables) -> DataFrame:
    """Scores and classes of all labelled texts in one pass."""
    texts = spread(t.documents.select("doc_id", "text").join(t.labels.select("doc_id", "quality"), "doc_id"))
    return detect.fast_detect(texts).select("score", (F.lit(1) - F.col("quality")).cast("int").alias("class"))


@query("detector_f1", SCORED + "\nSELECT tp, fp, fn, tn, round(f1, 8) AS f1 FROM f1")
def detector_f1(t: Tables):
    groups = evaluate.score_groups(labelled_scores(t))
    return evaluate.confusion(groups, THRESHOLD).withColumn("f1", F.round("f1", 8))


@query(
    "detector_roc",
    SCORED + "\nSELECT score, pos, neg, tp, fp, round(tpr, 8) AS tpr, round(fpr, 8) AS fpr FROM roc",
)
def detector_roc(t: Tables):
    roc = evaluate.roc_curve(evaluate.score_groups(labelled_scores(t)))
    return roc.withColumn("tpr", F.round("tpr", 8)).withColumn("fpr", F.round("fpr", 8))


@query("detector_auc", SCORED + "\nSELECT round(auc, 8) AS auc FROM area")
def detector_auc(t: Tables):
    roc = evaluate.roc_curve(evaluate.score_groups(labelled_scores(t)))
    return evaluate.auc(roc).withColumn("auc", F.round("auc", 8))


@query("tpr_at_fpr", SCORED + "\nSELECT round(tpr_at_fpr, 8) AS tpr_at_fpr FROM interp")
def tpr_at_fpr(t: Tables):
    roc = evaluate.roc_curve(evaluate.score_groups(labelled_scores(t)))
    return evaluate.tpr_at_fpr(roc).withColumn("tpr_at_fpr", F.round("tpr_at_fpr", 8))


@query(
    "detector_evaluation",
    SCORED
    + """
SELECT tp, fp, fn, tn, round(f1, 8) AS f1, round(auc, 8) AS auc, round(tpr_at_fpr, 8) AS tpr_at_fpr
FROM f1, area, interp""",
)
def detector_evaluation(t: Tables):
    report = evaluate.evaluate_detector(labelled_scores(t), THRESHOLD)
    return report.select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("f1", "auc", "tpr_at_fpr")])
