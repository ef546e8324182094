"""Queries over machine-text detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import labels, stylometry
from docspark.operators import detect, scorers, segment
from docspark.plans import oracle
from docspark.plans.registry import Tables, query

ROUNDED = ", ".join(f"{oracle.rounded(f, 8)} AS {f}" for f in oracle.FEATURES)
PARAS = rf"""
praw AS (SELECT doc_id, u.i, {oracle.strip('u.p')} AS segment
         FROM documents d, unnest(string_split_regex(text, '\n+')) WITH ORDINALITY AS u(p, i)),
paras AS (SELECT doc_id, segment, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos
          FROM praw WHERE length(segment) > 30)"""


@query(
    "fast_detect",
    f"""
WITH {oracle.score_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, {oracle.rounded('1.0::DOUBLE - s', 4)} AS score,
  {oracle.rounded('1.0::DOUBLE - (1.0::DOUBLE - s)', 4)} AS ai_likeness,
  {oracle.rounded('greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - (1.0::DOUBLE - s))) * 100', 2)} AS ai_percentage,
  CASE WHEN 1.0::DOUBLE - s >= 0.5 THEN 'Most likely human-generated' ELSE 'Most likely AI-generated' END AS prediction,
  1.0::DOUBLE - (1.0::DOUBLE - s) > 0.5 AS is_ai_generated,
  CASE WHEN s > 0.7 THEN 'red' WHEN s >= 0.4 THEN 'yellow' ELSE 'green' END AS band
FROM score""",
)
def fast_detect(t: Tables):
    return detect.fast_detect(t.texts)


@query(
    "stylometric_features",
    f"""
WITH {oracle.feature_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, md5(w) AS window_md5, {ROUNDED} FROM feat""",
)
def stylometric_features(t: Tables):
    windows = segment.sample_windows(t.texts)
    featured = detect.stylometric_features(windows)
    return featured.select(
        "doc_id", F.md5("segment").alias("window_md5"), *[labels.rounded(F.col(k), 8).alias(k) for k in stylometry.FEATURES]
    )


@query(
    "combined_features",
    f"""
WITH {oracle.score_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, {", ".join(f"{oracle.rounded(f, 8)} AS {f}" for f in oracle.FEATURES)}, {oracle.rounded(oracle.SCORE, 8)} AS ai_likeness
FROM avgf""",
)
def combined_features(t: Tables):
    """Features averaged over the windows of each document, from exploded windows."""
    windows = segment.sample_windows(t.texts)
    scored = detect.stylometric_score(detect.combine_windows(detect.stylometric_features(windows)))
    return scored.select(
        "doc_id", *[labels.rounded(F.col(k), 8).alias(k) for k in stylometry.FEATURES], labels.rounded(F.col("ai_likeness"), 8).alias("ai_likeness")
    )


REPORT = f"""
WITH {PARAS},
{oracle.score_ctes('paras', 'doc_id, pos, segment', 'segment')},
agg AS (SELECT doc_id, list_sum(list(s * length(segment) ORDER BY pos)) / sum(length(segment)) AS o, count(*) AS n
  FROM score GROUP BY doc_id),
every AS (SELECT d.doc_id, coalesce(o, 0.5::DOUBLE) AS o, coalesce(n, 0) AS n
          FROM documents d LEFT JOIN agg USING (doc_id))"""


@query(
    "document_report",
    REPORT
    + f"""
SELECT doc_id, {oracle.rounded('o', 8)} AS overall_score, {oracle.percent('o')} AS overall_ai_percentage,
  CAST(100 - {oracle.percent('o')} AS INTEGER) AS overall_human_percentage, o > 0.7 AS is_likely_ai,
  CAST(n AS INTEGER) AS n_segments
FROM every""",
)
def document_report(t: Tables):
    report = detect.detect_paragraphs(t.texts, gap=r"\n+")
    return report.drop("segments").withColumn("overall_score", labels.rounded(F.col("overall_score"), 8))


@query(
    "paragraph_report",
    REPORT
    + f""",
off AS (SELECT *, CAST(coalesce(sum(length(segment) + 2) OVER (PARTITION BY doc_id ORDER BY pos
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st FROM score)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, segment AS text, {oracle.rounded('s', 8)} AS ai_score,
  {oracle.percent('s')} AS ai_percentage, CAST(100 - {oracle.percent('s')} AS INTEGER) AS human_percentage,
  s > 0.7 AS is_ai, st AS start_index, CAST(st + length(segment) AS BIGINT) AS end_index
FROM off""",
)
def paragraph_report(t: Tables):
    report = detect.detect_paragraphs(t.texts, gap=r"\n+")
    return report.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.*").withColumn(
        "ai_score", labels.rounded(F.col("ai_score"), 8)
    )


@query(
    "chunk_report",
    f"""
WITH ch AS (SELECT doc_id, i, substr(text, i * 100 + 1, 100) AS segment
  FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 99) // 100)) AS i FROM documents)),
{oracle.score_ctes('ch', 'doc_id, i, segment', 'segment')},
agg AS (SELECT doc_id, list_sum(list(s * length(segment) ORDER BY i)) / sum(length(segment)) AS o, count(*) AS n,
  count(*) FILTER (WHERE s > 0.7) AS n_ai FROM score GROUP BY doc_id)
SELECT doc_id, {oracle.rounded('o', 8)} AS overall_score, {oracle.percent('o')} AS overall_ai_percentage,
  CAST(100 - {oracle.percent('o')} AS INTEGER) AS overall_human_percentage, o > 0.7 AS is_likely_ai,
  CAST(n AS INTEGER) AS n_segments, CAST(n_ai AS INTEGER) AS n_ai_segments
FROM agg""",
)
def chunk_report(t: Tables):
    report = detect.detect_chunks(t.texts)
    return report.withColumn("n_ai_segments", F.size(F.filter("segments", lambda s: s["is_ai"]))).drop(
        "segments"
    ).withColumn("overall_score", labels.rounded(F.col("overall_score"), 8))


@query(
    "segment_scores",
    f"""
WITH {PARAS}
SELECT doc_id, {oracle.rounded('sum(coalesce(sc, 0.5::DOUBLE) * length(segment)) / sum(length(segment))', 8)} AS overall_score,
  CAST(count(*) AS BIGINT) AS n_segments
FROM (SELECT p.doc_id, p.pos, p.segment,
        CASE WHEN (p.doc_id + p.pos) % 5 <> 0 THEN length(p.segment) % 100 / 100.0::DOUBLE END AS sc FROM paras p)
GROUP BY doc_id""",
)
def segment_scores(t: Tables):
    """Scores delivered apart from the segments (every fifth missing), joined by position and rolled up."""
    paras = segment.split_paragraphs(t.texts, gap=r"\n+")
    scores = paras.filter((F.col("doc_id") + F.col("pos")) % 5 != 0).select(
        "doc_id", "pos", ((F.length("segment") % 100) / F.lit(100.0)).alias("score")
    )
    rolled = detect.weighted_document_score(detect.attach_scores(paras, scores))
    return rolled.withColumn("overall_score", labels.rounded(F.col("overall_score"), 8))


@query(
    "label_shares",
    f"""
WITH sent AS (SELECT doc_id, u.i, u.s AS segment
  FROM documents d, unnest({oracle.sentences('text')}) WITH ORDINALITY AS u(s, i)),
{oracle.score_ctes('sent', 'doc_id, i, segment', 'segment')},
lab AS (SELECT doc_id, CASE WHEN s > 0.5 AND greatest(s, 1.0::DOUBLE - s) >= 0.8 THEN 1 WHEN s > 0.5 THEN 2
  WHEN greatest(s, 1.0::DOUBLE - s) >= 0.8 THEN 3 ELSE 4 END AS k FROM score),
agg AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE k = 1) AS a, count(*) FILTER (WHERE k = 2) AS b,
  count(*) FILTER (WHERE k = 3) AS c, count(*) FILTER (WHERE k = 4) AS d FROM lab GROUP BY doc_id)
SELECT d0.doc_id, CAST(coalesce(n, 0) AS INTEGER) AS n_sentences,
  CASE WHEN n > 0 THEN round(a / n * 100, 2) ELSE 0.0::DOUBLE END AS ai_share,
  CASE WHEN n > 0 THEN round(b / n * 100, 2) ELSE 0.0::DOUBLE END AS ai_refined_share,
  CASE WHEN n > 0 THEN round(c / n * 100, 2) ELSE 0.0::DOUBLE END AS human_share,
  CASE WHEN n > 0 THEN round(agg.d / n * 100, 2) ELSE 0.0::DOUBLE END AS human_refined_share
FROM documents d0 LEFT JOIN agg USING (doc_id)""",
)
def label_shares(t: Tables):
    return detect.classify_sentences(t.texts)


@query(
    "dedup_scoring",
    f"""
WITH {oracle.score_ctes('documents', 'doc_id', 'text')},
h AS (SELECT doc_id, sha256(text) AS text_hash, count(*) OVER (PARTITION BY text) AS copies FROM documents)
SELECT doc_id, text_hash, {oracle.rounded('s', 8)} AS ai_likeness, CAST(copies AS BIGINT) AS copies FROM h JOIN score USING (doc_id)""",
)
def dedup_scoring(t: Tables):
    return detect.dedup_scoring(t.texts).withColumn(
        "ai_likeness", labels.rounded(F.col("ai_likeness"), 8)
    )


@query(
    "neutral_labels",
    """
SELECT doc_id, coalesce(h, 0.5::DOUBLE) AS score,
  CASE WHEN h IS NULL THEN 'unknown' WHEN h >= 0.8536432310785527 THEN 'Most likely human-generated'
    ELSE 'Most likely AI-generated' END AS low_fpr,
  CASE WHEN h IS NULL THEN 'unknown' WHEN h >= 0.9015310749276843 THEN 'Most likely human-generated'
    ELSE 'Most likely AI-generated' END AS accuracy,
  CAST(floor(coalesce(h, 0.5::DOUBLE) * 100 + 0.5) AS INTEGER) AS score_percent
FROM (SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN (n_chars % 101) / 100.0::DOUBLE END AS h
      FROM documents d LEFT JOIN labels l USING (doc_id))""",
)
def neutral_labels(t: Tables):
    """Labels at two operating points where only some documents have a score."""
    scores = t.labels.select("doc_id").join(t.documents.select("doc_id", "n_chars"), "doc_id").select(
        "doc_id", ((F.col("n_chars") % 101) / F.lit(100.0)).alias("h")
    )
    joined = t.documents.select("doc_id").join(scores, "doc_id", "left")
    return joined.select(
        "doc_id",
        labels.neutral(F.col("h")).alias("score"),
        labels.label_by_threshold(F.col("h"), "low-fpr").alias("low_fpr"),
        labels.label_by_threshold(F.col("h"), "accuracy").alias("accuracy"),
        labels.percent(labels.neutral(F.col("h"))).alias("score_percent"),
    )


VOWEL_SCORES = """
SELECT doc_id, CASE WHEN NOT contains(text, 'token = ') THEN
    len(regexp_extract_all(text, '[aeiou]')) / greatest(length(text), 1) END AS score,
  CASE WHEN contains(text, 'token = ') THEN 'scoring_failed' END AS error FROM documents"""


def vowel_model():
    """A stand-in for a model: the share of plain vowels; a batch with a text that holds a token is refused."""
    def load_model():
        def score(texts):
            if any("token = " in x for x in texts):
                raise ValueError("refused")
            return [sum(x.count(v) for v in "aeiou") / max(1, len(x)) for x in texts]

        return score

    return load_model


@query("external_scorer", VOWEL_SCORES)
def external_scorer(t: Tables):
    """An external model that refuses some texts."""
    return scorers.score_with(t.texts, vowel_model())


@query("scorer_in_sql", VOWEL_SCORES)
def scorer_in_sql(t: Tables):
    """The same model as a table function in SQL."""
    scorers.register_table_function(t.spark, "vowel_score", vowel_model())
    return t.spark.sql("SELECT * FROM vowel_score(TABLE(SELECT doc_id, text FROM {docs}))", docs=t.texts)
