"""Machine-text detection: features, scores, labels, per-document reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, labels, stylometry
from docspark.functions.expr import let, prefix_sums, total
from docspark.operators.segment import chunks_of, paragraphs_of
from docspark.operators.skew import balanced_join
from docspark.session import cut_lineage

Scorer = Callable[[Column], Column]


def stylometric_features(df: DataFrame, text_col: str = "segment") -> DataFrame:
    """Adds the eight features of one window of text."""
    measured = df.withColumn("_m", stylometry.measure(F.col(text_col)))
    featured = measured.withColumn("_f", stylometry.features_of(F.col("_m")))
    return featured.select(*df.columns, *[F.col("_f")[k].alias(k) for k in stylometry.FEATURES])


def combine_windows(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Mean of each feature over the windows of a document."""
    return df.groupBy(key).agg(*[F.avg(k).alias(k) for k in stylometry.FEATURES])


def stylometric_score(df: DataFrame) -> DataFrame:
    """Adds ``ai_likeness`` from the averaged feature columns."""
    return df.withColumn(
        "ai_likeness", stylometry.score_features(F.struct(*[F.col(k) for k in stylometry.FEATURES]))
    )


def document_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Window-averaged features and ``ai_likeness`` per document, without leaving the row.

    The features are one bound expression rather than a chain of columns: the optimizer
    inlines column chains into pushed-down filters, which would repeat the work many times.
    """
    kept = [c for c in df.columns if c != text_col]
    staged = df.select(*kept, stylometry.fast_features(F.col(text_col)).alias("_avg"))
    return staged.select(*kept, "_avg.*", let(F.col("_avg"), stylometry.score_features).alias("ai_likeness"))


def fast_detect(df: DataFrame, text_col: str = "text", mode: str = "fast",
                inverted_output: bool = False) -> DataFrame:
    """Score, label and percentages per document.

    ``ai_likeness`` grows with machine-like traits and ``score`` is its complement, so the
    label rule "human at or above the threshold" holds. ``inverted_output`` reproduces the
    other published orientation, where the raw stylometric value itself is the score.
    """
    kept = [c for c in df.columns if c != text_col]
    scored = df.select(*kept, stylometry.fast_score(F.col(text_col)).alias("_s"))
    human = F.col("_s") if inverted_output else F.lit(1.0) - F.col("_s")
    scored = scored.withColumn("_human", human)
    likeness = F.lit(1.0) - F.col("_human")
    return scored.select(
        *kept,
        labels.rounded(F.col("_human"), 4).alias("score"),
        labels.rounded(likeness, 4).alias("ai_likeness"),
        labels.percent2(likeness).alias("ai_percentage"),
        labels.label_by_threshold(F.col("_human"), mode).alias("prediction"),
        (likeness > 0.5).alias("is_ai_generated"),
        labels.traffic_light(likeness).alias("band"),
    )


def segment_struct(segments: Column, scorer: Scorer, separator_chars: int) -> Column:
    """Array of scored segments with running offsets, for a bound array of segment texts."""
    scored = F.transform(segments, lambda s: labels.neutral(scorer(s)))

    def assemble(scores: Column, starts: Column) -> Column:
        return F.transform(
            segments,
            lambda s, i: F.struct(
                i.alias("pos"),
                s.alias("text"),
                F.get(scores, i).alias("ai_score"),
                labels.percent(F.get(scores, i)).alias("ai_percentage"),
                (F.lit(100) - labels.percent(F.get(scores, i))).alias("human_percentage"),
                (F.get(scores, i) > fixed.THRESHOLDS["backend"]).alias("is_ai"),
                F.get(starts, i).alias("start_index"),
                (F.get(starts, i) + F.length(s)).alias("end_index"),
            ),
        )

    widths = F.transform(segments, lambda s: (F.length(s) + separator_chars).cast("bigint"))
    return let(scored, lambda sc: let(prefix_sums(widths), lambda st: assemble(sc, st)))


def weighted_score(segments: Column) -> Column:
    """Length-weighted mean of the segment scores; no segments gives the neutral score."""
    lengths = total(F.transform(segments, lambda s: F.length(s["text"])))
    weighted = total(F.transform(segments, lambda s: s["ai_score"] * F.length(s["text"])))
    return F.when(F.size(segments) > 0, weighted / lengths).otherwise(F.lit(fixed.NEUTRAL_SCORE))


def detect_paragraphs(df: DataFrame, scorer: Scorer = stylometry.fast_score, text_col: str = "text",
                      gap: str = r"\n\n+") -> DataFrame:
    """Per-document report over scored paragraphs, computed inside the document's row."""
    return _report(df, paragraphs_of(F.col(text_col), gap), scorer, fixed.PARAGRAPH_BREAK_CHARS, text_col)


def detect_chunks(df: DataFrame, scorer: Scorer = stylometry.fast_score, text_col: str = "text",
                  width: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Per-document report over scored fixed-width chunks."""
    return _report(df, chunks_of(F.col(text_col), width), scorer, 0, text_col)


def _report(df: DataFrame, segments: Column, scorer: Scorer, separator_chars: int, text_col: str) -> DataFrame:
    kept = [c for c in df.columns if c != text_col]
    scored = df.select(*kept, let(segments, lambda s: segment_struct(s, scorer, separator_chars)).alias("segments"))
    overall = scored.withColumn("overall_score", weighted_score(F.col("segments")))
    return overall.select(
        *kept,
        "overall_score",
        labels.percent(F.col("overall_score")).alias("overall_ai_percentage"),
        (F.lit(100) - labels.percent(F.col("overall_score"))).alias("overall_human_percentage"),
        (F.col("overall_score") > fixed.THRESHOLDS["backend"]).alias("is_likely_ai"),
        F.size("segments").alias("n_segments"),
        "segments",
    )


def attach_scores(segments: DataFrame, scores: DataFrame, key: str = "doc_id") -> DataFrame:
    """Positional join of segments with externally computed scores; a missing one is neutral."""
    joined = segments.join(scores.select(key, "pos", "score"), [key, "pos"], "left")
    return joined.withColumn("score", labels.neutral(F.col("score")))


def weighted_document_score(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """Length-weighted score of externally scored segments."""
    lengths = F.sum(F.length("segment"))
    return df.groupBy(key).agg(
        F.coalesce(F.sum(F.col("score") * F.length("segment")) / lengths, F.lit(fixed.NEUTRAL_SCORE)).alias(
            "overall_score"
        ),
        F.count("*").alias("n_segments"),
    )


def classify_sentences(df: DataFrame, scorer: Scorer | None = None, threshold: float = 0.8,
                       text_col: str = "text") -> DataFrame:
    """Shares of the four sentence labels per document.

    The two-class label and its confidence come from one machine-likeness score: FAKE with
    that confidence when it is above one half, REAL with the complement otherwise. Without a
    ``scorer`` it is the stylometric one, and sentences whose label is settled earlier are not scored to the end.
    A document without text has no sentences.
    """
    kept = [c for c in df.columns if c != text_col]

    def label(s: Column) -> Column:
        return labels.sentence_label(
            F.when(s > 0.5, "FAKE").otherwise("REAL"), F.greatest(s, F.lit(1.0) - s), threshold
        )

    if scorer:
        marks = F.transform(stylometry.sentences_of(F.col(text_col)), lambda s: let(scorer(s), label))
    else:
        sentences = stylometry.sentences_of(stylometry.lowered(F.col(text_col)))
        marks = F.transform(sentences, lambda s: stylometry.sentence_verdict(s, label))
    marked = df.select(*kept, marks.alias("_labels"))
    n = F.coalesce(F.size("_labels"), F.lit(0))

    def share(name: str) -> Column:
        hits = F.size(F.filter("_labels", lambda x: x == name))
        return F.when(n > 0, F.round(hits / n * 100, 2)).otherwise(F.lit(0.0))

    return marked.select(
        *kept,
        n.alias("n_sentences"),
        *[share(name).alias(alias) for name, alias in zip(fixed.SENTENCE_LABELS, LABEL_COLUMNS)],
    )


LABEL_COLUMNS = ["ai_share", "ai_refined_share", "human_share", "human_refined_share"]


def dedup_scoring(df: DataFrame, scorer: Scorer = stylometry.fast_score, key: str = "doc_id",
                  text_col: str = "text", fold: bool = False) -> DataFrame:
    """Score of every text with its hash and the number of its copies.

    A native scorer runs in the row, for a score costs less than moving the text. With ``fold`` identical texts are
    folded map-side and scored once, which pays for expensive scorers. Either way the narrow table is written once, and
    the join of the counts spreads any text that owns a large share of the rows.
    """
    text_hash = F.sha2(text_col, 256).alias("text_hash")
    if fold:
        distinct = df.groupBy(text_hash).agg(F.first(text_col).alias("_text"), F.count("*").alias("copies"))
        scored = cut_lineage(distinct.select("text_hash", "copies", scorer(F.col("_text")).alias("ai_likeness")))
        return balanced_join(df.select(key, text_hash), scored, ["text_hash"], scored, [key], count_col="copies")
    rows = cut_lineage(df.select(key, text_hash, scorer(F.col(text_col)).alias("ai_likeness")))
    counts = rows.groupBy("text_hash").agg(F.count("*").alias("copies"))
    joined = balanced_join(rows, counts, ["text_hash"], counts, [key], count_col="copies")
    return joined.select("text_hash", key, "copies", "ai_likeness")
