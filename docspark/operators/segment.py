"""Text segmentation: one row per paragraph, chunk, window, sentence, line, token list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import fixed, stylometry
from docspark.functions.expr import strip

PARAGRAPH_GAP = r"\n\n+"


def paragraphs_of(text: Column, gap: str = PARAGRAPH_GAP, min_chars: int = fixed.MIN_PARAGRAPH_CHARS) -> Column:
    """Trimmed blank-line blocks longer than ``min_chars``."""
    return F.filter(F.transform(F.split(text, gap), strip), lambda p: F.length(p) > min_chars)


def chunks_of(text: Column, width: int = fixed.CHUNK_CHARS) -> Column:
    """Fixed-width pieces in one linear pass; the last may be shorter."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{width}}}"), F.lit(0))


def _explode(df: DataFrame, pieces: Column, name: str, text_col: str) -> DataFrame:
    kept = [c for c in df.columns if c != text_col]
    return df.select(*kept, F.posexplode(pieces).alias("pos", name))


def split_paragraphs(df: DataFrame, text_col: str = "text", gap: str = PARAGRAPH_GAP,
                     min_chars: int = fixed.MIN_PARAGRAPH_CHARS) -> DataFrame:
    return _explode(df, paragraphs_of(F.col(text_col), gap, min_chars), "segment", text_col)


def chunk_text(df: DataFrame, text_col: str = "text", width: int = fixed.CHUNK_CHARS) -> DataFrame:
    """Chunks with their character offsets."""
    return (
        _explode(df, chunks_of(F.col(text_col), width), "segment", text_col)
        .withColumn("start_index", F.col("pos") * width)
        .withColumn("end_index", F.col("start_index") + F.length("segment"))
    )


def sample_windows(df: DataFrame, text_col: str = "text", window: int = fixed.WINDOW_CHARS,
                   max_windows: int | None = None) -> DataFrame:
    """One row per window: the whole text in tiles, or ``max_windows`` windows spread over it."""
    return _explode(df, stylometry.windows_of(F.col(text_col), window, max_windows), "segment", text_col)


def split_sentences(df: DataFrame, text_col: str = "text") -> DataFrame:
    return _explode(df, stylometry.sentences_of(F.col(text_col)), "segment", text_col)


def split_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Lines in order, blank ones kept in place."""
    return _explode(df, F.split(F.col(text_col), "\n"), "segment", text_col)


def join_segments(df: DataFrame, key: str = "doc_id", separator: str = "\n") -> DataFrame:
    """Inverse of a split: segments of a key joined in position order.

    The group is one document, which was a single row before it was split.
    """
    ordered = F.sort_array(F.collect_list(F.struct("pos", "segment")))
    return df.groupBy(key).agg(
        F.array_join(F.transform(ordered, lambda s: s["segment"]), separator).alias("text")
    )


def tokenize_words(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``words``: the alphabetic tokens."""
    return df.withColumn("words", stylometry.words_of(F.col(text_col)))


def tokenize_counts(text: Column) -> Column:
    """Number of word-or-symbol tokens, used by the rewriting counts."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"))


def word_ngrams(df: DataFrame, n: int = 3, text_col: str = "text") -> DataFrame:
    """Adds ``ngrams``: lower-cased space-joined word n-grams."""
    lowered = F.transform(stylometry.words_of(F.col(text_col)), F.lower)
    return df.withColumn("ngrams", stylometry.ngrams_of(lowered, n))


OFFSET_BLOCK = 1024


def segment_offsets(df: DataFrame, separator_chars: int, key: str = "doc_id", block: int = OFFSET_BLOCK) -> DataFrame:
    """Running start and end offset of each segment; ``separator_chars`` lie between segments.

    Runs inside blocks of ``block`` positions; each block starts at the total width of the
    blocks before it, so no task has to hold all segments of one document.
    """
    placed = df.withColumn("_block", F.floor(F.col("pos") / block)).withColumn(
        "_width", (F.length("segment") + separator_chars).cast("bigint")
    )
    earlier = W.partitionBy(key).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = placed.groupBy(key, "_block").agg(F.sum("_width").alias("_sum")).select(
        key, "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base")
    )
    inside = W.partitionBy(key, "_block").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_width").over(inside), F.lit(0)))
    start = F.col("_base") + F.col("_local")
    return (
        local.join(starts, [key, "_block"])
        .withColumn("start_index", start)
        .withColumn("end_index", F.col("start_index") + F.length("segment"))
        .select(*df.columns, "start_index", "end_index")
    )


def with_rejection(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``reason``: why the row cannot be processed, null when it can."""
    text = F.col(text_col)
    reason = F.when(text.isNull(), "missing text").when(~text.rlike(r"\S"), "empty text")
    return df.withColumn("reason", reason)


def reject_empty(df: DataFrame, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Split into usable rows and quarantined rows with a reason."""
    marked = with_rejection(df, text_col)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def token_gate(df: DataFrame, min_tokens: int = 64, max_tokens: int | None = None,
               words_col: str = "words") -> DataFrame:
    """Marks documents long enough to be scored; a model's ``max_tokens`` also cuts the scored tokens."""
    words = F.col(words_col)
    gated = df.withColumn("n_tokens", F.size(words)).withColumn("scorable", F.col("n_tokens") >= min_tokens)
    if max_tokens is None:
        return gated
    return gated.withColumn("truncated", F.col("n_tokens") > max_tokens).withColumn(
        words_col, F.slice(words, 1, max_tokens)
    )
