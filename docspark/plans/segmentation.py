"""Queries over segmentation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import let
from docspark.operators import segment
from docspark.plans import oracle
from docspark.plans.registry import Tables, query

#: Tasks per input partition that fold word n-grams.
NGRAM_TASKS = 8


@query(
    "chunk_offsets",
    r"""
SELECT doc_id, CAST(i AS INTEGER) AS pos, substr(text, i * 100 + 1, 100) AS segment,
  CAST(i * 100 AS INTEGER) AS start_index, CAST(least((i + 1) * 100, length(text)) AS INTEGER) AS end_index
FROM (SELECT doc_id, text, unnest(range(0, (length(text) + 99) // 100)) AS i FROM documents)""",
)
def chunk_offsets(t: Tables):
    return segment.chunk_text(t.texts)


@query(
    "sample_windows",
    f"""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS pos, u.w AS segment
FROM (SELECT doc_id, {oracle.spread_windows('text')} AS ws FROM documents) d, unnest(ws) WITH ORDINALITY AS u(w, i)""",
)
def sample_windows(t: Tables):
    """Six windows spread over each text."""
    return segment.sample_windows(t.texts, max_windows=fixed.MAX_WINDOWS)


@query(
    "paragraphs",
    rf"""
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, segment
FROM (SELECT doc_id, u.i, {oracle.strip('u.p')} AS segment
      FROM documents d, unnest(string_split_regex(text, '\n+')) WITH ORDINALITY AS u(p, i))
WHERE length(segment) > 30""",
)
def paragraphs(t: Tables):
    return segment.split_paragraphs(t.texts, gap=r"\n+")


@query(
    "paragraph_offsets",
    rf"""
SELECT doc_id, pos, segment, start_index, CAST(start_index + length(segment) AS BIGINT) AS end_index FROM (
  SELECT doc_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, segment,
    CAST(coalesce(sum(length(segment) + 2) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT)
      AS start_index
  FROM (SELECT doc_id, u.i, {oracle.strip('u.p')} AS segment
        FROM documents d, unnest(string_split_regex(text, '\n+')) WITH ORDINALITY AS u(p, i))
  WHERE length(segment) > 30
  WINDOW w AS (PARTITION BY doc_id ORDER BY i))""",
)
def paragraph_offsets(t: Tables):
    paras = segment.split_paragraphs(t.texts, gap=r"\n+")
    return segment.segment_offsets(paras, separator_chars=2)


@query(
    "sentences",
    f"""
SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS pos, u.s AS segment
FROM documents d, unnest({oracle.sentences('text')}) WITH ORDINALITY AS u(s, i)""",
)
def sentences(t: Tables):
    return segment.split_sentences(t.texts)


@query(
    "lines_roundtrip",
    r"""
SELECT doc_id, text, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents""",
)
def lines_roundtrip(t: Tables):
    lines = segment.split_lines(t.texts)
    counted = segment.join_segments(lines)
    return counted.withColumn("n_lines", F.size(F.split("text", "\n")).cast("bigint"))


@query(
    "word_tokens",
    f"""
SELECT doc_id, CAST(len(words) AS INTEGER) AS n_words,
  CAST(len(list_distinct(list_transform(words, lambda x: lower(x)))) AS INTEGER) AS n_distinct,
  md5(array_to_string(words, ' ')) AS words_md5
FROM (SELECT doc_id, regexp_extract_all(text, '{oracle.WORD}') AS words FROM documents)""",
)
def word_tokens(t: Tables):
    words = segment.tokenize_words(t.texts)
    return words.select(
        "doc_id",
        F.size("words").alias("n_words"),
        F.size(F.array_distinct(F.transform("words", F.lower))).alias("n_distinct"),
        F.md5(F.array_join("words", " ")).alias("words_md5"),
    )


@query(
    "word_ngrams",
    f"""
SELECT gram, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT doc_id) AS BIGINT) AS n_docs FROM (
  SELECT doc_id, unnest(CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1),
    lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) ELSE [] END) AS gram
  FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{oracle.WORD}'), lambda x: lower(x)) AS words
        FROM documents))
GROUP BY gram""",
)
def word_ngrams(t: Tables):
    """Corpus counts of word 3-grams in one shuffle.

    Sorting a document's grams in its row marks their first occurrences, so the number of
    documents is a plain sum and needs no distinct. Texts are dealt to more tasks first: a task holds
    nearly all grams of its texts, about ten times their size, until it has folded them.
    """
    texts = t.documents.select("doc_id", "text")
    tasks = max(NGRAM_TASKS * texts.rdd.getNumPartitions(), 2 * t.spark.sparkContext.defaultParallelism)
    grams = segment.word_ngrams(texts.repartition(tasks)).select(F.sort_array("ngrams").alias("g"))
    marked = let(
        F.col("g"),
        lambda g: F.transform(
            g, lambda x, i: F.struct(x.alias("gram"), F.get(g, i - 1).eqNullSafe(x).alias("again"))
        ),
    )
    rows = grams.select(F.explode(marked).alias("m")).select("m.*")
    return rows.groupBy("gram").agg(F.count("*").alias("n"), F.count_if(~F.col("again")).alias("n_docs"))


@query(
    "token_gate",
    f"""
SELECT doc_id, CAST(n AS INTEGER) AS n_tokens, n >= 64 AS scorable, n > 512 AS truncated,
  CAST(least(n, 512) AS INTEGER) AS n_scored
FROM (SELECT doc_id, len(regexp_extract_all(text, '{oracle.WORD}')) AS n FROM documents)""",
)
def token_gate(t: Tables):
    gated = segment.token_gate(segment.tokenize_words(t.texts), max_tokens=512)
    return gated.select("doc_id", "n_tokens", "scorable", "truncated", F.size("words").alias("n_scored"))


@query(
    "rejected_inputs",
    r"""
SELECT kind, reason, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT CASE WHEN conv_id % 7 = 0 THEN 'blanked' WHEN conv_id % 11 = 0 THEN 'missing' ELSE 'kept' END AS kind,
    CASE WHEN conv_id % 7 = 0 THEN 'empty text' WHEN conv_id % 11 = 0 THEN 'missing text'
      WHEN NOT regexp_matches(text, '\S') THEN 'empty text' END AS reason
  FROM conversations)
GROUP BY kind, reason""",
)
def rejected_inputs(t: Tables):
    """Conversations with some texts blanked or removed, split by whether they may be processed."""
    conv = t.conversations.withColumn(
        "kind",
        F.when(F.col("conv_id") % 7 == 0, "blanked").when(F.col("conv_id") % 11 == 0, "missing").otherwise("kept"),
    ).withColumn(
        "text",
        F.when(F.col("kind") == "blanked", F.lit(" \n ")).when(F.col("kind") == "kept", F.col("text")),
    )
    return segment.with_rejection(conv).groupBy("kind", "reason").agg(F.count("*").alias("n"))
