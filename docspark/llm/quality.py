"""Quality rules: measures of one document, and cross-document line frequency.

Lines are normalised and hashed; per host the number of distinct documents that hold a line is counted. Lines
held by more documents than the limit, the same for every host, stay in one document, and a document that keeps too few
of its words is rejected (``line_fates``). Measures and line hashes are taken in one pass over the texts and written;
counting shuffles hashes only. Each document names a line once, so a common line is pre-aggregated in the tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.expr import let
from docspark.llm.common import LAST_ID, WHITE, filled, fresh, lower_ascii, words
from docspark.session import cut_lineage

#: Limits of the fixed rules (fixed values).
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = r"[^#*$%&|<>]+"

#: A line is common in a host when more than this many of the host's documents hold it.
LINE_DOCS = 10
#: A document is depleted when less than this share of its words is left.
KEPT_SHARE = 0.3


def repeated_words(tokens: Column) -> Column:
    """Words inside 3-word windows that the text holds at least twice, the first occurrence included.

    Each window becomes one number, (hash, position); sorted, equal windows are neighbours. The hash has as many
    bits as the positions leave free, and equal neighbours are compared word by word.
    """
    def same(t: Column, a: Column, b: Column) -> Column:
        return (F.get(t, a) == F.get(t, b)) & (F.get(t, a + 1) == F.get(t, b + 1)) & (F.get(t, a + 2) == F.get(t, b + 2))

    def covered(t: Column) -> Column:
        n = F.size(t)
        span = F.floor(F.lit(float(2 ** 61)) / n).cast("bigint")
        coded = F.sort_array(F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.pmod(F.xxhash64(F.get(t, i), F.get(t, i + 1), F.get(t, i + 2)), span) * n + i,
        ))

        def starts(codes: Column) -> Column:
            at = lambda j: (F.get(codes, j) % n).cast("int")
            bucket = lambda j: (F.get(codes, j) - F.get(codes, j) % n)
            twin = lambda j, k: F.coalesce((bucket(j) == bucket(k)) & same(t, at(j), at(k)), F.lit(False))
            found = F.filter(F.sequence(F.lit(0), F.size(codes) - 1), lambda j: twin(j, j + 1) | F.when(j > 0, twin(j, j - 1)).otherwise(F.lit(False)))
            return F.sort_array(F.transform(found, at))

        def total(places: Column) -> Column:
            gaps = F.zip_with(places, F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
            return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

        return let(let(coded, starts), total)

    return F.when(F.size(tokens) >= 4, let(tokens, covered)).otherwise(F.lit(0)).cast("long")


def line_forms(text: Column) -> Column:
    """The normal form of every ``\\n``-line: A-Z lower-cased, white space collapsed and trimmed; empty for a line without a word."""
    tidy = F.regexp_replace(F.regexp_replace(lower_ascii(text), r"[\x20\x09\x0B-\x0D]+", " "), r" ?\n ?", "\n")
    return F.split(F.regexp_replace(tidy, r"^ | $", ""), "\n")


def normal_lines(text: Column) -> Column:
    """Normal forms of a text's lines; lines without a word dropped."""
    return F.array_remove(line_forms(text), "")


def without_lines(text: Column, hashes: Column) -> Column:
    """The text without the lines whose normal form has one of the hashes; the other lines as they are."""
    def left(forms: Column) -> Column:
        return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(hashes, F.xxhash64(F.get(forms, i)))), "\n")

    return let(line_forms(text), left)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The measures of every row and its normal lines, one entry for each place, as ``lines: (hash, n)``; written once."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    tokens, lines = F.col("tokens"), F.col("normal")
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), text.alias("text"), words(text, WHITE).alias("tokens"),
        raw.alias("raw"), normal_lines(text).alias("normal"),
    )
    sized = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("hash"), (F.size(F.split(x, " "))).alias("n")))
    return cut_lineage(rows.select(
        "doc_id", "host", F.xxhash64("text").alias("text_hash"),
        F.size(tokens).cast("long").alias("n_words"),
        F.length(F.array_join(tokens, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("text", SYMBOLS, "")).cast("long").alias("n_symbols"),
        (F.size("raw") - F.size(F.array_distinct("raw"))).cast("long").alias("n_dup_lines"),
        repeated_words(tokens).alias("n_repeat_words"),
        sized.alias("lines"),
    ))


def base_failed() -> Column:
    """Whether a measured row fails the rules that look at the document alone."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def left_too_few(removed: Column, kept_share: float) -> Column:
    return (F.col("n_words") - removed) < F.lit(kept_share) * F.col("n_words")


def common_lines(rows: DataFrame, line_docs: int = LINE_DOCS) -> DataFrame:
    """Lines held by more than ``line_docs`` documents of a host, however large the host: ``key, hash, n_docs``; written once. Every row counts as one document."""
    named = rows.select(filled(F.col("host")).alias("key"), F.explode(F.array_distinct(F.col("lines.hash"))).alias("hash"))
    counted = named.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("n_docs"))
    return cut_lineage(counted.filter(F.col("n_docs") > line_docs))


def held_lines(rows: DataFrame, common: DataFrame) -> DataFrame:
    """The common lines of every document: ``key, doc, text_hash, hash, n, n_words, failed``; written once.

    ``n`` counts the words of all the line's places in the document; repeated rows count once.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    lines = rows.select(filled(F.col("host")).alias("key"), doc.alias("doc"), "text_hash", "n_words", base_failed().alias("failed"), F.posexplode("lines").alias("place", "line"))
    lines = lines.select("key", "doc", "text_hash", "n_words", "failed", "place", F.col("line.hash").alias("hash"), F.col("line.n").alias("n"))
    lines = lines.join(common.select("key", "hash"), ["key", "hash"])
    once = lines.groupBy("key", "doc", "text_hash", "hash", "n_words", "failed", "place").agg(F.max("n").alias("n"))
    return cut_lineage(once.groupBy("key", "doc", "text_hash", "hash").agg(F.sum("n").alias("n"), F.max("n_words").alias("n_words"), F.max("failed").alias("failed")))


def line_fates(held: DataFrame, kept_share: float = KEPT_SHARE) -> DataFrame:
    """What common lines mean for every document that holds one: ``key, doc, text_hash, removed, rescued, hashes``; written once.

    1. The first holder of a line is the smallest id among its holders that pass the base rules. ``removed`` counts the words of a
       document's common lines that have an earlier first holder; a document with too few words left is depleted.
    2. A line that only depleted documents hold is orphaned. Of these the one with the smallest md5 of its id is rescued,
       so neighbours that share lines mostly agree on one document, and no line is lost that any of them could have kept.
    3. Documents that pass the base rules and are not depleted, or are rescued, are kept. A line stays in the kept document with
       the smallest id; ``hashes`` are the lines that a document loses to another one.

    Each step is one pass, whatever the lines of a host look like.
    """
    doc, line = ["key", "doc", "text_hash"], ["key", "hash"]
    able = held.filter("NOT failed")
    by_chance = F.min(F.struct(F.md5(F.col("doc").cast("string")).alias("chance"), "doc"))
    firsts = cut_lineage(able.groupBy(*line).agg(F.min("doc").alias("first"), by_chance["doc"].alias("rescuer")))
    told = cut_lineage(held.join(firsts, line))
    others = F.coalesce(F.sum(F.when(F.col("first") < F.col("doc"), F.col("n"))), F.lit(0))
    sums = told.groupBy(*doc).agg(others.alias("removed"), F.max("n_words").alias("n_words"))
    sums = cut_lineage(sums.select(*doc, "removed", left_too_few(F.col("removed"), kept_share).alias("depleted")))
    judged = cut_lineage(told.join(sums, doc))
    orphaned = judged.filter("NOT failed").groupBy(*line).agg(F.min("depleted").alias("orphaned"), F.max("rescuer").alias("rescuer")).filter("orphaned")
    rescued = cut_lineage(orphaned.select("key", F.col("rescuer").alias("doc"), F.lit(True).alias("rescued")).distinct())
    settled = judged.join(rescued, ["key", "doc"], "left").withColumn("rescued", F.coalesce("rescued", F.lit(False)) & ~F.col("failed"))
    settled = cut_lineage(settled.withColumn("kept", ~F.col("failed") & (~F.col("depleted") | F.col("rescued"))))
    owners = cut_lineage(settled.filter("kept").groupBy(*line).agg(F.min("doc").alias("owner")))
    lost = F.collect_set(F.when(F.col("owner") != F.col("doc"), F.col("hash")))
    return cut_lineage(settled.join(owners, line).groupBy(*doc).agg(F.max("removed").alias("removed"), F.max("rescued").alias("rescued"), lost.alias("hashes")))


def judge_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, line_docs: int, kept_share: float) -> DataFrame:
    """Measures and verdict of every row, with ``hashes``, the lines that it loses."""
    rows = measure(docs, id_col, text_col, host_col)
    fates = line_fates(held_lines(rows, common_lines(rows, line_docs)), kept_share)
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID))
    judged = rows.select(filled(F.col("host")).alias("key"), doc.alias("doc"), "*").join(fates, ["key", "doc", "text_hash"], "left")
    return judged.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.coalesce("removed", F.lit(0)).cast("long").alias("n_common_words"), base_failed().alias("base_failed"),
        F.coalesce("rescued", F.lit(False)).alias("rescued"), "hashes",
    ).withColumn("depleted", left_too_few(F.col("n_common_words"), kept_share) & ~F.col("rescued")).withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", line_docs: int = LINE_DOCS,
                  kept_share: float = KEPT_SHARE) -> DataFrame:
    """Measures and verdict of every row.

    Columns: ``doc_id, text_hash, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_common_words,
    base_failed, rescued, depleted, kept``. A null text has no words and fails the base rules. A null host is a host of its
    own. Common lines and who keeps them: ``line_fates``; one that no document passing the base rules holds is removed from none.
    Ids are whole numbers. A row without an id (or with the largest 64-bit number) never counts as a line's first holder unless all are
    without. Repeated rows (equal id and text) get the same verdict. An empty table gives no row.
    """
    return judge_lines(docs, id_col, text_col, host_col, line_docs, kept_share).drop("hashes")


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", remove_lines: bool = False) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their columns; with ``remove_lines`` their texts lose the common lines that count as removed.

    Rejected and changed rows are looked up by id, host and text hash; a text without such lines stays as it is.
    """
    names = {c: fresh(f"out_{c}", docs.columns) for c in ("doc_id", "host", "text_hash", "kept", "hashes")}
    out = judge_lines(docs, id_col, text_col, host_col, LINE_DOCS, KEPT_SHARE).withColumn("hashes", F.when(F.size("hashes") > 0, F.col("hashes")))
    out = out.filter(F.expr("NOT kept OR hashes IS NOT NULL") if remove_lines else F.expr("NOT kept"))
    out = cut_lineage(out.select(
        filled(F.col("doc_id")).alias(names["doc_id"]), filled(F.col("host")).alias(names["host"]), F.col("text_hash").alias(names["text_hash"]),
        F.col("kept").alias(names["kept"]), F.when(F.col("kept"), F.sort_array("hashes")).alias(names["hashes"]),
    ).distinct())
    match = (
        (filled(docs[id_col]) == out[names["doc_id"]]) & (filled(docs[host_col]) == out[names["host"]])
        & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == out[names["text_hash"]])
    )
    if not remove_lines:
        return docs.join(out, match, "left_anti")
    found = docs.join(out, match, "left").filter(F.coalesce(F.col(names["kept"]), F.lit(True)))
    text = F.when(F.col(names["hashes"]).isNull(), docs[text_col]).otherwise(without_lines(docs[text_col], F.col(names["hashes"])))
    return found.select(*[text.alias(c) if c == text_col else docs[c] for c in docs.columns])
