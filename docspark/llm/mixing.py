"""Mixing sources to target weights with an exact cut in a hash-random order.

Every document has a hash-random key. Inside a source the documents are ordered by that key: the key
space is cut into ranges, range totals are summed up to prefix sums, and only the one range in which the
budget ends is sorted to find the cut. Documents up to the cut get one epoch more than the others, so a
decision needs nothing but the document's own key and one row per source: texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import WHITE, filled, fresh, key_range, range_starts, shuffle_key, words
from docspark.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = 7
RANGE_ROWS = 1000


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """One narrow row per document: ``doc_id, source, src, size, key``; written once, because every later step reads it.

    ``src`` is the source without nulls. A null text has size 0.
    """
    text = F.col(text_col)
    return cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        filled(F.col(source_col)).alias("src"),
        F.size(words(text, WHITE)).cast("long").alias("size"),
        shuffle_key(seed, F.col(id_col), text).alias("key"),
    ))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: ``src, source_rows, source_size, target``.

    Sources in code-point order, null last, take the weights in turn and share ``share`` of all words. A
    target stops at ``most`` times its source; what is left over goes to the others by weight. With
    sources ordered by size per weight the capped ones come first, so one running sum finds the level
    at which the rest shares. An empty input gives no row; sources without words have target 0.
    """
    sizes = rows.groupBy("src").agg(F.max("source").alias("source"), F.count(F.lit(1)).alias("source_rows"), F.sum("size").alias("source_size"))
    position = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(position, F.lit(len(weights))) + 1).cast("int"))
    everywhere = W.partitionBy()
    by_ratio = W.orderBy("ratio", "place")
    filling = (
        sizes.withColumn("place", position)
        .withColumn("weight", weight)
        .withColumn("total", F.sum("source_size").over(everywhere))
        .withColumn("ratio", F.lit(float(most)) * F.col("source_size") / F.col("weight"))
        .withColumn("capped", F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) * most)
        .withColumn("sharing", F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.lit(share) * F.col("total") - F.col("capped")) / F.col("sharing"))
        .withColumn("open", F.col("ratio") > F.col("level"))
        .withColumn("final", F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
            by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    )
    return filling.select(
        "src", "source_rows", "source_size",
        F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(F.col("final"), F.lit(0.0)) * F.col("weight")).alias("target"),
    )


def cuts(rows: DataFrame, sources: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per source: its totals, full ``epochs``, ``ranges``, and where the last epoch ends.

    The last epoch takes the ranges before ``cut_range`` and, inside it, keys up to ``cut_key``; the document
    at the cut belongs to it if that brings the source nearer to its target. Equal keys (repeated rows) stay together.
    """
    planned = (
        sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("ranges", F.ceil(F.col("source_rows") / range_rows))
    )
    planned = cut_lineage(planned)
    ranged = rows.join(planned.select("src", "ranges", "rest"), "src").withColumn("bucket", key_range(F.col("key"), F.col("ranges")))
    totals = ranged.groupBy("src", "bucket").agg(F.sum("size").alias("bucket_size"), F.max("rest").alias("rest"))
    placed = range_starts(totals, ["src"], "bucket", "bucket_size", "before")
    last = cut_lineage(placed.filter("before < rest AND before + bucket_size >= rest").select("src", F.col("bucket").alias("cut_range"), "before", F.col("rest").alias("budget")))
    units = (
        ranged.select("src", "bucket", "key", "size")
        .join(last, (ranged["src"] == last["src"]) & (ranged["bucket"] == last["cut_range"]), "inner")
        .drop(last["src"])
        .groupBy("src", "cut_range", "key").agg(F.sum("size").alias("size"), F.max("before").alias("before"), F.max("budget").alias("budget"))
    )
    earlier = W.partitionBy("src").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    ends = (
        units.withColumn("start", F.col("before") + F.coalesce(F.sum("size").over(earlier), F.lit(0)))
        .filter(2 * F.col("start") + F.col("size") <= 2 * F.col("budget"))
        .groupBy("src").agg(F.max("key").alias("cut_key"))
    )
    return cut_lineage(planned.join(last.select("src", "cut_range"), "src", "left").join(ends, "src", "left"))


def _epochs(key, ranges, epochs, cut_range, cut_key):
    place = key_range(key, ranges)
    extra = (place < cut_range) | ((place == cut_range) & (key <= cut_key))
    return epochs + F.when(extra, F.lit(1)).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """How often the mix takes each document: ``doc_id, source, size, source_size, target, epochs, taken``.

    Null sources form a source of their own, null texts have no words and are taken along with their
    epoch. Repeated rows are taken alike. The order depends on the seed, the id and the text only.
    """
    rows = measured(docs, id_col, text_col, source_col, seed)
    plan = cuts(rows, targets(rows, weights, share, most))
    times = _epochs(*[F.col(c) for c in ("key", "ranges", "epochs", "cut_range", "cut_key")])
    return rows.join(plan, "src").withColumn("epochs", times).select(
        "doc_id", "source", "size", "source_size", "target", F.col("epochs").cast("long").alias("epochs"), (F.col("epochs") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, seed: int = SEED) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, with the columns of ``docs``."""
    plan = cuts(rows := measured(docs, id_col, text_col, source_col, seed), targets(rows, weights, share, most))
    names = {c: fresh(f"mix_{c}", docs.columns) for c in ("src", "ranges", "epochs", "cut_range", "cut_key", "copy")}
    plan = plan.select(*[F.col(c).alias(names[c]) for c in ("src", "ranges", "epochs", "cut_range", "cut_key")])
    keyed = docs.join(plan, filled(docs[source_col]) == plan[names["src"]])
    times = _epochs(shuffle_key(seed, docs[id_col], docs[text_col]), *[F.col(names[c]) for c in ("ranges", "epochs", "cut_range", "cut_key")])
    return keyed.withColumn(names["copy"], F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*[docs[c] for c in docs.columns])
