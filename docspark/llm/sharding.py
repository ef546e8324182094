"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash inside each source and ranked; the rank as a fraction of the source
spreads every source evenly over [0, 1). Sorted by that fraction the sources interleave in proportion,
and cutting the order into equal runs gives shards that all match the mixture. Ranks come from key
ranges with prefix sums, so a source with most of the rows is ranked by many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import filled, key_range, range_starts, shuffle_key
from docspark.session import cut_lineage

SHARDS = 40
SEED = 11
RANGE_ROWS = 1000
OVERHEAD = 16


def interleave(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text",
               source_col: str = "source", seed: int = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """``doc_id, source, size, text_crc32, place, shard, slot`` of every row.

    Shard sizes differ by one row at most; ``place`` is the row's position in the whole order, ``slot`` its
    position in the shard. Null sources are a source of their own; a null text counts as an empty one.
    Repeated rows (equal id, text and source) are placed side by side in their source's order. An empty table gives no row.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    units = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        filled(F.col(source_col)).alias("src"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        shuffle_key(seed, F.col(id_col), F.col(text_col)).alias("key"),
    ).groupBy("src", "key", "doc_id", "source", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies"))
    units = cut_lineage(units)
    sources = cut_lineage(units.groupBy("src").agg(F.sum("copies").alias("source_rows")))
    total = sources.agg(F.coalesce(F.sum("source_rows"), F.lit(0))).first()[0]

    ranged = units.join(sources, "src").withColumn("bucket", key_range(F.col("key"), F.ceil(F.col("source_rows") / range_rows)))
    starts = range_starts(ranged.groupBy("src", "bucket").agg(F.sum("copies").alias("n")), ["src"], "bucket", "n", "before").drop("n")
    inside = W.partitionBy("src", "bucket").orderBy("key").rowsBetween(W.unboundedPreceding, -1)
    ranked = (
        ranged.withColumn("earlier", F.coalesce(F.sum("copies").over(inside), F.lit(0)))
        .join(starts, ["src", "bucket"])
        .withColumn("rank", F.explode(F.sequence(F.col("before") + F.col("earlier"), F.col("before") + F.col("earlier") + F.col("copies") - 1)))
        .withColumn("fraction", (2 * F.col("rank") + 1) / (2.0 * F.col("source_rows")))
        .select("doc_id", "source", "size", "text_crc32", "key", "src", "rank", "fraction")
    )
    spans = max(1, -(-total // range_rows))
    spread = cut_lineage(ranked.withColumn("span", F.floor(F.col("fraction") * spans).cast("long")))
    firsts = range_starts(spread.groupBy("span").agg(F.count(F.lit(1)).alias("n")).withColumn("all", F.lit(0)), ["all"], "span", "n", "before").drop("n", "all")
    order = W.partitionBy("span").orderBy("fraction", "key", "src", "rank")
    placed = spread.withColumn("in_span", F.row_number().over(order) - 1).join(firsts, "span").withColumn("place", F.col("before") + F.col("in_span"))
    shard = F.floor(F.col("place") * shards / F.lit(max(total, 1))).cast("int")
    first = F.ceil(F.col("shard") * F.lit(max(total, 1)) / shards)
    return placed.withColumn("shard", shard).select(
        "doc_id", "source", "size", "text_crc32", "place", "shard", (F.col("place") - first).cast("long").alias("slot"),
    )
