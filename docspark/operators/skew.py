"""Joins that stay balanced when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def hot_keys(counts: DataFrame, keys: list[str], count_col: str = "n") -> DataFrame:
    """Keys with more rows than a partition's fair share, and over how many partitions they have to spread: ``_salts``.

    There are fewer of them than partitions, whatever the data, so the result is always safe to broadcast.
    """
    rows = counts.agg(F.sum(count_col)).scalar()
    salts = F.ceil(F.col(count_col) * F.lit(shuffle_partitions(counts)) / rows).cast("int")
    return counts.withColumn("_salts", salts).filter("_salts > 1").select(*keys, "_salts")


def balanced_join(big: DataFrame, small: DataFrame, keys: list[str], counts: DataFrame,
                  spread: list[str], how: str = "left", count_col: str = "n") -> DataFrame:
    """Equi-join where each hot key of ``big`` is spread over as many partitions as its rows would fill.

    ``counts`` holds rows per key of ``big`` (``count_col``); ``spread`` names columns of
    ``big`` that vary inside a key. Only the few hot rows of ``small`` are replicated. Rows
    with a null key match nothing and are spread over all partitions.
    """
    hot = F.broadcast(hot_keys(counts, keys, count_col))
    unmatched = F.lit(False)
    for key in keys:
        unmatched = unmatched | F.col(key).isNull()
    drawn = F.xxhash64(*spread)
    salted_big = big.join(hot, keys, "left").withColumn(
        "_salt",
        F.when(F.col("_salts").isNotNull(), F.pmod(drawn, F.col("_salts")).cast("int"))
        .when(unmatched, F.pmod(drawn, F.lit(shuffle_partitions(big))).cast("int")).otherwise(F.lit(0)),
    ).drop("_salts")
    salts = F.when(F.col("_salts").isNotNull(), F.sequence(F.lit(0), F.col("_salts") - 1)).otherwise(F.array(F.lit(0)))
    salted_small = small.join(hot, keys, "left").withColumn("_salt", F.explode(salts)).drop("_salts")
    return salted_big.join(salted_small, [*keys, "_salt"], how).drop("_salt")
