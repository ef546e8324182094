"""Parquet tables and input parallelism."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Give a small input enough partitions to occupy every core.

    A table of a few row groups would otherwise run a CPU-heavy text job on a few cores.
    Inputs that already have two splits per core (any large table) are left alone, so no
    shuffle is added at scale.
    """
    wanted = 2 * df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= wanted:
        return df
    return df.repartition(wanted)

