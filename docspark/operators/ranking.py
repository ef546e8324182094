"""Running totals over groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.session import cut_lineage


def running_totals(df: DataFrame, keys: list[str], order: list[Column], values: dict[str, Column],
                   ranges: int | None = None) -> DataFrame:
    """Adds each named total of a value over the earlier rows of the same key (of all rows without keys) in ``order``.

    Rows are dealt out by ranges of (keys, order), so one key may lie in many tasks; each adds the totals of the
    slices before its own (``ranges`` sets how many, else the session does). ``order`` has to tell all rows of a key apart where the result should not depend on chance.
    """
    marks = [f"_o{i}" for i in range(len(order))]
    ordered = df.withColumns({f"_v_{n}": v for n, v in values.items()} | dict(zip(marks, order)))
    dealt = ordered.repartitionByRange(*([ranges] if ranges else []), *keys, *marks)
    placed = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    slices = placed.groupBy(*keys, "_slice").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values]).select(
        *keys, "_slice", *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values]
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*marks).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumns({f"_l_{n}": F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    joined = local.join(slices, [*keys, "_slice"])
    return joined.select(*df.columns, *[(F.col(f"_b_{n}") + F.col(f"_l_{n}")).alias(n) for n in values])


def running_total(df: DataFrame, keys: list[str], order: list[Column], value: Column, name: str) -> DataFrame:
    """:func:`running_totals` of one value."""
    return running_totals(df, keys, order, {name: value})
