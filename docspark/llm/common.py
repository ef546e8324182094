"""Helpers shared by the corpus operators: words, keys, orders over many rows.

All operators read only the columns they name, so further columns of the input never clash with
theirs. A null text has no words. Rows are told apart by their id and a hash of their text; rows
that agree in both are the same document and get the same answer.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Separators between words (fixed values): white space, or every ASCII character that is neither letter nor digit.
WHITE = r"[\x20\x09-\x0D]+"
NOT_ALNUM = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a null id where ids are compared: after every other one.
LAST_ID = 9223372036854775807


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; other letters keep their case."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column, separator: str = WHITE) -> Column:
    """Words between separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def filled(key: Column) -> Column:
    """A grouping or join key without nulls that keeps null apart from every value."""
    return F.when(key.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), key.cast("string")))


def shuffle_key(seed: int, doc_id: Column, text: Column) -> Column:
    """Hash-random sort key of a document: 32 hex digits, the same in every run."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), filled(doc_id), F.md5(F.coalesce(text, F.lit("")))))


def key_range(key: Column, ranges: Column) -> Column:
    """Which of ``ranges`` equal spans of the key space holds the key; grows with the key."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("double") * ranges / F.lit(4294967296.0)).cast("long")


def range_starts(totals: DataFrame, group: list[str], bucket: str, value: str, start: str, span: int = 1000) -> DataFrame:
    """Sum of ``value`` over all earlier buckets of the group, as column ``start``.

    Two levels: spans of ``span`` buckets are summed first, so no window holds more than one span
    or the list of spans.
    """
    spanned = totals.withColumn("_span", F.floor(F.col(bucket) / span))
    spans = spanned.groupBy(*group, "_span").agg(F.sum(value).alias("_sum"))
    before = W.partitionBy(*group).orderBy("_span").rowsBetween(W.unboundedPreceding, -1)
    spans = spans.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = W.partitionBy(*group, "_span").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    return (
        spanned.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(spans, [*group, "_span"])
        .withColumn(start, F.col("_base") + F.col("_in"))
        .drop("_base", "_in", "_span")
    )


def fresh(name: str, taken: list[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it (case ignored)."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


def ship_with_tasks(module: str) -> None:
    """Send the module's functions and classes along with tasks, so executors need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
