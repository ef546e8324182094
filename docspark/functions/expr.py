"""Small expression builders shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX_BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` to a lambda variable so that ``body`` may use it many times but it runs once.

    The optimizer may inline a projected column into a lambda body, where it would be
    evaluated per element; a lambda variable cannot be inlined.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def clamp01(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def round_half_up(value: Column) -> Column:
    """Integer rounding with .5 going up, for any sign."""
    return F.floor(value + F.lit(0.5)).cast("int")


def total(values: Column) -> Column:
    """Sum of a numeric array as double."""
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def total_long(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda acc, x: acc + x)


def prefix_sums(values: Column) -> Column:
    """Exclusive running sums of an integer array.

    Two levels (blocks, then inside a block) keep the work near linear; elements are fetched
    by index because slicing copies the whole array.
    """
    zero = F.lit(0).cast("bigint")

    def span_sum(vals: Column, start: Column, count: Column) -> Column:
        indexes = F.when(count > 0, F.sequence(start, start + count - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(indexes, zero, lambda acc, j: acc + F.coalesce(F.get(vals, j), zero))

    def block_of(i: Column) -> Column:
        return F.floor(i / PREFIX_BLOCK).cast("int")

    def within(vals: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), block_of(F.size(vals) - 1)),
            lambda b: span_sum(vals, b * PREFIX_BLOCK, F.lit(PREFIX_BLOCK)),
        )
        starts = let(
            blocks,
            lambda sums: F.transform(
                F.sequence(F.lit(0), F.size(sums) - 1), lambda b: span_sum(sums, F.lit(0), b)
            ),
        )
        return let(
            starts,
            lambda st: F.transform(
                F.sequence(F.lit(0), F.size(vals) - 1),
                lambda i: F.get(st, block_of(i)) + span_sum(vals, block_of(i) * PREFIX_BLOCK, i % PREFIX_BLOCK),
            ),
        )

    return let(
        values,
        lambda v: F.when(F.size(v) > 0, within(v)).otherwise(F.array().cast("array<bigint>")),
    )


def draw(*parts: Column | str | int) -> Column:
    """Reproducible uniform number in [0, 1) keyed by ``parts``."""
    return draw_int(*parts) / F.lit(4294967296.0)


def draw_int(*parts: Column | str | int) -> Column:
    """Reproducible 32-bit unsigned number keyed by ``parts``."""
    pieces = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *pieces)), 1, 8), 16, 10).cast("bigint")


def nullif_empty(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of ``pattern``; null when there is none or it is empty."""
    return nullif_empty(F.regexp_extract(text, pattern, group))


def strip(text: Column) -> Column:
    """Drop ASCII white space at both ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s+", " ")


def replace_ignoring_case(text: Column, value: Column, replacement: str) -> Column:
    """Replace every occurrence of the literal ``value``, whatever its case."""
    quoted = F.concat(F.lit(r"(?iu)\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    escaped = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(text, quoted, F.lit(escaped))


def count_ignoring_case(text: Column, value: Column) -> Column:
    """Non-overlapping occurrences of the literal ``value``, whatever its case."""
    return count_lowered(F.lower(text), F.lower(value))


def count_lowered(low: Column, needle: Column) -> Column:
    """Non-overlapping occurrences of ``needle`` where both are lower-cased already."""
    removed = F.length(low) - F.length(F.replace(low, needle, F.lit("")))
    return F.when(F.length(needle) > 0, (removed / F.length(needle)).cast("int")).otherwise(F.lit(0))
