"""Scores to labels, percentages and bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import clamp01, round_half_up


def neutral(score: Column) -> Column:
    """Missing scores count as 0.5; a true zero stays zero."""
    return F.coalesce(score, F.lit(fixed.NEUTRAL_SCORE))


def label_by_threshold(human_likeness: Column, mode: str = "low-fpr") -> Column:
    """Human at or above the operating point, machine below; null score gives ``unknown``."""
    return (
        F.when(human_likeness.isNull(), "unknown")
        .when(human_likeness >= fixed.THRESHOLDS[mode], fixed.LABEL_HUMAN)
        .otherwise(fixed.LABEL_AI)
    )


def traffic_light(ai_likeness: Column) -> Column:
    return F.when(ai_likeness > 0.7, "red").when(ai_likeness >= 0.4, "yellow").otherwise("green")


def rounded(value: Column, digits: int) -> Column:
    """Half-up rounding after the twelfth digit was settled, so noise in the last bits decides nothing."""
    return F.round(F.round(value, 12), digits)


def percent(score: Column) -> Column:
    """Whole percent, half rounds up.

    The ninth digit is settled first, so a score that sits on a half does not change with
    the order in which a partitioned sum added its terms.
    """
    return round_half_up(F.round(clamp01(score), 9) * 100)


def percent2(score: Column) -> Column:
    return rounded(clamp01(score) * 100, 2)


def sentence_label(label: Column, score: Column, threshold: float = 0.8) -> Column:
    """Four-way label from a FAKE/REAL classifier label and its confidence."""
    name = F.upper(label)
    ai, ai_refined, human, human_refined = fixed.SENTENCE_LABELS
    return (
        F.when((name == "FAKE") & (score >= threshold), ai)
        .when(name == "FAKE", ai_refined)
        .when((name == "REAL") & (score >= threshold), human)
        .when(name == "REAL", human_refined)
        .otherwise(human)
    )
