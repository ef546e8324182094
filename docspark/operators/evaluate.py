"""Detector evaluation: confusion counts, F1, ROC, AUC and TPR at a fixed FPR.

Scores are human-likeness: class 1 (machine) is predicted *below* the threshold. All
measures work on counts per distinct score, never on the raw rows, and running totals are
taken inside score ranges so that no window has to hold all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.operators.ranking import running_totals
from docspark.session import cut_lineage


def union_scores(human: DataFrame, machine: DataFrame, score_col: str = "score") -> DataFrame:
    """Scores of human texts (class 0) and machine texts (class 1) in one frame."""
    return human.select(F.col(score_col).alias("score"), F.lit(0).alias("class")).unionByName(
        machine.select(F.col(score_col).alias("score"), F.lit(1).alias("class"))
    )


def score_groups(scores: DataFrame) -> DataFrame:
    """Class counts per distinct score, materialised because every measure reads it again.

    Unscored rows are dropped after the cut: a filter before it would be pushed below the
    scoring and evaluate the whole score expression twice per row.
    """
    grouped = scores.groupBy("score").agg(
        F.sum("class").cast("bigint").alias("pos"),
        F.sum(F.lit(1) - F.col("class")).cast("bigint").alias("neg"),
    )
    return cut_lineage(grouped).filter("score is not null")


def _safe_ratio(top: Column, bottom: Column) -> Column:
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def confusion(groups: DataFrame, threshold: float = fixed.THRESHOLDS["accuracy"]) -> DataFrame:
    """One row: tp, fp, fn, tn and F1 of the machine class."""
    below = F.col("score") < threshold
    counted = groups.agg(
        F.coalesce(F.sum(F.when(below, F.col("pos"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(below, F.col("neg"))), F.lit(0)).alias("fp"),
        F.coalesce(F.sum(F.when(~below, F.col("pos"))), F.lit(0)).alias("fn"),
        F.coalesce(F.sum(F.when(~below, F.col("neg"))), F.lit(0)).alias("tn"),
    )
    return counted.withColumn("f1", _safe_ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def roc_points(groups: DataFrame, ranges: int | None = None) -> DataFrame:
    """Cumulative true and false positives at each distinct score, most machine-like first.

    Scores are dealt out by sampled ranges, so outliers do not push the others into one task, and every range adds the
    totals of those before it.
    """
    running = running_totals(groups.select("score", "pos", "neg"), [], [F.col("score")], {"_tp": F.col("pos"), "_fp": F.col("neg")}, ranges)
    return running.select("score", "pos", "neg", (F.col("_tp") + F.col("pos")).alias("tp"), (F.col("_fp") + F.col("neg")).alias("fp"))


def roc_curve(groups: DataFrame, ranges: int | None = None) -> DataFrame:
    """ROC table with rates; the curve starts at the implied point (0, 0)."""
    positives = groups.agg(F.sum("pos")).scalar()
    negatives = groups.agg(F.sum("neg")).scalar()
    points = roc_points(groups, ranges).withColumn("_p", positives).withColumn("_n", negatives)
    return points.select(
        "score",
        "pos",
        "neg",
        "tp",
        "fp",
        _safe_ratio(F.col("tp"), F.col("_p")).alias("tpr"),
        _safe_ratio(F.col("fp"), F.col("_n")).alias("fpr"),
    )


def auc(roc: DataFrame) -> DataFrame:
    """Area under the ROC curve by the trapezoid rule, as one sum over its steps.

    Each step adds its negatives times the mean of the true positives before and after it.
    """
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    pairs = F.sum("pos") * F.sum("neg")
    return roc.agg(_safe_ratio(area, pairs).alias("auc"))


def tpr_at_fpr(roc: DataFrame, fpr: float = 0.0001) -> DataFrame:
    """TPR at a false positive rate, interpolated between the neighbouring ROC points."""
    point = F.struct("fpr", "tpr")
    picked = roc.agg(
        F.coalesce(
            F.max(F.when(F.col("fpr") <= fpr, point)), F.struct(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
        ).alias("a"),
        F.min(F.when(F.col("fpr") > fpr, point)).alias("b"),
    )
    slope = (F.col("b.tpr") - F.col("a.tpr")) / (F.col("b.fpr") - F.col("a.fpr"))
    return picked.select(
        F.when(F.col("b").isNull(), F.col("a.tpr"))
        .otherwise(F.col("a.tpr") + (F.lit(fpr) - F.col("a.fpr")) * slope)
        .alias("tpr_at_fpr")
    )


def evaluate_detector(scores: DataFrame, threshold: float = fixed.THRESHOLDS["accuracy"],
                      fpr: float = 0.0001) -> DataFrame:
    """One-row report: sizes, confusion counts, F1, AUC and TPR at the given FPR."""
    groups = score_groups(scores)
    roc = roc_curve(groups)
    return (
        confusion(groups, threshold)
        .withColumn("auc", auc(roc).scalar())
        .withColumn("tpr_at_fpr", tpr_at_fpr(roc, fpr).scalar())
    )
