"""Evaluation input and saved experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_eval_jsonl(spark: SparkSession, path: str, human_key: str, machine_key: str | None = None,
                    schema: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(human texts, machine texts) of a JSON-lines file.

    The machine column defaults to the last one whose name contains ``generated_text``.
    """
    reader = spark.read if schema is None else spark.read.schema(schema)
    records = reader.json(path)
    if machine_key is None:
        machine_key = [c for c in records.columns if "generated_text" in c][-1]
    return records.select(F.col(human_key).alias("text")), records.select(F.col(machine_key).alias("text"))


def save_experiment(scores: DataFrame, report: DataFrame, path: str) -> None:
    """Score frame as CSV and the one-row report as JSON under a folder."""
    scores.select("score", "class", "pred").write.mode("overwrite").option("header", "true").csv(f"{path}/score_df")
    report.write.mode("overwrite").json(f"{path}/details")
