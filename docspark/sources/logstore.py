"""Request-log and user tables: date-partitioned parquet, or a relational database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_logs(logs: DataFrame, path: str) -> None:
    """Append log rows; the date partition takes the place of an index on the creation time."""
    dated = logs.withColumn("log_date", F.to_date("created_at"))
    dated.write.mode("append").partitionBy("log_date").parquet(path)


def read_logs(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Log rows, reading only the date partitions from ``since`` (YYYY-MM-DD) on."""
    logs = spark.read.parquet(path)
    if since is not None:
        logs = logs.filter(F.col("log_date") >= F.lit(since).cast("date"))
    return logs.drop("log_date")


def read_table(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int,
               properties: dict[str, str] | None = None) -> DataFrame:
    """Parallel JDBC read, split on a numeric key range."""
    return spark.read.jdbc(url, table, key, low, high, partitions, properties=properties or {})


def append_table(df: DataFrame, url: str, table: str, properties: dict[str, str] | None = None) -> None:
    df.write.jdbc(url, table, mode="append", properties=properties or {})
