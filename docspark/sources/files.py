"""Object listings and whole-file text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_objects(spark: SparkSession, prefix: str, recursive: bool = True, glob: str | None = None) -> DataFrame:
    """(key, size, last_modified) of every object under a prefix; contents are never read.

    Listed by the driver, through Spark's own file index, which leaves out empty objects; ``sources.listing`` lists in parallel, with them.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(prefix).select(
        F.col("path").alias("key"), F.col("length").alias("size"), F.col("modificationTime").alias("last_modified")
    )


def read_blobs(spark: SparkSession, prefix: str, glob: str = "*") -> DataFrame:
    """(path, content) of every matching file."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(prefix)
        .select("path", "content")
    )


def write_blobs(df: DataFrame, path: str) -> None:
    """(path, content) rows as a table: millions of small files are no output format for a cluster."""
    df.select("path", "content").write.mode("overwrite").parquet(path)


def read_txt(spark: SparkSession, prefix: str) -> DataFrame:
    """(path, text): one row per UTF-8 text file."""
    return (
        spark.read.text(prefix, wholetext=True, recursiveFileLookup=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )


def write_txt(df: DataFrame, path: str, text_col: str = "text") -> None:
    """Text rows as UTF-8 text; formats without a writer of their own end up here too."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def read_documents(spark: SparkSession, prefix: str, file_format: str) -> DataFrame:
    """(path, text, error) of DOCX or text files; other formats have to arrive as text."""
    if file_format.lower() == "docx":
        from docspark.sources.docx import docx_documents

        return docx_documents(read_blobs(spark, prefix, "*.docx"))
    if file_format.lower() == "txt":
        return read_txt(spark, prefix).withColumn("error", F.lit(None).cast("string"))
    raise ValueError(f"unsupported file format: {file_format}")
