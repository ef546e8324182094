"""Run a stream over what is available and hand back its result as a table."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from docspark.session import work_folder
from docspark.streaming.uploads import ROCKSDB

def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a folder as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


@contextmanager
def stream_settings(spark: SparkSession):
    """Settings for the stateful queries started inside; the session's own return afterwards.

    RocksDB keeps state off the heap, and two state partitions per core replace the batch
    partition count, which adaptive execution cannot lower for streams.
    """
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.shuffle.partitions": str(2 * spark.sparkContext.defaultParallelism),
    }
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def run_to_table(stream: DataFrame, timeout_seconds: int = 3600) -> DataFrame:
    """Drain an append-mode stream into the shared folder and read the rows it wrote."""
    spark = stream.sparkSession
    folder = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    with stream_settings(spark):
        query = (
            stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
            .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        )
        if not query.awaitTermination(timeout_seconds):
            query.stop()
            raise TimeoutError(f"the stream did not drain within {timeout_seconds} seconds")
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
