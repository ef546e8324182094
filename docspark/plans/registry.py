"""Registry of named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from docspark.sources.tables import spread


class Tables:
    """Lazy access to the parquet tables of one folder: ``Tables(spark, path).documents``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")

    @property
    def texts(self) -> DataFrame:
        """(doc_id, text) of every document, spread over all cores."""
        return spread(self.documents.select("doc_id", "text"))

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    oracle: str | None

    def __call__(self, spark: SparkSession, path: str) -> DataFrame:
        return self.build(Tables(spark, path))


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    """Register ``build(tables)`` under ``name`` with the SQL that must give the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, build, oracle)
        return build

    return register
