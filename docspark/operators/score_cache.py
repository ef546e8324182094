"""Scores kept by content hash across runs, so that a text once scored is never scored again.

The store is a parquet table bucketed by the SHA-256 of the text. A run folds its own hashes, anti-joins them
with the store and scores what is left. The store's side of each join is read bucket by bucket and never shuffled, however
large it has grown; what moves are the run's hashes and the texts of new hashes. Scores are appended by Spark's own committer, so
a failed run leaves nothing behind; two runs that score the same text at once leave two equal rows, which count as one.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import stylometry
from docspark.operators.detect import Scorer
from docspark.operators.skew import balanced_join
from docspark.session import cut_lineage

BUCKETS = 256


@dataclass(frozen=True)
class ScoreStore:
    """Scores of one scorer in a shared folder: ``text_hash string, ai_likeness double``.

    ``scorer_id`` names the scorer and its version: another version has scores of its own. The bucket count is a part of the
    path, so a store opened with another count starts empty instead of being misread.
    """

    path: str
    scorer_id: str
    buckets: int = BUCKETS

    @property
    def location(self) -> str:
        return f"{self.path.rstrip('/')}/scorer={self.scorer_id}/buckets={self.buckets}"

    @property
    def name(self) -> str:
        return "score_store_" + hashlib.sha256(self.location.encode()).hexdigest()[:16]

    def open(self, spark: SparkSession) -> DataFrame:
        """The store's rows, one per text; an absent store is made."""
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (text_hash STRING, ai_likeness DOUBLE) USING parquet "
            f"CLUSTERED BY (text_hash) INTO {self.buckets} BUCKETS LOCATION '{self.location}'"
        )
        spark.catalog.refreshTable(self.name)
        return spark.table(self.name).groupBy("text_hash").agg(F.min("ai_likeness").alias("ai_likeness"))

    def append(self, scores: DataFrame) -> None:
        """Add rows; each bucket's rows are brought together first, so a run writes at most one file per bucket."""
        rows = scores.select("text_hash", "ai_likeness").repartition(self.buckets, "text_hash")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "text_hash").option("path", self.location).saveAsTable(self.name)


def cached_scores(df: DataFrame, store: ScoreStore, scorer: Scorer = stylometry.fast_score, key: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """``key, text_hash, copies, known, ai_likeness`` of every row; texts new to ``store`` are scored once and added to it.

    ``known`` says that the store held the text before this run. A null text has no hash, counts as not known and has no
    score; its copies are 0. Repeated rows are each answered. The narrow rows are written once; a text that owns a large share
    of them is spread by the join.
    """
    spark = df.sparkSession
    text_hash: Column = F.sha2(F.col(text_col), 256).alias("text_hash")
    rows = cut_lineage(df.select(F.col(key), text_hash))
    needed = rows.filter("text_hash IS NOT NULL").groupBy("text_hash").agg(F.count("*").alias("copies"))
    new = cut_lineage(needed.join(store.open(spark), "text_hash", "left_anti").select("text_hash"))
    texts = df.select(text_hash, F.col(text_col).alias("_text")).join(new, "text_hash", "left_semi")
    distinct = texts.groupBy("text_hash").agg(F.first("_text").alias("_text"))
    store.append(distinct.select("text_hash", scorer(F.col("_text")).alias("ai_likeness")))

    fresh = new.withColumn("_new", F.lit(True))
    scored = cut_lineage(
        needed.join(store.open(spark), "text_hash").join(fresh, "text_hash", "left")
        .select("text_hash", "copies", F.col("_new").isNull().alias("known"), "ai_likeness")
    )
    found = balanced_join(rows.filter("text_hash IS NOT NULL"), scored, ["text_hash"], scored, [key], count_col="copies")
    columns = [F.col(key), "text_hash", "copies", "known", "ai_likeness"]
    nothing = rows.filter("text_hash IS NULL").select(
        F.col(key), "text_hash", F.lit(0).cast("bigint").alias("copies"), F.lit(False).alias("known"), F.lit(None).cast("double").alias("ai_likeness")
    )
    return found.select(*columns).unionByName(nothing)
