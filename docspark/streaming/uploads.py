"""Upload events as streams: part assembly with expiry, and the ledger of failures."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.functions import fixed

ASSEMBLY_SCHEMA = "multipart_id bigint, outcome string, total_parts int, part_uploads array<bigint>"
#: Hash buckets of open uploads; a batch rewrites only those that its parts fall into. A checkpoint is bound to their number.
ASSEMBLY_BUCKETS = 1024
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _assembler(idle_ms: int):
    """State per bucket of uploads: the newest copy of each part of the open ones; an upload idle in event time expires.

    Every access to state is a call to the JVM, so a bucket's parts are read and written as one list, and its timer is the earliest
    expiry of its uploads.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Assembler(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.parts = handle.getListState("parts", "multipart_id bigint, part_index int, micros bigint, upload_id bigint, total int")
            self.timer = handle.getValueState("timer", "at bigint")

        def handleInputRows(self, key, rows, timerValues):
            timer = self.timer.get()
            uploads = self._stored() if timer else {}
            for row in rows:
                parts = uploads.setdefault(row.multipart_id, {})
                part = (row.micros, row.upload_id, row.total_parts)
                known = parts.get(row.part_index)
                if known is None or part[:2] > known[:2]:
                    parts[row.part_index] = part
            for multipart_id, parts in list(uploads.items()):
                if len(parts) == parts[min(parts)][2]:
                    yield self._row(multipart_id, "assembled", uploads.pop(multipart_id))
            if timer:
                self.handle.deleteTimer(timer[0])
            self._store(uploads)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            uploads = self._stored()
            now = timerValues.getCurrentWatermarkInMs()
            for multipart_id, parts in list(uploads.items()):
                if self._expiry(parts) <= now:
                    yield self._row(multipart_id, "expired", uploads.pop(multipart_id))
            self._store(uploads)

        def close(self):
            pass

        def _stored(self):
            uploads = {}
            for multipart_id, part_index, *part in self.parts.get():
                uploads.setdefault(multipart_id, {})[part_index] = tuple(part)
            return uploads

        def _store(self, uploads):
            if not uploads:
                self.parts.clear()
                self.timer.clear()
                return
            self.parts.put([(multipart_id, index, *part) for multipart_id, parts in uploads.items() for index, part in parts.items()])
            at = min(map(self._expiry, uploads.values()))
            self.timer.update((at,))
            self.handle.registerTimer(at)

        def _expiry(self, parts):
            return max(part[0] for part in parts.values()) // 1000 + idle_ms

        def _row(self, multipart_id, outcome, parts):
            indexes = sorted(parts)
            return Row(multipart_id=multipart_id, outcome=outcome, total_parts=parts[indexes[0]][2], part_uploads=[parts[i][1] for i in indexes])

    return Assembler()


def assemble_multipart(parts: DataFrame, delay: str = "10 minutes",
                       idle_seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """Stream of finished uploads: assembled once all parts are in, or expired after an idle hour.

    A part that arrives after the expiry opens a new assembly. Needs the RocksDB state store.
    """
    timed = parts.withColumn("ts", F.col("ts").cast("timestamp")).select(
        "multipart_id", "part_index", "total_parts", "upload_id", "ts", F.unix_micros("ts").alias("micros"),
        F.pmod(F.xxhash64("multipart_id"), F.lit(ASSEMBLY_BUCKETS)).cast("int").alias("bucket"))
    return (
        timed.withWatermark("ts", delay)
        .groupBy("bucket")
        .transformWithState(
            _assembler(idle_seconds * 1000), ASSEMBLY_SCHEMA, outputMode="append", timeMode="EventTime"
        )
    )


LEDGER = "upload_id bigint, ts timestamp, outcome string, error string, failures bigint, bucket int, version bigint, run string, epoch bigint"
#: Hash buckets of a ledger; a batch rewrites only those that its uploads fall into.
BUCKETS = 64


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of all kept versions; None where no ledger is yet."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as problem:
        if "PATH_NOT_FOUND" in str(problem):
            return None
        raise


def _newest(ledger: DataFrame) -> DataFrame:
    """The rows of every bucket's last version."""
    last = ledger.groupBy("bucket").agg(F.max("version").alias("version"))
    return ledger.join(F.broadcast(last), ["bucket", "version"])


def fold_outcomes(rows: DataFrame) -> DataFrame:
    """``bucket, upload_id, ts, outcome, error, failures, new, known``: one row per upload of its events and its stored row.

    The latest event decides; ties go to the larger outcome. ``failures`` counts those after the last success.
    """
    keys = ["bucket", "upload_id"]
    last = rows.groupBy(*keys).agg(
        F.max(F.struct("ts", "outcome", "error")).alias("l"), F.max(F.when(F.col("outcome") == "success", F.col("ts"))).alias("closed_at"),
        F.max("new").alias("new"), F.min("new").alias("_all_new"),
    )
    since = rows.join(last.select(*keys, "closed_at"), keys).filter(F.col("closed_at").isNull() | (F.col("ts") > F.col("closed_at")))
    counted = since.groupBy(*keys).agg(F.sum("failures").alias("failures"))
    return last.join(counted, keys, "left").select(
        *keys, "l.ts", "l.outcome", "l.error", F.coalesce("failures", F.lit(0)).cast("bigint").alias("failures"), "new", (F.col("_all_new") == 0).alias("known"))


def update_ledger(batch: DataFrame, epoch: int, path: str, run: str, delay: str = "1 hour", buckets: int = BUCKETS) -> None:
    """Fold a batch of upload outcomes into the ledger: parquet, partitioned by bucket and version.

    Only the buckets of the batch's uploads are read and written, as their next version; readers take each bucket's last one, so they never
    see half a bucket. A replayed batch (same ``run``, the id that the checkpoint keeps, and ``epoch``) starts from the versions before it and
    overwrites its own ones. Versions before the previous one are removed.

    Each bucket has a watermark, ``delay`` behind the newest event that earlier batches brought. Closed uploads behind it leave the ledger when
    their bucket is written next; an event behind it of an upload that the ledger does not know is late and ignored. Events without
    an upload id are ignored.
    """
    spark = batch.sparkSession
    bucket = F.pmod(F.xxhash64("upload_id"), F.lit(buckets)).cast("int").alias("bucket")
    is_failure = (F.col("outcome") == "failure").cast("bigint").alias("failures")
    events = batch.filter("upload_id IS NOT NULL").select("upload_id", F.col("ts").cast("timestamp").alias("ts"), "outcome", "error", is_failure, bucket).persist()
    try:
        touched = sorted(r["bucket"] for r in events.select("bucket").distinct().collect())
        if not touched:
            return
        version, rows = 0, events.withColumn("new", F.lit(1))
        marks = events.groupBy("bucket").agg(F.max("ts").alias("ts"))
        before = marks.limit(0).withColumnRenamed("ts", "seen")
        stored = _stored(spark, path)
        if stored is not None:
            own = stored.filter((F.col("run") == run) & (F.col("epoch") == epoch)).agg(F.max("version")).first()[0]
            version = own if own is not None else 1 + (stored.agg(F.max("version")).first()[0] or 0)
            base = _newest(stored.filter(F.col("bucket").isin(touched) & (F.col("version") < version)))
            rows = rows.unionByName(base.filter("upload_id IS NOT NULL").select(*events.columns, F.lit(0).alias("new")))
            before = base.filter("upload_id IS NULL").select("bucket", F.col("ts").alias("seen"))
            marks = marks.unionByName(before.withColumnRenamed("seen", "ts")).groupBy("bucket").agg(F.max("ts").alias("ts"))
        folded = fold_outcomes(rows).join(F.broadcast(before), "bucket", "left").withColumn("behind", F.coalesce(F.col("ts") < F.col("seen") - F.expr(f"INTERVAL {delay}"), F.lit(False)))
        kept = folded.filter(~(F.col("behind") & F.when(F.col("known"), (F.col("new") == 0) & (F.col("outcome") == "success")).otherwise(F.lit(True))))
        written = kept.select("upload_id", "ts", "outcome", "error", "failures", "bucket").unionByName(marks, allowMissingColumns=True)
        stamped = written.withColumns({"version": F.lit(version).cast("bigint"), "run": F.lit(run), "epoch": F.lit(epoch).cast("bigint")})
        stamped.repartition(len(touched), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "version", "run", "epoch").parquet(path)
    finally:
        events.unpersist()
    _forget_versions(spark, path, touched, version)


def _forget_versions(spark: SparkSession, path: str, touched: list[int], version: int) -> None:
    """Remove what is older than the last version before ``version`` in the touched buckets."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for bucket in touched:
        found = {int(s.getPath().getName().split("=")[1]): s.getPath() for s in files.listStatus(hadoop(f"{path}/bucket={bucket}")) if "=" in s.getPath().getName()}
        for old in sorted(v for v in found if v < version)[:-1]:
            files.delete(found[old], True)


def failed_ledger(outcomes: DataFrame, path: str, checkpoint: str, delay: str = "1 hour", buckets: int = BUCKETS) -> StreamingQuery:
    """Start the ledger stream over what is available."""
    def fold(batch: DataFrame, epoch: int) -> None:
        update_ledger(batch, epoch, path, batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId"), delay, buckets)

    return (
        outcomes.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_failures(spark: SparkSession, path: str) -> DataFrame:
    """``upload_id, failed_at, error, failures``: uploads whose last event is a failure, and how often they failed since their last success."""
    return _newest(_stored(spark, path)).filter("outcome = 'failure'").select("upload_id", F.col("ts").alias("failed_at"), "error", "failures")
