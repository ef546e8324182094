"""Request logs and job progress as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docspark.functions import fixed
from docspark.operators import logs


def rate_limit_violations(requests: DataFrame, client: str = "user_id", delay: str = "10 minutes",
                          window: str = fixed.RATE_WINDOW, limit: int = fixed.RATE_MAX_REQUESTS) -> DataFrame:
    """Closed windows in which a client went over the limit."""
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    return logs.rate_limit_violations(timed.withWatermark("created_at", delay), client, window, limit)


def request_log_rows(requests: DataFrame, delay: str = "10 minutes", sample_rate: float = 1.0,
                     max_body: int | None = None) -> DataFrame:
    """Log rows of a request stream, each request id once within the watermark."""
    timed = requests.withColumn("created_at", F.col("created_at").cast("timestamp"))
    unique = timed.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["request_id"])
    return logs.request_log_rows(unique, sample_rate, max_body=max_body)


def store_logs(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append log rows to date-partitioned parquet, exactly once."""
    return (
        rows.withColumn("log_date", F.to_date("created_at"))
        .writeStream.partitionBy("log_date")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


PROGRESS = "job_id bigint, opened_at timestamp, total bigint, finished bigint, progress int, status string, results bigint, closed boolean"
ENDED = ("success", "error")


#: Hash buckets of active jobs; a batch rewrites only those that its items fall into. A checkpoint is bound to their number.
JOB_BUCKETS = 1024


def _tracker(idle_ms: int):
    """State per bucket of jobs: their counts, and the newest status of each item; both go when a job has been idle in event time.

    Every access to state is a call to the JVM, so a bucket's counts and items are read and written as one list each, and its timer is
    the earliest end of its jobs.
    """
    from pyspark.sql import Row
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Tracker(StatefulProcessor):
        def init(self, handle):
            self.handle = handle
            self.items = handle.getListState("items", "job_id bigint, item_id bigint, status string, micros bigint")
            self.counts = handle.getListState("counts", "job_id bigint, opened bigint, newest bigint, total bigint, finished bigint, successful bigint")
            self.timer = handle.getValueState("timer", "at bigint")

        def handleInputRows(self, key, rows, timerValues):
            timer = self.timer.get()
            jobs, items = self._stored() if timer else ({}, {})
            arrived = {}
            for row in rows:
                arrived.setdefault(row.job_id, []).append((row.micros, row.item_id, row.status))
            for job_id, news in arrived.items():
                counts, known = jobs.get(job_id), items.setdefault(job_id, {})
                for micros, item_id, status in sorted(news, key=lambda n: (n[0], n[1], n[2] or "")):
                    if counts and micros - counts[1] > 1000 * idle_ms:
                        yield self._row(job_id, counts, True)
                        known.clear()
                        counts = None
                    counts = counts or [micros, micros, 0, 0, 0]
                    counts[1] = max(counts[1], micros)
                    self._take(counts, known, item_id, status, micros)
                jobs[job_id] = counts
                yield self._row(job_id, counts, False)
            if timer:
                self.handle.deleteTimer(timer[0])
            self._store(jobs, items)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            jobs, items = self._stored()
            now = timerValues.getCurrentWatermarkInMs()
            for job_id, counts in list(jobs.items()):
                if self._end(counts) <= now:
                    yield self._row(job_id, counts, True)
                    del jobs[job_id], items[job_id]
            self._store(jobs, items)

        def close(self):
            pass

        def _stored(self):
            jobs = {job_id: counts for job_id, *counts in self.counts.get()}
            items = {job_id: {} for job_id in jobs}
            for job_id, item_id, status, micros in self.items.get():
                items[job_id][item_id] = (status, micros)
            return jobs, items

        def _store(self, jobs, items):
            if not jobs:
                for state in (self.items, self.counts, self.timer):
                    state.clear()
                return
            self.counts.put([(job_id, *counts) for job_id, counts in jobs.items()])
            self.items.put([(job_id, item_id, *seen) for job_id, known in items.items() for item_id, seen in known.items()])
            at = min(map(self._end, jobs.values()))
            self.timer.update((at,))
            self.handle.registerTimer(at)

        def _end(self, counts):
            return counts[1] // 1000 + idle_ms

        def _take(self, counts, known, item_id, status, micros):
            """Count an item's status in place of an older one; one sent again or late changes nothing."""
            seen = known.get(item_id)
            if seen is None:
                counts[2] += 1
            elif micros < seen[1]:
                return
            else:
                counts[3] -= seen[0] in ENDED
                counts[4] -= seen[0] == "success"
            counts[3] += status in ENDED
            counts[4] += status == "success"
            known[item_id] = (status, micros)

        def _row(self, job_id, counts, closed):
            opened, _, total, finished, successful = counts
            status = "processing" if finished < total else "failed" if not successful else "completed"
            return Row(
                job_id=job_id, opened=opened, total=total, finished=finished, progress=int(finished * 100 / total + 0.5), status=status,
                results=successful if status == "completed" else None, closed=closed)

    return Tracker()


def job_progress(items: DataFrame, delay: str = "10 minutes", idle_seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """Progress per job for the update output mode: ``job_id, opened_at, total, finished, progress, status, results, closed``.

    ``items`` holds (job_id, item_id, ts, status); the newest status of an item counts, so items sent again are not counted twice. A
    job ends when no item came for ``idle_seconds`` in event time: its last row is marked ``closed`` and its state goes, so state holds
    only jobs active within that time and the watermark's ``delay``. Later items open the job anew. Needs the RocksDB state store. The metric
    ``job_items`` (items, finished) of every micro-batch is in the query's progress.
    """
    timed = items.select("job_id", "item_id", "status", F.col("ts").cast("timestamp").alias("ts")).withColumns({
        "micros": F.unix_micros("ts"), "bucket": F.pmod(F.xxhash64("job_id"), F.lit(JOB_BUCKETS)).cast("int")})
    counted = timed.observe("job_items", F.count(F.lit(1)).alias("items"), F.count_if(F.col("status").isin(*ENDED)).alias("finished"))
    tracked = counted.withWatermark("ts", delay).groupBy("bucket").transformWithState(
        _tracker(idle_seconds * 1000), PROGRESS.replace("opened_at timestamp", "opened bigint"), outputMode="update", timeMode="EventTime")
    return tracked.select("job_id", F.timestamp_micros("opened").alias("opened_at"), "total", "finished", "progress", "status", "results", "closed")


def store_progress(progress: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a stream that keeps every micro-batch's changes, one folder per batch; a replayed batch writes its own folder again."""
    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return progress.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_progress(spark: SparkSession, path: str) -> DataFrame:
    """The newest row of every run of a job: of one micro-batch, the one with more items."""
    rows = spark.read.schema(f"{PROGRESS}, epoch bigint").parquet(path)
    newest = F.max_by(F.struct("total", "finished", "progress", "status", "results", "closed"), F.struct("epoch", "closed", "total")).alias("r")
    return rows.groupBy("job_id", "opened_at").agg(newest).select("job_id", "opened_at", "r.*")
