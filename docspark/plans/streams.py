"""Streaming jobs over the given tables, drained once, against the batch SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.plans import logs as log_plans
from docspark.plans import uploads as upload_plans
from docspark.plans import views
from docspark.plans.registry import QUERIES, Tables, query
from docspark.session import work_folder
from docspark.streaming import logs, runs, uploads


class StreamTables(Tables):
    """The same tables as streams."""

    def __getattr__(self, name: str):
        return runs.table_stream(self.spark, self.path, name)


def streams(t: Tables) -> StreamTables:
    return StreamTables(t.spark, t.path)


#: Modification time given to the first staged file; the others follow second by second.
FIRST_FILE_MS = 1_700_000_000_000


def staged(t: Tables, df, order: str, batches: int = 4):
    """Derived rows as a stream of ``batches`` micro-batches in time order, written in one job, range by range.

    Files are streamed by their modification time, so each gets one in the order of its range.
    """
    folder = f"{work_folder(t.spark)}/{uuid.uuid4().hex}"
    files = batches * max(1, t.spark.sparkContext.defaultParallelism // 2)
    at = F.col(order).cast("timestamp")
    df.repartitionByRange(files, at).sortWithinPartitions(at).write.parquet(folder)
    hadoop = t.spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = hadoop.getFileSystem(t.spark._jsc.hadoopConfiguration())
    parts = sorted((s.getPath() for s in store.listStatus(hadoop) if s.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    for i, part in enumerate(parts):
        store.setTimes(part, FIRST_FILE_MS + 1000 * i, -1)
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files // batches).parquet(folder)


@query("request_log_stream", QUERIES["request_log_rows"].oracle)
def request_log_stream(t: Tables):
    """Requests masked and levelled as a stream, each request once, stored as parquet."""
    rows = runs.run_to_table(logs.request_log_rows(log_plans.raw_requests(streams(t)), max_body=fixed.MAX_BODY_CHARS))
    return rows.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))


@query(
    "failed_ledger_stream",
    upload_plans.WITH + upload_plans.LEDGER + """
SELECT upload_id, failed_at, error, (SELECT CAST(count(*) AS BIGINT) FROM outc o WHERE o.upload_id = l.upload_id AND outcome = 'failure'
  AND ts > coalesce((SELECT max(ts) FROM outc s WHERE s.upload_id = l.upload_id AND outcome = 'success'), TIMESTAMP '1970-01-01')) AS failures
FROM ledger l""",
)
def failed_ledger_stream(t: Tables):
    """The ledger after several micro-batches; closed uploads have left it, so failures count from the last success on."""
    folder = f"{work_folder(t.spark)}/{uuid.uuid4().hex}"
    stream = uploads.failed_ledger(staged(t, upload_plans.outcomes(t), "ts"), f"{folder}/ledger", f"{folder}/state")
    stream.awaitTermination()
    return uploads.open_failures(t.spark, f"{folder}/ledger")


@query(
    "assembly_stream",
    f"WITH {views.UPLOAD_PARTS}{upload_plans.LATEST},"
    + """
g AS (SELECT multipart_id, max(total_parts) AS total_parts, max(ts) AS last, count(*) AS n,
  list(upload_id ORDER BY part_index) AS part_uploads FROM latest GROUP BY multipart_id)
SELECT multipart_id, CASE WHEN n = total_parts THEN 'assembled' ELSE 'expired' END AS outcome, total_parts, part_uploads
FROM g WHERE n = total_parts OR last <= (SELECT max(ts) FROM parts0) - INTERVAL 70 MINUTES""",
)
def assembly_stream(t: Tables):
    """Uploads assembled, or expired an hour after their last part (watermark ten minutes behind)."""
    return runs.run_to_table(uploads.assemble_multipart(views.upload_parts(streams(t))))


@query(
    "rate_limit_stream",
    """
SELECT time_bucket(INTERVAL 15 MINUTES, created_at) AS window_start, c AS client, CAST(count(*) AS BIGINT) AS requests
FROM (SELECT ts AS created_at, event_type AS c FROM events) GROUP BY 1, 2
HAVING count(*) > 1 AND time_bucket(INTERVAL 15 MINUTES, created_at) <= (SELECT max(ts) FROM events) - INTERVAL 25 MINUTES""",
)
def rate_limit_stream(t: Tables):
    """The rate limit over a stream of several micro-batches: windows closed by the watermark ten minutes behind."""
    events = t.events.select(F.col("ts").alias("created_at"), F.col("event_type").alias("client"))
    closed = logs.rate_limit_violations(staged(t, events, "created_at"), "client", limit=1)
    return runs.run_to_table(closed).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    "job_progress_stream",
    """
WITH items AS (SELECT user_id AS job_id, ts, CASE WHEN user_id % 4 = 0 AND event_id % 10 = 0 THEN 'pending'
    WHEN event_type = 'error' OR user_id % 10 = 1 THEN 'error' ELSE 'success' END AS status FROM events),
cut AS (SELECT *, ts - lag(ts) OVER (PARTITION BY job_id ORDER BY ts) > INTERVAL 1 DAY AS opens FROM items),
runs AS (SELECT *, count(*) FILTER (opens) OVER (PARTITION BY job_id ORDER BY ts) AS run FROM cut),
sums AS (SELECT job_id, min(ts) AS opened_at, count(*) AS total, count(*) FILTER (status <> 'pending') AS finished,
    count(*) FILTER (status = 'success') AS successful FROM runs GROUP BY job_id, run)
SELECT job_id, opened_at, total, finished, CAST(floor(finished * 100 / total + 0.5) AS INTEGER) AS progress, s AS status,
  CASE WHEN s = 'completed' THEN successful END AS results
FROM (SELECT *, CASE WHEN finished < total THEN 'processing' WHEN successful = 0 THEN 'failed' ELSE 'completed' END AS s FROM sums)""",
)
def job_progress_stream(t: Tables):
    """Progress of jobs whose items stream in over several micro-batches; a tenth of the items is sent twice, and a day without items ends a job's run."""
    u, e = F.col("user_id"), F.col("event_id")
    status = F.when((u % 4 == 0) & (e % 10 == 0), "pending").when((F.col("event_type") == "error") | (u % 10 == 1), "error").otherwise("success")
    items = t.events.select(u.alias("job_id"), e.alias("item_id"), "ts", status.alias("status"))
    items = items.unionByName(items.filter(F.col("item_id") % 10 == 3))
    folder = f"{work_folder(t.spark)}/{uuid.uuid4().hex}"
    with runs.stream_settings(t.spark):
        progress = logs.job_progress(staged(t, items, "ts"), idle_seconds=86400)
        logs.store_progress(progress, f"{folder}/rows", f"{folder}/state").awaitTermination()
    return logs.latest_progress(t.spark, f"{folder}/rows").drop("closed").withColumn("opened_at", F.col("opened_at").cast("timestamp_ntz"))
