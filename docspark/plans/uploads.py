"""Queries over upload events in batch form."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from docspark.functions import naming
from docspark.operators import uploads
from docspark.plans import views
from docspark.plans.registry import Tables, query
from docspark.session import work_folder
from docspark.sources import assembled

WITH = f"WITH {views.UPLOAD_PARTS}"
LATEST = """,
latest AS (SELECT multipart_id, part_index, max_by(upload_id, (ts, upload_id)) AS upload_id, max(ts) AS ts,
  max(total_parts) AS total_parts FROM upload_parts GROUP BY 1, 2)"""
NOW = dt.datetime(2024, 1, 20, 12, 0, 0)


@query(
    "assemble_multipart",
    WITH + LATEST
    + """
SELECT multipart_id, max(total_parts) AS total_parts, max(ts) AS completed_at,
  list(upload_id ORDER BY part_index) AS part_uploads
FROM latest GROUP BY multipart_id HAVING count(*) = max(total_parts)""",
)
def assemble_multipart(t: Tables):
    return uploads.assemble_multipart(views.upload_parts(t))


@query(
    "stale_uploads",
    WITH + LATEST
    + """
SELECT multipart_id, CAST(count(*) AS BIGINT) AS received_parts, max(total_parts) AS total_parts,
  max(ts) AS last_part_at
FROM latest GROUP BY multipart_id
HAVING count(*) < max(total_parts) AND max(ts) < TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 1 HOUR""",
)
def stale_uploads(t: Tables):
    return uploads.stale_assemblies(views.upload_parts(t), F.lit(NOW).cast("timestamp_ntz"))


@query(
    "concatenate_parts",
    """
SELECT multipart_id, CAST(total AS INTEGER) AS total_parts, CASE WHEN n = total THEN content END AS content,
  CASE WHEN n <> total THEN 'missing part' END AS error
FROM (SELECT event_id // 4 AS multipart_id, CASE WHEN (event_id // 4) % 3 = 0 THEN 5 ELSE 4 END AS total, count(*) AS n,
  string_agg(props, '' ORDER BY event_id % 4) AS content FROM events GROUP BY 1, 2)""",
)
def concatenate_parts(t: Tables):
    e = F.col("event_id")
    upload = F.floor(e / 4).cast("bigint")
    parts = t.events.select(
        upload.alias("multipart_id"), (e % 4).cast("int").alias("part_index"),
        views.announced_parts(upload).alias("total_parts"), F.col("props").alias("data"), "ts", e.alias("upload_id"),
    )
    return uploads.concatenate_parts(parts)


@query(
    "assembled_files",
    """
WITH parts AS (SELECT event_id // 4 AS multipart_id, event_id % 4 AS part_index, CASE WHEN (event_id // 4) % 3 = 0 THEN 5 ELSE 4 END AS total,
    coalesce(props, '') || CASE WHEN event_id % 11 = 0 THEN ' sent again' ELSE '' END AS data FROM events),
files AS (SELECT multipart_id, total, count(*) AS n, string_agg(data, '' ORDER BY part_index) AS content,
    list_min(list_filter(range(total), lambda i: NOT list_contains(list(part_index), i))) AS missing FROM parts GROUP BY 1, 2)
SELECT multipart_id, CAST(total AS INTEGER) AS total_parts, CAST(n AS INTEGER) AS parts, CASE WHEN missing IS NULL THEN CAST(strlen(content) AS BIGINT) END AS bytes,
  CASE WHEN missing IS NULL THEN sha256(content) END AS sha256, CAST(missing AS INTEGER) AS missing_index,
  CASE WHEN missing IS NOT NULL THEN 'missing part' END AS error FROM files""",
)
def assembled_files(t: Tables):
    """Files of the complete uploads, written block by block (9 characters each); every eleventh part is sent again with other contents."""
    parts = views.upload_parts(t).join(t.events.select(F.col("event_id").alias("e"), "props"), F.col("upload_id") % 1_000_000_000 == F.col("e"))
    again = F.when(F.col("upload_id") >= 1_000_000_000, " sent again").otherwise("")
    parts = parts.withColumn("data", F.concat(F.coalesce("props", F.lit("")), again)).drop("props", "e")
    folder = f"{work_folder(t.spark)}/{uuid.uuid4().hex}"
    return assembled.write_assembled(assembled.split_blocks(parts, block=9), folder).drop("path")


LEDGER = """,
outc AS (SELECT user_id AS upload_id, ts, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'failure' ELSE 'success'
  END AS outcome, CASE WHEN event_type = 'error' OR event_id % 3 = 0 THEN 'code ' || (event_id % 5) END AS error FROM events),
ledger AS (SELECT upload_id, max(ts) AS failed_at, max_by(error, ts) AS error,
  CAST(count(*) FILTER (WHERE outcome = 'failure') AS BIGINT) AS failures
  FROM outc GROUP BY upload_id HAVING max_by(outcome, ts) = 'failure')"""


def outcomes(t: Tables):
    failed = (F.col("event_type") == "error") | (F.col("event_id") % 3 == 0)
    return t.events.select(
        F.col("user_id").alias("upload_id"), "ts", F.when(failed, "failure").otherwise("success").alias("outcome"),
        F.when(failed, F.concat(F.lit("code "), (F.col("event_id") % 5).cast("string"))).alias("error"),
    )


@query("failed_ledger", WITH + LEDGER + "\nSELECT upload_id, failed_at, error, failures FROM ledger")
def failed_ledger(t: Tables):
    return uploads.failed_ledger(outcomes(t))


@query(
    "retry_uploads",
    WITH + LEDGER
    + """
SELECT r.c_custkey AS upload_id, CASE WHEN l.upload_id IS NULL THEN 'not_found' WHEN r.c_custkey % 3 = 0
  THEN 'file_missing' ELSE 'retried' END AS verdict
FROM customer r LEFT JOIN ledger l ON l.upload_id = r.c_custkey""",
)
def retry_uploads(t: Tables):
    """A retry of every customer's upload, where every third staged file is gone."""
    requests = t.customer.select(F.col("c_custkey").alias("upload_id"))
    files = requests.filter(F.col("upload_id") % 3 != 0)
    return uploads.retry_uploads(requests, uploads.failed_ledger(outcomes(t)), files)[0]


@query(
    "retry_remaining",
    WITH + LEDGER + "\nSELECT upload_id, failed_at, error, failures FROM ledger WHERE upload_id % 3 = 0",
)
def retry_remaining(t: Tables):
    """The ledger after those retries."""
    requests = t.customer.select(F.col("c_custkey").alias("upload_id"))
    files = requests.filter(F.col("upload_id") % 3 != 0)
    return uploads.retry_uploads(requests, uploads.failed_ledger(outcomes(t)), files)[1]


@query(
    "rejected_duplicates",
    """
SELECT doc_id, source || '.pdf' AS name FROM documents d
WHERE EXISTS (SELECT 1 FROM documents x WHERE x.lang = 'fr' AND x.source = d.source AND x.n_chars = d.n_chars)""",
)
def rejected_duplicates(t: Tables):
    """Uploads refused because a file of the same name and size is stored (those of French documents)."""
    d = t.documents.select("doc_id", F.concat("source", F.lit(".pdf")).alias("name"), F.col("n_chars").alias("size"), "lang")
    return uploads.split_duplicates(d, d.filter("lang = 'fr'"), ["name", "size"])[1].select("doc_id", "name")


@query(
    "queue_files",
    """
SELECT DISTINCT source || '.pdf' AS name, n_chars AS size FROM documents d WHERE lang <> 'fr'
AND NOT EXISTS (SELECT 1 FROM documents x WHERE x.lang = 'fr' AND x.source = d.source AND x.n_chars = d.n_chars)""",
)
def queue_files(t: Tables):
    d = t.documents.select(F.concat("source", F.lit(".pdf")).alias("name"), F.col("n_chars").alias("size"), "lang")
    return uploads.queue_files(d.filter("lang <> 'fr'"), d.filter("lang = 'fr'")).select("name", "size")


@query(
    "number_duplicates",
    """
WITH files AS (SELECT event_id, event_type AS dir, CASE WHEN event_id % 50 = 7 THEN 'report(' || event_id % 4 || ')' ELSE 'report' END
    || CASE WHEN user_id % 3 = 0 THEN '.tar' ELSE '.pdf' END AS name FROM events),
stored AS (SELECT DISTINCT event_type AS dir, unnest(['report.pdf', 'report(1).pdf', 'report(5).tar', 'report(6).tar', 'report(08).tar']) AS name FROM events),
present AS (SELECT DISTINCT dir, name FROM files UNION SELECT dir, name FROM stored),
reserved AS (SELECT dir, regexp_replace(name, '\\([0-9]+\\)', '') AS family, list(DISTINCT regexp_extract(name, '\\(([0-9]+)\\)', 1)::BIGINT) AS ks
  FROM present WHERE regexp_matches(name, '\\([1-9][0-9]*\\)\\.') GROUP BY ALL),
ranked AS (SELECT f.*, row_number() OVER (PARTITION BY f.dir, f.name ORDER BY event_id) - 1 + (s.name IS NOT NULL)::BIGINT AS r
  FROM files f LEFT JOIN stored s ON s.dir = f.dir AND s.name = f.name),
placed AS (SELECT ranked.*, coalesce(ks, []) AS ks FROM ranked LEFT JOIN reserved ON reserved.dir = ranked.dir AND family = name)
SELECT event_id, dir, name, CASE WHEN r = 0 THEN name ELSE regexp_extract(name, '^(.*)\\.', 1) || '('
  || list_filter(range(1, r + len(ks) + 1), lambda k: NOT list_contains(ks, k))[r] || ').' || regexp_extract(name, '([a-z]+)$', 1) END AS final_name
FROM placed""",
)
def number_duplicates(t: Tables):
    """Files numbered per directory and name around stored names and incoming ones that look numbered."""
    files = t.events.select(
        "event_id", F.col("event_type").alias("dir"),
        F.concat(
            F.when(F.col("event_id") % 50 == 7, F.concat(F.lit("report("), (F.col("event_id") % 4).cast("string"), F.lit(")"))).otherwise("report"),
            F.when(F.col("user_id") % 3 == 0, ".tar").otherwise(".pdf"),
        ).alias("name"),
    )
    dirs = t.events.select(F.col("event_type").alias("dir")).distinct()
    names = ["report.pdf", "report(1).pdf", "report(5).tar", "report(6).tar", "report(08).tar"]
    existing = dirs.withColumn("name", F.explode(F.array(*[F.lit(n) for n in names])))
    return uploads.number_duplicates(files, existing, order=["event_id"])


@query(
    "final_names",
    """
SELECT page_id, regexp_replace(url, '[^a-zA-Z0-9._-]', '_', 'g') AS final_name FROM pages""",
)
def final_names(t: Tables):
    files = t.pages.select("page_id", F.col("page_id").alias("upload_id"), F.col("url").alias("name"))
    return uploads.final_names(files, "original").select("page_id", "final_name")


@query(
    "clean_metadata",
    r"""
SELECT doc_id,
  trim(regexp_replace(regexp_replace(replace(translate(regexp_replace(text || chr(9) || ' “x” – y…', '[\x00-\x1F\x7F]', '', 'g'),
    '–—“”‘’', '--""''' || ''''), '…', '...'), '[^\x20-\x7E]', '-', 'g'), '\s+', ' ', 'g')) AS metadata,
  regexp_replace(source || ' ' || lang || '/' || doc_id || '.pdf', '[^a-zA-Z0-9._-]', '_', 'g') AS filename,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE lang || '/' || source || '/' END AS destination
FROM documents""",
)
def clean_metadata(t: Tables):
    """Texts as header values, names with odd characters, destination paths with stray slashes."""
    d = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        naming.sanitize_metadata_value(F.concat("text", F.lit("\t “x” – y…"))).alias("metadata"),
        naming.sanitize_filename(
            F.concat("source", F.lit(" "), "lang", F.lit("/"), d.cast("string"), F.lit(".pdf"))
        ).alias("filename"),
        naming.normalize_destination_path(
            F.when(d % 3 == 0, F.lit(" // ")).otherwise(F.concat(F.lit(" //"), "lang", F.lit("/"), "source", F.lit("///")))
        ).alias("destination"),
    )


@query(
    "part_counts",
    """
SELECT doc_id, CAST(CASE WHEN s <= 536870912 THEN 1 WHEN s > 4294967296 THEN 8 ELSE ceil(s / 536870912) END AS INTEGER) AS parts
FROM (SELECT doc_id, n_chars * 300000 AS s FROM documents)""",
)
def part_counts(t: Tables):
    return t.documents.select("doc_id", naming.part_count(F.col("n_chars") * 300000).alias("parts"))


@query(
    "upload_metadata",
    """
SELECT doc_id, source || '.docx' AS filename, lang AS filetype, CAST(n_chars AS BIGINT) AS size, CAST(3 AS INTEGER) AS entries
FROM documents""",
)
def upload_metadata(t: Tables):
    """Headers of base64 pairs (one without a value) parsed back."""
    def pair(key: str, value):
        return F.concat(F.lit(key + " "), F.base64(F.encode(value, "UTF-8")))

    header = F.concat_ws(
        ",", pair("filename", F.concat("source", F.lit(".docx"))), F.lit("empty"), pair("filetype", F.col("lang")),
        pair("size", F.col("n_chars").cast("string")),
    )
    parsed = t.documents.select("doc_id", naming.parse_upload_metadata(header).alias("m"))
    return parsed.select(
        "doc_id", F.col("m")["filename"].alias("filename"), F.col("m")["filetype"].alias("filetype"),
        F.col("m")["size"].try_cast("bigint").alias("size"), F.size("m").alias("entries"),
    )


@query(
    "pending_uploads",
    """
SELECT 'f' || page_id AS upload_id, CASE WHEN page_id % 3 = 0 THEN 'page' || page_id || '.html' ELSE 'f' || page_id END
  AS filename, CASE WHEN page_id % 3 = 0 THEN 'u' || (page_id % 7) ELSE 'default-user' END AS user_id,
  CASE WHEN page_id % 5 = 0 THEN 'error' ELSE 'success' END AS status FROM pages""",
)
def pending_uploads(t: Tables):
    """Staged pages: a third with readable metadata, a third with broken metadata, a third without."""
    p = F.col("page_id")
    s = p.cast("string")
    base = t.pages.select(p, s.alias("s"), F.when(p % 5 == 0, 0).otherwise(F.length("html")).alias("size"), "html")
    files = base.select(F.concat(F.lit("f"), "s").alias("name"), "size", F.lit(None).cast("string").alias("content"))
    info = base.filter(p % 3 < 2).select(
        F.concat(F.lit("f"), "s", F.lit(".info")).alias("name"), F.lit(10).alias("size"),
        F.when(p % 3 == 0, F.concat(F.lit('{"metadata":{"filename":"page'), "s", F.lit('.html","userId":"u'),
                                    (p % 7).cast("string"), F.lit('"}}'))).otherwise("{broken").alias("content"),
    )
    other = base.select(F.concat(F.lit("assembled-"), "s").alias("name"), "size", F.col("html").alias("content"))
    done = base.select(F.concat(F.lit("f"), "s", F.lit(".uploaded")).alias("name"), "size", F.col("html").alias("content"))
    storage = files.unionByName(info).unionByName(other).unionByName(done)
    return uploads.pending_uploads(storage)


@query(
    "job_progress",
    """
SELECT job_id, CAST(total AS BIGINT) AS total, CAST(finished AS BIGINT) AS finished,
  CAST(floor(finished * 100 / total + 0.5) AS INTEGER) AS progress, s AS status,
  CASE WHEN s = 'completed' THEN CAST(successful AS BIGINT) END AS results
FROM (SELECT *, CASE WHEN finished < total THEN 'processing' WHEN successful = 0 THEN 'failed' ELSE 'completed' END AS s
  FROM (SELECT user_id AS job_id, count(*) AS total, count(*) FILTER (WHERE user_id % 4 <> 0 OR event_id % 10 <> 0) AS finished,
    count(*) FILTER (WHERE (user_id % 4 <> 0 OR event_id % 10 <> 0) AND event_type <> 'error' AND user_id % 10 <> 1) AS successful
    FROM events GROUP BY user_id))""",
)
def job_progress(t: Tables):
    """Each user's events as a job's items; some jobs are still running, some failed altogether."""
    u, e = F.col("user_id"), F.col("event_id")
    status = F.when((u % 4 == 0) & (e % 10 == 0), "pending").when(
        (F.col("event_type") == "error") | (u % 10 == 1), "error"
    ).otherwise("success")
    return uploads.job_progress(t.events.select(u.alias("job_id"), status.alias("status")))
