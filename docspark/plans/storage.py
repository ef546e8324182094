"""Queries that write given rows with the package's sinks and read them back with its sources."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from docspark.functions import labels, wording
from docspark.operators import score_cache as cache
from docspark.operators import scorers, uploads
from docspark.plans import oracle, views
from docspark.plans.registry import Tables, query
from docspark.session import work_folder
from docspark.sources import evaluation, files, listing, logstore
from docspark.streaming import runs

ONE_LINE = r"[\n\r]+"


def folder_of(t: Tables) -> str:
    return f"{work_folder(t.spark)}/{uuid.uuid4().hex}"


@query(
    "scan_objects",
    r"""
SELECT CAST(sum(strlen(regexp_replace(text, '[\n\r]+', ' ', 'g')) + 1) AS BIGINT) AS bytes FROM documents""",
)
def scan_objects(t: Tables):
    """Bytes of the text files that the documents were written to, from their listing."""
    folder = folder_of(t)
    files.write_txt(t.texts.withColumn("text", F.regexp_replace("text", ONE_LINE, " ")), folder)
    return files.scan_objects(t.spark, folder, glob="part-*.txt").agg(F.sum("size").alias("bytes"))


@query(
    "object_stream",
    r"""
SELECT lang, CAST(sum(strlen(regexp_replace(coalesce(text, ''), '[\n\r]+', ' ', 'g')) + 1) AS BIGINT) AS bytes FROM documents GROUP BY lang""",
)
def object_stream(t: Tables):
    """Bytes of the text files of each language's folder, from a stream of their listing."""
    folder = folder_of(t)
    lines = t.documents.select("lang", F.regexp_replace("text", ONE_LINE, " ").alias("value"))
    lines.write.partitionBy("lang").text(folder)
    listed = runs.run_to_table(listing.object_stream(t.spark, folder, glob="part-*.txt", settle_seconds=0))
    lang = F.nullif(F.regexp_extract("key", "/lang=([^/]*)/", 1), F.lit("__HIVE_DEFAULT_PARTITION__"))
    return listed.groupBy(lang.alias("lang")).agg(F.sum("size").alias("bytes"))


@query(
    "text_files",
    r"""
SELECT md5(line) AS line, CAST(count(*) AS BIGINT) AS n FROM (SELECT regexp_replace(text, '[\n\r]+', ' ', 'g') AS line FROM documents) GROUP BY 1""",
)
def text_files(t: Tables):
    """Documents written as text, one per line, and read back as whole files."""
    folder = folder_of(t)
    files.write_txt(t.texts.withColumn("text", F.regexp_replace("text", ONE_LINE, " ")), folder)
    whole = files.read_txt(t.spark, folder)
    lines = whole.select(F.explode(F.split(F.regexp_replace("text", r"\n$", ""), "\n")).alias("line")).filter("line <> ''")
    return lines.groupBy(F.md5("line").alias("line")).agg(F.count("*").alias("n"))


@query(
    "evaluation_files",
    """
SELECT side, md5(text) AS text, CAST(count(*) AS BIGINT) AS n FROM (
  SELECT 'human' AS side, text FROM documents JOIN labels USING (doc_id) WHERE quality = 1
  UNION ALL SELECT 'machine', upper(lang) || ' ' || text FROM documents JOIN labels USING (doc_id) WHERE quality = 1)
GROUP BY side, 2""",
)
def evaluation_files(t: Tables):
    """JSON lines of good documents with an altered copy each, read back as human and machine texts."""
    folder = folder_of(t)
    good = t.documents.join(t.labels.filter("quality = 1").select("doc_id"), "doc_id")
    good.select(F.col("text").alias("article"), F.concat(F.upper("lang"), F.lit(" "), "text").alias("m_generated_text_wo_prompt")).write.json(folder)
    human, machine = evaluation.read_eval_jsonl(t.spark, folder, "article")
    sides = human.select(F.lit("human").alias("side"), "text").unionByName(machine.select(F.lit("machine").alias("side"), "text"))
    return sides.groupBy("side", F.md5("text").alias("text")).agg(F.count("*").alias("n"))


@query(
    "log_store",
    f"""
WITH {views.REQUEST_LOGS}
SELECT event_id, method, status_code FROM request_logs WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00'""",
)
def log_store(t: Tables):
    """Request logs appended to the store by day and read back from a day on."""
    folder = folder_of(t)
    logs = views.request_logs(t).withColumn("created_at", F.col("created_at").cast("timestamp"))
    logstore.append_logs(logs.filter("event_id % 2 = 0"), folder)
    logstore.append_logs(logs.filter("event_id % 2 = 1"), folder)
    return logstore.read_logs(t.spark, folder, "2024-01-10").select("event_id", "method", "status_code")


@query(
    "whitespace_shell",
    r"""
SELECT conv_id, turn, regexp_extract(s, '^(\s*)', 1) || 'new' || regexp_extract(s, '(\s*)$', 1) AS shelled
FROM (SELECT conv_id, turn, repeat(' ', (turn % 4)::BIGINT) || text || repeat(chr(10), (conv_id % 3)::BIGINT) AS s FROM conversations)""",
)
def whitespace_shell(t: Tables):
    """White space around each turn kept around a new core."""
    text = F.concat(F.repeat(F.lit(" "), F.col("turn") % 4), F.col("text"), F.repeat(F.lit("\n"), (F.col("conv_id") % 3).cast("int")))
    return t.conversations.select("conv_id", "turn", wording.preserve_whitespace_shell(text, F.lit("new")).alias("shelled"))


@query(
    "registered_strategies",
    f"""
WITH {oracle.score_ctes('documents', 'doc_id', 'text')}
SELECT doc_id, doc_id::VARCHAR AS final_name, {oracle.rounded('s', 8)} AS score FROM score""",
)
def registered_strategies(t: Tables):
    """An unknown naming strategy falls back to the default one; the scorer comes from its registry."""
    named = uploads.final_names(t.texts.withColumn("upload_id", F.col("doc_id")), "no such strategy")
    return scorers.score_by("stylometric", named).select("doc_id", "final_name", F.round(F.col("score"), 8).alias("score"))


@query(
    "score_cache",
    f"""
WITH {oracle.score_ctes('documents', 'doc_id', 'text')},
h AS (SELECT doc_id, sha256(text) AS text_hash, CAST(count(*) OVER (PARTITION BY text) AS BIGINT) AS copies,
  coalesce(bool_or(lang = 'en') OVER (PARTITION BY text), false) AS known FROM documents)
SELECT doc_id, text_hash, copies, known, {oracle.rounded('s', 8)} AS ai_likeness FROM h JOIN score USING (doc_id)""",
)
def score_cache(t: Tables):
    """All documents scored against a store that an earlier run over the English ones filled."""
    store = cache.ScoreStore(folder_of(t), "stylometric-1", buckets=16)
    cache.cached_scores(t.documents.filter("lang = 'en'"), store)
    return cache.cached_scores(t.texts, store).withColumn("ai_likeness", labels.rounded(F.col("ai_likeness"), 8))
