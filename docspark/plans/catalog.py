"""Queries over the object catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import fixed, naming
from docspark.operators import catalog
from docspark.plans import views
from docspark.plans.registry import Tables, query

WITH = f"WITH {views.OBJECT_CATALOG}"


@query(
    "parse_object_key",
    WITH
    + """,
p AS (SELECT doc_id, key, size, string_split(key, '/') AS p FROM object_catalog)
SELECT doc_id, key, size, p[2] AS user_id, p[4] AS upload_id, p[5] AS stage,
  CASE WHEN p[5] IS NOT NULL THEN array_to_string(p[list_position(p, p[5]) + 1:], '/') END AS relative_path, p[-1] AS name
FROM p""",
)
def parse_object_key(t: Tables):
    return catalog.parse_object_key(views.object_catalog(t))


@query(
    "build_object_key",
    """
SELECT doc_id, regexp_replace('users/' || lang || '/uploads/' || source || '/raw/' || '/sub//f' || doc_id, '/+', '/', 'g')
  AS key FROM documents""",
)
def build_object_key(t: Tables):
    path = F.concat(F.lit("/sub//f"), F.col("doc_id").cast("string"))
    return t.documents.select(
        "doc_id", naming.build_object_key(F.col("lang"), F.col("source"), F.lit("raw"), path).alias("key")
    )


@query(
    "list_files",
    WITH
    + """,
p AS (SELECT *, string_split(key, '/') AS p FROM object_catalog
  WHERE starts_with(key, 'users/') AND list_contains(string_split(key, '/'), 'raw') AND suffix(lower(key), '.pdf'))
SELECT doc_id, key, size, p[2] AS user_id, p[4] AS upload_id, 'raw' AS stage,
  array_to_string(p[list_position(p, 'raw') + 1:], '/') AS relative_path, p[-1] AS name FROM p""",
)
def list_files(t: Tables):
    """Raw PDFs of every user."""
    return catalog.list_files(views.object_catalog(t))


@query(
    "list_users",
    WITH + "\nSELECT DISTINCT split_part(key, '/', 2) AS id FROM object_catalog WHERE starts_with(key, 'users/')",
)
def list_users(t: Tables):
    return catalog.list_users(views.object_catalog(t))


@query(
    "list_uploads",
    WITH
    + """
SELECT DISTINCT split_part(key, '/', 2) AS user_id, split_part(key, '/', 4) AS id FROM object_catalog
WHERE starts_with(key, 'users/') AND split_part(key, '/', 3) = 'uploads' AND len(string_split(key, '/')) > 3""",
)
def list_uploads(t: Tables):
    return catalog.list_uploads(views.object_catalog(t))


@query(
    "list_formatted",
    WITH
    + r"""
SELECT doc_id, key, size, string_split(key, '/')[-1] AS name,
  regexp_replace(key, '^users/[^/]+/uploads/[^/]+/formatted/', '') AS path FROM object_catalog
WHERE regexp_matches(key, '^users/[^/]+/uploads/[^/]+/formatted/') AND regexp_matches(lower(key), '\.(docx|doc|html|htm)$')""",
)
def list_formatted(t: Tables):
    return catalog.list_formatted(views.object_catalog(t))


@query(
    "list_by_extension",
    WITH + "\nSELECT doc_id, key, size, string_split(key, '/')[-1] AS name FROM object_catalog"
    + " WHERE suffix(lower(key), '.docx')",
)
def list_by_extension(t: Tables):
    return catalog.list_by_extension(views.object_catalog(t), "docx")


@query(
    "list_edited",
    WITH + "\nSELECT key AS id, replace(key, 'edited-files/', '') AS name FROM object_catalog"
    + " WHERE starts_with(key, 'edited-files/')",
)
def list_edited(t: Tables):
    return catalog.list_edited(views.object_catalog(t))


@query(
    "derive_output_keys",
    WITH
    + r"""
SELECT doc_id, key, size,
  CASE WHEN suffix(lower(m), '.docx') THEN regexp_replace(m, '(?i)\.docx$', '_humanized.docx')
    ELSE m || '_humanized.docx' END AS rewritten_key,
  replace(raw, '.pdf', '_anonymized.docx') AS anonymized_key,
  regexp_replace(key, '(\.[^./]+)$', '_redacted\1') AS redacted_key,
  regexp_replace(raw, '(?i)\.pdf$', '.docx') AS docx_key, regexp_replace(raw, '(?i)\.pdf$', '.html') AS html_key
FROM (SELECT doc_id, key, size, regexp_replace(key, '/raw/', '/formatted/') AS raw,
  CASE WHEN contains(key, '/raw/') THEN regexp_replace(key, '/raw/', '/formatted/')
    WHEN contains(key, '/converted/') THEN regexp_replace(key, '/converted/', '/formatted/')
    ELSE regexp_replace(key, '^(.*/)?([^/]*)$', '\1formatted/\2') END AS m FROM object_catalog)""",
)
def derive_output_keys(t: Tables):
    return catalog.derive_output_keys(views.object_catalog(t))


@query(
    "find_derived",
    WITH
    + r""",
src AS (SELECT DISTINCT key FROM object_catalog WHERE suffix(lower(key), '.docx') AND NOT contains(key, '_humanized')),
x AS (SELECT key, regexp_replace(regexp_replace(key, '/raw/', '/formatted/'), '(?i)\.docx$', '_humanized.docx') AS expected,
  regexp_replace(key, '(?i)\.docx$', '_humanized.docx') AS sibling FROM src),
y AS (SELECT x.*, expected IN (SELECT key FROM object_catalog) AS ex,
  (SELECT min(c.key) FROM object_catalog c WHERE contains(c.key, '_humanized.docx')
    AND array_to_string(string_split(c.key, '/')[1:4], '/') = array_to_string(string_split(x.key, '/')[1:4], '/')
    AND contains(c.key, regexp_replace(string_split(x.key, '/')[-1], '\.docx', ''))) AS found FROM x)
SELECT key, expected, ex AS exists, CASE WHEN NOT ex THEN list_filter([
  CASE WHEN contains(key, '/raw/') THEN regexp_replace(sibling, '/raw/', '/formatted/') END, sibling, found],
  lambda v: v IS NOT NULL) END AS alternatives FROM y""",
)
def find_derived(t: Tables):
    stored = views.object_catalog(t)
    sources = stored.filter(
        naming.has_extension(F.col("key"), "docx") & ~F.contains(F.col("key"), F.lit("_humanized"))
    )
    return catalog.find_derived(sources, stored)


@query(
    "check_exists",
    WITH
    + """
SELECT k.doc_id, k.key, o.size, o.key IS NOT NULL AS exists FROM (
  SELECT doc_id, 'users/u' || (doc_id % 20) || '/uploads/up' || (doc_id % 100) || '/raw/doc' || doc_id || '.docx' AS key
  FROM documents) k LEFT JOIN object_catalog o ON o.key = k.key""",
)
def check_exists(t: Tables):
    d = F.col("doc_id")
    keys = t.documents.select("doc_id", naming.build_object_key(
        F.concat(F.lit("u"), (d % 20).cast("string")), F.concat(F.lit("up"), (d % 100).cast("string")), F.lit("raw"),
        F.concat(F.lit("doc"), d.cast("string"), F.lit(".docx")),
    ).alias("key"))
    return catalog.check_exists(keys, views.object_catalog(t), ["size"])


@query(
    "audit_uploads",
    WITH
    + """,
e AS (SELECT doc_id, key || CASE WHEN doc_id % 13 = 0 THEN '.lost' ELSE '' END AS key,
  CASE WHEN doc_id % 17 = 0 THEN 0 WHEN doc_id % 19 = 0 THEN size + 1 ELSE size END AS size FROM object_catalog)
SELECT e.doc_id, e.key, e.size, o.size AS stored_size, CASE WHEN e.size = 0 THEN 'empty' WHEN o.size IS NULL THEN 'missing'
  WHEN o.size <> e.size THEN 'size_mismatch' ELSE 'ok' END AS verdict
FROM e LEFT JOIN object_catalog o ON o.key = e.key""",
)
def audit_uploads(t: Tables):
    stored, d = views.object_catalog(t), F.col("doc_id")
    expected = stored.select(
        "doc_id",
        F.concat("key", F.when(d % 13 == 0, ".lost").otherwise("")).alias("key"),
        F.when(d % 17 == 0, 0).when(d % 19 == 0, F.col("size") + 1).otherwise(F.col("size")).alias("size"),
    )
    return catalog.audit_uploads(expected, stored)


@query(
    "preview",
    """
SELECT doc_id, key, CASE WHEN suffix(key, '.docx') THEN substr(text, 1, 5000)
  ELSE '[Preview for ' || string_split(key, '/')[-1] || ' not available]' END AS preview
FROM (SELECT doc_id, 'a/doc' || doc_id || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.pdf' END AS key, text
  FROM documents)""",
)
def preview(t: Tables):
    d = F.col("doc_id")
    keyed = t.documents.select(
        "doc_id", F.concat(F.lit("a/doc"), d.cast("string"), F.when(d % 2 == 0, ".docx").otherwise(".pdf")).alias("key"),
        "text",
    )
    return catalog.preview(keyed, chars=fixed.PREVIEW_CHARS).drop("text")


@query(
    "refused_types",
    WITH
    + """
SELECT key, 'only pdf files are supported' AS error FROM object_catalog WHERE NOT suffix(lower(key), '.pdf')""",
)
def refused_types(t: Tables):
    return catalog.select_file_type(views.object_catalog(t), "pdf")[1].select("key", "error")


@query(
    "batch_rollup",
    WITH
    + """
SELECT user_id, CAST(count(*) AS BIGINT) AS total, CAST(sum(ok) AS BIGINT) AS successful,
  CAST(count(*) - sum(ok) AS BIGINT) AS failed, round(sum(ok) * 100 / count(*), 2) AS success_percentage
FROM (SELECT split_part(key, '/', 2) AS user_id, (size % 4 > 0)::INTEGER AS ok FROM object_catalog) GROUP BY user_id""",
)
def batch_rollup(t: Tables):
    """Per user: objects converted and failed, where every fourth size fails."""
    items = views.object_catalog(t).select(
        F.get(F.split("key", "/"), F.lit(1)).alias("user_id"),
        F.when(F.col("size") % 4 > 0, "success").otherwise("error").alias("status"),
    )
    return catalog.batch_rollup(items, keys=["user_id"])
