"""Tables derived from the given ones, as DataFrames and as the DuckDB SQL that gives the same rows.

The given documents carry no labelled identities, stored-object keys or request logs, so
these views add them to every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.plans.registry import Tables

NAMES = ["ASHA RAO", "JOHN DOE", "MARY LEE", "Ravi Kumar"]
SQL_NAME = "(['ASHA RAO','JOHN DOE','MARY LEE','Ravi Kumar'])[CAST(doc_id % 4 AS INTEGER) + 1]"
SQL_ROLL = "CAST(25145050000 + doc_id AS VARCHAR)"
NL = "chr(10)"


def person() -> Column:
    return F.get(F.array(*[F.lit(n) for n in NAMES]), (F.col("doc_id") % 4).cast("int"))


def roll() -> Column:
    return (F.lit(25145050000) + F.col("doc_id")).cast("string")


def _case(cases: list[Column], other: Column) -> Column:
    kind = F.col("doc_id") % 6
    chosen = F.when(kind == 0, cases[0])
    for i, value in enumerate(cases[1:], start=1):
        chosen = chosen.when(kind == i, value)
    return chosen.otherwise(other)


def id_docs(t: Tables) -> DataFrame:
    """Documents with a cover page in six styles and a signature repeating name and number."""
    docs = t.texts.withColumn("n", person()).withColumn("r", roll())
    n, r = F.col("n"), F.col("r")
    dashed = F.concat(F.substring(r, 1, 4), F.lit("-"), F.substring(r, 5, 4), F.lit("-"), F.substring(r, 9, 9))
    cover = _case(
        [
            F.concat(F.lit("NAME: "), n, F.lit("\nROLL NUMBER: "), r, F.lit("\nPROGRAM: MBA\n")),
            F.concat(F.lit("Name: "), n, F.lit("\nRoll No: "), r, F.lit("\nCourse: BCA\n")),
            F.concat(F.lit("STUDENT NAME  "), n, F.lit("\nENROLLMENT NO: "), dashed, F.lit("\n")),
            F.lit(""),
            F.lit("NAME: CARROLL SMITH\nROLL NO: 2514-5050-010\n"),
        ],
        F.concat(F.lit("ROLL NUMBER: "), r, F.lit("\n")),
    )
    tail = F.concat(
        F.lit("\nSigned "), F.lower(n), F.lit(" "), F.substring(r, 1, 8), F.lit("-"), F.substring(r, 9, 9),
        F.lit(" "), n, F.lit(" "), r,
    )
    return docs.select("doc_id", F.concat(cover, F.col("text"), tail).alias("text"))


ID_DOCS = f"""id_docs AS (
  SELECT doc_id, CASE doc_id % 6
    WHEN 0 THEN 'NAME: ' || n || {NL} || 'ROLL NUMBER: ' || r || {NL} || 'PROGRAM: MBA' || {NL}
    WHEN 1 THEN 'Name: ' || n || {NL} || 'Roll No: ' || r || {NL} || 'Course: BCA' || {NL}
    WHEN 2 THEN 'STUDENT NAME  ' || n || {NL} || 'ENROLLMENT NO: ' || substr(r, 1, 4) || '-' || substr(r, 5, 4) || '-'
      || substr(r, 9) || {NL}
    WHEN 3 THEN ''
    WHEN 4 THEN 'NAME: CARROLL SMITH' || {NL} || 'ROLL NO: 2514-5050-010' || {NL}
    ELSE 'ROLL NUMBER: ' || r || {NL} END
    || text || {NL} || 'Signed ' || lower(n) || ' ' || substr(r, 1, 8) || '-' || substr(r, 9) || ' ' || n || ' ' || r
    AS text
  FROM (SELECT doc_id, text, {SQL_NAME} AS n, {SQL_ROLL} AS r FROM documents))"""


def id_nodes(t: Tables) -> DataFrame:
    """Documents as ordered text nodes: a cover in seven styles (one far down), the text lines, name and number again."""
    docs = t.texts.withColumn("n", person()).withColumn("r", roll())
    n, r = F.col("n"), F.col("r")
    cover = _case(
        [
            F.array(F.lit("NAME:"), n, F.lit("ROLL NUMBER:"), r),
            F.array(F.concat(F.lit("Student Name: "), n), F.concat(F.lit("Roll No "), r)),
            F.array(F.lit("Submitted by:"), F.lit("12345"), n, F.concat(F.lit("Enrollment No: "), r)),
            F.when(F.col("doc_id") % 12 == 9, F.concat(
                F.array_repeat(F.lit("plain text"), 35), F.array(F.lit("NAME:"), n, F.concat(F.lit("ROLL NO: "), r))
            )).otherwise(F.array().cast("array<string>")),
            F.array(F.concat(F.lit("Prepared for "), n, F.lit(" "), r)),
        ],
        F.array(F.concat(n, F.lit(" registered")), F.concat(F.lit("ROLL NO: "), r)),
    )
    return docs.select("doc_id", F.concat(cover, F.split("text", "\n"), F.array(n, r)).alias("nodes"))


ID_NODES = f"""id_nodes AS (
  SELECT doc_id, list_concat(CASE doc_id % 6
    WHEN 0 THEN ['NAME:', n, 'ROLL NUMBER:', r]
    WHEN 1 THEN ['Student Name: ' || n, 'Roll No ' || r]
    WHEN 2 THEN ['Submitted by:', '12345', n, 'Enrollment No: ' || r]
    WHEN 3 THEN CASE WHEN doc_id % 12 = 9 THEN list_concat(list_transform(range(35), lambda k: 'plain text'), ['NAME:', n, 'ROLL NO: ' || r])
      ELSE CAST([] AS VARCHAR[]) END
    WHEN 4 THEN ['Prepared for ' || n || ' ' || r]
    ELSE [n || ' registered', 'ROLL NO: ' || r] END,
    list_concat(string_split(text, {NL}), [n, r])) AS nodes
  FROM (SELECT doc_id, text, {SQL_NAME} AS n, {SQL_ROLL} AS r FROM documents))"""


def node_rows(t: Tables) -> DataFrame:
    """One row per text node of ``id_nodes``."""
    return id_nodes(t).select("doc_id", F.posexplode("nodes").alias("node_idx", "text"))


NODE_ROWS = (
    ID_NODES
    + """,
node_rows AS (SELECT doc_id, CAST(u.i - 1 AS INTEGER) AS node_idx, u.x AS text
  FROM id_nodes, unnest(nodes) WITH ORDINALITY AS u(x, i))"""
)


def identities(t: Tables) -> DataFrame:
    """Known name and number of every document, as a table of its own."""
    return t.documents.select("doc_id", person().alias("name"), roll().alias("roll_no"))


IDENTITIES = f"identities AS (SELECT doc_id, {SQL_NAME} AS name, {SQL_ROLL} AS roll_no FROM documents)"


def object_catalog(t: Tables) -> DataFrame:
    """Stored objects: one per document, plus a rewritten copy for some and a few loose keys."""
    d = F.col("doc_id")
    stage = F.when(d % 3 == 0, "raw").when(d % 3 == 1, "converted").otherwise("formatted")
    folder = F.concat(F.lit("users/u"), (d % 20).cast("string"), F.lit("/uploads/up"), (d % 100).cast("string"))
    name = F.concat(F.lit("/doc"), d.cast("string"))
    keyed = t.documents.select("doc_id", F.col("n_chars").alias("size"), folder.alias("f"), stage.alias("s"),
                               name.alias("b"))
    ext = F.when(d % 2 == 0, ".docx").otherwise(".PDF")
    main = keyed.select("doc_id", F.concat("f", F.lit("/"), "s", F.when(d % 7 == 0, "/sub").otherwise(""), "b",
                                           ext).alias("key"), "size")
    derived = keyed.filter((d % 2 == 0) & (d % 5 < 2)).select(
        "doc_id",
        F.concat("f", F.when(d % 5 == 0, F.lit("/formatted")).otherwise(F.lit("/other")),
                 F.when(d % 7 == 0, "/sub").otherwise(""), "b", F.when(d % 4 == 0, "_v2").otherwise(""),
                 F.lit("_humanized.docx")).alias("key"),
        (F.col("size") + d % 3).alias("size"),
    )
    loose = keyed.filter(d % 50 == 0).select(
        "doc_id", F.concat(F.lit("edited-files"), "b", F.lit(".html")).alias("key"), "size")
    return main.unionByName(derived).unionByName(loose)


OBJECT_CATALOG = """keyed AS (
  SELECT doc_id, n_chars AS size, 'users/u' || (doc_id % 20) || '/uploads/up' || (doc_id % 100) AS f,
    CASE doc_id % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'converted' ELSE 'formatted' END AS s,
    CASE WHEN doc_id % 7 = 0 THEN '/sub' ELSE '' END AS sub, '/doc' || doc_id AS b FROM documents),
object_catalog AS (
  SELECT doc_id, f || '/' || s || sub || b || CASE WHEN doc_id % 2 = 0 THEN '.docx' ELSE '.PDF' END AS key, size
  FROM keyed
  UNION ALL SELECT doc_id, f || CASE WHEN doc_id % 5 = 0 THEN '/formatted' ELSE '/other' END || sub || b
    || CASE WHEN doc_id % 4 = 0 THEN '_v2' ELSE '' END || '_humanized.docx', size + doc_id % 3 FROM keyed WHERE doc_id % 2 = 0 AND doc_id % 5 < 2
  UNION ALL SELECT doc_id, 'edited-files' || b || '.html', size FROM keyed WHERE doc_id % 50 = 0)"""


def request_logs(t: Tables) -> DataFrame:
    """Events as request logs."""
    kind, rest = F.col("event_type"), F.col("event_id") % 7
    method = F.when(kind.isin("purchase", "signup"), "POST").when(kind == "error", "DELETE").otherwise("GET")
    status = F.when(rest == 0, 404).when(rest == 1, 500).when(rest == 2, 201).when(rest == 3, 401).otherwise(200)
    return t.events.select(
        "event_id", F.col("ts").alias("created_at"), method.alias("method"), status.alias("status_code"), "user_id",
        F.col("value").alias("response_time"), F.col("props").alias("body"),
    )


REQUEST_LOGS = """request_logs AS (
  SELECT event_id, ts AS created_at,
    CASE event_type WHEN 'purchase' THEN 'POST' WHEN 'signup' THEN 'POST' WHEN 'error' THEN 'DELETE' ELSE 'GET' END
      AS method,
    CAST(CASE event_id % 7 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 201 WHEN 3 THEN 401 ELSE 200 END AS INTEGER)
      AS status_code,
    user_id, value AS response_time, props AS body FROM events)"""


def rewrite_docs(t: Tables) -> DataFrame:
    """Documents opened by a sentence with a contraction and a citation."""
    intro = F.concat(
        F.lit("It can't be ignored (Smith et al., 2020). We've seen "), F.col("doc_id").cast("string"),
        F.lit(" cases; they don't agree (Rao, 2019, pp. 3-4).\n"),
    )
    return t.texts.select("doc_id", F.concat(intro, "text").alias("text"))


REWRITE_DOCS = f"""rewrite_docs AS (
  SELECT doc_id, 'It can''t be ignored (Smith et al., 2020). We''ve seen ' || doc_id
    || ' cases; they don''t agree (Rao, 2019, pp. 3-4).' || {NL} || text AS text FROM documents)"""


def qa_paras(t: Tables) -> DataFrame:
    """Conversations as paragraphs: a heading turn, then questions and answers."""
    turn = F.col("turn")
    prefix = (
        F.when(turn == 0, F.lit("Assignment Set - 1 "))
        .when(turn % 2 == 1, F.concat(F.lit("Q"), turn.cast("string"), F.lit(". ")))
        .otherwise(F.concat(F.lit("A"), turn.cast("string"), F.lit(". ")))
    )
    return t.conversations.select(
        F.col("conv_id").alias("doc_id"), turn.alias("para_idx"), F.concat(prefix, "text").alias("text")
    )


QA_PARAS = """qa_paras AS (
  SELECT conv_id AS doc_id, turn AS para_idx,
    CASE WHEN turn = 0 THEN 'Assignment Set - 1 ' WHEN turn % 2 = 1 THEN 'Q' || turn || '. '
      ELSE 'A' || turn || '. ' END || text AS text FROM conversations)"""


def announced_parts(upload: Column) -> Column:
    return F.when(upload % 3 == 0, 5).otherwise(4)


def upload_parts(t: Tables) -> DataFrame:
    """Events as upload parts, four per upload, every eleventh sent twice; each third upload announces a part that never comes."""
    e = F.col("event_id")
    upload = F.floor(e / 4).cast("bigint")
    parts = t.events.select(
        upload.alias("multipart_id"), (e % 4).cast("int").alias("part_index"),
        announced_parts(upload).alias("total_parts"), e.alias("upload_id"), F.col("ts"),
    )
    again = parts.filter(F.col("upload_id") % 11 == 0).withColumn("upload_id", F.col("upload_id") + 1_000_000_000)
    return parts.unionByName(again)


UPLOAD_PARTS = """parts0 AS (
  SELECT CAST(event_id // 4 AS BIGINT) AS multipart_id, CAST(event_id % 4 AS INTEGER) AS part_index,
    CAST(CASE WHEN (event_id // 4) % 3 = 0 THEN 5 ELSE 4 END AS INTEGER) AS total_parts, event_id AS upload_id, ts FROM events),
upload_parts AS (SELECT * FROM parts0
  UNION ALL SELECT multipart_id, part_index, total_parts, upload_id + 1000000000, ts FROM parts0
  WHERE upload_id % 11 = 0)"""


def user_table(t: Tables) -> DataFrame:
    """Customers as registered users."""
    c = F.col("c_custkey")
    return t.customer.select(
        c.alias("id"),
        F.concat(F.lit("user"), c.cast("string"), F.lit("@example.com")).alias("email"),
        F.concat(F.lit("user"), c.cast("string")).alias("username"),
        F.md5("c_name").alias("password"),
        F.when(c % 10 == 0, "admin").otherwise("user").alias("role"),
        F.timestamp_seconds(F.lit(1704067200) + c % 500).alias("created_at"),
    )


USER_TABLE = """user_table AS (
  SELECT c_custkey AS id, 'user' || c_custkey || '@example.com' AS email, 'user' || c_custkey AS username,
    md5(c_name) AS password, CASE WHEN c_custkey % 10 = 0 THEN 'admin' ELSE 'user' END AS role,
    make_timestamp((1704067200 + c_custkey % 500) * 1000000) AS created_at FROM customer)"""
