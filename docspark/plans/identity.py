"""Queries over identity detection, redaction and verification."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.functions import patterns
from docspark.operators import identity, redact
from docspark.plans import oracle, views
from docspark.plans.registry import Tables, query
from docspark.session import cut_lineage
from docspark.sources import docx

EDGE = r"(?:^|[^\p{L}\p{N}_])"
EDGE_END = r"(?:$|[^\p{L}\p{N}_])"
LABEL_EDGE = r"(?:^|[^\p{L}\p{N}_\s]|(?:^|[^&])\s)"
RE_NAME_STRICT = (
    "(?im)" + LABEL_EDGE + r"NAME\s*:\s*([A-Z][A-Za-z\s]*?)(?:\n|$|\s(?:ROLL|PROGRAM|SEMESTER|COURSE))"
)
RE_NAME_FLEX = (
    "(?im)" + LABEL_EDGE + r"(?:STUDENT\s+)?NAME\s*[:\s]+\s*([A-Z][A-Za-z\s]*?)(?:\n|$|\s(?:ROLL|PROGRAM))"
)
RE_NAME_STRICT_LITERAL = r"(?im)NAME\s*:\s*([A-Z][A-Za-z\s]+?)(?:\n|$|ROLL|PROGRAM|SEMESTER|COURSE)"
RE_NAME_FLEX_LITERAL = r"(?im)(?:STUDENT\s+)?NAME\s*[:\s]+\s*([A-Z][A-Za-z\s]+?)(?:\n|ROLL|PROGRAM|$)"
RE_ROLL_STRICT = r"(?im)ROLL\s*(?:NUMBER|NO\.?)\s*:\s*([\d\-\s]{8,20}?)(?:\n|$|PROGRAM|COURSE|SEMESTER|STUDENT)"
RE_ROLL_FLEX = (
    r"(?im)(?:ROLL\s*(?:NUMBER|NO)|ENROLLMENT\s+(?:NUMBER|NO)|REGISTRATION|STUDENT\s*ID|REG\s*(?:NUMBER|NO))"
    r"\s*[:\s]+\s*([\d\-\s]{8,20}?)(?:\n|PROGRAM|COURSE|SEMESTER|$)"
)


def first(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, '{pattern}', {group}), '')"


def name_of(text: str, pattern: str) -> str:
    return f"nullif({oracle.strip(f'''regexp_replace({first(text, pattern)}, '\\s+', ' ', 'g')''')}, '')"


def roll_of(text: str, pattern: str) -> str:
    digits = f"regexp_replace({first(text, pattern)}, '[\\s\\-]', '', 'g')"
    return f"CASE WHEN length({digits}) >= 8 THEN {digits} END"


def found_ctes(source: str, literal: bool = False) -> str:
    strict, flex = (RE_NAME_STRICT_LITERAL, RE_NAME_FLEX_LITERAL) if literal else (RE_NAME_STRICT, RE_NAME_FLEX)
    return f"""
hits AS (SELECT doc_id, text, {name_of('text', strict)} AS ns, {name_of('text', flex)} AS nf,
  {roll_of('text', RE_ROLL_STRICT)} AS rs, {roll_of('text', RE_ROLL_FLEX)} AS rf FROM {source}),
found AS (SELECT doc_id, text, coalesce(ns, nf) AS detected_name, coalesce(rs, rf) AS detected_roll_no,
  CASE WHEN ns IS NOT NULL AND rs IS NOT NULL THEN 'high' WHEN ns IS NOT NULL OR rs IS NOT NULL THEN 'medium'
    ELSE 'low' END AS extraction_confidence FROM hits)"""


REDACTED = """
r0 AS (SELECT *, CASE WHEN detected_name IS NULL THEN text
  ELSE regexp_replace(text, '(?i)' || regexp_escape(detected_name), '[REDACTED]', 'g') END AS t0 FROM found),
red AS (SELECT *, CASE WHEN detected_roll_no IS NULL THEN t0 ELSE
  replace(replace(replace(replace(t0, detected_roll_no, '[REDACTED]'),
    substr(detected_roll_no, 1, 8) || '-' || substr(detected_roll_no, 9), '[REDACTED]'),
    array_to_string(regexp_extract_all(detected_roll_no, '.{1,4}'), ' '), '[REDACTED]'),
    substr(detected_roll_no, 1, 5) || '-' || substr(detected_roll_no, 6), '[REDACTED]') END AS redacted_text,
  CAST((detected_name IS NOT NULL)::INTEGER + (detected_roll_no IS NOT NULL)::INTEGER AS INTEGER) AS redaction_count
  FROM r0)"""

WITH_IDS = f"WITH {views.ID_DOCS},"


def occurrences(text: str, value: str) -> str:
    return (
        f"CAST(CASE WHEN {value} = '' THEN 0 ELSE (length({text}) - length(replace(lower({text}), lower({value}), '')))"
        f" // greatest(length({value}), 1) END AS INTEGER)"
    )


@query(
    "extract_identity",
    WITH_IDS
    + found_ctes("id_docs")
    + f""",
spot AS (SELECT *, instr(text, coalesce(detected_name, detected_roll_no)) - 1 AS i FROM found)
SELECT doc_id, detected_name, detected_roll_no, extraction_confidence,
  {oracle.strip("substr(text, greatest(0, i - 50) + 1, i + 100 - greatest(0, i - 50))")} AS excerpt
FROM spot""",
)
def extract_identity(t: Tables):
    return identity.extract_identity(views.id_docs(t)).drop("text")


@query(
    "extract_identity_literal",
    WITH_IDS + found_ctes("id_docs", literal=True)
    + "\nSELECT doc_id, detected_name, detected_roll_no, extraction_confidence FROM found",
)
def extract_identity_literal(t: Tables):
    """Without word boundaries, so a stop word inside a name cuts it."""
    return identity.extract_identity(views.id_docs(t), literal=True).drop("text", "excerpt")


@query(
    "redact_everywhere",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + "\nSELECT doc_id, detected_name, detected_roll_no, redacted_text, redaction_count FROM red",
)
def redact_everywhere(t: Tables):
    return redact.redact_everywhere(views.id_docs(t)).drop("text")


@query(
    "redact_known_values",
    f"WITH {views.ID_DOCS}, {views.IDENTITIES},"
    + " found AS (SELECT doc_id, text, name AS detected_name, roll_no AS detected_roll_no"
    + " FROM id_docs JOIN identities USING (doc_id)),"
    + REDACTED
    + "\nSELECT doc_id, redacted_text FROM red",
)
def redact_known_values(t: Tables):
    """Texts redacted with values joined from a separate identity table."""
    return redact.redact_with(views.id_docs(t), views.identities(t)).select("doc_id", "redacted_text")


def field_sql(keep_label: bool) -> str:
    def step(source: str, out: str, text: str, strict: str, flex: str, edge: bool) -> str:
        lead = f"regexp_replace({{}}, '^(?:{LABEL_EDGE[3:-1]})', '')" if edge else "{}"
        return f"""
{out}0 AS (SELECT doc_id, {text} AS t, {first(text, strict, 1)} AS vs, {first(text, flex, 1)} AS vf,
  {first(text, strict, 0)} AS ws, {first(text, flex, 0)} AS wf FROM {source}),
{out}1 AS (SELECT doc_id, t, coalesce(vs, vf) AS v, coalesce(ws, wf) AS w FROM {out}0),
{out}2 AS (SELECT doc_id, t, v, substr(w, 1, instr(w, v) - 1 + length(v)) AS w FROM {out}1),
{out}3 AS (SELECT doc_id, t, v, {"substr(w, instr(upper(w), CASE WHEN instr(upper(w), 'STUDENT') > 0 THEN 'STUDENT' ELSE 'NAME' END))" if edge else "w"} AS w FROM {out}2),
{out} AS (SELECT doc_id, CASE WHEN w IS NULL THEN t ELSE replace(t, w, {"substr(w, 1, length(w) - length(v)) || '[REDACTED]'" if keep_label else "'[REDACTED]'"}) END AS t FROM {out}3)"""

    return (
        WITH_IDS
        + step("id_docs", "nm", "text", RE_NAME_STRICT, RE_NAME_FLEX, True)
        + ","
        + step("nm", "rl", "t", RE_ROLL_STRICT, RE_ROLL_FLEX, False)
        + "\nSELECT doc_id, t AS redacted_text FROM rl"
    )


@query("redact_labels", field_sql(True))
def redact_labels(t: Tables):
    """Fields redacted with their labels kept."""
    return redact.redact_field(views.id_docs(t), preserve_label=True).select("doc_id", "redacted_text")


@query("redact_fields", field_sql(False))
def redact_fields(t: Tables):
    """Fields redacted together with their labels."""
    return redact.redact_field(views.id_docs(t)).select("doc_id", "redacted_text")


@query(
    "clear_after_label",
    WITH_IDS[:-1]
    + r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '(?im)^(\s*NAME\s*:[ \t]*).*$', '\1', 'g'),
  '(?im)^(\s*ROLL\s*NUMBER\s*:[ \t]*).*$', '\1', 'g') AS cleared_text FROM id_docs""",
)
def clear_after_label(t: Tables):
    return redact.clear_after_label(views.id_docs(t)).select("doc_id", "cleared_text")


PATTERN_SQL = r"""
found AS (SELECT doc_id, text, nullif(regexp_extract(text, '{edge}([A-Z][a-z]+ [A-Z][a-z]+){end}', 1), '')
    AS detected_name,
  nullif(regexp_extract(text, '{edge}(\d{{6,15}}){end}', 1), '') AS detected_roll_no FROM {source}),
rolled AS (SELECT *, CASE WHEN detected_roll_no IS NULL THEN text ELSE replace(text, detected_roll_no, '') END AS t
  FROM found)
SELECT doc_id, detected_name, detected_roll_no, CASE WHEN detected_name IS NULL THEN t
  ELSE regexp_replace(t, '(?i)' || regexp_escape(detected_name), '', 'g') END AS anonymized_text FROM rolled"""


@query("anonymize_by_pattern", WITH_IDS + PATTERN_SQL.format(edge=EDGE, end=EDGE_END, source="id_docs"))
def anonymize_by_pattern(t: Tables):
    return redact.anonymize_by_pattern(views.id_docs(t)).drop("text")


@query(
    "anonymize_mail_and_token",
    r"""
WITH found AS (SELECT doc_id, text,
  nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', 0), '') AS detected_name,
  nullif(regexp_extract(text, '[0-9a-f]{40}', 0), '') AS detected_roll_no FROM documents),
rolled AS (SELECT *, CASE WHEN detected_roll_no IS NULL THEN text ELSE replace(text, detected_roll_no, '') END AS t
  FROM found)
SELECT doc_id, detected_name, detected_roll_no, CASE WHEN detected_name IS NULL THEN t
  ELSE regexp_replace(t, '(?i)' || regexp_escape(detected_name), '', 'g') END AS anonymized_text FROM rolled""",
)
def anonymize_mail_and_token(t: Tables):
    """Caller patterns on the plain documents: mail addresses and long hexadecimal tokens."""
    return redact.anonymize_by_pattern(
        t.texts, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"[0-9a-f]{40}"
    ).drop("text")


@query(
    "leak_check",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + f"""
SELECT doc_id, {occurrences('redacted_text', "coalesce(detected_name, '')")} AS name_leaks,
  {occurrences('redacted_text', "coalesce(detected_roll_no, '')")} AS roll_leaks,
  {occurrences('redacted_text', "'[REDACTED]'")} AS placeholders FROM red""",
)
def leak_check(t: Tables):
    checked = redact.leak_check(redact.redact_everywhere(views.id_docs(t)))
    return checked.select("doc_id", "name_leaks", "roll_leaks", "placeholders")


@query(
    "redact_batch",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + """
SELECT status, CAST(count(*) AS BIGINT) AS n, CAST(sum(redaction_count) AS BIGINT) AS redactions,
  CAST(count(*) FILTER (WHERE redaction_count = 2) AS BIGINT) AS complete
FROM (SELECT *, CASE WHEN regexp_matches(text, '\\S') THEN 'success' ELSE 'error' END AS status FROM red)
GROUP BY status""".replace("\\\\", "\\"),
)
def redact_batch(t: Tables):
    done = redact.redact_batch(views.id_docs(t))
    return done.groupBy("status").agg(
        F.count("*").alias("n"),
        F.sum("redaction_count").alias("redactions"),
        F.count_if(F.col("redaction_count") == 2).alias("complete"),
    )


TERMS = "['name', 'roll', 'the', 'redacted']"


@query(
    "term_deltas",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + f""",
tt AS (SELECT doc_id, text, redacted_text, unnest({TERMS}) AS term FROM red),
cc AS (SELECT doc_id, term, {occurrences('text', 'term')} AS before, {occurrences('redacted_text', 'term')} AS after
  FROM tt)
SELECT doc_id, term, before, after, CAST(after - before AS INTEGER) AS delta FROM cc""",
)
def term_deltas(t: Tables):
    done = redact.redact_everywhere(views.id_docs(t))
    return redact.term_counts(done, "text", "redacted_text", ["name", "roll", "the", "redacted"])


@query(
    "removed_lines",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + f""",
lines AS (SELECT doc_id, u.i, {oracle.strip('u.x')} AS line, redacted_text
  FROM red, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, i))
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS INTEGER) AS pos, line
FROM lines WHERE line <> '' AND NOT contains(redacted_text, line)""",
)
def removed_lines(t: Tables):
    return redact.removed_lines(redact.redact_everywhere(views.id_docs(t)), "text", "redacted_text")


@query(
    "removed_lines_preview",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + f""",
lines AS (SELECT doc_id, u.i, {oracle.strip('u.x')} AS line, redacted_text
  FROM red, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(x, i)),
gone AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, line
  FROM lines WHERE line <> '' AND NOT contains(redacted_text, line))
SELECT doc_id, CAST(pos AS INTEGER) AS pos, substr(line, 1, 20) AS line FROM gone WHERE pos < 3""",
)
def removed_lines_preview(t: Tables):
    """A report's top three removed lines per document, cut to 20 characters."""
    lines = redact.removed_lines(redact.redact_everywhere(views.id_docs(t)), "text", "redacted_text")
    return redact.removed_preview(lines, 3, 20)


# --- node tables ------------------------------------------------------------------------
SHORT_NAME_LABEL = patterns.SHORT_WALK["name_label"]
SHORT_ROLL_LABEL = patterns.SHORT_WALK["roll_label"]
FULL_NAME_LABEL = patterns.FULL_WALK["name_label"]
FULL_ROLL_LABEL = patterns.FULL_WALK["roll_label"]


def labelled(label: str, own: str, following: str, limit: str) -> str:
    """Value of a label node; ``own`` and ``following`` test the text put in for {v}."""
    def test(rule: str, value: str) -> str:
        return f"CASE WHEN {rule.replace('{v}', value)} THEN {value} END"

    rest = oracle.strip(f"regexp_extract(s, '{label}', 2)")
    return (
        f"CASE WHEN {limit} regexp_matches(s, '{label}') THEN coalesce({test(own, rest)}, "
        + ", ".join(test(following, f"s{k}") for k in (1, 2, 3))
        + ") END"
    )


LONG = "length({v}) > 2"
NAMED = r"(length({v}) > 2 AND NOT regexp_matches({v}, '^\d+$'))"
NUMBERED = r"regexp_matches({v}, '^\d{6,15}$')"
GIVEN = "length({v}) > 0"


def short_walk(rows: str, p: str = "") -> str:
    """CTEs ending in ``{p}id``: the short label walk over node rows called ``rows``."""
    name = labelled(SHORT_NAME_LABEL, LONG, NAMED, "length(s) >= 2 AND")
    roll = labelled(SHORT_ROLL_LABEL, NUMBERED, NUMBERED, "length(s) >= 2 AND")
    return f"""
{p}st AS (SELECT doc_id, node_idx, text, {oracle.strip('text')} AS s FROM {rows}),
{p}ld AS (SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(s, 3) OVER w AS s3 FROM {p}st
  WINDOW w AS (PARTITION BY doc_id ORDER BY node_idx)),
{p}vv AS (SELECT doc_id, node_idx, text, {name} AS nv, {roll} AS rv FROM {p}ld),
{p}ph AS (SELECT doc_id, min_by(nv, node_idx) FILTER (WHERE nv IS NOT NULL) AS nl,
  min_by(rv, node_idx) FILTER (WHERE rv IS NOT NULL) AS rl,
  {oracle.strip("string_agg(text, ' ' ORDER BY node_idx)")} AS head
  FROM {p}vv GROUP BY doc_id),
{p}tx AS (SELECT doc_id, nl, rl,
  {oracle.strip(first('head', patterns.SHORT_WALK['name_text']))} AS nt,
  {first('head', patterns.SHORT_WALK['roll_text'])} AS rt,
  {first('head', EDGE + r'([A-Z][A-Za-z]+\s+[A-Z][A-Za-z]+)' + EDGE_END)} AS nw,
  {first('head', EDGE + r'(\d{6,15})' + EDGE_END)} AS rw FROM {p}ph),
{p}id AS (SELECT doc_id, coalesce(nl, nt, nw) AS name, coalesce(rl, rt, rw) AS roll_no,
  CASE WHEN coalesce(nl, nt, nw) IS NOT NULL AND coalesce(rl, rt, rw) IS NOT NULL THEN 'HIGH'
    WHEN coalesce(nl, nt, nw) IS NULL AND coalesce(rl, rt, rw) IS NULL THEN 'CLEAN'
    WHEN coalesce(nl, nt) IS NOT NULL THEN 'HIGH' ELSE 'LOW' END AS confidence,
  CASE WHEN nl IS NOT NULL THEN 'label' WHEN nt IS NOT NULL THEN 'regex' WHEN nw IS NOT NULL THEN 'weak' END
    AS name_evidence,
  CASE WHEN rl IS NOT NULL THEN 'label' WHEN rt IS NOT NULL THEN 'regex' WHEN rw IS NOT NULL THEN 'weak' END
    AS roll_evidence FROM {p}tx)"""


@query(
    "identity_nodes",
    f"WITH {views.NODE_ROWS},{short_walk('node_rows')}"
    + "\nSELECT doc_id, name, roll_no, confidence, name_evidence, roll_evidence FROM id",
)
def identity_nodes(t: Tables):
    return identity.detect_identity_nodes(views.id_nodes(t))


DOUBLED = r"regexp_replace({0}, '([^\p{{L}}\p{{N}}_])', '\1\1', 'g')"
SINGLE = r"regexp_replace({0}, '(\s)\s', '\1', 'g')"
WEAK_NAME = EDGE + r"([A-Z][A-Za-z]*\s+[A-Z][A-Za-z]*)" + EDGE_END


def full_walk(rows: str) -> str:
    name = labelled(FULL_NAME_LABEL, GIVEN, GIVEN, "")
    roll = labelled(FULL_ROLL_LABEL, GIVEN, GIVEN, "")

    def names(text: str) -> str:
        return f"regexp_extract_all({DOUBLED.format(text)}, '{WEAK_NAME}', 1)"

    text_name, text_roll = patterns.FULL_WALK["name_text"], patterns.FULL_WALK["roll_text"]
    return f"""
st AS (SELECT doc_id, node_idx, text, {oracle.strip('text')} AS s FROM {rows}),
ld AS (SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(s, 3) OVER w AS s3 FROM st
  WINDOW w AS (PARTITION BY doc_id ORDER BY node_idx)),
vv AS (SELECT doc_id, node_idx, text, {name} AS nv, {roll} AS rv FROM ld),
ph AS (SELECT doc_id, min_by(nv, node_idx) FILTER (WHERE nv IS NOT NULL) AS nl,
  min_by(rv, node_idx) FILTER (WHERE rv IS NOT NULL) AS rl,
  coalesce(string_agg(text, ' ' ORDER BY node_idx) FILTER (WHERE text <> ''), '') AS t FROM vv GROUP BY doc_id),
tx AS (SELECT *, {oracle.strip(first('t', text_name))} AS nt, {first('t', text_roll)} AS rt FROM ph),
spot AS (SELECT *, instr(t, coalesce(rl, rt)) - 1 AS i FROM tx),
ctx AS (SELECT *, substr(t, greatest(0, i - 200) + 1, i - greatest(0, i - 200)) AS b,
  substr(t, greatest(0, i - 200) + 1, i - greatest(0, i - 200) + 200) AS a FROM spot),
near AS (SELECT *, CASE WHEN nl IS NULL AND nt IS NULL AND coalesce(rl, rt) IS NOT NULL AND i >= 0
    AND len({names('a')}) > 0 THEN CASE WHEN len({names('b')}) > 0 THEN {names('b')}[-1] ELSE {names('a')}[1] END
    END AS np0 FROM ctx),
weak AS (SELECT *, {SINGLE.format('np0')} AS np,
  CASE WHEN coalesce(nl, nt, np0, rl, rt) IS NULL THEN {first('t', WEAK_NAME)} END AS nw,
  CASE WHEN coalesce(nl, nt, np0, rl, rt) IS NULL THEN {first('t', EDGE + r'(\d{6,15})' + EDGE_END)} END AS rw
  FROM near),
id AS (SELECT doc_id, coalesce(nl, nt, np, nw) AS name, coalesce(rl, rt, rw) AS roll_no,
  CASE WHEN np IS NOT NULL THEN 'MEDIUM' WHEN coalesce(nl, nt, rl, rt) IS NOT NULL THEN 'HIGH' ELSE 'LOW' END
    AS confidence,
  CASE WHEN nl IS NOT NULL THEN 'label' WHEN nt IS NOT NULL THEN 'regex' WHEN np IS NOT NULL THEN 'proximity'
    WHEN nw IS NOT NULL THEN 'weak' END AS name_evidence,
  CASE WHEN rl IS NOT NULL THEN 'label' WHEN rt IS NOT NULL THEN 'regex' WHEN rw IS NOT NULL THEN 'weak' END
    AS roll_evidence FROM weak)"""


@query(
    "identity_proximity",
    f"WITH {views.NODE_ROWS},{full_walk('node_rows')}"
    + """
SELECT *, roll_no IS NOT NULL AS remove_roll_no, name IS NOT NULL AND confidence IN ('HIGH', 'MEDIUM') AS remove_name
FROM id""",
)
def identity_proximity(t: Tables):
    """Whole-document detection followed by the removal policy."""
    return identity.removal_policy(identity.detect_identity_proximity(views.id_nodes(t)))


@query(
    "label_then_value",
    f"WITH {views.NODE_ROWS},"
    + f"""
st AS (SELECT doc_id, node_idx, {oracle.strip('text')} AS s FROM node_rows),
ld AS (SELECT *, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(s, 3) OVER w AS s3 FROM st
  WINDOW w AS (PARTITION BY doc_id ORDER BY node_idx)),
vv AS (SELECT doc_id, node_idx, {labelled(SHORT_NAME_LABEL, LONG, NAMED, '')} AS v FROM ld)
SELECT doc_id, min_by(v, node_idx) AS value, min(node_idx) AS node_idx FROM vv WHERE v IS NOT NULL
GROUP BY doc_id""",
)
def label_then_value(t: Tables):
    return identity.first_per_document(identity.label_then_value(views.node_rows(t)))


@query(
    "first_nodes",
    f"WITH {views.NODE_ROWS}\nSELECT doc_id, node_idx, text FROM node_rows WHERE node_idx < 30",
)
def first_nodes(t: Tables):
    return identity.first_nodes(views.node_rows(t), 30)


@query(
    "clear_exact_nodes",
    f"WITH {views.NODE_ROWS}, {views.IDENTITIES}"
    + f"""
SELECT doc_id, node_idx, text, CASE WHEN lower({oracle.strip('text')}) IN (lower(name), lower(roll_no)) THEN chr(160)
  ELSE text END AS cleared FROM node_rows JOIN identities USING (doc_id)""",
)
def clear_exact_nodes(t: Tables):
    return redact.clear_exact_nodes(views.node_rows(t), views.identities(t))


@query(
    "clear_containing_nodes",
    f"WITH {views.NODE_ROWS}, {views.IDENTITIES}"
    + """
SELECT doc_id, node_idx, text, regexp_replace(replace(text, roll_no, chr(160)), '(?i)' || regexp_escape(name),
  chr(160), 'g') AS cleared FROM node_rows JOIN identities USING (doc_id)""",
)
def clear_containing_nodes(t: Tables):
    return redact.clear_containing_nodes(views.node_rows(t), views.identities(t))


@query(
    "clear_tagged_value",
    f"WITH {views.ID_NODES}, {views.IDENTITIES},"
    + r"""
xml AS (SELECT doc_id, array_to_string(list_transform(nodes, lambda n: '<w:t>' || n || '</w:t>'), '') AS x, name,
  roll_no FROM id_nodes JOIN identities USING (doc_id))
SELECT doc_id, regexp_replace(x, '(?i)(<w:t[^>]*>)' || regexp_escape(name) || '(</w:t>)', '\1' || chr(160) || '\2', 'g')
  AS named,
  CASE WHEN contains(x, '<w:t>' || roll_no || '0</w:t>') THEN x ELSE replace(x, roll_no || '0', '') END AS raw
FROM xml""",
)
def clear_tagged_value(t: Tables):
    """Name blanked inside its element; a number that fills no element removed raw."""
    xml = views.id_nodes(t).select(
        "doc_id", F.array_join(F.transform("nodes", lambda n: F.concat(F.lit("<w:t>"), n, F.lit("</w:t>"))), "").alias("x")
    )
    joined = xml.join(views.identities(t), "doc_id")
    return joined.select(
        "doc_id",
        redact.clear_tagged_value(F.col("x"), F.col("name")).alias("named"),
        redact.clear_tagged_value(F.col("x"), F.concat("roll_no", F.lit("0")), "", raw_fallback=True).alias("raw"),
    )


@query(
    "redact_and_verify",
    f"WITH {views.NODE_ROWS},{short_walk('node_rows', 'a_')},"
    + f"""
cl AS (SELECT n.doc_id, n.node_idx, n.text AS before,
  CASE WHEN roll_no <> '' AND lower({oracle.strip('n.text')}) = lower({oracle.strip('roll_no')}) THEN chr(160)
    ELSE n.text END AS t1, name FROM node_rows n JOIN a_id USING (doc_id)),
cl2 AS (SELECT *, CASE WHEN name <> '' AND lower({oracle.strip('t1')}) = lower({oracle.strip('name')}) THEN chr(160)
  ELSE t1 END AS text FROM cl),
cnt AS (SELECT doc_id, CAST(count(*) FILTER (WHERE text <> t1) AS INTEGER) AS removed_name,
  CAST(count(*) FILTER (WHERE t1 <> before) AS INTEGER) AS removed_roll,
  CAST(sum(strlen(before)) - sum(strlen(text)) AS INTEGER) AS bytes_removed FROM cl2 GROUP BY doc_id),
{short_walk('cl2', 'b_')}
SELECT a.doc_id, a.name AS name_before, a.roll_no AS roll_before, a.confidence AS confidence_before, removed_name,
  removed_roll, bytes_removed, b.name AS name_after, b.roll_no AS roll_after, b.confidence AS confidence_after
FROM a_id a JOIN b_id b USING (doc_id) JOIN cnt USING (doc_id)""",
)
def redact_and_verify(t: Tables):
    return redact.redact_and_verify(views.id_nodes(t))


@query(
    "node_difference",
    f"WITH {views.NODE_ROWS}, {views.IDENTITIES},"
    + f"""
cl AS (SELECT doc_id, CASE WHEN lower({oracle.strip('text')}) IN (lower(name), lower(roll_no)) THEN chr(160) ELSE text
  END AS text FROM node_rows JOIN identities USING (doc_id))
SELECT doc_id, text FROM node_rows EXCEPT SELECT doc_id, text FROM cl""",
)
def node_difference(t: Tables):
    nodes = views.node_rows(t)
    cleared = redact.clear_exact_nodes(nodes, views.identities(t))
    return redact.node_difference(nodes, cleared.select("doc_id", F.col("cleared").alias("text")))


@query(
    "bullet_nodes",
    """
WITH n AS (SELECT conv_id AS doc_id, turn AS para_idx, 0 AS node_in_para,
  CASE WHEN turn % 3 = 0 THEN '•' WHEN turn % 3 = 1 THEN ' - ' ELSE 'text' END AS text,
  CASE WHEN conv_id % 4 = 0 THEN 'Symbol' WHEN conv_id % 4 = 1 THEN 'Arial' END AS font FROM conversations
  UNION ALL SELECT conv_id, turn, 1, text, NULL FROM conversations)
SELECT doc_id, CAST(count(*) FILTER (WHERE node_in_para = 0 AND trim(text) IN ('•', '-')) AS BIGINT) AS bullets,
  CAST(count(*) FILTER (WHERE font = 'Symbol') AS BIGINT) AS symbol_runs, CAST(count(*) AS BIGINT) AS nodes
FROM n GROUP BY doc_id""",
)
def bullet_nodes(t: Tables):
    turn = F.col("turn")
    base = t.conversations.withColumn("parts", F.array(
        F.struct(
            F.when(turn % 3 == 0, "•").when(turn % 3 == 1, " - ").otherwise("text").alias("text"),
            F.when(F.col("conv_id") % 4 == 0, "Symbol").when(F.col("conv_id") % 4 == 1, "Arial").alias("font"),
        ),
        F.struct(F.col("text"), F.lit(None).cast("string").alias("font")),
    ))
    nodes = base.select(
        F.col("conv_id").alias("doc_id"), turn.alias("para_idx"), F.posexplode("parts").alias("node_in_para", "p")
    ).select("doc_id", "para_idx", "node_in_para", "p.*")
    return redact.mark_bullets(nodes).groupBy("doc_id").agg(
        F.count_if("is_bullet").alias("bullets"),
        F.count_if("symbol_font").alias("symbol_runs"),
        F.count("*").alias("nodes"),
    )


@query(
    "docx_roundtrip",
    f"WITH {views.ID_DOCS}"
    + """
SELECT 'doc' || doc_id || '.docx' AS path, text FROM id_docs""",
)
def docx_roundtrip(t: Tables):
    """Texts written as DOCX packages and read back, one paragraph per line."""
    texts = views.id_docs(t).select(
        F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".docx")).alias("path"), "text"
    )
    return docx.docx_text(docx.read_docx_nodes(docx.text_to_docx(texts)))


@query(
    "docx_redaction",
    WITH_IDS + found_ctes("id_docs") + "," + REDACTED
    + "\nSELECT 'doc' || doc_id || '.docx' AS path, redacted_text AS text FROM red",
)
def docx_redaction(t: Tables):
    """DOCX packages whose nodes are redacted with the values found in the whole text, then read back.

    Values never cross a line here, so the result equals the redacted text.
    """
    path = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".docx"))
    docs = views.id_docs(t).select("doc_id", path.alias("path"), "text")
    blobs = cut_lineage(docx.text_to_docx(docs))
    found = identity.extract_identity(docs).select(
        "path", F.col("detected_name").alias("name"), F.col("detected_roll_no").alias("roll_no")
    )
    redacted = redact.redact_with(docx.read_docx_nodes(blobs), found, key="path").select(
        "path", "node_idx", F.col("redacted_text").alias("text")
    )
    written = docx.docx_documents(docx.write_docx_parts(blobs, redacted))
    return written.filter("error IS NULL").select("path", "text")
