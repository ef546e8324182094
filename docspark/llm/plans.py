"""Registered queries of the corpus operators, each with the DuckDB SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm import (
    bpe,
    conversation_trie,
    decontamination,
    language_id,
    lexical_search,
    license_scan,
    mixing,
    quality,
    sharding,
    simhash,
    substring_dedup,
    token_counts,
    url_filter,
)


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    oracle: str | None = None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(spark, folder)


QUERIES: dict[str, Query] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = Query(build, oracle)
        return build

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


WHITE_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOW = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
LOW_WORDS = r"list_filter(string_split_regex(" + LOW + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"


def _src(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN '-' ELSE '+' || {column} END"


def _key(seed: int) -> str:
    return f"md5(concat_ws('|', '{seed}', {_src('doc_id')}, md5(coalesce(text, ''))))"


# -- 1 ------------------------------------------------------------------------------------------------------------

OP1 = rf"""
WITH docs AS (SELECT doc_id, {WHITE_WORDS} AS ws FROM documents),
win AS (
  SELECT doc_id, s, md5(array_to_string(list_slice(ws, s + 1, s + {substring_dedup.WINDOW}), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(len(ws) - {substring_dedup.WINDOW} + 1)) AS s FROM docs WHERE len(ws) >= {substring_dedup.WINDOW})),
first AS (SELECT h, min(doc_id) AS owner FROM win GROUP BY h),
gone AS (
  SELECT DISTINCT doc_id, p FROM (
    SELECT doc_id, unnest(range(s, s + {substring_dedup.WINDOW})) AS p FROM win JOIN first USING (h) WHERE doc_id > owner)),
marked AS (SELECT doc_id, list(p) AS gone FROM gone GROUP BY doc_id),
flat AS (SELECT doc_id, ws[p + 1] AS w, p FROM (SELECT doc_id, ws, unnest(range(len(ws))) AS p FROM docs)),
kept AS (SELECT f.doc_id, string_agg(w, ' ' ORDER BY f.p) AS txt, count(*) AS n FROM flat f LEFT JOIN gone g ON f.doc_id = g.doc_id AND f.p = g.p WHERE g.p IS NULL GROUP BY f.doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(txt, '')) AS kept_sha256
FROM docs d LEFT JOIN kept k USING (doc_id)"""


@query("op1_substring_dedup", OP1)
def op1_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """What is left of every document without repeated 50-word passages."""
    left = substring_dedup.remove_repeats(table(spark, folder, "documents"), with_text=False)
    return left.select("doc_id", "n_words", "n_removed", "kept_sha256")


# -- 2 ------------------------------------------------------------------------------------------------------------


@query("op2_token_counts")
def op2_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every document."""
    return token_counts.count_tokens(table(spark, folder, "documents"))


# -- 3 ------------------------------------------------------------------------------------------------------------


def _template_rows() -> str:
    rows = []
    for number, (label, text) in enumerate(license_scan.TEMPLATES):
        members = license_scan.template_words(text)
        need = license_scan.math.ceil(license_scan.THRESHOLD * len(members) - 1e-9)
        span = len(license_scan.template_sequence(text)) + license_scan.MARGIN
        rows.append(f"({number}, '{label}', [{', '.join(repr(w) for w in members)}], {need}, {span})")
    return ",\n  ".join(rows)


def _phrase_rows() -> str:
    rows = [f"('{label}', [{', '.join(repr(w) for w in phrase.split())}])" for phrase, label in license_scan.PHRASES]
    return ", ".join(rows)


OP3 = f"""
WITH templates(t, label, members, need, span) AS (VALUES
  {_template_rows()}),
phrases(label, parts) AS (VALUES {_phrase_rows()}),
docs AS (SELECT doc_id, {LOW_WORDS.format('text')} AS ws FROM documents),
places AS (
  SELECT doc_id, label, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1:i + len(parts)] = parts)) AS pos
  FROM docs, phrases WHERE list_contains(ws, parts[1])),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS labels FROM places GROUP BY doc_id),
held AS (SELECT doc_id, ws, t, label, members, need, span FROM docs, templates WHERE len(list_intersect(list_distinct(ws), members)) >= need),
begun AS (SELECT *, unnest(list_filter(range(len(ws)), lambda i: list_contains(members, ws[i + 1]))) AS i FROM held),
blocks AS (SELECT doc_id, t, label, members, need, len(list_intersect(list_distinct(list_slice(ws, i + 1, i + span)), members)) AS overlap FROM begun),
met AS (
  SELECT doc_id, label, max(overlap) / len(members)::DOUBLE AS share
  FROM blocks GROUP BY doc_id, t, label, members, need HAVING max(overlap) >= need),
method AS (SELECT doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base,
  b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(b.labels, m.labels))), ','), '') AS labels,
  CASE WHEN b.n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(m.share, 0.0::DOUBLE) END AS score
FROM docs d LEFT JOIN base b USING (doc_id) LEFT JOIN method m USING (doc_id)"""


@query("op3_license_scans", OP3)
def op3_license_scans(spark: SparkSession, folder: str) -> DataFrame:
    """License labels of every document."""
    return license_scan.scan_licenses(table(spark, folder, "documents")).drop("matches")


# -- 4 ------------------------------------------------------------------------------------------------------------


def _rules_sql() -> str:
    cases = sorted(url_filter.RULES, key=lambda r: -(len(r[0]) + len(r[1])))
    fits = "(host = '{0}' OR ends_with(host, '.{0}')) AND starts_with(path, '{1}')"
    return "\n".join(f"  WHEN {fits.format(h, p)} THEN '{h}{p}|{v}'" for h, p, v in cases)


OP4 = rf"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, {LOW.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path, regexp_extract(string_split(coalesce(url, ''), '#')[1], '\?(.*)$', 1) AS query FROM cut),
named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(regexp_replace(path, '\.html?$', ''), '/+$', '')
    || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END AS canonical
  FROM (SELECT *, array_to_string(list_filter(string_split(query, '&'),
    lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}')), '&') AS kept FROM parts)),
listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(host, '(^|\.)({"|".join(url_filter.LISTED_SITES)})\.')),
ruled AS (SELECT *, CASE
{_rules_sql()} END AS hit FROM named)
SELECT page_id, host, path, string_split(hit, '|')[1] AS rule, l.canonical IS NOT NULL AND host <> '' AS listed,
  coalesce(string_split(hit, '|')[2], CASE WHEN l.canonical IS NOT NULL AND host <> '' THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled LEFT JOIN listed l USING (canonical)"""


@query("op4_url_filters", OP4)
def op4_url_filters(spark: SparkSession, folder: str) -> DataFrame:
    """Verdict on every page's URL; the list holds the canonical URLs of pages on the listed sites."""
    pages = table(spark, folder, "pages")
    judged = url_filter.judge_urls(pages, url_filter.listed_urls(pages))
    return judged.select("page_id", "host", "path", "rule", "listed", "verdict")


# -- 5 ------------------------------------------------------------------------------------------------------------


@query("op5_language_id")
def op5_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, folder, "documents")
    return language_id.predict(docs, language_id.train(language_id.training_sample(docs)))


# -- 6 ------------------------------------------------------------------------------------------------------------

MIX = rf"""
sized AS (SELECT doc_id, source, {_src('source')} AS src, len({WHITE_WORDS})::BIGINT AS size, {_key(mixing.SEED)} AS key FROM documents),
sizes AS (SELECT src, max(source) AS source, sum(size)::BIGINT AS source_size FROM sized GROUP BY src),
weighted AS (
  SELECT src, source_size, [3, 1, 2][((place - 1) % 3) + 1] AS weight, place
  FROM (SELECT *, row_number() OVER (ORDER BY source COLLATE "C" NULLS LAST) AS place FROM sizes)),
ratios AS (SELECT *, 2.0::DOUBLE * source_size / weight AS ratio, sum(source_size) OVER () AS total FROM weighted),
levels AS (
  SELECT *, (1.5::DOUBLE * total - coalesce(sum(source_size) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
    / sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ratios),
final AS (SELECT arg_min(level, [ratio, place]) AS level FROM levels WHERE ratio > level),
goals AS (SELECT src, source_size, least(2.0::DOUBLE * source_size, coalesce((SELECT level FROM final), 0.0::DOUBLE) * weight) AS target FROM levels),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS epochs,
    target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END * source_size AS rest FROM goals),
units AS (SELECT src, key, sum(size) AS size FROM sized GROUP BY src, key),
running AS (SELECT src, key, size, coalesce(sum(size) OVER (PARTITION BY src ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM units),
mix AS (
  SELECT s.doc_id, s.source, s.key, s.size, p.source_size, p.target,
    (p.epochs + CASE WHEN r.start < p.rest AND 2 * r.start + r.size <= 2 * p.rest THEN 1 ELSE 0 END)::BIGINT AS epochs
  FROM sized s JOIN plan p USING (src) JOIN running r USING (src, key))"""


@query("op6_source_mix", f"WITH {MIX.strip()} SELECT doc_id, size, source_size, target, epochs, (epochs * size)::BIGINT AS taken FROM mix")
def op6_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    """How many words of every document the mix takes."""
    return mixing.mix_sources(table(spark, folder, "documents")).drop("source")


# -- 7 ------------------------------------------------------------------------------------------------------------

QUALITY = rf"""
qdocs AS (SELECT doc_id, source, coalesce(text, '') AS text, {WHITE_WORDS} AS ws FROM documents),
qwin AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: {{'i': i, 'g': ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2]}})) AS w FROM qdocs),
qrep AS (SELECT doc_id, w.i AS i FROM qwin QUALIFY count(*) OVER (PARTITION BY doc_id, w.g) > 1),
qrepeat AS (
  SELECT doc_id, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
  FROM (SELECT *, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM qrep) GROUP BY doc_id),
qlines AS (
  SELECT doc_id, source, line, trim(regexp_replace({LOW.format('line')}, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM qdocs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
qdup AS (SELECT doc_id, (count(*) - count(DISTINCT line))::BIGINT AS n_dup_lines FROM qlines GROUP BY doc_id),
qnorm AS (
  SELECT doc_id, {_src('source')} AS host, norm, sum(len(string_split(norm, ' '))) AS n
  FROM qlines GROUP BY doc_id, source, norm),
qmeasured AS (
  SELECT d.doc_id, {_src('source')} AS host, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(ws) AS base_failed
  FROM qdocs d LEFT JOIN qrepeat USING (doc_id) LEFT JOIN qdup USING (doc_id)),
qcommon AS (SELECT host, norm FROM qnorm GROUP BY host, norm HAVING count(*) > {quality.LINE_DOCS}),
qheld AS (SELECT doc_id, host, norm, n, n_words, base_failed FROM qnorm JOIN qcommon USING (host, norm) JOIN qmeasured USING (doc_id, host)),
qfirst AS (
  SELECT host, norm, min(doc_id) AS first_doc, arg_min(doc_id, md5(doc_id::VARCHAR)) AS rescuer
  FROM qheld WHERE NOT base_failed GROUP BY host, norm),
qsums AS (SELECT doc_id, coalesce(sum(n) FILTER (first_doc < doc_id), 0) AS removed, max(n_words) AS n_words FROM qheld JOIN qfirst USING (host, norm) GROUP BY doc_id),
qthin AS (SELECT doc_id, removed, n_words - removed < {quality.KEPT_SHARE}::DOUBLE * n_words AS thin FROM qsums),
qrescued AS (
  SELECT DISTINCT rescuer AS doc_id FROM (
    SELECT host, norm, any_value(rescuer) AS rescuer FROM qheld JOIN qfirst USING (host, norm) JOIN qthin USING (doc_id)
    WHERE NOT base_failed GROUP BY host, norm HAVING bool_and(thin))),
qverdict AS (
  SELECT m.* EXCLUDE (host), coalesce(removed, 0)::BIGINT AS n_common_words, r.doc_id IS NOT NULL AS rescued,
    coalesce(thin, false) AND r.doc_id IS NULL AS depleted
  FROM qmeasured m LEFT JOIN qthin USING (doc_id) LEFT JOIN qrescued r USING (doc_id))"""


@query("op7_quality_rules", f"WITH {QUALITY.strip()} SELECT *, NOT base_failed AND NOT depleted AS kept FROM qverdict")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality measures and verdict of every document."""
    return quality.judge_quality(table(spark, folder, "documents")).drop("host", "text_hash")


# -- 8 ------------------------------------------------------------------------------------------------------------

HITS = rf"""
bitems AS (SELECT item_id::VARCHAR AS item, {LOW_WORDS.format('text')} AS ws FROM benchmark),
bwin AS (
  SELECT DISTINCT item, list_slice(ws, s + 1, s + 13) AS parts
  FROM (SELECT item, ws, unnest(range(greatest(len(ws) - 13, 0) + 1)) AS s FROM bitems WHERE len(ws) > 0)),
hdocs AS (SELECT doc_id, {LOW_WORDS.format('text')} AS ws FROM documents),
hwin AS (
  SELECT doc_id, b, list_slice(ws, b + 1, b + n) AS parts, n
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS b FROM hdocs, (SELECT DISTINCT len(parts) AS n FROM bwin) WHERE len(ws) >= n)),
hmet AS (SELECT doc_id, b, n, item FROM hwin JOIN bwin USING (parts)),
hwords AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(b, b + n)) AS p FROM (SELECT DISTINCT doc_id, b, n FROM hmet)) GROUP BY doc_id),
hnames AS (SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM hmet GROUP BY doc_id),
ncounts AS (SELECT term, count(*) AS n FROM (SELECT unnest(ws) AS term FROM hdocs) GROUP BY term),
nplaced AS (SELECT parts, unnest(parts) AS term, unnest(range(len(parts))) AS o FROM (SELECT DISTINCT parts FROM bwin)),
nfirst AS (
  SELECT parts, r.term AS term, r.o AS o
  FROM (SELECT parts, min(struct_pack(n := n, o := o, term := term)) AS r FROM nplaced JOIN ncounts USING (term) GROUP BY parts HAVING count(*) = len(parts))),
npos AS (SELECT doc_id, unnest(ws) AS term, unnest(range(len(ws))) AS pos FROM hdocs),
nmet AS (
  SELECT DISTINCT doc_id, parts FROM (SELECT doc_id, parts, pos - o AS b FROM npos JOIN nfirst USING (term)) JOIN hdocs USING (doc_id)
  WHERE len(list_distinct(list_intersect(parts, list_slice(ws, greatest(b - {decontamination.SLOP}, 0) + 1, b + len(parts) + {decontamination.SLOP})))) = len(list_distinct(parts))),
nnames AS (
  SELECT doc_id, count(*) AS n_near_items FROM (SELECT DISTINCT doc_id, item FROM nmet JOIN bwin USING (parts) EXCEPT SELECT doc_id, item FROM hmet) GROUP BY doc_id),
hits AS (
  SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(w.n_hit, 0)::BIGINT AS n_hit, coalesce(len(i.items), 0)::BIGINT AS n_items,
    sha256(coalesce(array_to_string(i.items, ','), '')) AS items_sha256, coalesce(n.n_near_items, 0)::BIGINT AS n_near_items
  FROM hdocs d LEFT JOIN hwords w USING (doc_id) LEFT JOIN hnames i USING (doc_id) LEFT JOIN nnames n USING (doc_id))"""


@query("op8_benchmark_decontamination", f"WITH {HITS.strip()} SELECT *, n_hit > 0 AND 20 * n_hit >= n_words AS contaminated FROM hits")
def op8_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark items in every document: phrases that stand in it, and further items whose words stand near each other."""
    found = decontamination.find_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        F.size("near_items").cast("long").alias("n_near_items"), decontamination.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


# -- 9 ------------------------------------------------------------------------------------------------------------

OP9 = rf"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
bytes AS (
  SELECT doc_id, source, text, list_transform(list_filter(string_split(regexp_replace(hex(encode(coalesce(text, ''))), '(..)', '\1,', 'g'), ','),
    lambda x: x <> ''), lambda x: ('0x' || x)::UBIGINT) AS b FROM documents),
rows AS (
  SELECT doc_id, {_src('source')} AS src, len(b) + 16 AS size, {_key(sharding.SEED)} AS key,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, b), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INTEGER + 1])), 4294967295::UBIGINT) AS text_crc32
  FROM bytes, crc),
ranked AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY key) - 1 AS rank, count(*) OVER (PARTITION BY src) AS n FROM rows),
placed AS (
  SELECT *, row_number() OVER (ORDER BY (2 * rank + 1) / (2.0::DOUBLE * n), key, src, rank) - 1 AS place, count(*) OVER () AS total FROM ranked),
cut AS (SELECT *, (place * {sharding.SHARDS}) // total AS shard FROM placed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, shard::INTEGER AS shard,
  (place - ceil(shard * total / {sharding.SHARDS}::DOUBLE))::BIGINT AS slot, NULL::INTEGER AS grown_shard
FROM cut"""


@query("op9_shards", OP9)
def op9_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document."""
    placed = sharding.interleave(table(spark, folder, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


# -- 10 -----------------------------------------------------------------------------------------------------------


@query("op10_simhash_groups")
def op10_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


# -- 11 -----------------------------------------------------------------------------------------------------------

OP11 = rf"""
WITH items AS (SELECT DISTINCT item_id, unnest({LOW_WORDS.format('text')}) AS term FROM benchmark),
docs AS (SELECT doc_id, {LOW_WORDS.format('text')} AS ws FROM documents),
sums AS (SELECT count(*) FILTER (len(ws) > 0) AS n_docs, sum(len(ws))::BIGINT AS n_terms FROM docs),
tfs AS (
  SELECT doc_id, term, n, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term, len(ws) AS n FROM docs)
  WHERE term IN (SELECT term FROM items) GROUP BY doc_id, term, n),
weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tfs GROUP BY term), sums),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN tfs USING (term) JOIN weights USING (term), sums GROUP BY item_id, doc_id)
SELECT item_id, (row_number() OVER best)::INTEGER AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW best AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= {lexical_search.BEST}"""


@query("op11_lexical_search", OP11)
def op11_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    """The best 50 documents for every benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


# -- 12 -----------------------------------------------------------------------------------------------------------

OP12 = rf"""
WITH RECURSIVE steps(i, c, k) AS (
  SELECT i, i::UBIGINT, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END, k + 1 FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
turns AS (
  SELECT conv_id, turn, substr(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS k, len({WHITE_WORDS}) AS w
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'k': k, 'w': w}} ORDER BY turn NULLS FIRST, k) AS ts FROM turns GROUP BY conv_id),
heads AS (
  SELECT conv_id, ts, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda a, x: xor(a >> 8, t[(xor(a, x) & 255)::INTEGER + 1])), 4294967295::UBIGINT) % 4)::BIGINT AS h
  FROM own, crc),
rebuilt AS (
  SELECT c.conv_id, list_concat(coalesce(list_slice(b.ts, 1, c.h), []), list_slice(c.ts, c.h + 1, len(c.ts))) AS rb
  FROM heads c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 20),
prefixes AS (
  SELECT conv_id, d, len(rb) AS size, CASE WHEN d > 0 THEN rb[d].w ELSE 0 END AS w,
    sha256(array_to_string(list_transform(list_slice(rb, 1, d), lambda x: x.k), '')) AS node,
    CASE WHEN d > 0 THEN sha256(array_to_string(list_transform(list_slice(rb, 1, d - 1), lambda x: x.k), '')) END AS parent
  FROM (SELECT conv_id, rb, unnest(range(len(rb) + 1)) AS d FROM rebuilt)),
nodes AS (
  SELECT node, any_value(parent) AS parent, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(w) AS w,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = size), '')) AS ends_sha256
  FROM prefixes GROUP BY node),
below AS (SELECT parent, count(*) AS n_children FROM nodes WHERE parent IS NOT NULL GROUP BY parent),
sums AS (
  SELECT p.node, sum(CASE WHEN b.parent IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved_tokens
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.d <= n.depth LEFT JOIN below b ON b.parent = n.node GROUP BY p.node)
SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(b.n_children, 0)::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes u ON u.node = n.parent LEFT JOIN below b ON b.parent = n.node JOIN sums s ON s.node = n.node"""


@query("op12_conversation_trie", OP12)
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return conversation_trie.conversation_trie(table(spark, folder, "conversations"))


# -- 13 -----------------------------------------------------------------------------------------------------------


@query("op13_bpe_codec")
def op13_bpe_codec(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document and the text that they stand for, as checksums."""
    coded = bpe.decode(bpe.encode(table(spark, folder, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
