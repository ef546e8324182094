"""Queries over text augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, wording
from docspark.operators import rewrite
from docspark.plans import oracle, views
from docspark.plans.registry import Tables, query
from docspark.sources.tables import spread

SEED = 7
P_SYN = 0.4
P_TRANS = 0.2
SYNONYM_ENDINGS = ["a", "eth", "ory"]
CLASSES = ["ADJ", "ADV", "NOUN", "VERB", "OTHER"]
CIT = fixed.CITATION_PATTERN
MARK = fixed.PLACEHOLDER_PATTERN
TOKEN_SQL = r"[\p{L}'']+|[^\p{L}'']+"
PIECE_SQL = r"[\p{L}'']+[^\p{L}'']*|[^\p{L}'']+"


def lexicon(t: Tables) -> DataFrame:
    """Synonym rows (word, pos, rank, synonym) for every longer word of the benchmark texts."""
    words = t.benchmark.select(
        F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}']+"), F.lit(0))).alias("w")
    ).select(F.lower("w").alias("word")).filter(F.length("word") > 3).distinct()
    tagged = words.withColumn(
        "pos",
        F.get(
            F.array(*[F.lit(c) for c in CLASSES]),
            (F.conv(F.substring(F.md5("word"), 1, 4), 16, 10).cast("bigint") % 5).cast("int"),
        ),
    )
    return tagged.select(
        "word", "pos", F.posexplode(F.array(*[F.lit(e) for e in SYNONYM_ENDINGS])).alias("rank", "ending")
    ).select("word", "pos", "rank", F.concat("word", "ending").alias("synonym"))


LEXICON = r"""
lexicon AS (SELECT word, (['ADJ','ADV','NOUN','VERB','OTHER'])[CAST(('0x' || substr(md5(word), 1, 4)) AS BIGINT) % 5 + 1]
    AS word_class, [word || 'a', word || 'eth', word || 'ory'] AS synonyms
  FROM (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}'']+')) AS w
    FROM benchmark)) WHERE length(word) > 3)"""


def expand_sql(token: str) -> str:
    pairs = ", ".join(f"{oracle.literal(k)}: {oracle.literal(v)}" for k, v in fixed.CONTRACTIONS.items())
    low = f"lower({token})"
    suffixes = " ".join(
        f"WHEN suffix({low}, {oracle.literal(s)}) THEN substr({low}, 1, length({low}) - {len(s)}) || {oracle.literal(e)}"
        for s, e in fixed.CONTRACTION_SUFFIXES.items()
    )
    found = f"CASE WHEN (MAP {{{pairs}}})[{low}] IS NOT NULL THEN (MAP {{{pairs}}})[{low}] {suffixes} END"
    return (
        f"CASE WHEN NOT contains({token}, '''') OR ({found}) IS NULL THEN {token} "
        f"WHEN regexp_matches({token}, '^\\p{{Lu}}') THEN upper(substr({found}, 1, 1)) || substr({found}, 2) "
        f"ELSE {found} END"
    )


def contractions_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, '{TOKEN_SQL}'), lambda t: {expand_sql('t')}), '')"
    )


def citations_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(string_split_regex({text}, '{CIT}'), lambda p, i: p || CASE WHEN i <= "
        f"len(regexp_extract_all({text}, '{CIT}')) THEN '[[REF_' || i || ']]' ELSE '' END), '')"
    )


def restore_sql(text: str, refs: str) -> str:
    return (
        f"array_to_string(list_transform(string_split_regex({text}, '{MARK}'), lambda p, i: p || coalesce("
        f"{refs}[CAST(regexp_extract_all({text}, '{MARK}', 1)[i] AS INTEGER)], "
        f"regexp_extract_all({text}, '{MARK}')[i], '')), '')"
    )


def spacing_sql(text: str) -> str:
    out = f"regexp_replace({text}, '[ \\t]+([.,;:!?])', '\\1', 'g')"
    out = f"regexp_replace({out}, '(\\()[ \\t]+', '\\1', 'g')"
    out = f"regexp_replace({out}, '[ \\t]+(\\))', '\\1', 'g')"
    out = f"regexp_replace({out}, '[ \\t]{{2,}}', ' ', 'g')"
    return f"regexp_replace({out}, '``\\s*(.+?)\\s*''''', '\"\\1\"', 'g')"


TRANSITIONS_SQL = "[" + oracle.literals(fixed.TRANSITIONS) + "]"


def opened_sql(line: str, p: float, *keys: str) -> str:
    pick = oracle.draw_int(*keys, "'transition'", "i - 1")
    chance = oracle.draw(*keys, "'open'", "i - 1")
    return (
        f"array_to_string(list_transform({oracle.sentences(line)}, lambda s, i: CASE WHEN {chance} < {p} "
        f"THEN ({TRANSITIONS_SQL})[{pick} % {len(fixed.TRANSITIONS)} + 1] || ' ' || s ELSE s END), ' ')"
    )


def opened_lines_sql(text: str, p: float, *keys: str) -> str:
    return (
        f"array_to_string(list_transform(string_split({text}, chr(10)), lambda line, j: CASE WHEN "
        f"regexp_matches(line, '\\S') THEN {opened_sql('line', p, *keys, 'j - 1')} ELSE line END), chr(10))"
    )


def synonyms_ctes(source: str, seed: int, p: float, key: str = "doc_id") -> str:
    keys = (f"'{seed}'", key)
    return rf"""
tok AS (SELECT {key}, u.i - 1 AS pos, regexp_extract(u.x, '^([\p{{L}}'']*)', 1) AS token,
  regexp_extract(u.x, '^[\p{{L}}'']*(.*)$', 1, 's') AS gap
  FROM {source}, unnest(regexp_extract_all(work, '{PIECE_SQL}')) WITH ORDINALITY AS u(x, i)),
swp AS (SELECT {key}, pos, CASE WHEN {oracle.draw(*keys, "'swap'", 'pos')} < CASE
    WHEN word_class IN ('ADJ', 'ADV') THEN {p}::DOUBLE * 1.3::DOUBLE WHEN word_class IN ('NOUN', 'VERB') THEN {p}::DOUBLE
    ELSE 0.0::DOUBLE END THEN synonyms[{oracle.draw_int(*keys, "'pick'", 'pos')} % 3 + 1] ELSE token END || gap AS token
  FROM tok LEFT JOIN lexicon ON lexicon.word = lower(token) AND length(token) > 3),
syn AS (SELECT {key}, string_agg(token, '' ORDER BY pos) AS work FROM swp GROUP BY {key})"""


@query(
    "expand_contractions",
    f"WITH {views.REWRITE_DOCS}\nSELECT doc_id, {contractions_sql('text')} AS expanded FROM rewrite_docs",
)
def expand_contractions(t: Tables):
    return views.rewrite_docs(t).select("doc_id", wording.expand_contractions(F.col("text")).alias("expanded"))


@query(
    "citations_roundtrip",
    f"WITH {views.REWRITE_DOCS}"
    + f"""
SELECT doc_id, {citations_sql('text')} AS masked, regexp_extract_all(text, '{CIT}') AS refs, text AS restored
FROM rewrite_docs""",
)
def citations_roundtrip(t: Tables):
    masked = views.rewrite_docs(t).select("doc_id", wording.extract_citations(F.col("text")).alias("c"))
    return masked.select(
        "doc_id", F.col("c.text").alias("masked"), "c.refs",
        wording.restore_citations(F.col("c.text"), F.col("c.refs")).alias("restored"),
    )


@query(
    "number_citations",
    f"WITH {views.REWRITE_DOCS}"
    + f"""
SELECT doc_id, CAST(u.i AS INTEGER) AS number, u.x AS citation, '[[REF_' || u.i || ']]' AS placeholder
FROM rewrite_docs, unnest(regexp_extract_all(text, '{CIT}')) WITH ORDINALITY AS u(x, i)""",
)
def number_citations(t: Tables):
    return rewrite.number_citations(views.rewrite_docs(t))


@query(
    "add_transitions",
    f"""
SELECT doc_id, {opened_sql('text', P_TRANS, f"'{SEED}'", 'doc_id')} AS opened FROM documents""",
)
def add_transitions(t: Tables):
    return t.texts.select("doc_id", wording.with_transitions(F.col("text"), P_TRANS, SEED, F.col("doc_id")).alias("opened"))


@query(
    "replace_synonyms",
    f"WITH {LEXICON}, src AS (SELECT doc_id, text AS work FROM documents),{synonyms_ctes('src', SEED, P_SYN)}"
    + "\nSELECT doc_id, work AS text FROM syn",
)
def replace_synonyms(t: Tables):
    return rewrite.replace_synonyms(t.texts, rewrite.prepare_lexicon(lexicon(t)), P_SYN, SEED)


@query(
    "rewrite_text",
    f"WITH {views.REWRITE_DOCS}, {LEXICON},"
    + f"""
c0 AS (SELECT doc_id, text, {citations_sql('text')} AS m, regexp_extract_all(text, '{CIT}') AS refs FROM rewrite_docs),
src AS (SELECT doc_id, text, refs, {contractions_sql('m')} AS work FROM c0),
{synonyms_ctes('src', SEED, P_SYN)},
opn AS (SELECT doc_id, {opened_lines_sql('work', P_TRANS, f"'{SEED}'", 'doc_id')} AS o FROM syn),
res AS (SELECT doc_id, text, {restore_sql('o', 'refs')} AS r FROM opn JOIN src USING (doc_id)),
fin AS (SELECT doc_id, text, {spacing_sql('r')} AS rewritten FROM res),
cnt AS (SELECT *, len(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS ow,
  len(regexp_extract_all(rewritten, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')) AS nw,
  len({oracle.sentences('text')}) AS os, len({oracle.sentences('rewritten')}) AS ns FROM fin)
SELECT doc_id, rewritten, CAST(ow AS INTEGER) AS orig_word_count, CAST(os AS INTEGER) AS orig_sentence_count,
  CAST(nw AS INTEGER) AS new_word_count, CAST(ns AS INTEGER) AS new_sentence_count,
  CAST(nw - ow AS INTEGER) AS words_added, CAST(ns - os AS INTEGER) AS sentences_added FROM cnt""",
)
def rewrite_text(t: Tables):
    done = rewrite.rewrite_text(
        views.rewrite_docs(t), rewrite.prepare_lexicon(lexicon(t)), P_SYN, P_TRANS, SEED, preserve_linebreaks=True
    )
    return rewrite.rewrite_metrics(done).drop("text")


@query(
    "section_gate",
    f"WITH {views.QA_PARAS},"
    + r"""
nrm AS (SELECT *, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n FROM qa_paras),
hd AS (SELECT *, contains(n, 'assignment') AND contains(n, 'set') AS h FROM nrm),
st AS (SELECT *, max(h::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM hd)
SELECT doc_id, para_idx, text, regexp_matches(n, '^q\s*\d+[\.:]*|^question\s+\d+') AS is_question,
  regexp_matches(n, '^a\s*\d+[\.:]*|^answer\s+\d+') AS is_answer
FROM st WHERE open = 1 AND NOT h""",
)
def section_gate(t: Tables):
    gated = rewrite.section_gate(views.qa_paras(t))
    return gated.withColumn("is_question", rewrite.is_question(F.col("text"))).withColumn(
        "is_answer", rewrite.is_answer(F.col("text"))
    )


@query(
    "rewrite_answers_only",
    f"WITH {views.QA_PARAS},"
    + rf"""
nrm AS (SELECT *, lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS n FROM qa_paras),
hd AS (SELECT *, contains(n, 'assignment') AND contains(n, 'set') AS h FROM nrm),
st AS (SELECT *, max(h::INTEGER) OVER (PARTITION BY doc_id ORDER BY para_idx
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS open FROM hd),
ans AS (SELECT doc_id, para_idx, text, doc_id || '/' || para_idx AS k FROM st
  WHERE open = 1 AND NOT h AND regexp_matches(n, '^a\s*\d+[\.:]*|^answer\s+\d+')),
c0 AS (SELECT *, {citations_sql('text')} AS m, regexp_extract_all(text, '{CIT}') AS refs FROM ans),
src AS (SELECT *, {contractions_sql('m')} AS work FROM c0),
opn AS (SELECT *, {opened_lines_sql('work', P_TRANS, f"'{SEED}'", 'k')} AS o FROM src),
res AS (SELECT *, {restore_sql('o', 'refs')} AS r FROM opn)
SELECT doc_id, para_idx, text, {spacing_sql('r')} AS rewritten FROM res""",
)
def rewrite_answers_only(t: Tables):
    return rewrite.rewrite_answers_only(views.qa_paras(t), P_TRANS, SEED)


@query(
    "rewrite_eligible",
    f"WITH {views.QA_PARAS},"
    + r"""
n AS (SELECT doc_id, para_idx, text, CASE WHEN para_idx = 0 THEN 'Heading1' WHEN para_idx % 4 = 0 THEN 'Normal' END
    AS style, para_idx % 5 = 0 AS is_list, doc_id % 6 = 0 AS in_table FROM qa_paras)
SELECT doc_id, para_idx, NOT coalesce(regexp_matches(style, '(?i)heading'), false)
  AND NOT regexp_matches(lower(regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')),
    '^q\s*\d+[\.:]*|^question\s+\d+')
  AND (is_list OR length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 15)
  AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 5 AND regexp_matches(text, '[\p{L}\p{N}_]{2,}')
  AND NOT in_table AS eligible FROM n""",
)
def rewrite_eligible(t: Tables):
    idx = F.col("para_idx")
    return views.qa_paras(t).select(
        "doc_id",
        "para_idx",
        rewrite.rewrite_eligible(
            F.col("text"), F.col("text"), F.when(idx == 0, "Heading1").when(idx % 4 == 0, "Normal"),
            idx % 5 == 0, F.col("doc_id") % 6 == 0,
        ).alias("eligible"),
    )


@query(
    "wording_guards",
    r"""
WITH p AS (SELECT conv_id, turn, text AS a, CASE turn % 4 WHEN 0 THEN upper(text) WHEN 1 THEN lower(text)
    WHEN 2 THEN text || ' 12 and 3,400.5 more' ELSE text END AS src,
  CASE WHEN turn % 3 = 0 THEN 'new 7 words 8' ELSE 'Plain new words 1 2 3' END AS cand FROM conversations),
q AS (SELECT *, regexp_replace(src, '^\s+|\s+$', '', 'g') AS o,
  regexp_extract_all(src, '\d+[\d,\.]*') AS old, regexp_extract_all(cand, '\d+[\d,\.]*') AS new FROM p),
w AS (SELECT *, list_filter(string_split_regex(o, '\s+'), lambda x: length(x) > 0) AS ws FROM q)
SELECT conv_id, turn, abs(length(cand) - length(src)) <= 0.2::DOUBLE * length(src) AS length_ok,
  CASE WHEN len(old) = len(new) THEN cand WHEN len(new) > 0 THEN
    array_to_string(list_transform(string_split_regex(cand, '\d+[\d,\.]*'), lambda x, i: x || CASE WHEN i <= len(new)
      THEN coalesce(old[i], new[i]) ELSE '' END), '') END AS numbers_kept,
  CASE WHEN NOT regexp_matches(o, '\S') THEN cand WHEN regexp_matches(o, '\p{L}') AND upper(o) = o THEN upper(cand)
    WHEN len(list_filter(ws, lambda x: regexp_matches(x, '^\p{Lu}'))) >= greatest(1, CAST(floor(len(ws) * 0.6::DOUBLE) AS BIGINT))
      THEN array_to_string(list_transform(string_split(cand, ' '), lambda x: upper(x[1]) || x[2:]), ' ')
    WHEN regexp_matches(o, '\p{L}') AND lower(o) = o THEN lower(cand) ELSE cand END AS cased
FROM w""",
)
def wording_guards(t: Tables):
    """Length, number and casing guards on conversation turns against two stock candidates."""
    turn, text = F.col("turn"), F.col("text")
    source = (
        F.when(turn % 4 == 0, F.upper(text)).when(turn % 4 == 1, F.lower(text))
        .when(turn % 4 == 2, F.concat(text, F.lit(" 12 and 3,400.5 more"))).otherwise(text)
    )
    pairs = t.conversations.select(
        "conv_id", "turn", source.alias("src"),
        F.when(turn % 3 == 0, "new 7 words 8").otherwise("Plain new words 1 2 3").alias("cand"),
    )
    src, cand = F.col("src"), F.col("cand")
    return pairs.select(
        "conv_id", "turn",
        wording.length_ratio_ok(src, cand).alias("length_ok"),
        wording.restore_numbers(src, cand).alias("numbers_kept"),
        wording.apply_casing_like(src, cand).alias("cased"),
    )


def conversation_nodes(t: Tables) -> DataFrame:
    return spread(t.conversations).select(
        F.concat_ws("/", "conv_id", "turn").alias("node_id"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text")
    )


#: DuckDB measures edits in bytes: letters outside ASCII become single unused bytes first, one for one.
FOREIGN = "äöüßéèêàçñáíóúâîôûÄÖÜÉÈÊÀÇÑÁÍÓÚ"
UNUSED = [*range(1, 9), *range(14, 32), 94, 95, 96, 123, 124, 125, 126]


def edits_sql(a: str, b: str) -> str:
    """Edit similarity of two texts by characters."""
    assert len(FOREIGN) <= len(UNUSED)
    single = "translate({0}, '" + FOREIGN + "', " + " || ".join(f"chr({c})" for c in UNUSED[: len(FOREIGN)]) + ")"
    return (
        f"1.0::DOUBLE - levenshtein({single.format(a)}, {single.format(b)}) / greatest(length({a}), length({b}))"
    )


def cased_sql(source: str, new: str) -> str:
    """Casing of ``source`` passed on to ``new``."""
    words = f"list_filter(string_split_regex({source}, '\\s+'), lambda x: length(x) > 0)"
    return (
        f"CASE WHEN NOT regexp_matches({source}, '\\S') THEN {new} "
        f"WHEN regexp_matches({source}, '\\p{{L}}') AND upper({source}) = {source} THEN upper({new}) "
        f"WHEN len(list_filter({words}, lambda x: regexp_matches(x, '^\\p{{Lu}}'))) >= "
        f"greatest(1, CAST(floor(len({words}) * 0.6::DOUBLE) AS BIGINT)) THEN array_to_string(list_transform("
        f"list_filter(string_split_regex({new}, '\\s+'), lambda x: length(x) > 0), lambda x: upper(x[1]) || x[2:]), ' ') "
        f"WHEN regexp_matches({source}, '\\p{{L}}') AND lower({source}) = {source} THEN lower({new}) ELSE {new} END"
    )


TRIES = ", ".join(
    f"({i * fixed.REWRITE_ATTEMPTS + k}, {p_syn}::DOUBLE, {p_trans}::DOUBLE)"
    for i, (p_syn, p_trans) in enumerate(fixed.REWRITE_LEVELS) for k in range(fixed.REWRITE_ATTEMPTS)
)
DRAWN = (f"'{SEED}'", "node_id", "n")
NUMBERS = r"\d+[\d,\.]*"


@query(
    "guarded_rewrite",
    f"WITH {LEXICON}, tries(n, ps, pt) AS (VALUES {TRIES}),"
    + rf"""
nodes AS (SELECT conv_id || '/' || turn AS node_id, ' ' || text || chr(10) AS text FROM conversations),
c0 AS (SELECT *, {oracle.strip('text')} AS core FROM nodes),
c1 AS (SELECT *, {citations_sql('core')} AS m, regexp_extract_all(core, '{CIT}') AS refs FROM c0),
c2 AS (SELECT *, {contractions_sql('m')} AS work FROM c1),
tok AS (SELECT node_id, u.i - 1 AS pos, regexp_extract(u.x, '^([\p{{L}}'']*)', 1) AS token,
  regexp_extract(u.x, '^[\p{{L}}'']*(.*)$', 1, 's') AS gap FROM c2, unnest(regexp_extract_all(work, '{PIECE_SQL}')) WITH ORDINALITY AS u(x, i)),
ent AS (SELECT tok.*, word_class, synonyms FROM tok LEFT JOIN lexicon ON lexicon.word = lower(token) AND length(token) > 3),
swp AS (SELECT node_id, n, pos, CASE WHEN {oracle.draw(*DRAWN, "'swap'", 'pos')} < CASE
    WHEN word_class IN ('ADJ', 'ADV') THEN ps * 1.3::DOUBLE WHEN word_class IN ('NOUN', 'VERB') THEN ps ELSE 0.0::DOUBLE END
    THEN synonyms[{oracle.draw_int(*DRAWN, "'pick'", 'pos')} % 3 + 1] ELSE token END || gap AS piece FROM ent, tries),
syn AS (SELECT node_id, n, string_agg(piece, '' ORDER BY pos) AS w FROM swp GROUP BY node_id, n),
opn AS (SELECT node_id, n, {opened_lines_sql('w', 'pt', *DRAWN)} AS o FROM syn JOIN tries USING (n)),
res AS (SELECT opn.*, core, {restore_sql('o', 'refs')} AS r FROM opn JOIN c2 USING (node_id)),
fin AS (SELECT node_id, n, core, {spacing_sql('r')} AS c FROM res),
num AS (SELECT *, regexp_extract_all(core, '{NUMBERS}') AS old, regexp_extract_all(c, '{NUMBERS}') AS new FROM fin
  WHERE regexp_matches(c, '\S') AND abs(length(c) - length(core)) <= 0.2::DOUBLE * length(core)),
kept AS (SELECT node_id, n, core, CASE WHEN len(old) = len(new) THEN c WHEN len(new) > 0 THEN
    array_to_string(list_transform(string_split_regex(c, '{NUMBERS}'), lambda x, i: x || CASE WHEN i <= len(new)
      THEN coalesce(old[i], new[i]) ELSE '' END), '') END AS c FROM num),
best AS (SELECT node_id, min(n) AS n, arg_min(c, n) AS c FROM kept WHERE c IS NOT NULL AND {edits_sql('core', 'c')} <= {fixed.MAX_SIMILARITY}::DOUBLE GROUP BY node_id)
SELECT node_id, text, CAST(n AS INTEGER) AS attempt, CASE WHEN n IS NULL THEN text ELSE regexp_extract(text, '^(\s*)', 1)
  || ({cased_sql('core', 'c')}) || regexp_extract(text, '(\s*)$', 1) END AS rewritten
FROM c0 LEFT JOIN best USING (node_id)""",
)
def guarded_rewrite(t: Tables):
    return rewrite.guarded_rewrite(conversation_nodes(t), rewrite.prepare_lexicon(lexicon(t)), SEED)


SHOUTED = "translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(
    "redistribute_words",
    rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, string_split(regexp_replace(text, '([.,])', '\1' || chr(1), 'g'), chr(1)) AS runs, string_split({SHOUTED}, ' ') AS ws
  FROM conversations),
sized AS (SELECT *, list_sum(list_transform(runs, lambda r: length(r)))::BIGINT AS total, len(ws) AS n FROM src),
step AS (
  SELECT conv_id, turn, runs, ws, total, n, 0::BIGINT AS i, 0::BIGINT AS used, 0::BIGINT AS took, []::VARCHAR[] AS out FROM sized
  UNION ALL
  SELECT conv_id, turn, runs, ws, total, n, i + 1, used + take, take, list_append(out, array_to_string(list_slice(ws, used + 1, used + take), ' ')
    || CASE WHEN take > 0 AND used + take < n THEN ' ' ELSE '' END)
  FROM (SELECT *, greatest(0, least(n - used, CASE WHEN i = len(runs) - 1 THEN n - used ELSE greatest(1,
      CASE WHEN total > 0 THEN (n - used) * length(runs[i + 1]) // total ELSE (n - used) // (len(runs) - i) END) END)) AS take
    FROM step WHERE i < len(runs)))
SELECT conv_id, turn, out AS runs FROM step WHERE i = len(runs)""",
)
def redistribute_words(t: Tables):
    """Each conversation turn's text, in capitals, spread over the parts of the original as runs."""
    runs = t.conversations.select("conv_id", "turn", "text", F.split("text", r"(?<=[.,])").alias("runs"))
    return runs.select(
        "conv_id", "turn", rewrite.redistribute_words(F.col("runs"), F.expr(SHOUTED)).alias("runs")
    )


@query(
    "rewrite_sizes",
    f"WITH {views.REWRITE_DOCS}, x AS (SELECT doc_id, text, {contractions_sql('text')} AS e FROM rewrite_docs)"
    + """
SELECT doc_id, CAST(length(text) AS INTEGER) AS original_length, CAST(length(e) AS INTEGER) AS new_length,
  CAST(greatest(1, abs(length(e) - length(text))) AS INTEGER) AS changes_applied FROM x""",
)
def rewrite_sizes(t: Tables):
    sized = views.rewrite_docs(t).select(
        "doc_id", F.length("text").alias("original_length"),
        F.length(wording.expand_contractions(F.col("text"))).alias("new_length"),
    )
    return sized.withColumn(
        "changes_applied", rewrite.changes_applied(F.col("original_length"), F.col("new_length"))
    )


@query(
    "projected_field",
    """
SELECT event_id, 'v' || CAST(event_id % 9 AS VARCHAR) AS text FROM events WHERE event_id % 3 <> 2
UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 3 = 2""",
)
def projected_field(t: Tables):
    """The first known text field of JSON payloads of three shapes."""
    e = F.col("event_id")
    value = F.concat(F.lit("v"), (e % 9).cast("string"))
    body = (
        F.when(e % 3 == 0, F.to_json(F.struct(value.alias("output"), F.lit("late").alias("result"))))
        .when(e % 3 == 1, F.to_json(F.struct(F.lit(1).alias("code"), value.alias("text"))))
        .otherwise(F.lit('{"other": 1}'))
    )
    return t.events.select("event_id", rewrite.projected_text(body).alias("text"))


@query(
    "edit_similarity",
    r"""
SELECT conv_id, turn, round(1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b)), 8) AS similarity,
  1.0::DOUBLE - levenshtein(a, b) / greatest(length(a), length(b)) <= 0.75 AS changed_enough
FROM (SELECT conv_id, turn, a, regexp_replace(a, '(en|th|ou|la)', CASE WHEN turn % 2 = 0 THEN 'xx' ELSE '' END, 'g') AS b
  FROM (SELECT conv_id, turn, regexp_replace(text, '[^\x00-\x7F]', '-', 'g') AS a FROM conversations))""",
)
def edit_similarity(t: Tables):
    """Native similarity of each turn to a changed copy, against the acceptance bound."""
    plain = spread(t.conversations).select("conv_id", "turn", F.regexp_replace("text", r"[^\x00-\x7F]", "-").alias("a"))
    pairs = plain.withColumn(
        "b",
        F.regexp_replace("a", F.lit("(en|th|ou|la)"), F.when(F.col("turn") % 2 == 0, "xx").otherwise("")),
    )
    scored = pairs.select("conv_id", "turn", wording.edit_similarity(F.col("a"), F.col("b")).alias("similarity"))
    return scored.select(
        "conv_id", "turn", F.round("similarity", 8).alias("similarity"),
        (F.col("similarity") <= fixed.MAX_SIMILARITY).alias("changed_enough"),
    )
