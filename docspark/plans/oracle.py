"""DuckDB SQL building blocks shared by the oracles."""

from __future__ import annotations

from docspark.functions import fixed


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def literals(values) -> str:
    return ", ".join(literal(v) for v in values)


STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def strip(expr: str) -> str:
    return STRIP.format(expr)


def sentences(expr: str) -> str:
    """Sentence list: mark each gap after an end mark, then split on the mark."""
    return (
        f"list_filter(string_split(regexp_replace({expr}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), "
        "lambda s: regexp_matches(s, '\\S'))"
    )


WORD = "[A-Za-z'']+"


def windows(expr: str) -> str:
    """Windows that tile a text."""
    return (
        f"CASE WHEN length({expr}) <= 800 THEN [{expr}] ELSE list_transform(range(0, length({expr}), 800), "
        f"lambda i: substr({expr}, i + 1, 800)) END"
    )


def spread_windows(expr: str) -> str:
    """Six windows spread over a text."""
    n = f"length({expr})"
    return (
        f"CASE WHEN {n} <= 800 THEN [{expr}] ELSE list_transform("
        f"list_slice(range(0, {n} - 800 + 1, greatest(1, ({n} - 800) // 5)), 1, 6), "
        f"lambda i: substr({expr}, i + 1, 800)) END"
    )


def feature_ctes(source: str, keys: str, text: str, prefix: str = "") -> str:
    """CTEs ``{prefix}win`` (one row per window) and ``{prefix}feat`` (its features).

    ``source`` is a FROM item, ``keys`` a column list identifying one text.
    """
    p = prefix
    stop = literals(fixed.STOPWORDS)
    return f"""
{p}win AS (
  SELECT {keys}, unnest(ws) AS w, generate_subscripts(ws, 1) AS wi FROM (SELECT {keys}, {windows(text)} AS ws FROM {source})),
{p}meas AS (
  SELECT {keys}, w, wi,
    list_transform(regexp_extract_all(w, '{WORD}'), lambda x: lower(x)) AS words,
    list_transform({sentences('w')}, lambda x: len(regexp_extract_all(x, '{WORD}'))) AS sl
  FROM {p}win),
{p}meas2 AS (
  SELECT {keys}, w, wi, words, greatest(len(words), 1) AS n, greatest(length(w), 1) AS nc,
    CASE WHEN len(sl) > 0 THEN sl ELSE [greatest(len(words), 1)] END AS sl,
    CASE WHEN len(words) >= 3 THEN list_transform(range(1, len(words) - 1),
      lambda i: words[i] || ' ' || words[i+1] || ' ' || words[i+2]) ELSE [] END AS g
  FROM {p}meas),
{p}feat AS (
  SELECT {keys}, w, wi,
    len(list_distinct(words)) / n AS ttr,
    coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) / n AS avg_word_len,
    len(list_filter(words, lambda x: list_contains([{stop}], x))) / n AS stop_ratio,
    list_sum(sl) / len(sl) AS mean_len,
    list_sum(list_transform(sl, lambda x: (x - list_sum(sl) / len(sl)) * (x - list_sum(sl) / len(sl)))) / len(sl)
      AS var_len,
    len(regexp_extract_all(w, '[.,;:!?]')) / nc AS punct_density,
    len(regexp_extract_all(w, '\\p{{Lu}}')) / nc AS upper_ratio,
    CASE WHEN len(g) > 0 THEN 1.0::DOUBLE - len(list_distinct(g)) / len(g) ELSE 0.0::DOUBLE END AS rep_ratio
  FROM {p}meas2)"""


FEATURES = [
    "ttr", "avg_word_len", "stop_ratio", "mean_len", "var_len", "punct_density", "upper_ratio", "rep_ratio",
]
AVG_FEATURES = ", ".join(f"list_sum(list({f} ORDER BY wi)) / count(*) AS {f}" for f in FEATURES)

SCORE = """greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.15::DOUBLE + 0.7::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE,
  0.35::DOUBLE * greatest(0.0::DOUBLE, 0.45::DOUBLE - ttr) / 0.45::DOUBLE
  + 0.25::DOUBLE * greatest(0.0::DOUBLE, 0.8::DOUBLE - least(1.5::DOUBLE, var_len)) / 0.8::DOUBLE
  + 0.15::DOUBLE * least(1.0::DOUBLE, rep_ratio * 3.0::DOUBLE)
  + 0.10::DOUBLE * least(1.0::DOUBLE, punct_density * 50.0::DOUBLE)
  + 0.10::DOUBLE * greatest(0.0::DOUBLE, 0.22::DOUBLE - least(0.22::DOUBLE, ttr)) / 0.22::DOUBLE))))"""


def score_ctes(source: str, keys: str, text: str, prefix: str = "", extra: str = "") -> str:
    """Feature CTEs plus ``{prefix}score``: one averaged score ``s`` per text."""
    return (
        feature_ctes(source, keys, text, prefix)
        + f""",
{prefix}avgf AS (SELECT {keys}, {AVG_FEATURES} FROM {prefix}feat GROUP BY {keys}),
{prefix}score AS (SELECT {keys}, {SCORE} AS s FROM {prefix}avgf)"""
    )


def rounded(expr: str, digits: int) -> str:
    """Twelve digits first, then half up, as exact decimals."""
    return f"CAST(round(CAST({expr} AS DECIMAL(38, 12)), {digits}) AS DOUBLE)"


def percent(expr: str) -> str:
    return f"CAST(floor(round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {expr})), 9) * 100 + 0.5::DOUBLE) AS INTEGER)"


def draw(*parts: str) -> str:
    return f"{draw_int(*parts)} / 4294967296.0::DOUBLE"


def draw_int(*parts: str) -> str:
    joined = ", ".join(parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {joined})), 1, 8)) AS BIGINT)"
