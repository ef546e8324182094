"""Redaction of identity values, its verification and its metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, patterns
from docspark.functions.containment import missing
from docspark.functions.expr import count_ignoring_case, count_lowered, first_match, let, replace_ignoring_case, strip
from docspark.operators import identity

NAME_LINE = r"(?im)^(\s*NAME\s*:[ \t]*).*$"
ROLL_LINE = r"(?im)^(\s*ROLL\s*NUMBER\s*:[ \t]*).*$"


def roll_formats(roll: Column) -> list[Column]:
    """The plain number and its three written forms: dash after 8, blocks of 4, dash after 5."""
    blocks = F.array_join(F.regexp_extract_all(roll, F.lit(".{1,4}"), F.lit(0)), " ")
    return [
        roll,
        F.concat(F.substring(roll, 1, 8), F.lit("-"), F.substring(roll, F.lit(9), F.length(roll))),
        blocks,
        F.concat(F.substring(roll, 1, 5), F.lit("-"), F.substring(roll, F.lit(6), F.length(roll))),
    ]


def _replace_if(text: Column, value: Column, new_text: Column) -> Column:
    return F.when(value.isNull(), text).otherwise(new_text)


def redact_values(text: Column, name: Column, roll: Column) -> Column:
    """``text`` without any occurrence of the two values, in any case and written form.

    Roll numbers are digits, so plain replacement does; only the name needs a pattern.
    """
    redacted = _replace_if(text, name, replace_ignoring_case(text, name, fixed.REDACTED))
    for written in roll_formats(roll):
        redacted = _replace_if(redacted, roll, F.replace(redacted, written, F.lit(fixed.REDACTED)))
    return redacted


def redact_everywhere(df: DataFrame, remove_name: bool = True, remove_roll: bool = True, literal: bool = False,
                      text_col: str = "text") -> DataFrame:
    """Detect name and roll number of each document and remove both wherever they occur."""
    nothing = F.lit(None).cast("string")
    name = identity.extract_name(F.col(text_col), literal=literal)[0] if remove_name else nothing
    roll = identity.extract_roll(F.col(text_col))[0] if remove_roll else nothing
    found = df.withColumn("detected_name", name).withColumn("detected_roll_no", roll)
    named = found.withColumn(
        "_named",
        _replace_if(
            F.col(text_col),
            F.col("detected_name"),
            replace_ignoring_case(F.col(text_col), F.col("detected_name"), fixed.REDACTED),
        ),
    )
    redacted = let(
        F.struct(F.col("_named").alias("t"), F.col("detected_roll_no").alias("r")),
        lambda s: redact_values(s["t"], nothing, s["r"]),
    )
    return named.withColumn("redacted_text", redacted).withColumn(
        "redaction_count",
        F.col("detected_name").isNotNull().cast("int") + F.col("detected_roll_no").isNotNull().cast("int"),
    ).drop("_named")


def redact_with(docs: DataFrame, identities: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Redact texts with identity values kept in another table (one row per document)."""
    joined = docs.join(identities.select(key, "name", "roll_no"), key, "left")
    return joined.withColumn("redacted_text", redact_values(F.col(text_col), F.col("name"), F.col("roll_no")))


def redact_field(df: DataFrame, preserve_label: bool = False, literal: bool = False,
                 text_col: str = "text") -> DataFrame:
    """Redact only the labelled fields; the label may be kept in front of the placeholder."""
    strict_name, flexible_name = identity.name_patterns(literal)
    out = df
    current = F.col(text_col)
    for field in ((strict_name, flexible_name), (patterns.ROLL_STRICT, patterns.ROLL_FLEXIBLE)):
        whole = F.coalesce(*[first_match(current, p, 0) for p in field])
        value = F.coalesce(*[first_match(current, p, 1) for p in field])
        out = out.withColumn("_whole", whole).withColumn("_value", value)
        if preserve_label:
            label = F.substring(F.col("_whole"), F.lit(1), F.length("_whole") - F.length("_value"))
            replacement = F.concat(label, F.lit(fixed.REDACTED))
        else:
            replacement = F.lit(fixed.REDACTED)
        out = out.withColumn(
            "redacted_text", _replace_if(current, F.col("_whole"), F.replace(current, F.col("_whole"), replacement))
        ).drop("_whole", "_value")
        current = F.col("redacted_text")
    return out


def clear_after_label(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Blank what follows ``NAME:`` or ``ROLL NUMBER:`` on lines that start with the label."""
    cleared = F.regexp_replace(F.regexp_replace(F.col(text_col), NAME_LINE, "$1"), ROLL_LINE, "$1")
    return df.withColumn("cleared_text", cleared)


def anonymize_by_pattern(df: DataFrame, name_pattern: str = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+ [A-Z][a-z]+(?![\p{L}\p{N}_])",
                         roll_pattern: str = r"(?<![\p{L}\p{N}_])\d{6,15}(?![\p{L}\p{N}_])",
                         text_col: str = "text") -> DataFrame:
    """Caller-supplied patterns; the first hit of each is removed everywhere."""
    found = df.withColumn("detected_name", first_match(F.col(text_col), name_pattern, 0)).withColumn(
        "detected_roll_no", first_match(F.col(text_col), roll_pattern, 0)
    )
    without_roll = _replace_if(
        F.col(text_col), F.col("detected_roll_no"), F.replace(F.col(text_col), F.col("detected_roll_no"), F.lit(""))
    )
    rolled = found.withColumn("_rolled", without_roll)
    return rolled.withColumn(
        "anonymized_text",
        _replace_if(
            F.col("_rolled"), F.col("detected_name"), replace_ignoring_case(F.col("_rolled"), F.col("detected_name"), "")
        ),
    ).drop("_rolled")


# --- node tables ------------------------------------------------------------------------
def clear_exact(text: Column, value: Column, blank: str = fixed.NBSP, ignore_case: bool = True) -> Column:
    """Blank a node whose trimmed text equals the value."""
    trimmed, wanted = strip(text), strip(value)
    same = F.lower(trimmed) == F.lower(wanted) if ignore_case else trimmed == wanted
    return F.when(same & (F.length(wanted) > 0), F.lit(blank)).otherwise(text)


def clear_exact_nodes(nodes: DataFrame, identities: DataFrame, blank: str = fixed.NBSP,
                      roll_ignores_case: bool = True, key: str = "doc_id") -> DataFrame:
    """Node table with nodes equal to the document's name or roll number blanked."""
    joined = nodes.join(identities.select(key, "name", "roll_no"), key, "left")
    cleared = clear_exact(F.col("text"), F.coalesce("roll_no", F.lit("")), blank, roll_ignores_case)
    out = joined.withColumn("_t", cleared)
    return out.withColumn("cleared", clear_exact(F.col("_t"), F.coalesce("name", F.lit("")), blank)).drop(
        "_t", "name", "roll_no"
    )


def clear_containing_nodes(nodes: DataFrame, identities: DataFrame, key: str = "doc_id") -> DataFrame:
    """Node table with every occurrence of the values inside a node replaced by a hard space."""
    joined = nodes.join(identities.select(key, "name", "roll_no"), key, "left")
    out = joined.withColumn("_t", _replace_if(
        F.col("text"), F.col("roll_no"), replace_ignoring_case(F.col("text"), F.col("roll_no"), fixed.NBSP)))
    return out.withColumn("cleared", _replace_if(
        F.col("_t"), F.col("name"), replace_ignoring_case(F.col("_t"), F.col("name"), fixed.NBSP)
    )).drop("_t", "name", "roll_no")


def clear_tagged_value(xml: Column, value: Column, blank: str = fixed.NBSP, raw_fallback: bool = False) -> Column:
    """Blank the value where it fills a whole ``w:t`` element of an XML string.

    ``raw_fallback`` removes it anywhere when no element matched.
    """
    pattern = F.concat(F.lit(r"(?iu)(<w:t[^>]*>)\Q"), strip(value), F.lit(r"\E(</w:t>)"))
    tagged = F.regexp_replace(xml, pattern, F.lit(f"$1{blank}$2"))
    if raw_fallback:
        tagged = let(
            tagged, lambda t: F.when(t == xml, F.replace(xml, strip(value), F.lit(""))).otherwise(t)
        )
    return F.when(F.length(strip(F.coalesce(value, F.lit("")))) > 0, tagged).otherwise(xml)


def mark_bullets(nodes: DataFrame) -> DataFrame:
    """Adds ``is_bullet`` (a paragraph's first node is a bullet glyph) and ``symbol_font``."""
    first = F.col("node_in_para") == 0
    return nodes.withColumn(
        "is_bullet", first & strip(F.col("text")).isin(fixed.BULLET_GLYPHS)
    ).withColumn("symbol_font", F.coalesce(F.col("font").isin(fixed.SYMBOL_FONTS), F.lit(False)))


# --- verification -----------------------------------------------------------------------
def redact_and_verify(df: DataFrame, nodes_col: str = "nodes") -> DataFrame:
    """Detect on nodes, blank the found values, detect again; counts and bytes as separate columns."""
    found = identity.detect_identity_nodes(df.withColumn("_nodes", F.col(nodes_col)), nodes_col)

    def blanked(nodes: str, value: str) -> Column:
        return let(
            F.coalesce(value, F.lit("")), lambda v: F.transform(nodes, lambda n: clear_exact(n, v))
        )

    cleaned = found.withColumn("_roll_out", blanked("_nodes", "roll_no")).withColumn(
        "_clean", blanked("_roll_out", "name")
    )

    def changed(before: str, after: str) -> Column:
        return F.size(F.filter(F.zip_with(before, after, lambda a, b: a != b), lambda x: x))

    def octets(nodes: str) -> Column:
        return F.octet_length(F.array_join(nodes, ""))

    kept = [c for c in df.columns if c != nodes_col]
    counted = cleaned.select(
        *kept,
        F.col("name").alias("name_before"),
        F.col("roll_no").alias("roll_before"),
        F.col("confidence").alias("confidence_before"),
        changed("_roll_out", "_clean").alias("removed_name"),
        changed("_nodes", "_roll_out").alias("removed_roll"),
        (octets("_nodes") - octets("_clean")).alias("bytes_removed"),
        F.col("_clean").alias(nodes_col),
    )
    after = identity.detect_identity_nodes(counted, nodes_col)
    return after.drop("name_evidence", "roll_evidence").withColumnsRenamed(
        {"name": "name_after", "roll_no": "roll_after", "confidence": "confidence_after"}
    )


def leak_check(df: DataFrame, text_col: str = "redacted_text") -> DataFrame:
    """Residual occurrences of the detected values and number of placeholders per document."""
    name = F.coalesce("detected_name", F.lit(""))
    roll = F.coalesce("detected_roll_no", F.lit(""))
    return df.withColumn("name_leaks", count_ignoring_case(F.col(text_col), name)).withColumn(
        "roll_leaks", count_ignoring_case(F.col(text_col), roll)
    ).withColumn("placeholders", count_ignoring_case(F.col(text_col), F.lit(fixed.REDACTED)))


def redact_batch(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Whole-table redaction with a status per document; unusable rows are errors, not failures."""
    usable = F.coalesce(F.col(text_col).rlike(r"\S"), F.lit(False))
    redacted = redact_everywhere(df.withColumn("_usable", usable))
    return redacted.withColumn("status", F.when(F.col("_usable"), "success").otherwise("error")).drop("_usable")


def term_counts(df: DataFrame, before: str, after: str, terms: list[str] | None = None,
                key: str = "doc_id") -> DataFrame:
    """Occurrences of watch terms before and after, one row per document and term.

    Both texts are lower-cased once and all terms are counted in the row, so rows of terms carry numbers and no text.
    """
    def counts(s: Column) -> Column:
        return F.array(*[
            F.struct(F.lit(t).alias("term"), count_lowered(s["b"], F.lit(t.lower())).alias("before"),
                     count_lowered(s["a"], F.lit(t.lower())).alias("after"))
            for t in (terms or fixed.WATCH_TERMS)
        ])

    lowered = F.struct(F.lower(before).alias("b"), F.lower(after).alias("a"))
    counted = df.select(key, F.explode(let(lowered, counts)).alias("c")).select(key, "c.*")
    return counted.withColumn("delta", F.col("after") - F.col("before"))


def removed_lines(df: DataFrame, before: str, after: str, key: str = "doc_id") -> DataFrame:
    """Trimmed non-blank lines of ``before`` that occur nowhere in ``after``; a null text has none."""
    lines = F.filter(F.transform(F.split(before, "\n"), strip), lambda line: F.length(line) > 0)
    judged = df.select(F.col(key).alias("key"), lines.alias("lines"), F.col(after).alias("kept"))
    judged = judged.select("key", "lines", missing(F.col("lines"), F.col("kept")).alias("lost"))
    lost = F.filter("lines", lambda line, i: F.get("lost", i))
    return judged.select(F.col("key").alias(key), F.posexplode(lost).alias("pos", "line"))


def removed_preview(lines: DataFrame, n: int | None = None, width: int | None = None, key: str = "doc_id") -> DataFrame:
    """First ``n`` removed lines of each document, each cut to ``width`` characters; without bounds, all and whole."""
    shown = lines if n is None else lines.filter(F.col("pos") < n)
    line = F.col("line") if width is None else F.substring("line", 1, width)
    return shown.select(key, "pos", line.alias("line"))


def node_difference(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct node texts present before and absent after."""
    return before.select("doc_id", "text").subtract(after.select("doc_id", "text"))
