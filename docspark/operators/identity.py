"""Detection of a person's name and ID number in document text and text nodes.

Text is scanned with native regular expressions inside the document's row; node-table
variants are keyed by (doc_id, node_idx).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import patterns
from docspark.functions.expr import collapse_spaces, first_match, let, strip

# --- labelled fields in running text ----------------------------------------------------
MIN_ROLL_DIGITS = 8


def _clean_name(value: Column) -> Column:
    """Collapsed blanks, cut at the first character that is neither letter nor blank."""
    cleaned = strip(F.regexp_replace(collapse_spaces(strip(value)), r"[^A-Za-z\s].*$", ""))
    return F.nullif(cleaned, F.lit(""))


def _clean_roll(value: Column) -> Column:
    digits = F.regexp_replace(value, r"[\s\-]", "")
    return F.when(F.length(digits) >= MIN_ROLL_DIGITS, digits)


def _cascade(strict: Column, flexible: Column, use_strict: bool) -> tuple[Column, Column]:
    if not use_strict:
        return flexible, F.when(flexible.isNotNull(), "medium").otherwise("none")
    level = F.when(strict.isNotNull(), "high").when(flexible.isNotNull(), "medium").otherwise("none")
    return F.coalesce(strict, flexible), level


def name_patterns(literal: bool = False) -> tuple[str, str]:
    """(strict, flexible) name patterns; ``literal`` drops the word boundaries."""
    if literal:
        return patterns.NAME_STRICT_LITERAL, patterns.NAME_FLEXIBLE_LITERAL
    return patterns.NAME_STRICT, patterns.NAME_FLEXIBLE


def extract_name(text: Column, strict: bool = True, literal: bool = False) -> tuple[Column, Column]:
    """(name, level) columns; level is high, medium or none."""
    labelled = F.contains(F.lower(text), F.lit("name"))  # in all patterns; finding it costs less than a failing pattern

    def found(pattern: str) -> Column:
        return F.when(labelled, _clean_name(first_match(text, pattern)))

    strict_pattern, flexible_pattern = name_patterns(literal)
    return _cascade(found(strict_pattern), found(flexible_pattern), strict)


def extract_roll(text: Column, strict: bool = True) -> tuple[Column, Column]:
    """(roll number, level) columns; the number keeps its digits only."""
    return _cascade(
        _clean_roll(first_match(text, patterns.ROLL_STRICT)),
        _clean_roll(first_match(text, patterns.ROLL_FLEXIBLE)),
        strict,
    )


def extract_identity(df: DataFrame, strict: bool = True, literal: bool = False, text_col: str = "text") -> DataFrame:
    """Adds detected name, roll number, overall confidence and an excerpt around the first hit."""
    name, name_level = extract_name(F.col(text_col), strict, literal)
    roll, roll_level = extract_roll(F.col(text_col), strict)
    found = df.withColumn("detected_name", name).withColumn("_nl", name_level)
    found = found.withColumn("detected_roll_no", roll).withColumn("_rl", roll_level)
    high = (F.col("_nl") == "high").cast("int") + (F.col("_rl") == "high").cast("int")
    at = F.instr(F.col(text_col), F.coalesce("detected_name", "detected_roll_no"))
    start = F.greatest(F.lit(0), at - 51)
    excerpt = strip(F.substring(F.col(text_col), start + 1, at + 99 - start))
    return found.select(
        *df.columns,
        "detected_name",
        "detected_roll_no",
        F.when(high == 2, "high").when(high == 1, "medium").otherwise("low").alias("extraction_confidence"),
        F.when(F.coalesce("detected_name", "detected_roll_no").isNotNull(), excerpt).alias("excerpt"),
    )


# --- label walk over text nodes ---------------------------------------------------------
LOOKAHEAD = 3
NEIGHBOURHOOD = 200


def _labelled(nodes: Column, limit: int | None, label: str, own_ok, next_ok, min_chars: int = 1) -> Column:
    """Value of the first label node that has one: its own remainder or an acceptable next node.

    ``nodes`` must be a bound array; nodes are read by index.
    """
    last = F.size(nodes) if limit is None else F.least(F.size(nodes), F.lit(limit))
    indexes = F.when(last > 0, F.sequence(F.lit(0), last - 1)).otherwise(F.array().cast("array<int>"))

    def value_at(i: Column) -> Column:
        def own(node: Column) -> Column:
            remainder = strip(F.regexp_extract(node, label, 2))
            following = F.coalesce(
                *[
                    let(strip(F.get(nodes, i + k)), lambda n: F.when(next_ok(n), n))
                    for k in range(1, LOOKAHEAD + 1)
                ]
            )
            return F.when(
                (F.length(node) >= min_chars) & node.rlike(label),
                let(remainder, lambda r: F.when(own_ok(r), r).otherwise(following)),
            )

        return let(strip(F.get(nodes, i)), own)

    return F.get(F.filter(F.transform(indexes, value_at), lambda v: v.isNotNull()), F.lit(0))


def detect_identity_nodes(df: DataFrame, nodes_col: str = "nodes", label_nodes: int | None = None,
                          text_nodes: int | None = None) -> DataFrame:
    """Label walk over the nodes of a document, then patterns over its text, then a weak guess.

    Whole documents are read; ``label_nodes`` and ``text_nodes`` limit the walk and the patterns to the first nodes.

    ``nodes_col`` is the ordered array of the document's text nodes. ``evidence`` columns say
    which phase found each value.
    """
    kept = [c for c in df.columns if c != nodes_col]
    p = patterns.SHORT_WALK
    long_enough = lambda v: F.length(v) > 2
    named = lambda v: (F.length(v) > 2) & ~v.rlike(r"^\d+$")
    numbered = lambda v: v.rlike(patterns.ROLL_VALUE)
    head = strip(F.array_join(nodes_col if text_nodes is None else F.slice(nodes_col, 1, text_nodes), " "))
    walked = df.select(
        *kept,
        let(F.col(nodes_col), lambda n: _labelled(n, label_nodes, p["name_label"], long_enough, named, 2)).alias("nl"),
        let(F.col(nodes_col), lambda n: _labelled(n, label_nodes, p["roll_label"], numbered, numbered, 2)).alias("rl"),
        head.alias("head"),
    )
    found = walked.select(
        *kept,
        "nl",
        "rl",
        strip(first_match(F.col("head"), p["name_text"])).alias("nt"),
        first_match(F.col("head"), p["roll_text"]).alias("rt"),
        first_match(F.col("head"), p["name_weak"]).alias("nw"),
        first_match(F.col("head"), patterns.ROLL_WEAK).alias("rw"),
    )
    name, roll = F.coalesce("nl", "nt", "nw"), F.coalesce("rl", "rt", "rw")
    return found.select(
        *kept,
        name.alias("name"),
        roll.alias("roll_no"),
        F.when(name.isNotNull() & roll.isNotNull(), "HIGH")
        .when(name.isNull() & roll.isNull(), "CLEAN")
        .when(F.coalesce("nl", "nt").isNotNull(), "HIGH")
        .otherwise("LOW")
        .alias("confidence"),
        _evidence({"label": "nl", "regex": "nt", "weak": "nw"}).alias("name_evidence"),
        _evidence({"label": "rl", "regex": "rt", "weak": "rw"}).alias("roll_evidence"),
    )


def _evidence(phases: dict[str, str]) -> Column:
    return F.coalesce(*[F.when(F.col(column).isNotNull(), F.lit(phase)) for phase, column in phases.items()])


def detect_identity_proximity(df: DataFrame, nodes_col: str = "nodes") -> DataFrame:
    """Label walk over the whole document, then patterns, then the name nearest the roll number."""
    kept = [c for c in df.columns if c != nodes_col]
    p = patterns.FULL_WALK
    given = lambda v: F.length(v) > 0
    text = F.array_join(F.filter(nodes_col, lambda n: F.length(n) > 0), " ")
    walked = df.select(
        *kept,
        let(F.col(nodes_col), lambda n: _labelled(n, None, p["name_label"], given, given)).alias("nl"),
        let(F.col(nodes_col), lambda n: _labelled(n, None, p["roll_label"], given, given)).alias("rl"),
        text.alias("_text"),
    )
    labelled = walked.select(
        *kept,
        "_text",
        "nl",
        "rl",
        strip(first_match(F.col("_text"), p["name_text"])).alias("nt"),
        first_match(F.col("_text"), p["roll_text"]).alias("rt"),
    )
    sure_roll = F.coalesce("rl", "rt")
    at = F.instr(F.col("_text"), sure_roll)
    begin = F.greatest(F.lit(0), at - 1 - NEIGHBOURHOOD)
    before = F.substring(F.col("_text"), begin + 1, at - 1 - begin)
    around = F.substring(F.col("_text"), begin + 1, at - 1 - begin + NEIGHBOURHOOD)
    names_before = F.regexp_extract_all(before, F.lit(p["name_weak"]), F.lit(1))
    names_around = F.regexp_extract_all(around, F.lit(p["name_weak"]), F.lit(1))
    near = F.when(
        F.coalesce("nl", "nt").isNull() & sure_roll.isNotNull() & (at > 0) & (F.size(names_around) > 0),
        F.when(F.size(names_before) > 0, F.try_element_at(names_before, F.lit(-1))).otherwise(
            F.get(names_around, F.lit(0))
        ),
    )
    close = labelled.withColumn("np", near)
    nothing = F.coalesce("nl", "nt", "np", "rl", "rt").isNull()
    weak = close.withColumn("nw", F.when(nothing, first_match(F.col("_text"), p["name_weak"]))).withColumn(
        "rw", F.when(nothing, first_match(F.col("_text"), patterns.ROLL_WEAK))
    )
    return weak.select(
        *kept,
        F.coalesce("nl", "nt", "np", "nw").alias("name"),
        F.coalesce("rl", "rt", "rw").alias("roll_no"),
        F.when(F.col("np").isNotNull(), "MEDIUM")
        .when(F.coalesce("nl", "nt", "rl", "rt").isNotNull(), "HIGH")
        .otherwise("LOW")
        .alias("confidence"),
        _evidence({"label": "nl", "regex": "nt", "proximity": "np", "weak": "nw"}).alias("name_evidence"),
        _evidence({"label": "rl", "regex": "rt", "weak": "rw"}).alias("roll_evidence"),
    )


def removal_policy(df: DataFrame) -> DataFrame:
    """Adds what may be removed: a roll number always, a name only when the detection is sure enough."""
    return df.withColumn("remove_roll_no", F.col("roll_no").isNotNull()).withColumn(
        "remove_name", F.col("name").isNotNull() & F.col("confidence").isin("HIGH", "MEDIUM")
    )


# --- node tables ------------------------------------------------------------------------
BLOCK = 1024


def label_then_value(nodes: DataFrame, label: str = patterns.SHORT_WALK["name_label"], key: str = "doc_id") -> DataFrame:
    """(doc, node_idx, value) for each label node: its own remainder, else an acceptable next node.

    Nodes are windowed in blocks of BLOCK with the first few nodes of the next block copied
    over, so a document of any length never has to fit into one window group.
    """
    text = strip(F.col("text"))
    block = F.floor(F.col("node_idx") / BLOCK).cast("bigint")
    halo = (F.col("node_idx") % BLOCK < LOOKAHEAD) & (F.col("node_idx") >= BLOCK)
    blocks = F.when(halo, F.array(block - 1, block)).otherwise(F.array(block))
    placed = nodes.select(key, "node_idx", text.alias("text"), F.explode(blocks).alias("_block"))
    w = W.partitionBy(key, "_block").orderBy("node_idx")

    def near(k: int) -> Column:
        value = F.lead("text", k).over(w)
        adjacent = F.lead("node_idx", k).over(w) == F.col("node_idx") + k
        return F.when(adjacent & (F.length(value) > 2) & ~value.rlike(r"^\d+$"), value)

    looked = placed.select(
        key,
        "node_idx",
        "text",
        "_block",
        F.coalesce(*[near(k) for k in range(1, LOOKAHEAD + 1)]).alias("following"),
    )
    owned = looked.filter(F.col("text").rlike(label) & (F.floor(F.col("node_idx") / BLOCK) == F.col("_block")))
    remainder = strip(F.regexp_extract("text", label, 2))
    value = F.when(F.length(remainder) > 2, remainder).otherwise(F.col("following"))
    return owned.select(key, "node_idx", value.alias("value")).filter("value is not null")


def first_per_document(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The earliest hit of each document."""
    return hits.groupBy(key).agg(
        F.min_by("value", "node_idx").alias("value"), F.min("node_idx").alias("node_idx")
    )


def first_nodes(nodes: DataFrame, n: int | None = None) -> DataFrame:
    """The first ``n`` text nodes of each document; all of them without a number."""
    return nodes if n is None else nodes.filter(F.col("node_idx") < n)


def nodes_to_documents(nodes: DataFrame, key: str = "doc_id") -> DataFrame:
    """Ordered node array per document; a document is one file, so its node list is bounded by it."""
    ordered = F.sort_array(F.collect_list(F.struct("node_idx", F.coalesce("text", F.lit("")).alias("text"))))
    return nodes.groupBy(key).agg(F.transform(ordered, lambda n: n["text"]).alias("nodes"))
