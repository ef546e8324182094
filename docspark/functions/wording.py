"""Column expressions of the rewriting jobs: contractions, citations, casing, numbers, guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import draw, draw_int, let, strip
from docspark.functions.stylometry import sentences_of

WORD = r"[\p{L}']+"
PIECE = r"[\p{L}']+[^\p{L}']*|[^\p{L}']+"
WORD_HEAD = r"^([\p{L}']*)"
APOSTROPHE_WORD = r"(?<![\p{L}'])\p{L}*+'[\p{L}']*+"


def _capital_like(source: Column, lowered: Column) -> Column:
    capital = F.concat(F.upper(F.substring(lowered, 1, 1)), F.substring(lowered, F.lit(2), F.length(lowered)))
    return F.when(source.rlike(r"^\p{Lu}"), capital).otherwise(lowered)


def _expand_token(token: Column) -> Column:
    entries = [F.lit(x) for pair in fixed.CONTRACTIONS.items() for x in pair]

    def expanded(low: Column) -> Column:
        whole = F.try_element_at(F.create_map(*entries), low)
        by_suffix = F.coalesce(
            whole,
            *[
                F.when(
                    F.endswith(low, F.lit(suffix)),
                    F.concat(F.substring(low, F.lit(1), F.length(low) - len(suffix)), F.lit(expansion)),
                )
                for suffix, expansion in fixed.CONTRACTION_SUFFIXES.items()
            ],
        )
        return let(by_suffix, lambda found: F.when(found.isNull(), token).otherwise(_capital_like(token, found)))

    return let(F.lower(token), expanded)


def expand_contractions(text: Column) -> Column:
    """Whole-word contractions first, suffix rules for the rest; first-letter case is kept.

    Only lines with an apostrophe are looked at, and those are cut at words with an apostrophe only.
    """
    def expanded(line: Column) -> Column:
        return let(
            F.regexp_extract_all(line, F.lit(APOSTROPHE_WORD), F.lit(0)),
            lambda words: F.array_join(
                F.transform(F.split(line, APOSTROPHE_WORD), lambda p, i: F.when(
                    i < F.size(words), F.concat(p, _expand_token(F.get(words, i)))).otherwise(p)), ""),
        )

    def by_line(t: Column) -> Column:
        lines = F.transform(F.split(t, "\n"), lambda line: F.when(F.contains(line, F.lit("'")), expanded(line)).otherwise(line))
        return F.when(F.contains(t, F.lit("'")), F.array_join(lines, "\n")).otherwise(t)

    return let(text, by_line)


def extract_citations(text: Column) -> Column:
    """struct(text, refs): citations replaced by numbered placeholders, and the citations."""
    pattern = fixed.CITATION_PATTERN

    def numbered(t: Column) -> Column:
        refs = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
        parts = F.split(t, pattern)
        return let(
            refs,
            lambda r: F.struct(
                F.array_join(
                    F.transform(
                        parts,
                        lambda p, i: F.when(
                            i < F.size(r), F.concat(p, F.lit("[[REF_"), (i + 1).cast("string"), F.lit("]]"))
                        ).otherwise(p),
                    ),
                    "",
                ).alias("text"),
                r.alias("refs"),
            ),
        )

    return let(text, numbered)


def restore_citations(text: Column, refs: Column) -> Column:
    """Placeholders back to their citations by number; an unknown number stays as it is."""
    pattern = fixed.PLACEHOLDER_PATTERN

    def restored(s: Column) -> Column:
        marks = F.regexp_extract_all(s["t"], F.lit(pattern), F.lit(0))
        numbers = F.regexp_extract_all(s["t"], F.lit(pattern), F.lit(1))
        found = F.zip_with(
            marks, numbers, lambda m, n: F.coalesce(F.get(s["r"], n.try_cast("int") - 1), m)
        )
        parts = F.split(s["t"], pattern)
        return let(
            found,
            lambda f: F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(f, i), F.lit("")))), ""),
        )

    return let(F.struct(text.alias("t"), refs.alias("r")), restored)


def normalize_punctuation(text: Column) -> Column:
    """No blank before end marks or inside brackets, single blanks, plain double quotes."""
    out = F.regexp_replace(text, r"(?<=\()[ \t]+|[ \t]+(?=[.,;:!?)])", "")
    out = F.regexp_replace(out, r"[ \t]{2,}", " ")
    return let(out, lambda t: F.when(F.contains(t, F.lit("``")), F.regexp_replace(t, r"``\s*(.+?)\s*''", '"$1"')).otherwise(t))


def with_transitions(text: Column, p_trans: Column | float, *keys: Column | str | int) -> Column:
    """Prefix sentences with a drawn transition with probability ``p_trans``."""
    transitions = F.array(*[F.lit(t) for t in fixed.TRANSITIONS])

    def opened(sentence: Column, i: Column) -> Column:
        picked = F.get(transitions, (draw_int(*keys, "transition", i) % len(fixed.TRANSITIONS)).cast("int"))
        return F.when(
            draw(*keys, "open", i) < p_trans, F.concat(picked, F.lit(" "), sentence)
        ).otherwise(sentence)

    return F.array_join(F.transform(sentences_of(text), opened), " ")


def with_line_transitions(text: Column, p_trans: Column | float, *keys: Column | str | int) -> Column:
    """As :func:`with_transitions`, line by line, blank lines left alone."""
    lines = F.transform(
        F.split(text, "\n"),
        lambda line, j: F.when(line.rlike(r"\S"), with_transitions(line, p_trans, *keys, j)).otherwise(line),
    )
    return F.array_join(lines, "\n")


def apply_casing_like(original: Column, new: Column) -> Column:
    """ALL CAPS, mostly capitalised or lower-case sources pass their style on."""
    def cased(o: Column) -> Column:
        words = F.filter(F.split(o, r"\s+"), lambda w: F.length(w) > 0)
        needed = F.greatest(F.lit(1), F.floor(F.size(words) * F.lit(0.6)).cast("int"))
        titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}"))) >= needed
        title = F.array_join(
            F.transform(
                F.filter(F.split(new, r"\s+"), lambda w: F.length(w) > 0),
                lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w))),
            ),
            " ",
        )
        has_letter = o.rlike(r"\p{L}")
        return (
            F.when(~o.rlike(r"\S"), new)
            .when(has_letter & (F.upper(o) == o), F.upper(new))
            .when(titled, title)
            .when(has_letter & (F.lower(o) == o), F.lower(new))
            .otherwise(new)
        )

    return let(strip(original), cased)


def numbers_sequence(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(fixed.NUMBER_PATTERN), F.lit(0))


def restore_numbers(original: Column, candidate: Column) -> Column:
    """``candidate`` with the original numbers put back in order when their count changed.

    Null (rejected) when the original had numbers and the candidate lost them all.
    """
    def fixed_up(s: Column) -> Column:
        old, new = s["old"], s["new"]
        parts = F.split(s["text"], fixed.NUMBER_PATTERN)
        replaced = F.array_join(
            F.transform(
                parts,
                lambda p, i: F.when(i < F.size(new), F.concat(p, F.coalesce(F.get(old, i), F.get(new, i)))).otherwise(p),
            ),
            "",
        )
        return (
            F.when(F.size(old) == F.size(new), s["text"])
            .when(F.size(new) > 0, replaced)
            .otherwise(F.lit(None).cast("string"))
        )

    return let(
        F.struct(
            numbers_sequence(original).alias("old"), numbers_sequence(candidate).alias("new"), candidate.alias("text")
        ),
        fixed_up,
    )


def length_ratio_ok(a: Column, b: Column, max_delta: float = fixed.MAX_LENGTH_DELTA) -> Column:
    return (F.length(a) == 0) | (F.abs(F.length(b) - F.length(a)) <= max_delta * F.length(a))


def preserve_whitespace_shell(original: Column, core: Column) -> Column:
    return F.concat(F.regexp_extract(original, r"^(\s*)", 1), core, F.regexp_extract(original, r"(\s*)$", 1))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 minus the edit distance over the longer length: the all-native similarity."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.lit(1.0) - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def _allowed_edits(a: Column, b: Column, max_similarity: float) -> Column:
    """The largest edit distance at which two texts are still too similar."""
    return F.ceil(F.lit(1 - max_similarity) * F.greatest(F.length(a), F.length(b))).cast("int") - 1


def _edits_at_most(x: Column, y: Column) -> Column:
    """An upper bound of the edit distance of two sentences: their words are matched from the end, further words in front of ``y`` are inserted ones."""
    def matched(s: Column) -> Column:
        more = F.size(s["y"]) - F.size(s["x"])
        words = F.zip_with(s["x"], F.slice(s["y"], more + 1, F.size(s["x"])), lambda p, q: F.when(p == q, F.lit(0)).otherwise(F.levenshtein(p, q)))
        front = F.aggregate(F.slice(s["y"], F.lit(1), more), F.lit(0), lambda acc, w: acc + F.length(w) + 1)
        return F.when(more >= 0, F.aggregate(words, front, lambda acc, n: acc + n)).otherwise(F.levenshtein(x, y))

    split = let(F.struct(F.split(x, " ").alias("x"), F.split(y, " ").alias("y")), matched)
    return F.when(x == y, F.lit(0)).when(F.endswith(y, x), F.length(y) - F.length(x)).otherwise(split)


def surely_alike(a: Column, b: Column, max_similarity: float = fixed.MAX_SIMILARITY) -> Column:
    """Do edits inside matching sentences alone show that the texts are too similar? False says nothing.

    Both texts are cut behind end marks and line breaks. With equally many pieces the bounds of the pieces add up to an upper bound
    of the whole distance, in a time near the length of the text.
    """
    cut = lambda t: F.split(t, r"(?<=[.!?\n])")
    bounded = lambda s: (F.size(s["x"]) == F.size(s["y"])) & (
        F.aggregate(F.zip_with(s["x"], s["y"], _edits_at_most), F.lit(0), lambda acc, n: acc + n) <= _allowed_edits(a, b, max_similarity))
    return let(F.struct(cut(a).alias("x"), cut(b).alias("y")), bounded)


def changed_enough(a: Column, b: Column, max_similarity: float = fixed.MAX_SIMILARITY) -> Column:
    """Is the edit similarity at most ``max_similarity``? The distance is only followed up to that bound, and not at all where the texts are surely alike."""
    bound = F.greatest(_allowed_edits(a, b, max_similarity), F.lit(0))
    far = F.when(surely_alike(a, b, max_similarity), F.lit(False)).otherwise(F.call_function("levenshtein", a, b, bound) < 0)
    return F.when(F.greatest(F.length(a), F.length(b)) > 0, far).otherwise(F.lit(False))
