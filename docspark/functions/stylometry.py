"""Stylometric features and score as pure column expressions.

Everything stays inside the row: windows, tokens, features and their mean never leave the
document they come from, so scoring a corpus needs no shuffle at all.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import clamp01, let, total

WORD = r"[A-Za-z']+"
SENTENCE_GAP = r"(?<=[.!?])\s+"
PUNCTUATION = r"[.,;:!?]"
FEATURES = [
    "ttr", "avg_word_len", "stop_ratio", "mean_len", "var_len", "punct_density", "upper_ratio", "rep_ratio",
]
SCORED_FEATURES = ["ttr", "var_len", "punct_density", "rep_ratio"]
LETTERS_LOWERED_TO_ASCII = ["\u0130", "\u212a"]
NO_LETTER = "\ufffd"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def lowered_words(text: Column) -> Column:
    """Lower-cased words: one call for all of them instead of one per word."""
    return F.array_remove(F.split(F.lower(F.array_join(words_of(text), " ")), " "), "")


def lowered(text: Column) -> Column:
    """Lower-cased text of the same length and with the same words: dotted I and the Kelvin sign, which would turn into
    i (with a dot) and k, are taken out before."""
    for letter in LETTERS_LOWERED_TO_ASCII:
        text = F.replace(text, F.lit(letter), F.lit(NO_LETTER))
    return F.lower(text)


def sentences_of(text: Column) -> Column:
    """Sentences by the punctuation rule, blank ones dropped."""
    return F.filter(F.split(text, SENTENCE_GAP), lambda s: s.rlike(r"\S"))


def windows_of(text: Column, window: int = fixed.WINDOW_CHARS, max_windows: int | None = None) -> Column:
    """Windows that tile the whole text; a short text is one window.

    With ``max_windows``, at most that many overlapping windows spread over the text instead.
    """
    if max_windows is None:
        return let(text, lambda t: F.when(F.length(t) <= window, F.array(t)).otherwise(
            F.regexp_extract_all(t, F.lit(f"(?s).{{1,{window}}}"), F.lit(0))))

    def spread(t: Column) -> Column:
        span = F.greatest(F.length(t) - window, F.lit(0))
        step = F.greatest(F.lit(1), F.floor(span / max(1, max_windows - 1)).cast("int"))
        starts = F.slice(F.sequence(F.lit(0), span, step), 1, max_windows)
        return F.when(F.length(t) <= window, F.array(t)).otherwise(
            F.transform(starts, lambda s: F.substring(t, s + 1, F.lit(window)))
        )

    return let(text, spread)


def ngrams_of(words: Column, n: int = 3) -> Column:
    """Space-joined word n-grams.

    Elements are fetched by index: slicing would copy the whole array for every n-gram.
    """
    def joined(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= n, F.sequence(F.lit(0), F.size(ws) - n)).otherwise(
            F.array().cast("array<int>")
        )
        return F.transform(starts, lambda i: F.concat_ws(" ", *[F.get(ws, i + k) for k in range(n)]))

    return let(words, joined)


def _trigram_hashes(words: Column) -> Column:
    """A 64-bit hash per word 3-gram: enough to tell the few of one window apart."""
    def hashed(ws: Column) -> Column:
        starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)))

    return let(words, hashed)


def _punctuation(text: Column) -> Column:
    """Number of punctuation marks."""
    return F.regexp_count(text, F.lit(PUNCTUATION))


def measure(window: Column, low: bool = False) -> Column:
    """Tokens, sentence lengths and character counts of one window.

    Capitals are counted by the length they leave behind, which builds no match lists. In a window that is
    lower-cased already (``low``) they are not counted.
    """
    fields = {
        "chars": F.length(window),
        "punctuation": _punctuation(window),
        "words": words_of(window) if low else lowered_words(window),
        "sentence_words": F.transform(sentences_of(window), lambda s: F.regexp_count(s, F.lit(WORD))),
    }
    if not low:
        fields["capitals"] = F.length(F.regexp_replace(window, r"[^\p{Lu}]+", ""))
    return F.struct(*[value.alias(k) for k, value in fields.items()])


def _repetition(words: Column, distinct: Column) -> Column:
    """Share of 3-grams that occurred before.

    All three words of such a 3-gram occurred before, so with fewer repeated words there is none to look for.
    """
    share = let(_trigram_hashes(words), lambda g: F.lit(1.0) - F.size(F.array_distinct(g)) / F.size(g))
    return F.when(F.size(words) - distinct >= 3, share).otherwise(F.lit(0.0))


def features_of(measured: Column, names: Sequence[str] = FEATURES) -> Column:
    """The named features (all eight by default) of one measured window."""
    words = measured["words"]
    n_words = F.greatest(F.size(words), F.lit(1))
    n_chars = F.greatest(measured["chars"], F.lit(1))
    lengths = F.when(F.size(measured["sentence_words"]) > 0, measured["sentence_words"]).otherwise(F.array(n_words))
    mean_len = total(lengths) / F.size(lengths)
    variance = let(
        mean_len,
        lambda m: F.aggregate(lengths, F.lit(0.0), lambda acc, x: acc + (x - m) * (x - m)) / F.size(lengths),
    )

    def built(distinct: Column) -> Column:
        features = {
            "ttr": distinct / n_words,
            "avg_word_len": F.length(F.array_join(words, "")) / n_words,
            "stop_ratio": F.size(F.filter(words, lambda w: w.isin(fixed.STOPWORDS))) / n_words,
            "mean_len": mean_len,
            "var_len": variance,
            "punct_density": measured["punctuation"] / n_chars,
            "upper_ratio": measured["capitals"] / n_chars,
            "rep_ratio": _repetition(words, distinct),
        }
        return F.struct(*[features[k].alias(k) for k in names])

    return let(F.size(F.array_distinct(words)), built)


def mean_features(features: Column, names: Sequence[str] = FEATURES) -> Column:
    """Mean of each feature over an array of feature structs; null fields for an empty array."""
    return F.struct(
        *[
            F.when(F.size(features) > 0, total(_field(features, k)) / F.size(features)).alias(k) for k in names
        ]
    )


def _field(structs: Column, name: str) -> Column:
    return F.transform(structs, lambda s: s[name])


def score_features(avg: Column) -> Column:
    """Score in [0.15, 0.85]: higher means more regular, repetitive, machine-like text.

    A document without windows (null features) gets the neutral 0.5.
    """

    def shortfall(value: Column, limit: float) -> Column:
        """How far below the limit, as a share of it; nothing above it."""
        return F.greatest(F.lit(0.0), F.lit(limit) - value) / F.lit(limit)

    def saturating(value: Column, scale: float) -> Column:
        return F.least(F.lit(1.0), value * F.lit(scale))

    traits = [
        (fixed.TTR_WEIGHT, shortfall(avg["ttr"], fixed.TTR_LIMIT)),
        (fixed.VARIANCE_WEIGHT, shortfall(F.least(F.lit(fixed.VARIANCE_CAP), avg["var_len"]), fixed.VARIANCE_LIMIT)),
        (fixed.REPETITION_WEIGHT, saturating(avg["rep_ratio"], fixed.REPETITION_SCALE)),
        (fixed.PUNCTUATION_WEIGHT, saturating(avg["punct_density"], fixed.PUNCTUATION_SCALE)),
        (fixed.LOW_TTR_WEIGHT, shortfall(avg["ttr"], fixed.LOW_TTR_LIMIT)),
    ]
    raw = functools.reduce(lambda acc, x: acc + x, [F.lit(weight) * trait for weight, trait in traits])
    calibrated = clamp01(F.lit(fixed.SCORE_BASE) + F.lit(fixed.SCORE_SPAN) * clamp01(raw))
    return F.when(avg["ttr"].isNull(), F.lit(fixed.NEUTRAL_SCORE)).otherwise(calibrated)


def fast_features(text: Column) -> Column:
    """Window-averaged features of a text."""
    measured = F.transform(windows_of(text), lambda w: measure(w))
    return let(F.transform(measured, lambda m: features_of(m)), lambda f: mean_features(f))


def fast_score(text: Column) -> Column:
    """Stylometric score of a text of any length, as one expression usable inside lambdas."""
    return _lowered_score(lowered(text))


def _lowered_score(low: Column) -> Column:
    """Score of a lower-cased text, from the features that it depends on only."""
    measured = F.transform(windows_of(low), lambda w: measure(w, low=True))
    features = F.transform(measured, lambda m: features_of(m, SCORED_FEATURES))
    return let(let(features, lambda f: mean_features(f, SCORED_FEATURES)), score_features)


def sentence_verdict(sentence: Column, verdict: Callable[[Column], Column]) -> Column:
    """``verdict`` on the score of one lower-cased sentence, which is worked out only where the verdict hangs on it.

    A piece of one sentence has no gap after an end mark, so its sentence lengths never vary. If its words vary (``ttr`` at
    the limit or above), only repetition and punctuation move the score, between the two scores where both are 0 and 1.
    A verdict that is equal at both must be so for every score between them.
    """
    def varied(share: float) -> Column:
        values = {"ttr": fixed.TTR_LIMIT, "var_len": 0.0, "punct_density": share, "rep_ratio": share}
        return score_features(F.struct(*[F.lit(values[k]).alias(k) for k in SCORED_FEATURES]))

    def scored(words: Column, distinct: Column, ttr: Column) -> Column:
        values = {
            "ttr": ttr,
            "var_len": F.lit(0.0),
            "punct_density": _punctuation(sentence) / F.greatest(F.length(sentence), F.lit(1)),
            "rep_ratio": _repetition(words, distinct),
        }
        return let(F.struct(*[values[k].alias(k) for k in SCORED_FEATURES]), score_features)

    def judged(words: Column, distinct: Column) -> Column:
        ttr = distinct / F.greatest(F.size(words), F.lit(1))
        settled = (ttr >= fixed.TTR_LIMIT) & (verdict(varied(0.0)) == verdict(varied(1.0)))
        return F.when(settled, verdict(varied(0.0))).otherwise(let(scored(words, distinct, ttr), verdict))

    one_window = let(words_of(sentence), lambda w: let(F.size(F.array_distinct(w)), lambda d: judged(w, d)))
    return F.when(F.length(sentence) > fixed.WINDOW_CHARS, let(_lowered_score(sentence), verdict)).otherwise(one_window)
