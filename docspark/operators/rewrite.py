"""Seeded text augmentation with quality guards.

Every random choice is a hash of (seed, document, position), so a rerun or a lost task
gives the same text. Only the distinct words of a row leave it for the lexicon lookup.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, patterns, wording
from docspark.functions.expr import draw, draw_int, let, strip
from docspark.functions.stylometry import sentences_of
from docspark.operators.segment import tokenize_counts
from docspark.operators.skew import balanced_join
from docspark.session import cut_lineage

#: Only longer words are looked up.
MIN_WORD = 3


# --- predicates on paragraphs and nodes -------------------------------------------------
def normalized(text: Column) -> Column:
    return F.lower(strip(F.regexp_replace(text, r"\s+", " ")))


def is_question(text: Column) -> Column:
    return normalized(text).rlike(patterns.QUESTION)


def is_answer(text: Column) -> Column:
    return normalized(text).rlike(patterns.ANSWER)


def is_section_heading(text: Column) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.contains(normalized(text), F.lit(w)) for w in patterns.HEADING_WORDS])


def rewrite_eligible(node_text: Column, para_text: Column, style: Column, is_list: Column, in_table: Column,
                     min_para: int = fixed.MIN_REWRITE_PARAGRAPH, min_node: int = fixed.MIN_REWRITE_NODE) -> Column:
    """May a text node be rewritten? Headings, questions, tables and very short text may not."""
    heading = F.coalesce(style.rlike("(?i)heading"), F.lit(False))
    long_enough = is_list | (F.length(strip(para_text)) >= min_para)
    worth_it = (F.length(strip(node_text)) >= min_node) & node_text.rlike(r"[\p{L}\p{N}_]{2,}")
    return ~heading & ~is_question(para_text) & long_enough & worth_it & ~in_table


def section_gate(paras: DataFrame, key: str = "doc_id", order: str = "para_idx") -> DataFrame:
    """Paragraphs strictly after the first section heading of their document; later headings dropped.

    The first heading is a small per-document minimum folded map-side; the paragraphs are
    joined to it with long documents spread over several partitions.
    """
    marked = paras.withColumn("_heading", is_section_heading(F.col("text")))
    starts = cut_lineage(
        marked.groupBy(key).agg(
            F.min(F.when(F.col("_heading"), F.col(order))).alias("_start"), F.count("*").alias("n")
        )
    )
    gated = balanced_join(
        marked, starts.select(key, "_start"), [key], starts.select(key, "n"), [order], how="inner"
    )
    return gated.filter((F.col(order) > F.col("_start")) & ~F.col("_heading")).drop("_start", "_heading")


# --- synonyms ---------------------------------------------------------------------------
def prepare_lexicon(lexicon: DataFrame) -> DataFrame:
    """(word, pos, rank, synonym) rows to one row per word: its class and ordered single-word synonyms."""
    usable = lexicon.filter(
        ~F.col("synonym").rlike(r"[\s_]") & (F.lower("synonym") != F.lower("word"))
    )
    first_rank = usable.groupBy(F.lower("word").alias("word"), F.lower("synonym").alias("_low")).agg(
        F.min(F.struct("rank", "synonym", "pos")).alias("s")
    )
    return first_rank.groupBy("word").agg(
        F.min("s").getField("pos").alias("word_class"),
        F.transform(F.sort_array(F.collect_list("s")), lambda s: s["synonym"]).alias("synonyms"),
    )


def _row_key(key: str, text: Column) -> list[Column]:
    """What tells rows apart: the key (null kept apart from every value) and a hash of the text.

    Rows equal in both get the same drawn words, so they may share one entry.
    """
    return [F.coalesce(F.concat(F.lit("+"), F.col(key).cast("string")), F.lit("-")).alias("_k"), F.xxhash64(text).alias("_h")]


def _held(df: DataFrame, lexicon: DataFrame, key: str, text: Column) -> DataFrame:
    """(_k, _h, form, lexicon columns): the distinct words of each row that the lexicon holds, as written in the row.

    The optimizer broadcasts the lexicon when its size allows that. A word that many rows hold is an ordinary skewed join key.
    """
    forms = df.select(*_row_key(key, text), F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(wording.WORD), F.lit(0)))).alias("form"))
    return forms.filter(F.length("form") > MIN_WORD).withColumn("word", F.lower("form")).join(lexicon, "word")


def _with_entries(df: DataFrame, held: DataFrame, key: str, text: Column, entries: Column) -> DataFrame:
    """``df`` with ``_entries``: ``entries`` folded over the words that :func:`_held` found in the row, null when there is none.

    Only the words found come back, as one small value per row.
    """
    found = held.groupBy("_k", "_h").agg(entries.alias("_entries"))
    keyed = df.withColumns({"_k": _row_key(key, text)[0], "_h": _row_key(key, text)[1]})
    return keyed.join(found, ["_k", "_h"], "left").drop("_k", "_h")


def _entry(entries: Column, token: Column) -> Column:
    return F.when((F.length(token) > MIN_WORD) & entries.isNotNull(), F.try_element_at(entries, F.lower(token)))


def _chance(p_syn: Column | float, word_class: Column) -> Column:
    return F.when(word_class.isin(fixed.BOOSTED_POS), F.lit(p_syn) * F.lit(1.3)).when(
        word_class.isin(fixed.PLAIN_POS), p_syn
    ).otherwise(0.0)


def _chosen(p_syn: Column | float, *keys: Column | str | int, pos: Column, token: Column, word_class: Column,
            synonyms: Column) -> Column:
    chance = _chance(p_syn, word_class)
    picked = F.get(synonyms, (draw_int(*keys, "pick", pos) % F.greatest(F.size(synonyms), F.lit(1))).cast("int"))
    drawn = (chance > 0) & (draw(*keys, "swap", pos) < chance)
    return F.when(drawn, F.coalesce(picked, token)).otherwise(token)


def _pieces(text: Column) -> Column:
    """Array of struct(token, gap): words with the gap that follows them, so half the rows of single tokens."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(wording.PIECE), F.lit(0)),
        lambda p: let(
            F.regexp_extract(p, wording.WORD_HEAD, 1),
            lambda w: F.struct(w.alias("token"), F.substring(p, F.length(w) + 1, F.length(p)).alias("gap")),
        ),
    )


def _known_words(pieces: Column, entries: Column) -> Column:
    """``head`` and ``words``: the text up to the first word that has an entry, and each such word with its place, entry and the text up to the next one.

    So attempts go from known word to known word, and what lies between is put together once.
    """
    def between(texts: Column, begin: Column, end: Column) -> Column:
        return F.array_join(F.slice(texts, begin + 1, F.greatest(end - begin, F.lit(0))), "")

    def cut(s: Column) -> Column:
        at = lambda k: F.coalesce(F.get(s["hits"], k), F.size(s["texts"]))
        words = F.transform(s["hits"], lambda i, k: let(F.get(s["pieces"], i), lambda p: F.struct(
            i.alias("pos"), p["token"].alias("token"), _entry(entries, p["token"]).alias("entry"), F.concat(p["gap"], between(s["texts"], i + 1, at(k + 1))).alias("rest"))))
        return F.struct(between(s["texts"], F.lit(0), at(F.lit(0))).alias("head"), words.alias("words"))

    indexes = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1)).otherwise(F.array().cast("array<int>"))
    hits = F.filter(indexes, lambda i: _entry(entries, F.get(pieces, i)["token"]).isNotNull())
    texts = F.transform(pieces, lambda p: F.concat(p["token"], p["gap"]))
    return let(F.struct(pieces.alias("pieces"), texts.alias("texts"), hits.alias("hits")), cut)


def _swap():
    """Words, gaps and entries of rows to texts with drawn synonyms; one row at a time becomes Python strings.

    The draws are those of ``expr.draw`` with the keys of the row (``drawn_by``) and the place among the pieces of :func:`_pieces`.
    """
    def swapped(word_lists, gap_lists, entry_lists, drawn_by):
        from hashlib import md5

        import pyarrow as pa

        def strings(values) -> list:
            return values.to_numpy(zero_copy_only=False).tolist()

        def numbers(key: str, use: str):
            start = md5(f"{key}|{use}|".encode(), usedforsecurity=False)

            def number(pos: int) -> int:
                state = start.copy()
                state.update(b"%d" % pos)
                return int.from_bytes(state.digest()[:4], "big")

            return number

        def one(words: list, gaps: list, entries, key: str) -> str:
            chances, synonyms = entries.field("chance").to_pylist(), entries.field("synonyms")
            choices, sizes = strings(synonyms.flatten()), synonyms.value_lengths().to_numpy()
            sizes, starts = sizes.tolist(), (sizes.cumsum() - sizes).tolist()
            known = {form: i for i, form in enumerate(strings(entries.field("form")))}
            opened = 1 if gaps[0] else 0
            swap, pick = numbers(key, "swap"), numbers(key, "pick")
            places = [(k, e) for k, e in enumerate(map(known.get, words)) if e is not None]
            for k, e in places:
                if swap(k + opened) / 4294967296.0 < chances[e]:
                    chosen = choices[starts[e] + pick(k + opened) % sizes[e]]
                    words[k] = words[k] if chosen is None else chosen
            whole = [None] * (2 * len(words) + 1)
            whole[::2], whole[1::2] = gaps, words
            return "".join(whole)

        def rows():
            for words, gaps, entries, key in zip(word_lists, gap_lists, entry_lists, drawn_by):
                if words.is_valid and entries.is_valid:
                    yield one(strings(words.values), strings(gaps.values), entries.values, key.as_py())
                else:
                    yield None

        return pa.array(rows(), pa.string())

    return swapped


def replace_synonyms(df: DataFrame, lexicon: DataFrame, p_syn: float = 0.2, seed: int = 0, key: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """Swap words for drawn synonyms inside each row; all other columns, and rows with equal or null keys, stay as they are.

    Words of a class that is never swapped are not looked up. A row's entries are a dictionary in the Arrow batch, so the work grows
    with the words of a row, whatever the number of its entries.
    """
    if p_syn <= 0:
        return df
    text, work = F.col(text_col), _swap()
    usable = lexicon.select("word", "synonyms", _chance(p_syn, F.col("word_class")).alias("chance")).filter("chance > 0 and size(synonyms) > 0")
    found = _with_entries(df, _held(df, usable, key, text), key, text, F.collect_set(F.struct("form", "chance", "synonyms")))

    @F.arrow_udf("string")
    def swapped(words: pa.Array, gaps: pa.Array, entries: pa.Array, drawn_by: pa.Array) -> pa.Array:
        return work(words, gaps, entries, drawn_by)

    drawn_by = F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))
    new = swapped(F.regexp_extract_all(text, F.lit(wording.WORD), F.lit(0)), F.split(text, wording.WORD), F.col("_entries"), drawn_by)
    return found.select(*[F.coalesce(new, text).alias(c) if c == text_col else F.col(c) for c in df.columns])


# --- whole pipelines --------------------------------------------------------------------
def count_sentences(text: Column) -> Column:
    return F.size(sentences_of(text))


def rewrite_metrics(df: DataFrame, before: str = "text", after: str = "rewritten") -> DataFrame:
    """Adds word and sentence counts before and after, and their differences."""
    counted = df.withColumns(
        {
            "orig_word_count": tokenize_counts(F.col(before)),
            "orig_sentence_count": count_sentences(F.col(before)),
            "new_word_count": tokenize_counts(F.col(after)),
            "new_sentence_count": count_sentences(F.col(after)),
        }
    )
    return counted.withColumn("words_added", F.col("new_word_count") - F.col("orig_word_count")).withColumn(
        "sentences_added", F.col("new_sentence_count") - F.col("orig_sentence_count")
    )


def changes_applied(before_size: Column, after_size: Column) -> Column:
    return F.greatest(F.lit(1), F.abs(after_size - before_size))


def rewrite_text(df: DataFrame, lexicon: DataFrame | None = None, p_syn: float = 0.2, p_trans: float = 0.2,
                 seed: int = 0, preserve_linebreaks: bool = True, key: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Citations out, contractions, synonyms, transitions, citations in, spacing; adds ``rewritten``."""
    kept = [c for c in df.columns if c not in (key, text_col)]
    protected = df.select(
        key, *kept, F.col(text_col).alias("_original"), wording.extract_citations(F.col(text_col)).alias("_c")
    )
    expanded = protected.select(
        key, *kept, "_original", F.col("_c.refs").alias("_refs"),
        wording.expand_contractions(F.col("_c.text")).alias("_work"),
    )
    if lexicon is not None:
        expanded = replace_synonyms(expanded, lexicon, p_syn, seed, key, "_work")
    opener = wording.with_line_transitions if preserve_linebreaks else wording.with_transitions
    opened = expanded.withColumn("_work", opener(F.col("_work"), p_trans, seed, F.col(key)))
    final = wording.normalize_punctuation(wording.restore_citations(F.col("_work"), F.col("_refs")))
    return opened.select(key, *kept, F.col("_original").alias(text_col), final.alias("rewritten"))


def rewrite_answers_only(paras: DataFrame, p_trans: float = 0.2, seed: int = 0) -> DataFrame:
    """Rewrite only the answers after the section heading (no synonyms, light transitions)."""
    answers = section_gate(paras).filter(is_answer(F.col("text")) & ~is_question(F.col("text")))
    keyed = answers.withColumn("_key", F.concat_ws("/", "doc_id", "para_idx"))
    return rewrite_text(keyed, None, 0.0, p_trans, seed, key="_key").drop("_key")


def guarded_rewrite(nodes: DataFrame, lexicon: DataFrame, seed: int = 0, key: str = "node_id",
                    text_col: str = "text", attempts: int = fixed.REWRITE_ATTEMPTS) -> DataFrame:
    """First of several seeded rewrites that passes the guards; the original when none does.

    The lexicon is looked up once per node; candidates are then built and judged one after the other inside its row, and
    none after the first that passes. Guards: length within 20 %, numbers kept, edit similarity low enough, at any length.
    """
    core = nodes.select(
        F.col(key).alias("_key"), F.col(text_col).alias("_node"), strip(F.col(text_col)).alias("_core")
    ).withColumn("_c", wording.extract_citations(F.col("_core")))
    expanded = core.select("_key", "_node", "_core", F.col("_c.refs").alias("_refs"), wording.expand_contractions(F.col("_c.text")).alias("_work"))
    entries = F.map_from_entries(F.collect_set(F.struct("word", F.struct("word_class", "synonyms"))))
    found = _with_entries(expanded, _held(expanded, lexicon, "_key", F.col("_work")), "_key", F.col("_work"), entries)

    def candidate(node: Column, attempt: Column) -> Column:
        keys = (seed, node["key"], attempt["n"])
        swapped = F.transform(node["words"], lambda w: F.concat(
            _chosen(attempt["p_syn"], *keys, pos=w["pos"], token=w["token"], word_class=w["entry"]["word_class"], synonyms=w["entry"]["synonyms"]),
            w["rest"],
        ))
        text = F.concat(node["head"], F.array_join(swapped, ""))
        opened = let(text, lambda x: wording.with_line_transitions(x, attempt["p_trans"], *keys))
        final = wording.normalize_punctuation(wording.restore_citations(opened, node["refs"]))
        kept = let(
            final,
            lambda c: F.when(c.rlike(r"\S") & wording.length_ratio_ok(node["core"], c),
                             wording.restore_numbers(node["core"], c)),
        )
        return let(kept, lambda c: F.when(wording.changed_enough(node["core"], c),
                                          F.struct(attempt["n"].alias("n"), c.alias("text"))))

    tries = F.array(*[
        F.struct(F.lit(i * attempts + k).alias("n"), F.lit(p_syn).alias("p_syn"), F.lit(p_trans).alias("p_trans"))
        for i, (p_syn, p_trans) in enumerate(fixed.REWRITE_LEVELS)
        for k in range(attempts)
    ])
    node = let(F.struct(F.col("_work").alias("text"), F.col("_entries").alias("entries")), lambda r: let(_pieces(r["text"]), lambda p: _known_words(p, r["entries"])))
    node = F.struct(F.col("_key").alias("key"), node.alias("cut"), F.col("_core").alias("core"), F.col("_refs").alias("refs"))
    node = let(node, lambda n: F.struct(n["key"].alias("key"), n["cut"]["head"].alias("head"), n["cut"]["words"].alias("words"), n["core"].alias("core"), n["refs"].alias("refs")))
    none = F.lit(None).cast("struct<n:int,text:string>")
    picked = let(node, lambda n: F.aggregate(tries, none, lambda acc, attempt: F.when(acc.isNotNull(), acc).otherwise(candidate(n, attempt))))
    judged = found.select("_key", "_node", "_core", picked.alias("_picked"))
    styled = wording.preserve_whitespace_shell(
        F.col("_node"), wording.apply_casing_like(F.col("_core"), F.col("_picked.text"))
    )
    return judged.select(
        F.col("_key").alias(key),
        F.col("_node").alias(text_col),
        F.col("_picked.n").alias("attempt"),
        F.when(F.col("_picked").isNotNull(), styled).otherwise(F.col("_node")).alias("rewritten"),
    )


def redistribute_words(run_texts: Column, new_text: Column) -> Column:
    """Spread ``new_text`` over runs in proportion to their original length, at least a word each.

    The last run takes the rest; words keep their order and a blank ends every run but the
    one holding the last word.
    """
    def spread(s: Column) -> Column:
        words, runs = s["words"], s["runs"]
        total_chars = F.aggregate(runs, F.lit(0), lambda acc, r: acc + F.length(r))
        n = F.size(words)

        def step(acc: Column, i: Column) -> Column:
            left = n - acc["at"]
            share = F.when(
                total_chars > 0, F.floor(left * F.length(F.get(runs, i)) / F.greatest(total_chars, F.lit(1)))
            ).otherwise(F.floor(left / (F.size(runs) - i)))
            wanted = F.when(i == F.size(runs) - 1, left).otherwise(F.greatest(F.lit(1), share.cast("int")))
            return let(
                F.greatest(F.lit(0), F.least(wanted, left)),
                lambda take: F.struct(
                    (acc["at"] + take).alias("at"),
                    F.concat(
                        acc["out"],
                        F.array(
                            F.concat(
                                F.array_join(F.slice(words, acc["at"] + 1, take), " "),
                                F.when((take > 0) & (acc["at"] + take < n), F.lit(" ")).otherwise(F.lit("")),
                            )
                        ),
                    ).alias("out"),
                ),
            )

        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
        indexes = F.when(F.size(runs) > 0, F.sequence(F.lit(0), F.size(runs) - 1)).otherwise(
            F.array().cast("array<int>")
        )
        return F.aggregate(indexes, start, step, lambda acc: acc["out"])

    return let(F.struct(F.split(new_text, " ").alias("words"), run_texts.alias("runs")), spread)


def number_citations(df: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per citation with its running number and placeholder."""
    refs = F.regexp_extract_all(F.col(text_col), F.lit(fixed.CITATION_PATTERN), F.lit(0))
    return df.select(key, F.posexplode(refs).alias("i", "citation")).select(
        key,
        (F.col("i") + 1).alias("number"),
        "citation",
        F.concat(F.lit("[[REF_"), (F.col("i") + 1).cast("string"), F.lit("]]")).alias("placeholder"),
    )


def projected_text(body: Column) -> Column:
    """First of the known text fields present in a JSON object."""
    return F.coalesce(*[F.get_json_object(body, f"$.{name}") for name in fixed.REWRITE_TEXT_FIELDS])
