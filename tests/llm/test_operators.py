"""Every operator on awkward rows against its brute-force version, and on empty tables."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from docspark.llm import decontamination, language_id, license_scan, mixing, quality, sharding, simhash, substring_dedup, token_counts, url_filter
from tests.llm import brute

ITEMS = "item_id bigint, text string, term string, parts string"


def rows_of(df, *names):
    return Counter(tuple(tuple(v) if isinstance(v, list) else v for v in (r[n] for n in names)) for r in df.collect())


def test_substring_dedup(awkward, given, nothing):
    got = substring_dedup.remove_repeats(awkward)
    want = Counter((d, *w) for (d, t, _), w in zip(given, brute.substring_dedup([(d, t) for d, t, _ in given])))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert sum(k[2] * n for k, n in want.items()) > 300
    assert substring_dedup.remove_repeats(nothing).count() == 0


def test_substring_dedup_in_pieces(awkward, given, monkeypatch):
    monkeypatch.setattr(substring_dedup, "PIECE", 700)
    got = substring_dedup.remove_repeats(awkward, window=20, anchor=4)
    want = Counter((d, *w) for (d, t, _), w in zip(given, brute.substring_dedup([(d, t) for d, t, _ in given], 20)))
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    for r in got.filter("n_removed > 0").collect():
        assert sum(s["end"] - s["begin"] for s in r["spans"]) == r["n_removed"]
        assert len(r["kept_text"].split()) == r["n_words"] - r["n_removed"]


def test_token_counts(awkward, given, nothing):
    scores = token_counts.piece_scores()
    known = {}
    want = Counter()
    for d, t, _ in given:
        words = brute.plain(t)
        known |= {w: brute.unigram("▁" + w, scores) for w in set(words) - known.keys()}
        want[d, len(words), sum(known[w] for w in words)] += 1
    assert rows_of(token_counts.count_tokens(awkward), "doc_id", "n_pretokens", "n_tokens") == want
    assert token_counts.count_tokens(nothing).count() == 0


def test_token_counts_agree_with_a_unigram_library(given):
    from tokenizers import Tokenizer, models

    scores = token_counts.piece_scores()
    library = Tokenizer(models.Unigram([("<unk>", 0.0), *scores.items()], 0, False))
    words = sorted({"▁" + w for _, t, _ in given for w in brute.plain(t)} | {"▁日本語", "▁naïve", "▁\U0001F600x", "▁"})
    mine = token_counts.Trie(scores).count(words)
    for w in words:
        parts = library.encode(w)
        assert mine[w][0] == sum(len(w[a:b].encode()) if i == 0 else 1 for (a, b), i in zip(parts.offsets, parts.ids)), w


def test_license_scan(awkward, given, nothing):
    got = license_scan.scan_licenses(awkward)
    want = Counter()
    for d, t, _ in given:
        n, places, base, labels, score = brute.license_labels(t)
        want[d, n, len(places), places[0] if places else None, places[-1] if places else None, base, labels, score] += 1
    assert rows_of(got, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score") == want
    assert {"cc-by-nc", "mit", "apache,cc-by-nc,gpl,mit"} & {k[6] for k in want}
    assert license_scan.scan_licenses(nothing).count() == 0


def test_license_filters_lose_nothing(spark):
    """Blocks at, above and below every template's threshold."""
    rows = []
    for _, text in license_scan.TEMPLATES:
        words = license_scan.template_words(text)
        rows += [(len(rows) + k, " ".join(words[:i] + words[i + k :] + ["filler"])) for k in range(4) for i in range(0, len(words) - k, 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = rows_of(license_scan.scan_licenses(docs), "doc_id", "labels")
    assert got == Counter((d, brute.license_labels(t)[3]) for d, t in rows)


URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/1", "http://a.example.net/en", "http://net/x", "http://magnet/x", "http://x.org/fr/", "x://x.org/FR/?q",
    "http://a.example.com/de/7?page=2", "http://a.example.com#/de/", "https://www.free-bets.example.com/en/5.html?utm_source=x#top", "http://free-bets.example.com/en/5/",
    "http://free-bets.example.com/en/6?id=1&ref=x", "http://free-bets.example.com/en/6?id=2", "http://free-bets.example.org/fr/1", "ftp://h.example.com", "http://h.example.com?x://y/z",
] + ["http://ordinary.example.com/en/1"] * 5


def test_url_filter(spark):
    pages = spark.createDataFrame([(i if i % 7 else None, u, "x", "y") for i, u in enumerate(URLS)], "page_id bigint, url string, canonical string, block string")
    listed = url_filter.listed_urls(pages)
    got = url_filter.judge_urls(pages, listed)
    names = {r["canonical"] for r in listed.collect()}
    assert "free-bets.example.com/en/5" in names and len(names) == 4
    want = Counter()
    for i, u in enumerate(URLS):
        host, path = brute.split_url(u)
        rule, verdict = brute.url_rule(host, path)
        hit = "free-bets" in host
        want[i if i % 7 else None, host, path, rule, hit, verdict or ("block" if hit else "allow")] += 1
    assert rows_of(got, "page_id", "host", "path", "rule", "listed", "verdict") == want
    assert url_filter.judge_urls(pages.limit(0), listed).count() == 0
    assert rows_of(url_filter.judge_urls(pages, listed.limit(0)), "listed") == Counter({(False,): len(URLS)})


def test_pages_of_a_listed_url_are_urls_of_their_own(spark):
    pages = spark.createDataFrame([(i, f"http://www.h.example.com/en/1.html?{q}") for i, q in enumerate(["page=1", "page=2", "ref=a&page=1", "utm_source=b"])], "page_id bigint, url string")
    listed = spark.createDataFrame([("h.example.com/en/1?page=1",)], "canonical string")
    assert rows_of(url_filter.judge_urls(pages, listed), "page_id", "verdict") == Counter({(0, "block"): 1, (1, "allow"): 1, (2, "block"): 1, (3, "allow"): 1})


def test_pages_without_host_are_not_looked_up(spark):
    pages = spark.range(5000).selectExpr("id AS page_id", "CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 'nowhere' ELSE 'http://?q' END AS url")
    listed = spark.createDataFrame([("",), ("?q",)], "canonical string")
    assert rows_of(url_filter.judge_urls(pages, listed), "host", "rule", "maybe_listed", "listed", "verdict") == Counter({("", None, False, False, "allow"): 5000})


def test_bloom_filter_passes_every_listed_url(spark):
    urls = spark.range(3000).selectExpr("concat('h', id % 50, '.example.com/', id) AS canonical")
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://h', id % 50, '.example.com/', id) AS url")
    got = url_filter.judge_urls(pages, urls, rules=[])
    assert got.filter("listed").count() == 3000 and got.filter("listed AND NOT maybe_listed").count() == 0
    assert got.filter("maybe_listed AND NOT listed").count() < 60


def test_language_id(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.train(language_id.training_sample(docs, sample=60))
    judged = language_id.predict(docs, model).filter("held_out").join(docs.select("doc_id", "lang"), "doc_id")
    right, total = judged.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count(F.lit(1))).first()
    assert total > 300 and right / total > 0.98
    got = rows_of(language_id.predict(awkward, model), "doc_id", "lang_pred", "score", "held_out")
    assert sum(n for k, n in got.items() if k[1] == "und") == sum(not any(c.isalpha() for c in (r["text"] or "")) for r in awkward.collect())
    assert all(0 <= k[2] <= 1 for k in got) and sum(got.values()) == awkward.count()
    assert language_id.predict(nothing, model).count() == 0
    empty = language_id.train(language_id.training_sample(nothing))
    assert {r["lang_pred"] for r in language_id.predict(awkward, empty).collect()} == {"und"}


def test_language_scores_against_plain_python(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.train(language_id.training_sample(docs, sample=40))
    odd = [None, "", "12 !", " x", "x", "Ünï ÇÖDE ﬁ", "日本語の文", "İstanbul\t\n ſ", "a" * 70, "l'été, où es-tu? " * 50, "\u0301 e\u0301", "👍 ok 👍"]
    texts = odd + [r["text"] for r in awkward.collect() if len(r["text"] or "") < 20_000] + [r["text"] for r in docs.limit(40).collect()]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: r for r in language_id.predict(rows, model).collect()}
    for i, text in enumerate(texts):
        name, score = brute.language(model, text)
        assert got[i]["lang_pred"] == name and abs(got[i]["score"] - score) < 1e-9, text
        assert got[i]["rejected"] == (got[i]["score"] < model.threshold)


def test_held_out_rule(spark):
    import zlib

    got = {r[0]: r[1] for r in spark.range(200).select("id", language_id.held_out("id").alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 3 == 1 for i in range(200)}


@pytest.mark.parametrize("ranges", [3, 1000])
def test_mixing(awkward, given, nothing, monkeypatch, ranges):
    monkeypatch.setattr(mixing.cuts, "__defaults__", (ranges,))
    got = mixing.mix_sources(awkward)
    want = brute.mix(given, mixing.SEED)
    assert rows_of(got.withColumn("target", F.round("target", 6)), "doc_id", "size", "source_size", "target", "epochs", "taken") == Counter(
        (d, n, s, round(g, 6), e, e * n) for (d, _, _), (n, s, g, e) in zip(given, want))
    mixed = mixing.mixed_documents(awkward)
    assert mixed.columns == awkward.columns
    assert rows_of(mixed, "doc_id", "text", "source") == Counter(r for r, w in zip(given, want) for _ in range(w[3]))
    assert mixing.mix_sources(nothing).count() == 0 and mixing.mixed_documents(nothing).count() == 0


def test_quality_rules(awkward, given, nothing):
    got = quality.judge_quality(awkward)
    want = brute.quality_rules(given)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert rows_of(got, *names) == Counter((r[0], *w) for r, w in zip(given, want))
    assert any(not w[5] and not w[6] for w in want)
    kept = quality.kept_documents(awkward)
    assert kept.columns == awkward.columns
    assert rows_of(kept, "doc_id", "text") == Counter(r[:2] for r, w in zip(given, want) if w[6])
    assert quality.judge_quality(nothing).count() == 0 and quality.kept_documents(nothing).count() == 0


def test_decontamination(spark, awkward, given, nothing):
    texts = {d: t for d, t, _ in given}
    take = lambda d, a, b: " ".join(brute.plain(texts[d])[a:b])
    items = [(1, take(18, 100, 140)), (2, take(21, 4990, 5030)), (2, take(7, 5, 9)), (10, "Two, words!"), (None, take(1, 3, 17)), (5, None), (6, ""), (7, "absent words only here"),
             (8, take(13, 0, 12) + " other"), (9, take(18, 100, 140)), (11, "la " * 20)]
    bench = spark.createDataFrame([(*i, "x", None) for i in items], ITEMS)
    got = decontamination.find_items(awkward, bench)
    want = brute.decontaminate([r[:2] for r in given], [("" if i is None else i, t) for i, t in items])
    assert rows_of(got, "doc_id", "n_words", "n_hit", "items") == Counter((r[0], n, h, tuple(i)) for r, (n, h, i) in zip(given, want))
    assert sum(h > 0 for _, h, _ in want) > 8
    clean = decontamination.clean_documents(awkward, bench)
    assert clean.columns == awkward.columns
    assert rows_of(clean, "doc_id", "text") == Counter(r[:2] for r, (n, h, _) in zip(given, want) if not (h and 20 * h >= n))
    assert decontamination.find_items(nothing, bench).count() == 0
    assert decontamination.find_items(awkward, bench.limit(0)).filter("n_hit > 0").count() == 0


def test_proximity_matches(spark):
    words = [f"w{i}" for i in range(13)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:6] + ["x", "y"] + words[6:])), (3, " ".join(words[:12])), (4, " ".join(words[:6] + ["x"] * 9 + words[6:]))], "doc_id bigint, text string")
    bench = spark.createDataFrame([(5, " ".join(words))], "item_id bigint, text string")
    got = {r["doc_id"]: (r["items"], r["near_items"]) for r in decontamination.find_items(docs, bench).collect()}
    assert got == {1: (["5"], []), 2: ([], ["5"]), 3: ([], []), 4: ([], [])}


@pytest.mark.parametrize("ranges", [2, 1000])
def test_sharding(awkward, given, nothing, ranges):
    got = sharding.interleave(awkward, shards=7, range_rows=ranges)
    assert rows_of(got, "doc_id", "source", "size", "text_crc32", "place", "shard", "slot") == Counter(brute.shards(given, sharding.SEED, 7))
    assert sharding.interleave(nothing).count() == 0


def test_simhash(awkward, given, nothing):
    got = simhash.near_duplicates(awkward)
    want = brute.simhash_groups([r[:2] for r in given])
    assert rows_of(got, "doc_id", "fingerprint", "component_id") == Counter((r[0], *w) for r, w in zip(given, want))
    kept = simhash.unique_documents(awkward)
    assert kept.columns == awkward.columns
    assert kept.count() == len({w[1] for w in want}) + 1  # two components have the id 2, which two texts share
    assert {r["doc_id"] for r in kept.collect()} == {w[1] for w in want}
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.unique_documents(nothing).count() == 0


def test_simhash_links_on_bits(spark):
    """Chains, stars and dense balls of fingerprints, and pairs three bits apart."""
    base = [0, (1 << 64) - 1, 0x0F0F33CC5A5A9617]
    values = set(base)
    for b in base:
        values |= {b ^ (1 << i) ^ (1 << j) for i in range(0, 64, 9) for j in range(0, 64, 7)}
        chain = b ^ 0x8000000100000000
        for i in range(12):
            chain ^= 7 << 5 * i
            values |= {chain, chain ^ (1 << i), chain ^ (3 << i)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc bigint, fp bigint")
    got = {r["fp"]: r["component_id"] for r in simhash.group_fingerprints(rows).collect()}
    parent = list(range(len(signed)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(signed):
        for j in range(i):
            if ((a ^ signed[j]) & ((1 << 64) - 1)).bit_count() <= 2:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    assert got == {v: root(i) for i, v in enumerate(signed)}
    assert len(set(got.values())) > 3
