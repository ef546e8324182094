"""URL filtering: host and path rules, then a list of URLs behind a blocked Bloom filter.

The listed canonical URLs set eight bits each in one 512-bit block of a filter table. A page's URL looks up
its block only; what the filter passes goes to an exact hash join with the list, which removes false
positives. Whether the filter is broadcast or shuffled is left to the optimizer, which knows the size of the
written table; a hot URL or block is an ordinary skewed join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import lower_ascii
from docspark.session import cut_lineage

#: (host, path, verdict) of the rules (fixed values).
RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]
#: Names of sites whose URLs are listed (fixed values).
LISTED_SITES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: Query parameters and host prefixes that do not change what a URL shows (fixed values).
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid)="
HOST_PREFIX = r"^(www|m)\."

WORDS_PER_BLOCK = 8
BITS_PER_URL = 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule whose host is the URL's host or a parent of it and whose path begins the URL's path, and its verdict.

    Rules are few and fixed, so they are tried as one expression, longest first; equally long ones in the given order.
    """
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0]) + len(r[1])):
        name, verdict = F.when(fits(h, p), F.lit(h + p)).otherwise(name), F.when(fits(h, p), F.lit(v)).otherwise(verdict)
    return name, verdict


def canonical(url: Column) -> Column:
    """One form for the spellings of a URL: no scheme, ``www.`` or ``m.``, fragment, tracking parameters, ``.html`` or closing slash."""
    host, path = split_url(url)
    query = F.regexp_extract(F.substring_index(url, "#", 1), r"\?(.*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING)), "&")
    place = F.regexp_replace(F.regexp_replace(path, r"\.html?$", ""), "/+$", "")
    return F.concat(F.regexp_replace(host, HOST_PREFIX, ""), place, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))


def _place(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks))


def _bit(url: Column, word: int) -> Column:
    """The bit that a URL sets in word ``word`` of its block: six bits of a second hash."""
    six = F.shiftright(F.xxhash64(url, F.lit("bits")), 6 * word).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), six)


def bloom_filter(listed: DataFrame, url_col: str = "canonical", bits_per_url: int = BITS_PER_URL) -> tuple[DataFrame, int]:
    """The filter as a table ``block, w0 .. w7``, written once, and its number of blocks."""
    count = listed.select(F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-count * bits_per_url // (64 * WORDS_PER_BLOCK)))
    url = F.col(url_col)
    table = listed.select(_place(url, blocks).alias("block"), *[_bit(url, i).alias(f"b{i}") for i in range(WORDS_PER_BLOCK)])
    table = table.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS_PER_BLOCK)])
    return cut_lineage(table), blocks


def listed_urls(pages: DataFrame, url_col: str = "url", sites: list[str] = LISTED_SITES) -> DataFrame:
    """Distinct canonical URLs of pages on the listed sites: ``canonical``. Written once."""
    host, _ = split_url(F.col(url_col))
    pattern = r"(^|\.)(" + "|".join(sites) + r")\."
    found = pages.filter(host.rlike(pattern)).select(canonical(F.col(url_col)).alias("canonical"))
    return cut_lineage(found.distinct())


def judge_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url",
               rules: list[tuple[str, str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, canonical, rule, maybe_listed, listed, verdict`` of every row.

    ``listed`` holds distinct canonical URLs. A rule decides where one fits; else listed URLs are blocked and the
    others allowed. ``maybe_listed`` is the filter's answer. A null or broken url has empty host and path, fits no rule
    and is not listed; repeated rows are each judged. Empty tables give no row, an empty list blocks nothing.
    """
    table, blocks = bloom_filter(listed)
    host, path = split_url(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.coalesce(canonical(F.col(url_col)), F.lit("")).alias("canonical"))
    named = rows.filter(F.col("host") != "").withColumn("block", _place(F.col("canonical"), blocks))
    hit = F.lit(True)
    for i in range(WORDS_PER_BLOCK):
        hit = hit & (F.col(f"w{i}").bitwiseAND(_bit(F.col("canonical"), i)) != 0)
    tested = named.join(table, "block", "left").select("page_id", "host", "path", "canonical", F.coalesce(hit, F.lit(False)).alias("maybe_listed"))
    unnamed = rows.filter(F.col("host") == "").withColumn("maybe_listed", F.lit(False))  # they would share one block
    exact = listed.select(F.col("canonical"), F.lit(True).alias("found"))
    passed = tested.filter("maybe_listed").join(exact, "canonical", "left").withColumn("listed", F.coalesce("found", F.lit(False))).drop("found")
    stopped = tested.filter("NOT maybe_listed").unionByName(unnamed).withColumn("listed", F.lit(False))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    return passed.unionByName(stopped).select(
        "page_id", "host", "path", "canonical", name.alias("rule"), "maybe_listed", "listed",
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
    )
