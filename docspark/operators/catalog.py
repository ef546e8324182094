"""Object catalog: listings, lineage of derived objects, existence and integrity checks.

The catalog is a table of (key, size, ...). Listings filter on the key, so a table partitioned by
other columns is read whole unless the caller filters those columns as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, naming
from docspark.functions.expr import let, strip
from docspark.operators.skew import shuffle_partitions


def parse_object_key(df: DataFrame, stage: str | None = None, key_col: str = "key") -> DataFrame:
    parts = naming.key_parts(F.col(key_col), None if stage is None else F.lit(stage))
    return df.withColumns(parts)


def list_files(catalog: DataFrame, user: str | None = None, stage: str = "raw", file_type: str = "pdf") -> DataFrame:
    """Files of a user (or of every user) in a stage with an extension, any case."""
    prefix = "users/" if user is None else f"users/{user}/uploads/"
    parts = F.split("key", "/")
    listed = catalog.filter(
        F.col("key").startswith(prefix) & F.array_contains(parts, stage) & naming.has_extension(F.col("key"), file_type)
    )
    return parse_object_key(listed, stage)


def list_users(catalog: DataFrame) -> DataFrame:
    parts = F.split("key", "/")
    users = catalog.filter(F.col("key").startswith("users/") & (F.size(parts) > 1))
    return users.select(F.get(parts, F.lit(1)).alias("id")).distinct().orderBy("id")


def list_uploads(catalog: DataFrame, user: str | None = None) -> DataFrame:
    """Distinct upload ids of one user, or of every user with the user beside them."""
    parts = F.split("key", "/")
    prefix = "users/" if user is None else f"users/{user}/uploads/"
    under = catalog.filter(
        F.col("key").startswith(prefix) & (F.size(parts) > 3) & (F.get(parts, F.lit(2)) == "uploads")
    )
    columns = [F.get(parts, F.lit(1)).alias("user_id"), F.get(parts, F.lit(3)).alias("id")]
    listed = under.select(*columns).distinct().orderBy("user_id", "id")
    return listed if user is None else listed.select("id")


def list_formatted(catalog: DataFrame, user: str | None = None, upload: str | None = None) -> DataFrame:
    """Word and HTML files of the formatted stage, with the prefix stripped; folder markers dropped."""
    if user is not None and upload is not None:
        in_stage = F.col("key").startswith(f"users/{user}/uploads/{upload}/formatted/")
    else:
        in_stage = F.col("key").rlike(r"^users/[^/]+/uploads/[^/]+/formatted/")
    listed = catalog.filter(in_stage & naming.has_extension(F.col("key"), *fixed.FORMATTED_EXTENSIONS))
    return listed.withColumn("name", naming.file_name(F.col("key"))).withColumn(
        "path", F.regexp_replace("key", r"^users/[^/]+/uploads/[^/]+/formatted/", "")
    )


def list_by_extension(catalog: DataFrame, extension: str) -> DataFrame:
    listed = catalog.filter(naming.has_extension(F.col("key"), extension))
    return listed.withColumn("name", naming.file_name(F.col("key")))


def list_edited(catalog: DataFrame) -> DataFrame:
    """The flat listing of edited files, prefix stripped."""
    return catalog.filter(F.col("key").startswith("edited-files/")).select(
        F.col("key").alias("id"), F.regexp_replace("key", "^edited-files/", "").alias("name")
    )


def derive_output_keys(catalog: DataFrame) -> DataFrame:
    key = F.col("key")
    return catalog.withColumns(
        {
            "rewritten_key": naming.rewritten_key(key),
            "anonymized_key": naming.anonymized_key(key),
            "redacted_key": naming.redacted_key(key),
            "docx_key": naming.converted_key(key, "docx"),
            "html_key": naming.converted_key(key, "html"),
        }
    )


def find_derived(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """Does each source's rewritten copy exist; if not, which alternatives are there?

    Alternatives are the keys worth trying plus the first object of the same upload that is a rewritten copy and
    whose key contains the source's base name. A base name has no slash, so it lies inside one segment of the key: copies are
    cut into the pieces of the lengths that base names of their upload have, the first key per piece is kept, and
    an equi-join on (upload, piece) finds it. Pairs of sources and copies never arise. A copy has many more bytes of pieces than of
    its own, so copies are dealt to all partitions before they are cut; by their own size they would go to few tasks.
    """
    suffix = fixed.REWRITTEN_SUFFIX
    key = F.col("key")
    wanted = sources.select(key).distinct().withColumns(
        {
            "expected": naming.expected_rewritten_key(key),
            "sibling": naming.sibling_rewritten_key(key),
            "_upload": F.regexp_extract("key", r"^([^/]*/[^/]*/[^/]*/[^/]*)", 1),
            "_base": F.regexp_replace(naming.file_name(key), r"\.docx", ""),
        }
    )
    stored = catalog.select(F.col("key").alias("expected")).distinct().withColumn("exists", F.lit(True))
    lengths = wanted.groupBy("_upload").agg(F.collect_set(F.length("_base")).alias("_lengths"))
    copies = catalog.filter(F.contains(F.col("key"), F.lit(suffix))).select(
        F.regexp_extract("key", r"^([^/]*/[^/]*/[^/]*/[^/]*)", 1).alias("_upload"), F.col("key").alias("_found")
    )
    dealt = copies.join(lengths, "_upload").repartition(shuffle_partitions(copies), "_found")
    sized = dealt.select("_upload", "_found", F.explode("_lengths").alias("_n"))
    cut = let(F.col("_n"), lambda n: F.flatten(F.transform(
        F.filter(F.split("_found", "/"), lambda s: F.length(s) >= n),
        lambda s: F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, n)),
    )))
    found = sized.select("_upload", "_found", F.explode(F.array_distinct(cut)).alias("_base")).groupBy("_upload", "_base").agg(
        F.min("_found").alias("found"))
    joined = wanted.join(stored, "expected", "left").join(found, ["_upload", "_base"], "left")
    exists = F.coalesce("exists", F.lit(False))
    moved = F.when(F.contains(key, F.lit("/raw/")), F.regexp_replace("sibling", r"^(.*?)/raw/", "$1/formatted/"))
    return joined.select(
        "key",
        "expected",
        exists.alias("exists"),
        F.when(~exists, F.array_compact(F.array(moved, F.col("sibling"), F.col("found")))).alias("alternatives"),
    )


def check_exists(keys: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Existence flag and stored attributes of each requested key."""
    stored = catalog.select("key", *columns, F.lit(True).alias("_there"))
    joined = keys.join(stored, "key", "left")
    return joined.withColumn("exists", F.coalesce("_there", F.lit(False))).drop("_there")


def audit_uploads(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Uploads against stored objects: ok, empty, missing or size_mismatch."""
    stored = actual.select("key", F.col("size").alias("stored_size"))
    joined = expected.join(stored, "key", "left")
    return joined.withColumn(
        "verdict",
        F.when(F.col("size") == 0, "empty")
        .when(F.col("stored_size").isNull(), "missing")
        .when(F.col("stored_size") != F.col("size"), "size_mismatch")
        .otherwise("ok"),
    )


def select_file_type(catalog: DataFrame, extension: str) -> tuple[DataFrame, DataFrame]:
    """Keys of the wanted type, and the rest with the reason for refusing them."""
    wanted = naming.has_extension(F.col("key"), extension)
    refused = catalog.filter(~wanted).withColumn("error", F.lit(f"only {extension} files are supported"))
    return catalog.filter(wanted), refused


def preview(df: DataFrame, key_col: str = "key", text_col: str = "text", chars: int | None = None) -> DataFrame:
    """A Word document's text, or its first ``chars`` characters; a fixed message for other types."""
    message = F.concat(F.lit("[Preview for "), naming.file_name(F.col(key_col)), F.lit(" not available]"))
    shown = F.col(text_col) if chars is None else F.substring(text_col, 1, chars)
    return df.withColumn(
        "preview",
        F.when(F.col(key_col).endswith(".docx"), shown).otherwise(message),
    )


def batch_rollup(items: DataFrame, status_col: str = "status", keys: list[str] | None = None) -> DataFrame:
    """Totals, successes, failures and success percentage."""
    ok = F.count_if(F.col(status_col) == "success")
    return items.groupBy(*(keys or [])).agg(
        F.count("*").alias("total"),
        ok.alias("successful"),
        (F.count("*") - ok).alias("failed"),
        F.when(F.count("*") > 0, F.round(ok * 100 / F.count("*"), 2)).otherwise(F.lit(0.0)).alias("success_percentage"),
    )


def wrap_html(content: Column, title: str = "Document") -> Column:
    """Body content in a complete HTML document."""
    return F.concat(F.lit(fixed.HTML_HEAD.format(title=title)), content, F.lit(fixed.HTML_TAIL))


def extract_html_body(html: Column) -> Column:
    """Trimmed inner HTML of the body; blank input gives an empty string, no body the input."""
    closed = r"(?is)<body[^>]*>(.*)</body>"
    unclosed = r"(?is)<body[^>]*>(.*)$"
    return (
        F.when(html.isNull() | ~html.rlike(r"\S"), F.lit(""))
        .when(html.rlike(closed), strip(F.regexp_extract(html, closed, 1)))
        .when(html.rlike(unclosed), strip(F.regexp_extract(html, unclosed, 1)))
        .otherwise(html)
    )
