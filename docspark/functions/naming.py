"""Object keys, file names, upload metadata."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docspark.functions import fixed
from docspark.functions.expr import let, strip


def key_parts(key: Column, stage: Column | None = None) -> dict[str, Column]:
    """Parts of ``users/<user>/uploads/<upload>/<stage>/<relative path>``.

    With ``stage`` given, the relative path is what follows its first occurrence; otherwise
    the stage is the fifth part.
    """
    parts = F.split(key, "/")
    wanted = F.get(parts, F.lit(4)) if stage is None else stage
    at = F.array_position(parts, wanted)
    return {
        "user_id": F.get(parts, F.lit(1)),
        "upload_id": F.get(parts, F.lit(3)),
        "stage": F.when(at > 0, wanted),
        "relative_path": F.when(
            at > 0, F.array_join(F.slice(parts, (at + 1).cast("int"), F.size(parts)), "/")
        ),
        "name": F.try_element_at(parts, F.lit(-1)),
    }


def build_object_key(user: Column, upload: Column, stage: Column, path: Column) -> Column:
    """Joined key with doubled slashes collapsed."""
    joined = F.concat_ws("/", F.lit("users"), user, F.lit("uploads"), upload, stage, path)
    return F.regexp_replace(joined, "/+", "/")


def file_name(key: Column) -> Column:
    return F.regexp_extract(key, r"([^/]*)$", 1)


def has_extension(key: Column, *extensions: str) -> Column:
    return F.lower(key).rlike(r"\.(" + "|".join(extensions) + ")$")


def rewritten_key(key: Column) -> Column:
    """Output key of a rewritten document: the formatted stage and the rewritten suffix."""
    moved = (
        F.when(F.contains(key, F.lit("/raw/")), F.regexp_replace(key, r"^(.*?)/raw/", "$1/formatted/"))
        .when(F.contains(key, F.lit("/converted/")), F.regexp_replace(key, r"^(.*?)/converted/", "$1/formatted/"))
        .otherwise(F.regexp_replace(key, r"^(.*/)?([^/]*)$", "$1formatted/$2"))
    )
    return _suffixed(moved, fixed.REWRITTEN_SUFFIX)


def expected_rewritten_key(key: Column) -> Column:
    """Where a lookup expects the rewritten copy: only the raw stage moves."""
    return _suffixed(F.regexp_replace(key, r"^(.*?)/raw/", "$1/formatted/"), fixed.REWRITTEN_SUFFIX)


def sibling_rewritten_key(key: Column) -> Column:
    """The rewritten copy next to its source."""
    return F.regexp_replace(key, r"(?i)\.docx$", fixed.REWRITTEN_SUFFIX)


def _suffixed(key: Column, suffix: str) -> Column:
    return F.when(has_extension(key, "docx"), F.regexp_replace(key, r"(?i)\.docx$", suffix)).otherwise(
        F.concat(key, F.lit(suffix))
    )


def anonymized_key(key: Column) -> Column:
    moved = F.regexp_replace(key, r"^(.*?)/raw/", "$1/formatted/")
    return F.replace(moved, F.lit(".pdf"), F.lit(fixed.ANONYMIZED_SUFFIX))


def redacted_key(key: Column) -> Column:
    return F.regexp_replace(key, r"(\.[^./]+)$", fixed.REDACTED_SUFFIX + "$1")


def converted_key(key: Column, extension: str = "docx") -> Column:
    """Key of a converted PDF: formatted stage, new extension."""
    moved = F.regexp_replace(key, r"^(.*?)/raw/", "$1/formatted/")
    return F.regexp_replace(moved, r"(?i)\.pdf$", f".{extension}")


def sanitize_metadata_value(value: Column) -> Column:
    """Printable ASCII only: control characters dropped, typographic marks mapped, the rest a hyphen."""
    out = F.regexp_replace(value, r"[\x00-\x1F\x7F-\x9F]", "")
    out = F.translate(out, "–—“”‘’", "--\"\"''")
    out = F.replace(out, F.lit("…"), F.lit("..."))
    out = F.regexp_replace(out, r"[^\x20-\x7E]", "-")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def sanitize_filename(name: Column) -> Column:
    return F.regexp_replace(name, r"[^a-zA-Z0-9._-]", "_")


def normalize_destination_path(path: Column) -> Column:
    """No edge slashes, one trailing slash unless empty."""
    bare = F.regexp_replace(strip(F.coalesce(path, F.lit(""))), r"^/+|/+$", "")
    return F.when(bare == "", F.lit("")).otherwise(F.concat(bare, F.lit("/")))


def part_count(size: Column) -> Column:
    mb = 1024 * 1024
    return (
        F.when(size <= fixed.SINGLE_PART_MAX_MEGABYTES * mb, 1)
        .when(size > fixed.MAX_PART_MEGABYTES * mb, fixed.MAX_PARTS)
        .otherwise(F.ceil(size / (fixed.PART_MEGABYTES * mb)))
        .cast("int")
    )


def parse_upload_metadata(header: Column) -> Column:
    """``"k b64,k b64"`` to a map; pairs without key or value are dropped, the last of equal keys wins."""
    pairs = F.transform(F.split(header, ","), lambda item: F.split(item, " "))
    kept = F.filter(
        pairs,
        lambda p: (F.length(F.coalesce(F.get(p, F.lit(0)), F.lit(""))) > 0)
        & (F.length(F.coalesce(F.get(p, F.lit(1)), F.lit(""))) > 0),
    )

    def last_wins(ps: Column) -> Column:
        return F.filter(
            ps,
            lambda p, i: ~F.exists(
                F.slice(ps, i + 2, F.size(ps)), lambda later: F.get(later, F.lit(0)) == F.get(p, F.lit(0))
            ),
        )

    entries = F.transform(
        let(kept, last_wins),
        lambda p: F.struct(
            F.get(p, F.lit(0)).alias("key"), F.unbase64(F.get(p, F.lit(1))).cast("string").alias("value")
        ),
    )
    return F.map_from_entries(entries)


def split_name(name: Column) -> tuple[Column, Column]:
    """(base, extension with its dot); a leading dot is part of the base."""
    ext = F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)
    return F.substring(name, F.lit(1), F.length(name) - F.length(ext)), ext
