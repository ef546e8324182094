"""Upload events in batch form: part assembly, expiry, failures, duplicates, pending files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions import fixed, naming
from docspark.operators.ranking import running_total


def assemble_multipart(parts: DataFrame) -> DataFrame:
    """Uploads whose distinct parts are all present, with their ordered part ids.

    A part sent again replaces the earlier copy. Parts per upload are capped by
    ``total_parts`` after that reduction, so the ordered list stays small.
    """
    latest = latest_parts(parts)
    grouped = latest.groupBy("multipart_id").agg(
        F.count("*").alias("received_parts"),
        F.max("total_parts").alias("total_parts"),
        F.max("ts").alias("completed_at"),
        F.sort_array(F.collect_list(F.struct("part_index", "upload_id"))).alias("_parts"),
    )
    complete = grouped.filter(F.col("received_parts") == F.col("total_parts"))
    return complete.select(
        "multipart_id", "total_parts", "completed_at", F.transform("_parts", lambda p: p["upload_id"]).alias("part_uploads")
    )


def latest_parts(parts: DataFrame) -> DataFrame:
    """One row per (upload, part index): the last one received."""
    newest = F.max(F.struct("ts", "upload_id", "total_parts")).alias("_p")
    return parts.groupBy("multipart_id", "part_index").agg(newest).select("multipart_id", "part_index", "_p.*")


def stale_assemblies(parts: DataFrame, now: Column, idle_seconds: int = fixed.STALE_SECONDS) -> DataFrame:
    """Incomplete uploads with no part for ``idle_seconds``."""
    grouped = latest_parts(parts).groupBy("multipart_id").agg(
        F.count("*").alias("received_parts"), F.max("total_parts").alias("total_parts"), F.max("ts").alias("last_part_at")
    )
    idle = F.col("last_part_at") < now - F.make_interval(secs=F.lit(idle_seconds))
    return grouped.filter((F.col("received_parts") < F.col("total_parts")) & idle)


def concatenate_parts(parts: DataFrame, data_col: str = "data") -> DataFrame:
    """Part contents in index order per upload; a missing index is an error, not a short file.

    Indexes may start at 0 or 1. Of several copies of a part the newest (``ts, upload_id``) counts, so a list never holds
    more than the parts of one upload. For contents that fit in a cell together; ``sources.assembled`` writes larger ones to files.
    """
    newest = F.max_by(F.struct(data_col, "total_parts"), F.struct("ts", "upload_id")).alias("_n")
    once = parts.groupBy("multipart_id", "part_index").agg(newest).select("multipart_id", "part_index", "_n.*")
    grouped = once.groupBy("multipart_id").agg(
        F.sort_array(F.collect_list(F.struct("part_index", data_col))).alias("_p"),
        F.max("total_parts").alias("total_parts"),
        F.count("*").alias("distinct_parts"),
        F.min("part_index").alias("first_index"),
        F.max("part_index").alias("last_index"),
    )
    complete = (
        (F.col("distinct_parts") == F.col("total_parts"))
        & (F.col("last_index") - F.col("first_index") + 1 == F.col("total_parts"))
        & F.col("first_index").isin(0, 1)
    )
    content = F.array_join(F.transform("_p", lambda p: p[data_col]), "")
    return grouped.select(
        "multipart_id", "total_parts", F.when(complete, content).alias("content"),
        F.when(~complete, F.lit("missing part")).alias("error"),
    )


def failed_ledger(events: DataFrame) -> DataFrame:
    """Open failures: the latest event of an upload decides; a success closes it.

    ``events`` holds (upload_id, ts, outcome, error); ties go to the larger outcome.
    """
    latest = F.max(F.struct("ts", "outcome", "error")).alias("_l")
    failures = F.count_if(F.col("outcome") == "failure").alias("failures")
    state = events.groupBy("upload_id").agg(latest, failures)
    return state.filter(F.col("_l.outcome") == "failure").select(
        "upload_id", F.col("_l.ts").alias("failed_at"), F.col("_l.error").alias("error"), "failures"
    )


def retry_uploads(requests: DataFrame, ledger: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(requests with verdict, ledger without the successful ones).

    A retry needs an open failure and a staged file.
    """
    known = requests.join(ledger.select("upload_id", F.lit(True).alias("_open")), "upload_id", "left")
    staged = known.join(files.select("upload_id", F.lit(True).alias("_file")), "upload_id", "left")
    verdict = F.when(F.col("_open").isNull(), "not_found").when(F.col("_file").isNull(), "file_missing").otherwise("retried")
    judged = staged.withColumn("verdict", verdict).drop("_open", "_file")
    remaining = ledger.join(judged.filter("verdict = 'retried'").select("upload_id"), "upload_id", "left_anti")
    return judged, remaining


def split_duplicates(new: DataFrame, existing: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) by presence of the keys among ``existing``."""
    known = existing.select(*keys).distinct()
    return new.join(known, keys, "left_anti"), new.join(known, keys, "left_semi")


def queue_files(new: DataFrame, queued: DataFrame) -> DataFrame:
    """New files not yet queued under the same name and size, each such pair once."""
    accepted, _ = split_duplicates(new, queued, ["name", "size"])
    return accepted.dropDuplicates(["name", "size"])


def _reserved_numbers(names: DataFrame, dir_col: str, name_col: str) -> DataFrame:
    """(dir, name, k) for every present name of the form ``base(k)ext``: k is taken in the numbering of ``base + ext``."""
    base, ext = naming.split_name(F.col(name_col))
    stem = F.regexp_extract(base, r"^(.*)\(([1-9][0-9]{0,8})\)$", 1)
    number = F.regexp_extract(base, r"^(.*)\(([1-9][0-9]{0,8})\)$", 2)
    return names.filter(number != "").select(
        dir_col, F.concat(stem, ext).alias(name_col), number.cast("bigint").alias("_k")
    ).distinct()


def number_duplicates(files: DataFrame, existing: DataFrame | None = None, dir_col: str = "dir", name_col: str = "name",
                      order: list[str] | None = None) -> DataFrame:
    """``base(k)ext`` for repeats of a name in a directory; the first keeps its name if it is free.

    Numbers already used by stored or incoming names are left out: the r-th repeat takes the r-th free number, which is
    r plus the reserved numbers below it. Ranks and that count are running totals over slices, so a name shared by a third
    of all files is not ordered in one task. Rows equal in ``order`` are told apart by their whole content.
    """
    keys = [dir_col, name_col]
    ties = [*[F.col(c) for c in (order or ["ts"])], F.xxhash64(*files.columns)]
    ranked = running_total(files, keys, ties, F.lit(1), "_r")
    present = files.select(*keys)
    if existing is not None:
        stored = existing.select(*keys).distinct()
        ranked = ranked.join(stored.withColumn("_stored", F.lit(1)), keys, "left")
        ranked = ranked.withColumn("_r", F.col("_r") + F.coalesce("_stored", F.lit(0))).drop("_stored")
        present = present.unionByName(stored)
    reserved = running_total(_reserved_numbers(present, dir_col, name_col), keys, [F.col("_k")], F.lit(1), "_i")
    # of the numbers below reserved number k, k - 1 - i are free: repeats beyond those have to step over it
    steps = reserved.select(*keys, (F.col("_k") - 1 - F.col("_i")).alias("_r"), F.lit(1).alias("_kind"))
    rows = ranked.withColumn("_kind", F.lit(0)).unionByName(steps, allowMissingColumns=True)
    stepped = running_total(rows, keys, [F.col("_r"), F.col("_kind")], F.col("_kind"), "_below").filter("_kind = 0")
    k = (F.col("_r") + F.col("_below")).cast("string")
    base, ext = naming.split_name(F.col(name_col))
    final = F.when(F.col("_r") == 0, F.col(name_col)).otherwise(F.concat(base, F.lit("("), k, F.lit(")"), ext))
    return stepped.withColumn("final_name", final).select(*files.columns, "final_name")


FILENAME_STRATEGIES = {}


def filename_strategy(name: str):
    """Register ``Callable[[DataFrame], DataFrame]`` adding ``final_name`` under a strategy name."""
    def register(fn):
        FILENAME_STRATEGIES[name] = fn
        return fn

    return register


@filename_strategy("default")
def _by_upload_id(files: DataFrame) -> DataFrame:
    return files.withColumn("final_name", F.col("upload_id").cast("string"))


@filename_strategy("original")
def _by_original_name(files: DataFrame) -> DataFrame:
    given = naming.sanitize_filename(F.col("name"))
    return files.withColumn("final_name", F.coalesce(given, F.col("upload_id").cast("string")))


@filename_strategy("number")
def _numbered(files: DataFrame) -> DataFrame:
    return number_duplicates(files.withColumn("name", naming.sanitize_filename(F.col("name"))))


def final_names(files: DataFrame, strategy: str = "default") -> DataFrame:
    """Stored names by a registered strategy; an unknown one falls back to the default."""
    return FILENAME_STRATEGIES.get(strategy, FILENAME_STRATEGIES["default"])(files)


def pending_uploads(storage: DataFrame) -> DataFrame:
    """Staged files paired with the metadata of their ``.info`` file (defaults when unreadable).

    ``storage`` holds (name, size, content); metadata, parts and assembled files are no uploads.
    """
    name = F.col("name")
    uploads = storage.filter(~name.rlike(r"\.(json|info|uploaded)$") & ~name.startswith("assembled-"))
    info = storage.filter(name.endswith(".info")).select(
        F.regexp_replace("name", r"\.info$", "").alias("name"),
        F.get_json_object("content", "$.metadata.filename").alias("_filename"),
        F.get_json_object("content", "$.metadata.userId").alias("_user"),
    )
    joined = uploads.select("name", "size").join(info, "name", "left")
    return joined.select(
        F.col("name").alias("upload_id"),
        F.coalesce("_filename", "name").alias("filename"),
        F.coalesce("_user", F.lit("default-user")).alias("user_id"),
        F.when(F.col("size") > 0, "success").otherwise("error").alias("status"),
    )


def job_progress(items: DataFrame, key: str = "job_id") -> DataFrame:
    """Progress and status per job; results stay hidden (null) until the job has completed."""
    done = F.count_if(F.col("status").isin("success", "error"))
    n_ok = F.count_if(F.col("status") == "success")
    grouped = items.groupBy(key).agg(F.count("*").alias("total"), done.alias("finished"), n_ok.alias("successful"))
    state = (
        F.when(F.col("finished") < F.col("total"), "processing")
        .when(F.col("successful") == 0, "failed")
        .otherwise("completed")
    )
    return grouped.select(
        key,
        "total",
        "finished",
        F.floor(F.col("finished") * 100 / F.col("total") + F.lit(0.5)).cast("int").alias("progress"),
        state.alias("status"),
        F.when(state == "completed", F.col("successful")).alias("results"),
    )
