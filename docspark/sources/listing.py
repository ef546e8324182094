"""Object listings as a Python data source: read in parallel by prefix, or as a stream of new objects.

The driver lists folders only until there are enough prefixes to share out; each prefix is then listed by a task,
in Arrow batches. As a stream, the offset is a point of time: a micro-batch gives the objects modified after the last offset and
up to the new one, so the driver lists no object at all and a replayed batch asks the same question again. An object that is overwritten
later comes once more, with its new size and time. Contents are never read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "object_listing"
SCHEMA = "key string, size bigint, last_modified timestamp"
#: Prefixes that are shared out to tasks: folders are opened level by level until there are this many.
PREFIXES = 64
#: Seconds that an object may take to become visible in a listing after its modification time.
SETTLE_SECONDS = 10
#: Rows of an Arrow batch.
BATCH = 10_000


def store_of(prefix: str):
    """File system and path of a prefix, given as a URI or a path."""
    from pyarrow import fs

    if prefix.startswith("file:"):
        return fs.LocalFileSystem(), "/" + prefix[5:].lstrip("/")
    return fs.FileSystem.from_uri(prefix)


class Prefix(InputPartition):
    """One folder of a listing, to be listed with all below it or for its own objects only."""

    def __init__(self, path: str, deep: bool, after: int, until: int):
        super().__init__(path)
        self.path, self.deep, self.after, self.until = path, deep, after, until


class Listing:
    """What batch and stream share: options, the division into prefixes, the objects of a prefix."""

    def __init__(self, options: dict[str, str]):
        self.prefix = options["path"]
        self.recursive = options.get("recursive", "true") == "true"
        self.glob = options.get("glob")
        self.prefixes = int(options.get("prefixes", PREFIXES))
        self.settle = float(options.get("settle_seconds", SETTLE_SECONDS))

    def divided(self, after: int, until: int) -> list[Prefix]:
        """Prefixes that hold every object exactly once; ``after`` and ``until`` bound the modification time (ns)."""
        from pyarrow import fs

        store, path = store_of(self.prefix)
        if not self.recursive:
            return [Prefix(path, False, after, until)]
        flat, level = [], [path]
        while level and len(flat) + len(level) < self.prefixes:
            below = [f.path for p in level for f in store.get_file_info(fs.FileSelector(p, allow_not_found=True)) if f.type == fs.FileType.Directory]
            flat, level = flat + level, below
        return [Prefix(p, False, after, until) for p in flat] + [Prefix(p, True, after, until) for p in level]

    def objects(self, part: Prefix) -> Iterator[pa.RecordBatch]:
        from fnmatch import fnmatchcase

        from pyarrow import fs

        store, _ = store_of(self.prefix)
        folders, rows = [part.path], []
        names = pa.schema([("key", pa.string()), ("size", pa.int64()), ("last_modified", pa.timestamp("us", "UTC"))])

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: [r[i] for r in rows] for i, n in enumerate(names.names)}, names)

        while folders:  # a folder at a time: a task holds one folder's listing, not its prefix's
            for found in store.get_file_info(fs.FileSelector(folders.pop(), allow_not_found=True)):
                if found.type == fs.FileType.Directory:
                    if part.deep:
                        folders.append(found.path)
                elif found.mtime_ns is not None and part.after < found.mtime_ns <= part.until and (self.glob is None or fnmatchcase(found.base_name, self.glob)):
                    rows.append((found.path, found.size, found.mtime_ns // 1000))
                    if len(rows) == BATCH:
                        yield batch()
                        rows = []
        if rows:
            yield batch()


class ListingReader(DataSourceReader):
    def __init__(self, options):
        self.listing = Listing(options)

    def partitions(self):
        return self.listing.divided(-(1 << 62), 1 << 62)

    def read(self, partition):
        return self.listing.objects(partition)


class ListingStream(DataSourceStreamReader):
    def __init__(self, options):
        self.listing = Listing(options)

    def initialOffset(self):
        return {"until": -(1 << 62)}

    def latestOffset(self):
        import time

        return {"until": time.time_ns() - int(self.listing.settle * 1e9)}

    def partitions(self, start, end):
        return self.listing.divided(start["until"], end["until"])

    def read(self, partition):
        return self.listing.objects(partition)


class ObjectListing(DataSource):
    """``spark.read.format("object_listing").load(prefix)``, and the same with ``readStream``.

    Options: ``recursive``, ``glob`` (of the last part of the key), ``prefixes``, ``settle_seconds`` (stream only).
    """

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ListingReader(self.options)

    def streamReader(self, schema):
        return ListingStream(self.options)


def _options(recursive: bool, glob: str | None, **more) -> dict[str, str]:
    given = {"recursive": str(recursive).lower(), "glob": glob} | more
    return {name: str(value) for name, value in given.items() if value is not None}


def list_objects(spark: SparkSession, prefix: str, recursive: bool = True, glob: str | None = None, prefixes: int = PREFIXES) -> DataFrame:
    """(key, size, last_modified) of every object under a prefix, listed by as many tasks as there are prefixes.

    An absent or empty prefix gives no row. Keys are paths in their store, without a scheme.
    """
    spark.dataSource.register(ObjectListing)
    return spark.read.format(FORMAT).options(**_options(recursive, glob, prefixes=prefixes)).load(prefix)


def object_stream(spark: SparkSession, prefix: str, recursive: bool = True, glob: str | None = None, prefixes: int = PREFIXES,
                  settle_seconds: float = SETTLE_SECONDS) -> DataFrame:
    """The same rows as a stream: all objects first, then those that arrive. Objects younger than ``settle_seconds`` wait for the next micro-batch."""
    spark.dataSource.register(ObjectListing)
    options = _options(recursive, glob, prefixes=prefixes, settle_seconds=settle_seconds)
    return spark.readStream.format(FORMAT).options(**options).load(prefix)
