"""Object listings in batch and as a stream over a folder that grows."""

from __future__ import annotations

import os
import time

import pytest

from docspark.sources import files, listing


@pytest.fixture
def folder(tmp_path):
    for i in range(40):
        place = tmp_path / "objects" / f"user{i % 4}" / ("deep/er" if i % 3 else "")
        place.mkdir(parents=True, exist_ok=True)
        (place / f"file {i}.{'txt' if i % 2 else 'bin'}").write_bytes(b"x" * i)
    (tmp_path / "objects" / "top é.txt").write_text("top")
    (tmp_path / "objects" / "empty").mkdir()
    return tmp_path / "objects"


def found(df):
    return sorted((r.key, r.size, r.last_modified) for r in df.collect())


def on_disk(folder, suffix=""):
    paths = [os.path.join(at, f) for at, _, names in os.walk(folder) for f in names if f.endswith(suffix)]
    return sorted((p, os.path.getsize(p)) for p in paths)


@pytest.mark.parametrize("prefixes", [1, 3, 64])
def test_every_object_once(spark, folder, prefixes):
    got = found(listing.list_objects(spark, str(folder), prefixes=prefixes))
    assert [r[:2] for r in got] == on_disk(folder)
    assert got == found(listing.list_objects(spark, folder.as_uri(), prefixes=prefixes))


def test_same_as_the_plain_listing(spark, folder):
    """But for empty objects, which the plain one leaves out."""
    def millis(rows):
        return sorted((size, at.replace(microsecond=at.microsecond // 1000 * 1000)) for size, at in rows if size > 0)

    plain = millis((r.size, r.last_modified) for r in files.scan_objects(spark, str(folder)).collect())
    assert plain == millis(r[1:] for r in found(listing.list_objects(spark, str(folder))))


def test_options(spark, folder):
    assert [r[:2] for r in found(listing.list_objects(spark, str(folder), glob="*.bin"))] == on_disk(folder, ".bin")
    assert [r[0] for r in found(listing.list_objects(spark, str(folder), recursive=False))] == [str(folder / "top é.txt")]
    assert found(listing.list_objects(spark, str(folder / "empty"))) == found(listing.list_objects(spark, str(folder / "absent"))) == []


def test_prefixes_are_shared_out(spark, folder):
    assert listing.list_objects(spark, str(folder), prefixes=8).rdd.getNumPartitions() > 4


def test_stream_over_a_growing_folder(spark, folder, tmp_path):
    def drain():
        stream = listing.object_stream(spark, str(folder), settle_seconds=0)
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "rows")).option("checkpointLocation", str(tmp_path / "state"))
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    def rows():
        return found(spark.read.parquet(str(tmp_path / "rows")))

    assert drain() == 41 and rows() == found(listing.list_objects(spark, str(folder)))
    time.sleep(0.05)
    for i in range(5):
        (folder / "user1" / f"late {i}").write_bytes(b"y" * i)
    time.sleep(0.05)
    assert drain() == 5 and rows() == found(listing.list_objects(spark, str(folder)))
    time.sleep(0.05)
    (folder / "user1" / "late 0").write_bytes(b"longer now")
    time.sleep(0.05)
    assert drain() == 1 and [r[1] for r in rows() if r[0].endswith("late 0")] == [0, 10]
    assert drain() == 0


def test_young_objects_wait(spark, folder, tmp_path):
    stream = listing.object_stream(spark, str(folder), settle_seconds=3600)
    old = time.time() - 7200
    os.utime(folder / "top é.txt", (old, old))
    query = stream.writeStream.format("memory").queryName("young").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r.size for r in spark.table("young").collect()] == [3]
