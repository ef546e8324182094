"""Streams give what the batch forms give."""

import datetime as dt

from pyspark.sql import Row
from pyspark.sql import functions as F

from docspark.operators import logs as batch_logs
from docspark.operators import uploads as batch_uploads
from docspark.streaming import logs, uploads

START = dt.datetime(2024, 1, 1, 0, 0, 0)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def stream_of(spark, df, folder, schema=None):
    """The rows of ``df`` as a stream that reads one file per micro-batch."""
    df.write.mode("overwrite").parquet(folder)
    return (
        spark.readStream.schema(schema or df.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(folder)
    )


def staged(spark, batches, schema, folder):
    """A stream over several folders written in order, one micro-batch each."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/b{i:02d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option(
        "recursiveFileLookup", "true").parquet(folder)


def run(stream, tmp_path, name, mode="append"):
    query = (
        stream.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-cp")).trigger(availableNow=True).start()
    )
    query.awaitTermination(240)
    assert query.exception() is None
    return stream.sparkSession.table(name)


def test_assemble_and_expire(spark, tmp_path):
    schema = "multipart_id bigint, part_index int, total_parts int, upload_id bigint, ts timestamp"
    batches = [
        [(1, 0, 2, 10, at(0)), (2, 1, 3, 21, at(1)), (3, 0, 2, 30, at(2))],
        [(1, 1, 2, 11, at(5)), (2, 0, 3, 20, at(6)), (2, 1, 3, 22, at(7))],
        [(9, 0, 5, 90, at(200))],
        [(9, 1, 5, 91, at(201))],
        [(3, 1, 2, 31, at(202))],
        [(9, 2, 5, 92, at(203))],
    ]
    stream = staged(spark, batches, schema, str(tmp_path / "parts"))
    out = {(r.multipart_id, r.outcome): list(r.part_uploads)
           for r in run(uploads.assemble_multipart(stream), tmp_path, "assembled").collect()}
    assert out[(1, "assembled")] == [10, 11]
    assert out[(2, "expired")] == [20, 22]
    assert out[(3, "expired")] == [30]
    assert (3, "assembled") not in out and (9, "assembled") not in out
    flat = spark.createDataFrame([r for b in batches[:2] for r in b], schema)
    done = {r.multipart_id: r.part_uploads for r in batch_uploads.assemble_multipart(flat).collect()}
    assert done == {1: [10, 11]}
    stale = batch_uploads.stale_assemblies(flat, F.lit(at(100)))
    assert {r.multipart_id for r in stale.collect()} == {2, 3}


def test_failed_ledger(spark, tmp_path):
    schema = "upload_id bigint, ts timestamp, outcome string, error string"
    batches = [
        [(1, at(0), "failure", "a"), (2, at(1), "failure", "b")],
        [(1, at(2), "success", None), (2, at(3), "failure", "c")],
        [(3, at(4), "failure", "d"), (4, at(5), "success", None)],
    ]
    stream = staged(spark, batches, schema, str(tmp_path / "outcomes"))
    query = uploads.failed_ledger(stream, str(tmp_path / "ledger"), str(tmp_path / "ledger-cp"))
    query.awaitTermination(120)
    got = {tuple(r) for r in uploads.open_failures(spark, str(tmp_path / "ledger")).collect()}
    flat = spark.createDataFrame([r for b in batches for r in b], schema)
    want = {tuple(r) for r in batch_uploads.failed_ledger(flat).collect()}
    assert got == want and {r[0] for r in got} == {2, 3}
    # a new checkpoint goes on from the old ledger
    again = staged(spark, [[(2, at(9), "success", None), (5, at(9), "failure", "e")]], schema, str(tmp_path / "more"))
    uploads.failed_ledger(again, str(tmp_path / "ledger"), str(tmp_path / "other-cp")).awaitTermination(120)
    assert {r.upload_id for r in uploads.open_failures(spark, str(tmp_path / "ledger")).collect()} == {3, 5}


LEDGER_ROWS = "upload_id bigint, ts timestamp, outcome string, error string"


def stored(path):
    """Versions of each bucket, with the bytes of their files."""
    import pathlib

    return {(p.parts[-5], p.parts[-4]): p.stat().st_size for p in pathlib.Path(path).rglob("*.parquet")}


def test_ledger_batches_write_their_own_buckets(spark, tmp_path):
    path = str(tmp_path / "ledger")
    many = spark.createDataFrame([(i, at(i % 50), "failure", "e" * 50) for i in range(4000)], LEDGER_ROWS)
    uploads.update_ledger(many, 0, path, "run")
    before = stored(path)
    assert len({b for b, _ in before}) == uploads.BUCKETS
    one = spark.createDataFrame([(17, at(60), "failure", "again"), (None, at(60), "failure", "nobody's")], LEDGER_ROWS)
    uploads.update_ledger(one, 1, path, "run")
    written = {k: n for k, n in stored(path).items() if k not in before}
    assert len(written) == 1 and sum(written.values()) < 2 * sum(before.values()) / uploads.BUCKETS
    assert before.items() <= stored(path).items()
    for epoch in (2, 3):  # versions before the last one go
        uploads.update_ledger(one.withColumn("ts", F.lit(at(60 + epoch))), epoch, path, "run")
    assert {v for b, v in stored(path) if b == next(iter(written))[0]} == {"version=2", "version=3"}
    assert {r.upload_id: r.failures for r in uploads.open_failures(spark, path).collect()} == {i: 4 if i == 17 else 1 for i in range(4000)}


def test_ledger_replay_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "ledger")
    first = spark.createDataFrame([(i, at(i), "failure", "a") for i in range(6)], LEDGER_ROWS)
    second = spark.createDataFrame([(1, at(200), "success", None), (2, at(201), "failure", "b"), (2, at(90), "failure", "c"), (9, at(202), "failure", "d")], LEDGER_ROWS)
    third = spark.createDataFrame([(1, at(150), "failure", "late"), (2, at(400), "success", None), (2, at(401), "failure", "e"), (3, at(300), "failure", "f")], LEDGER_ROWS)
    results = []
    for epoch, batch in enumerate((first, second, third)):
        for _ in range(2):
            uploads.update_ledger(batch, epoch, path, "run", buckets=2)
            results.append(sorted(tuple(r) for r in uploads.open_failures(spark, path).collect()))
        assert results[-1] == results[-2]
    assert {(r[0], r[2], r[3]) for r in results[-1]} == {(0, "a", 1), (2, "e", 1), (3, "f", 2), (4, "a", 1), (5, "a", 1), (9, "d", 1)}


def test_closed_uploads_leave_the_ledger(spark, tmp_path):
    path = str(tmp_path / "ledger")
    batches = [
        [(i, at(0), "failure", "a") for i in range(20)], [(i, at(1), "success", None) for i in range(15)], [(99, at(500), "failure", "b")],
        [(99, at(501), "failure", "b")], [(3, at(2), "failure", "too late"), (16, at(3), "failure", "late but known")],
    ]
    for epoch, rows in enumerate(batches):
        uploads.update_ledger(spark.createDataFrame(rows, LEDGER_ROWS), epoch, path, "run", buckets=1)
    rows = uploads._newest(uploads._stored(spark, path)).filter("upload_id IS NOT NULL").collect()
    assert {r.upload_id: (r.failures, r.outcome) for r in rows} == {**{i: (1 + (i == 16), "failure") for i in range(15, 20)}, 99: (2, "failure")}
    # a new run with another checkpoint goes on from there
    uploads.update_ledger(spark.createDataFrame([(15, at(502), "success", None)], LEDGER_ROWS), 0, path, "other", buckets=1)
    assert {r.upload_id for r in uploads.open_failures(spark, path).collect()} == {16, 17, 18, 19, 99}


def test_rate_limit_stream(spark, tmp_path):
    rows = [(c, at(m)) for c in (1, 2) for m in range(0, 40, 1 if c == 1 else 6)]
    schema = "user_id bigint, created_at timestamp"
    stream = staged(spark, [rows, [(5, at(500))], [(5, at(501))]], schema, str(tmp_path / "req"))
    got = {tuple(r) for r in run(
        logs.rate_limit_violations(stream, limit=3), tmp_path, "violations").collect()}
    want = {tuple(r) for r in batch_logs.rate_limit_violations(spark.createDataFrame(rows, schema), limit=3).collect()}
    assert got == want and got


def test_request_log_stream(spark, tmp_path):
    schema = ("request_id bigint, created_at timestamp, method string, status_code int, body string, "
              "forwarded_for string, remote_ip string")
    rows = [
        (1, at(0), "POST", 200, '{"a":{"Token":{"x":{"y":1}}},"b":2}', "1.1.1.1, 2.2.2.2", "9.9.9.9"),
        (2, at(1), "GET", 404, '{"password":"p"}', None, "9.9.9.9"),
    ]
    stream = staged(spark, [rows, rows[:1]], schema, str(tmp_path / "raw"))
    query = logs.store_logs(logs.request_log_rows(stream), str(tmp_path / "store"), str(tmp_path / "store-cp"))
    query.awaitTermination(120)
    stored = {r.request_id: r for r in spark.read.parquet(str(tmp_path / "store")).collect()}
    assert len(stored) == 2 and spark.read.parquet(str(tmp_path / "store")).count() == 2
    assert stored[1].body == '{"a":{"Token":"[REDACTED]"},"b":2}'
    assert stored[1].ip == "1.1.1.1" and stored[2].ip == "9.9.9.9"
    assert stored[2].level == "warn" and stored[2].body == '{"password":"[REDACTED]"}'


ITEMS = "job_id bigint, item_id bigint, ts timestamp, status string"


def drained(spark, batches, tmp_path, **more):
    """The stream's rows by epoch, and its last query."""
    path = str(tmp_path / "progress")
    query = logs.store_progress(logs.job_progress(staged(spark, batches, ITEMS, str(tmp_path / "items")), **more), path, str(tmp_path / "cp"))
    query.awaitTermination(240)
    assert query.exception() is None
    return path, query


def test_job_progress_stream(spark, tmp_path):
    batches = [
        [(1, 1, at(0), "success"), (1, 2, at(1), "pending"), (2, 5, at(1), "error")],
        [(1, 3, at(2), "success"), (2, 6, at(2), "error"), (1, 1, at(0), "success")],  # 1 is sent again
        [(1, 2, at(4), "success"), (2, 6, at(0), "success")],  # 2 ends; an old status of 6 comes late
    ]
    path, query = drained(spark, batches, tmp_path)
    rows = {(r.epoch, r.job_id): r for r in spark.read.schema(logs.PROGRESS + ", epoch bigint").parquet(path).collect()}
    assert (rows[0, 1].total, rows[0, 1].finished, rows[0, 1].status, rows[0, 1].results) == (2, 1, "processing", None)
    assert (rows[1, 1].total, rows[1, 1].progress) == (3, 67) and rows[1, 2].status == "failed"
    latest = {r.job_id: r for r in logs.latest_progress(spark, path).collect()}
    assert (latest[1].total, latest[1].finished, latest[1].status, latest[1].results) == (3, 3, "completed", 3)
    assert (latest[2].total, latest[2].status, latest[2].results) == (2, "failed", None)
    flat = spark.createDataFrame([(1, "success"), (1, "success"), (1, "success"), (2, "error"), (2, "error")], "job_id bigint, status string")
    want = {r.job_id: r for r in batch_uploads.job_progress(flat).collect()}
    for job, row in latest.items():
        assert all(row[c] == want[job][c] for c in want[job].asDict())
    seen = [p["observedMetrics"]["job_items"] for p in query.recentProgress if p["numInputRows"]]
    assert [(m["items"], m["finished"]) for m in seen] == [(3, 2), (3, 3), (2, 2)]


def test_idle_jobs_leave_the_state(spark, tmp_path):
    batches = [[(j, i, at(60 * b + i), "success") for j in range(100 * b, 100 * b + 50) for i in range(3)] for b in range(8)]
    batches += [[(0, 77, at(1000), "error")], [(0, 78, at(1001), "success")]]
    path, query = drained(spark, batches, tmp_path, idle_seconds=1800)
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]]
    assert max(held[2:8]) <= 3 * max(held[:1])  # counts and items of two batches' jobs, however many there were
    latest = {(r.job_id, r.opened_at.hour): r for r in logs.latest_progress(spark, path).collect()}
    assert len(latest) == 401
    assert all(r.closed and r.total == 3 for (j, _), r in latest.items() if j and j < 600)
    again = [r for (j, _), r in latest.items() if j == 0]
    assert sorted((r.total, r.status) for r in again) == [(2, "completed"), (3, "completed")]


class CountedState:
    """State of one bucket, as a handle's list and value states; counts the calls."""

    def __init__(self):
        self.calls, self.states, self.timers = 0, {}, set()

    def getListState(self, name, schema):
        return self._state(name, [])

    def getValueState(self, name, schema):
        return self._state(name, None)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)

    def _state(self, name, empty):
        handle, states = self, self.states
        states[name] = empty

        class State:
            def get(self):
                handle.calls += 1
                return iter(states[name]) if empty == [] else states[name]

            def put(self, value):
                handle.calls += 1
                states[name] = value

            update = put

            def clear(self):
                self.put(empty)

        return State()


class Watermark:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = lambda: ms


def test_assembly_calls_state_per_bucket_not_per_part():
    part = Row("multipart_id", "part_index", "total_parts", "upload_id", "micros")
    handle, processor = CountedState(), uploads._assembler(3_600_000)
    processor.init(handle)
    first = [part(u, i, 4 + (u == 7), 10 * u + i, 1000 * (u + i)) for u in range(500) for i in range(4)]
    done = list(processor.handleInputRows((0,), iter(first), Watermark(0)))
    assert len(done) == 499 and handle.calls <= 10 and handle.timers == {7 + 3 + 3_600_000}
    late = [part(u, 0, 2, u, 10**6 * u) for u in range(1000, 1500)]
    assert not list(processor.handleInputRows((0,), iter(late), Watermark(0))) and handle.calls <= 20
    handle.timers.clear()
    assert [tuple(r) for r in processor.handleExpiredTimer((0,), Watermark(3_600_010), None)] == [(7, "expired", 5, [70, 71, 72, 73])]
    assert handle.calls <= 30 and handle.timers == {1000 * 1000 + 3_600_000}


def test_job_progress_calls_state_per_bucket_not_per_item():
    item = Row("job_id", "item_id", "micros", "status")
    handle, processor = CountedState(), logs._tracker(60_000)
    processor.init(handle)
    for start in (0, 1000):
        rows = [item(j, start + i, 10**6 * (start // 100 + j), "success") for j in range(5) for i in range(200)]
        out = list(processor.handleInputRows((0,), iter(rows), Watermark(0)))
    assert {(r.job_id, r.total, r.status, r.closed) for r in out} == {(j, 400, "completed", False) for j in range(5)}
    assert handle.calls <= 20 and handle.timers == {10_000 + 60_000}
    handle.timers.clear()
    out = list(processor.handleExpiredTimer((0,), Watermark(72_000), None))
    assert [(r.job_id, r.total, r.closed) for r in out] == [(j, 400, True) for j in range(3)]
    assert handle.timers == {13_000 + 60_000} and handle.calls <= 30
