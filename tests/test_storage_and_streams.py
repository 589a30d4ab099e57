"""History tables on disk, log files, and the streaming jobs over several landed files."""

import os
import subprocess
import sys
import textwrap
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetspan.operators import ingest
from fleetspan.sources import landing
from fleetspan.sources.versioned import VersionedTable
from fleetspan.streaming import jobs, membership

NOW = datetime(2024, 1, 31, 12)
STATE = 4


def history(spark, hours):
    rows = [("srv0", NOW - timedelta(hours=h), "w", h) for h in hours]
    return spark.createDataFrame(rows, "server_name string, capture_time timestamp_ntz, wait_type string, wait_time_ms long")


def test_append_read_and_purge(spark, tmp_path):
    path = str(tmp_path / "waits")
    landing.append_history(history(spark, range(0, 96)), path)
    landing.append_history(history(spark, range(96, 120)), path)
    assert spark.read.parquet(path).count() == 120
    recent = landing.read_history(spark, path, since=NOW - timedelta(hours=10))
    assert recent.count() == 11
    assert "PartitionFilters: [isnotnull(capture_date" in recent._jdf.queryExecution().executedPlan().toString()

    removed = landing.purge_history(spark, path, NOW, retention_days=2)
    assert removed == 119 - 48
    kept = spark.read.parquet(path)
    assert kept.count() == 49 and kept.agg(F.max("wait_time_ms")).first()[0] == 48
    days = sorted(d for d in os.listdir(path) if d.startswith("capture_date="))
    assert days == ["capture_date=2024-01-29", "capture_date=2024-01-30", "capture_date=2024-01-31"]
    assert landing.purge_history(spark, path, NOW, retention_days=2) == 0


def test_purge_on_a_day_boundary(spark, tmp_path):
    path = str(tmp_path / "waits")
    landing.append_history(history(spark, range(0, 60)), path)
    midnight = datetime(2024, 1, 31)
    assert landing.purge_history(spark, path, midnight + timedelta(days=1), retention_days=1) == 60 - 13
    assert spark.read.parquet(path).count() == 13


def test_log_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        "2024-01-31 10:00:00.123 UTC [77] bob@sales LOG:  connection received: host=10.1.2.3 port=1\n"
        "2024-01-31 10:00:01.000 UTC [77] bob@sales LOG:  disconnection: session time: 0:01 user=bob database=sales host=10.1.2.3 port=1\n"
        "2024-01-31 10:00:02.000 UTC [78] eve@sales FATAL:  password authentication failed for user \"eve\"\n"
        "2024-01-20 10:00:02.000 UTC [78] eve@sales FATAL:  password authentication failed for user \"eve\"\n"
        "2024-01-31 10:00:03.000 UTC [5] @ LOG:  checkpoint starting: time\n"
        "broken connection line\n"
    )
    lines = landing.read_log_lines(spark, str(tmp_path))
    out = ingest.parse_connection_log(lines, NOW, days_back=1).orderBy("log_time").collect()
    assert [(r.username, r.database_name, r.client_addr, r.event_type, r.process_id) for r in out] == [
        ("bob", "sales", "10.1.2.3", "LOGIN", 77), ("bob", "sales", "10.1.2.3", "LOGOUT", 77), ("eve", "sales", None, "FAILED_LOGIN", 78)
    ]
    assert out[0].log_time == datetime(2024, 1, 31, 10, 0, 0, 123000)


def land(df, folder, name):
    """One landed file, in arrival order by name and time."""
    target = folder / name
    df.coalesce(1).write.parquet(str(target))
    return target


def drain(spark, stream, tmp_path, label, **kw):
    out, progress = str(tmp_path / label), str(tmp_path / f"{label}-progress")
    jobs.run_append(stream, out, progress, STATE, **kw)
    return spark.read.parquet(out)


def test_ingest_keeps_late_rows_and_drops_redelivered_ones(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    out, progress = str(tmp_path / "ingest"), str(tmp_path / "progress")
    first = history(spark, [5, 4, 3])
    schema = first.schema
    capture = lambda raw: raw.where("wait_time_ms > 0")

    def run():
        stream = jobs.snapshot_stream(spark, f"{source}/*", schema, files_per_batch=1)
        jobs.run_batches(stream, jobs.ingest_batches(out, capture, ["server_name", "capture_time", "wait_type"], "capture_time"), progress, STATE)
        return sorted(r.wait_time_ms for r in spark.read.parquet(out).collect())

    land(first, source, "f1")
    assert run() == [3, 4, 5]
    land(history(spark, [3, 2, 1, 0]), source, "f2")  # hour 3 again, hour 0 has no wait
    land(history(spark, [90, 1]), source, "f3")  # a server that was silent for days
    assert run() == [1, 2, 3, 4, 5, 90]


def test_append_new_is_repeatable(spark, tmp_path):
    path = str(tmp_path / "h")
    rows = history(spark, [1, 2, 3]).unionByName(spark.createDataFrame([("srv9", None, "w", 7)], history(spark, [1]).schema))
    for _ in range(2):
        landing.append_new(spark, rows, path, ["server_name", "capture_time", "wait_type"])
    assert spark.read.parquet(path).count() == 4
    assert landing.purge_history(spark, path, NOW, retention_days=1) == 0  # rows without a time stay
    assert spark.read.parquet(path).count() == 4


def test_wait_windows_drop_late_rows(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    minute = lambda m: datetime(2024, 1, 31, 0) + timedelta(minutes=m)
    schema = "server_name string, capture_time timestamp_ntz, wait_type string, wait_time_ms long, waiting_tasks long"
    files = [
        [("s", minute(1), "w", 10, 1), ("s", minute(14), "w", 5, 1)],
        [("s", minute(16), "w", 7, 1), ("s", minute(60), "w", 1, 1)],
        [("s", minute(61), "w", 2, 1)],
        [("s", minute(2), "w", 1000, 1)],  # its window was closed by the watermark of the second file
        [("s", minute(200), "w", 3, 1)],
    ]
    for i, data in enumerate(files):
        land(spark.createDataFrame(data, schema), source, f"f{i}")
        time.sleep(0.05)
    stream = jobs.snapshot_stream(spark, f"{source}/*", spark.createDataFrame([], schema).schema, files_per_batch=1)
    out = drain(spark, jobs.wait_windows(stream), tmp_path, "windows").orderBy("window_start").collect()
    assert [(r.window_start, r.wait_time_ms, r.waiting_tasks) for r in out] == [
        (minute(0), 15, 2), (minute(15), 7, 1), (minute(60), 3, 2)
    ]


def test_membership_compares_a_server_with_its_own_last_snapshot(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    day = lambda d: datetime(2024, 1, d)
    schema = "server_name string, principal string, snapshot_time timestamp_ntz"
    files = [
        [("s", n, day(1)) for n in "ab"] + [("late", "x", day(1))],
        [("s", "a", day(2))],  # the rest of this snapshot comes in the next file
        [("s", n, day(2)) for n in "bc"],
        [("s", n, day(4)) for n in "bc"],  # no snapshot on day 3
        [("late", n, day(2)) for n in "xy"],  # a late server
        [("s", "c", day(5)), ("s", "a", day(1))],  # and a row of a snapshot that was compared long ago
    ]
    out, progress = str(tmp_path / "m"), str(tmp_path / "mp")
    empty = spark.createDataFrame([], schema).schema
    for i, data in enumerate(files):
        land(spark.createDataFrame(data, schema), source, f"f{i}")
        time.sleep(0.05)
    stream = jobs.snapshot_stream(spark, f"{source}/*", empty, files_per_batch=1)
    jobs.run_batches(stream, jobs.membership_batches(out), progress, STATE)
    read = lambda: sorted((r.server_name, r.change_time, r.principal, r.action_type) for r in spark.read.parquet(f"{out}/changes").collect())
    settled = [
        ("late", day(1), "x", "ADDED"), ("s", day(1), "a", "ADDED"), ("s", day(1), "b", "ADDED"), ("s", day(2), "c", "ADDED"),
        ("s", day(4), "a", "REMOVED"),
    ]
    assert read() == settled  # the newest snapshot of each server waits
    assert [r.principal for r in spark.read.parquet(f"{out}/late").collect()] == ["a"]
    land(spark.createDataFrame([("s", "c", day(6))], schema), source, "f9")
    jobs.run_batches(
        jobs.snapshot_stream(spark, f"{source}/*", empty, files_per_batch=1), jobs.membership_batches(out, complete=True), progress, STATE
    )
    assert read() == sorted([*settled, ("late", day(2), "y", "ADDED"), ("s", day(5), "b", "REMOVED")])


SESSIONS = (
    "server_name string, capture_time timestamp_ntz, session_id long, blocking_session_id long, login_name string, status string, "
    "program_name string, wait_type string, wait_time_ms long, query_text string"
)


def last_progress(spark, stream, out, checkpoint):
    """Drain a stream into parquet and return the progress of its batches."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    with jobs.state_width(spark, STATE):
        query = writer.start(out)
        query.awaitTermination()
    return query.recentProgress


def test_blocking_pairs_meet_across_files_and_state_ends(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    minute = lambda m: NOW + timedelta(minutes=m)
    row = lambda m, i, b, server="s": (server, minute(m), i, b, "l", "running", "p", None, 9, "q")
    files = [
        [row(0, 1, 2), row(0, 5, 2, "t")],  # the blocker of 1 comes two files later
        [row(0, 7, 8), row(1, 1, 9)],
        [row(0, 2, 0), row(1, 9, 1)],
        [row(0, 8, 0), row(5, 3, 4)],  # the last blocker within the delay; 5 on server t has none
        *[[row(20 + m, i, i + 1) for i in range(10)] for m in range(0, 200, 20)],
        [row(0, 4, 0)],  # behind the watermark
    ]
    for i, data in enumerate(files):
        land(spark.createDataFrame(data, SESSIONS), source, f"f{i:02d}")
        time.sleep(0.02)
    stream = jobs.snapshot_stream(spark, f"{source}/*", spark.createDataFrame([], SESSIONS).schema, files_per_batch=1)
    out = str(tmp_path / "b")
    progress = last_progress(spark, jobs.blocking_stream(stream, "10 minutes", 1), out, str(tmp_path / "bp"))
    got = sorted((r.server_name, r.capture_time, r.blocked_session, r.blocking_session) for r in spark.read.parquet(out).collect() if r.capture_time < minute(20))
    assert got == [("s", minute(0), 1, 2), ("s", minute(0), 7, 8), ("s", minute(1), 1, 9), ("s", minute(1), 9, 1)]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in progress if p["stateOperators"]]
    assert max(rows) <= 60  # two captures of ten sessions on both sides, however many captures there were
    read = [p["numInputRows"] for p in progress if p["numInputRows"]]
    assert max(read) <= 2 * 10 + 2  # each side reads the batch's own file and nothing else


def test_unique_ingest_drops_repeats_and_merges_what_is_older_than_its_memory(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    day = lambda d, h=0: datetime(2024, 1, d, h)
    schema = "server_name string, capture_time timestamp_ntz, n long, delivered timestamp_ntz"
    files = [
        [("s", day(1), 1, day(1)), ("s", day(1), 1, day(1)), ("s", None, 9, day(1))],
        [("s", day(1), 1, day(2)), ("s", day(2), 2, day(2))],  # again within the memory
        [("s", day(10), 3, day(10))],
        [("s", day(11), 4, day(11))],
        [("s", day(1), 1, day(12)), ("t", day(1), 5, day(12)), ("t", day(1), 5, day(12)), ("s", day(12), 6, day(12))],  # long forgotten, and a late server
    ]
    empty = spark.createDataFrame([], schema).schema
    out, keys = str(tmp_path / "u"), ["server_name", "capture_time"]

    def run():
        stream = jobs.snapshot_stream(spark, f"{source}/*", empty, files_per_batch=1)
        seen = jobs.ingest_unique(stream, lambda raw: raw.where("n > 0"), keys, "capture_time", "2 DAYS", F.col("delivered"))
        jobs.run_batches(seen, jobs.unique_batches(out, "capture_time"), str(tmp_path / "up"), STATE)

    for i, data in enumerate(files[:2]):
        land(spark.createDataFrame(data, schema), source, f"f{i}")
        time.sleep(0.05)
    run()
    for i, data in enumerate(files[2:], 2):
        land(spark.createDataFrame(data, schema), source, f"f{i}")
        time.sleep(0.05)
    run()  # goes on from its checkpoint
    history, late = VersionedTable(spark, f"{out}/history"), VersionedTable(spark, f"{out}/late")
    numbers = lambda t: sorted(r.n for r in t.read().collect())
    assert numbers(history) == [1, 2, 3, 4, 6]
    assert numbers(late) == [1, 5, 9]
    assert jobs.merge_late(spark, out, keys) == 2
    assert numbers(history) == [1, 2, 3, 4, 5, 6, 9] and numbers(late) == []
    assert jobs.merge_late(spark, out, keys) == 0
    run()
    assert numbers(history) == [1, 2, 3, 4, 5, 6, 9]


def test_a_repeated_batch_is_not_stored_twice(spark, tmp_path):
    df = history(spark, [1, 2]).withColumn("needs_merge", F.lit(False))
    handle = jobs.unique_batches(str(tmp_path / "x"), "capture_time")
    for batch in (0, 0, 1, 1, 0):
        handle(df, batch)
    assert VersionedTable(spark, str(tmp_path / "x/history")).read().count() == 4


def membership_state(spark, source, tmp_path, slots=4, **kw):
    schema = spark.createDataFrame([], "server_name string, principal string, snapshot_time timestamp_ntz").schema
    stream = jobs.snapshot_stream(spark, f"{source}/*", schema, files_per_batch=1)
    with membership.rocksdb_state(spark):
        return last_progress(spark, membership.membership_changes(stream, slots=slots, **kw), str(tmp_path / "m"), str(tmp_path / "mp"))


def test_membership_state_closes_snapshots_goes_on_and_stays_small(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d - 1)
    schema = "server_name string, principal string, snapshot_time timestamp_ntz"
    many = [f"p{i}" for i in range(40)]
    files = [
        [("s", n, day(1)) for n in [*many, "a", "b"]] + [("t", "x", day(1)), (None, "x", day(1)), ("t", None, day(1))],
        [("s", "a", day(2))],  # the rest of this snapshot comes in the next file
        [("s", n, day(2)) for n in [*many, "b", "c", "c"]],
        [("t", n, day(2)) for n in "xy"],  # a server that delivers late, within the delay
        [("s", n, day(4)) for n in [*many, "b", "c"]],  # no snapshot on day 3
        [("s", "z", day(7)), ("t", "y", day(7))],  # all but one go at once
    ]
    def land_all(some, first):
        for i, data in enumerate(some, first):
            land(spark.createDataFrame(data, schema), source, f"f{i:02d}")
            time.sleep(0.05)

    def changes():
        rows = spark.read.parquet(str(tmp_path / "m")).collect()
        assert len(rows) == len({(r.server_name, r.principal, r.change_time) for r in rows})
        return {(r.server_name, r.change_time.day, r.principal, r.action_type) for r in rows if r.principal not in many}, sum(r.principal in many for r in rows)

    land_all(files[:4], 0)
    membership_state(spark, source, tmp_path, delay="36 hours")
    assert changes() == (set(), 0)  # nothing is certain yet
    land_all(files[4:5], 4)
    membership_state(spark, source, tmp_path, delay="36 hours")  # restarted from its checkpoint
    settled = {("s", 1, "a", "ADDED"), ("s", 1, "b", "ADDED"), ("t", 1, "x", "ADDED"), ("s", 2, "c", "ADDED"), ("t", 2, "y", "ADDED")}
    assert changes() == (settled, 40)
    land_all(files[5:], 5)
    land_all([[("s", "z", day(9)), ("t", "y", day(9))]], 6)
    membership_state(spark, source, tmp_path, delay="36 hours")
    settled |= {("s", 4, "a", "REMOVED"), ("s", 7, "b", "REMOVED"), ("s", 7, "c", "REMOVED"), ("s", 7, "z", "ADDED"), ("t", 7, "x", "REMOVED")}
    assert changes() == (settled, 80)
    # A long run of snapshots of the same members: the state is what one of them needs.
    land_all([[("s", "z", day(d)), ("t", "y", day(d))] for d in range(10, 25)], 10)
    progress = membership_state(spark, source, tmp_path, delay="36 hours")
    sizes = [o["numRowsTotal"] for p in progress for o in p["stateOperators"] if "transform" in o["operatorName"].lower()]
    assert sizes and max(sizes[-3:]) <= max(sizes[:5]) + 8
    assert changes() == (settled, 80)


def test_membership_state_of_a_silent_server_is_dropped(spark, tmp_path):
    source = tmp_path / "landed"
    source.mkdir()
    day = lambda d: datetime(2024, 1, 1) + timedelta(days=d - 1)
    schema = "server_name string, principal string, snapshot_time timestamp_ntz"
    for i, data in enumerate([[("s", "a", day(1)), ("t", "b", day(1))], *[[("t", "b", day(d))] for d in range(2, 14)], [("s", "a", day(14)), ("t", "b", day(14))], [("t", "b", day(20))]]):
        land(spark.createDataFrame(data, schema), source, f"f{i:02d}")
        time.sleep(0.02)
    membership_state(spark, source, tmp_path, delay="12 hours", retire_after_days=5, slots=2)
    got = sorted((r.server_name, r.principal, r.change_time.day, r.action_type) for r in spark.read.parquet(str(tmp_path / "m")).collect())
    assert got == [("s", "a", 1, "ADDED"), ("s", "a", 14, "ADDED"), ("t", "b", 1, "ADDED")]


def test_newest_version_is_read(spark, tmp_path):
    path = str(tmp_path / "v")
    write = jobs.replace_table(path)
    for i, n in enumerate((3, 5)):
        write(spark.range(n), i)
    assert jobs.read_newest(spark, path).count() == 5


def test_driver_contract_from_another_folder(tmp_path):
    """Workers do not find the package on their own path when the driver starts elsewhere."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
        import importlib.util
        spec = importlib.util.spec_from_file_location("driver_entry", {repo + "/__spark_entry__.py"!r})
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        from pyspark.sql import SparkSession
        spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config(
            "spark.checkpoint.dir", {str(tmp_path)!r}).getOrCreate()
        assert module.entry(spark).count() > 0
        rows = module.queries()["r04_stream_membership_changes"](spark, "/root/testdata/sf0.001").count()
        print("rows", rows)
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("rows")[1]) > 0
