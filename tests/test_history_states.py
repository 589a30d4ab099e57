"""Day partials, the newest-first search, and records out of log files."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import ingest, partials
from fleetspan.sources import landing, logfiles, newest
from fleetspan.sources.versioned import VersionedTable

NOW = datetime(2024, 1, 31, 7, 30)
SCHEMA = "server_name string, metric string, capture_time timestamp_ntz, v long"
SERIES = ["server_name", "metric"]


def measures(spark, n=600, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{rng.randint(0, 2)}", rng.choice("ab"), NOW - timedelta(minutes=rng.randint(0, 60 * 24 * 40)), rng.choice([None, rng.randint(-50, 50)])) for _ in range(n)]
    return rows + [("s0", "a", None, 7)]


def plain(rows, since):
    out = {}
    for s, m, t, v in rows:
        if t is not None and t >= since:
            out.setdefault((s, m), []).append((t, v))
    state = {}
    for key, found in out.items():
        known = [v for _, v in found if v is not None]
        state[key] = (len(known), sum(known) if known else None, min(known, default=None), max(known, default=None), min(t for t, _ in found), max(t for t, _ in found))
    return state


def collected(df):
    return {(r.server_name, r.metric): (r.samples, r.sum_value, r.least, r.greatest, r.first_time, r.last_time) for r in df.collect()}


@pytest.mark.parametrize("as_of,days", [(NOW, 30), (NOW, 1), (datetime(2024, 1, 31), 30), (NOW, 400)])
def test_window_from_states_equals_the_history(spark, as_of, days):
    rows = measures(spark)
    history = spark.createDataFrame(rows, SCHEMA)
    states = partials.day_states(history, SERIES, "v")
    got = collected(partials.window_states(states, history, SERIES, "v", as_of, days))
    assert got == plain(rows, as_of - timedelta(days=days))


def test_late_rows_patch_their_days_only(spark, tmp_path):
    rows = measures(spark)
    late = [("s1", "a", NOW - timedelta(days=12), 1000), ("s9", "b", NOW - timedelta(days=12, hours=2), -1000), ("s1", "b", NOW - timedelta(days=3), None), ("s1", "b", None, 1)]
    table = VersionedTable(spark, str(tmp_path / "days"))
    partials.store_days(table, partials.day_states(spark.createDataFrame(rows, SCHEMA), SERIES, "v"))
    before = table.manifest()["parts"]
    whole = spark.createDataFrame(rows + late, SCHEMA)
    arrived = spark.createDataFrame(late, SCHEMA)
    for _ in range(2):  # a repeated patch changes nothing
        partials.patch_days(table, whole, arrived, SERIES, "v")
        assert collected(partials.window_states(table.read(), whole, SERIES, "v", NOW, 30)) == plain(rows + late, NOW - timedelta(days=30))
    after = table.manifest()["parts"]
    touched = {d for d in after if before.get(d) != after[d]}
    assert touched == {f"state_day={(NOW - timedelta(days=n)).date()}" for n in (3, 12)}
    assert partials.patch_days(table, whole, arrived.where("capture_time IS NULL"), SERIES, "v") == table.versions()[-1]


def test_a_window_reads_one_state_per_series_and_day(spark, tmp_path):
    """Whole days come from the states; of the history only the day that the window starts in is read."""
    rows = [("s0", "a", datetime(2024, 1, d, h), d) for d in range(1, 31) for h in range(24)]
    path = str(tmp_path / "h")
    landing.append_history(spark.createDataFrame(rows, SCHEMA), path)
    table = VersionedTable(spark, str(tmp_path / "days"))
    partials.store_days(table, partials.day_states(landing.read_history(spark, path), SERIES, "v"))
    stored = partials.recent_states(table, NOW, 20)
    assert stored.count() == 20
    as_of = datetime(2024, 1, 30, 12)
    edge_day = as_of.date() - timedelta(days=20)
    history = landing.read_history(spark, path).where(F.col(landing.DATE_COL) == F.lit(edge_day))  # nothing else is asked for
    got = partials.window_states(table.read(), history, SERIES, "v", as_of, 20).collect()
    assert [(r.samples, r.first_time) for r in got] == [(20 * 24 + 12, datetime(2024, 1, 10, 12))]
    assert "capture_date" not in str(got)


def test_first_and_last_follow_time(spark):
    rows = [("s", "m", NOW - timedelta(hours=h), v) for h, v in ((50, 5), (30, 1), (2, 9), (1, 3))]
    merged = partials.merge_states(partials.day_states(spark.createDataFrame(rows, SCHEMA), SERIES, "v"), SERIES).first()
    assert (merged.first_value, merged.last_value, merged.least, merged.greatest) == (5, 3, 1, 9)


def test_sketches_merge_like_sets(spark):
    """Users seen in several captures count once; the error stays within four standard errors."""
    rows = [(f"s{c % 2}", NOW - timedelta(hours=c), "x", f"u{i}" if i % 7 else None, f"p{i % 3}", NOW - timedelta(hours=c, seconds=i)) for c in range(6) for i in range(c * 500, c * 500 + 3000)]
    sessions = spark.createDataFrame(rows, "server_name string, capture_time timestamp_ntz, status string, login_name string, program_name string, query_start timestamp_ntz")
    states = partials.connection_states(sessions, NOW)
    assert states.count() == 6
    merged = {r.server_name: r for r in partials.distinct_connections(states).collect()}
    exact = {r.server_name: r for r in partials.distinct_connections_exact(sessions, NOW).collect()}
    for s, want in exact.items():
        users = {r[3] for r in rows if r[0] == s and r[3]}
        assert want.unique_users == len(users) and want.unique_apps == 3 == merged[s].unique_apps
        assert abs(merged[s].unique_users - want.unique_users) <= 4 * 0.01625 * want.unique_users
        assert (merged[s].connections, merged[s].max_duration_s) == (want.connections, want.max_duration_s)


# -- newest first -------------------------------------------------------------------------------


@pytest.fixture
def dated(spark, tmp_path):
    """Forty days: three servers report daily, one stopped on day 25, one on day 3, and some rows have no time."""
    rows = []
    for d in range(40):
        at = datetime(2024, 1, 1) + timedelta(days=d, hours=5)
        for s in ["a", "b", "c"] + (["d"] if d <= 24 else []) + (["e"] if d <= 2 else []):
            rows += [(s, "m", at, d), (s, "n", at, d), (s, "m", at - timedelta(hours=3), -d)]
    path = str(tmp_path / "h")
    landing.append_history(spark.createDataFrame([*rows, ("a", "x", None, 0)], SCHEMA), path)
    return path


def inventory(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "server_name string")


@pytest.mark.parametrize("names,folders", [("abc", 1), ("abcd", 31), ("abcde", 40), ("az", 40), ("", 0)])
def test_folders_are_read_until_everyone_is_found(spark, dated, names, folders):
    found, probed = newest.newest_captures(spark, dated, inventory(spark, *names, *names))
    last = {"a": 39, "b": 39, "c": 39, "d": 24, "e": 2}
    assert {r.server_name: r.capture_time for r in found.collect()} == {n: datetime(2024, 1, 1) + timedelta(days=last[n], hours=5) for n in names if n in last}
    assert len(probed) == folders and probed == newest.history_days(spark, dated)[:folders]
    assert newest.history_days(spark, dated)[0] == date(2024, 2, 9)


def test_latest_rows_keep_ties_and_read_few_files(spark, dated):
    df = newest.latest_rows(spark, dated, inventory(spark, "a", "d"))
    assert sorted((r.server_name, r.metric, r.v) for r in df.collect()) == [("a", "m", 39), ("a", "n", 39), ("d", "m", 24), ("d", "n", 24)]
    days = {f.split("capture_date=")[1].split("/")[0] for f in df.inputFiles()}
    assert days == {"2024-02-09", "2024-01-25"}
    assert newest.latest_rows(spark, dated, inventory(spark, "nobody")).count() == 0


# -- log records --------------------------------------------------------------------------------

PREFIX = "2024-01-31 10:00:{:02d}.000 UTC [{}] {}@sales "


def log_text(seed):
    """A log with interleaved processes, and the records it holds."""
    rng = random.Random(seed)
    lines, records, last = [], [], {}
    if seed % 2:
        lines.append("left over from an older file")
        records.append({"line": lines[0], "added": None})
    for _ in range(60):
        pid = rng.randint(1, 4)
        head = PREFIX.format(rng.randint(0, 59), pid, f"u{pid}")
        if pid in last and rng.random() < 0.4:
            kind = rng.choice(["DETAIL", "HINT", "CONTEXT", "STATEMENT"])
            text = f"more {rng.randint(0, 9)}" + "".join(f"\n\tline {k}" for k in range(rng.randint(0, 2)))
            lines.append(f"{head}{kind}:  {text}")
            before = records[last[pid]]["added"]
            records[last[pid]]["added"] = (before + "\n" if before else "") + f"{kind}: {text}"
        else:
            text = f"{head}{rng.choice(['LOG', 'FATAL', 'ERROR'])}:  " + "x" * rng.randint(0, 60) + "".join(f"\n  and {k}" for k in range(rng.randint(0, 3)))
            lines.append(text)
            last[pid] = len(records)
            records.append({"line": text, "added": None})
    return "\n".join(lines) + "\n", records


@pytest.mark.parametrize("split", [64, 300, 1 << 20])
def test_records_across_split_boundaries(spark, tmp_path, split):
    want = []
    for i in range(3):
        text, records = log_text(i)
        (tmp_path / f"{i}.log").write_text(text)
        want += [(f"{i}.log", r["line"], r["added"]) for r in records]
    keys = {"spark.sql.files.maxPartitionBytes": str(split), "spark.sql.files.openCostInBytes": "1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        lines = logfiles.read_lines(spark, str(tmp_path))
        assert lines.select("file", "block").distinct().count() >= (10 if split < 1000 else 3)
        got = [(os.path.basename(r.file), r.line, r.added) for r in logfiles.log_records(lines).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_records_feed_the_connection_log(spark, tmp_path):
    (tmp_path / "a.log").write_text(
        PREFIX.format(1, 7, "eve") + 'FATAL:  password authentication failed for user "eve"\n'
        + PREFIX.format(2, 8, "bob") + "LOG:  connection received: host=10.1.2.3 port=1\n"
        + PREFIX.format(3, 7, "eve") + "DETAIL:  Connection matched line 3\n\tof the file\n"
        + PREFIX.format(4, 9, "x") + "DETAIL:  of nobody\n"
    )
    records = logfiles.log_records(logfiles.read_lines(spark, str(tmp_path)))
    out = {r.username: (r.event_type, r.added) for r in ingest.parse_connection_log(records, keep=["added"]).collect()}
    assert out == {"eve": ("FAILED_LOGIN", "DETAIL: Connection matched line 3\n\tof the file"), "bob": ("LOGIN", None)}
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "b.log").write_text("")
    assert logfiles.log_records(logfiles.read_lines(spark, str(tmp_path / "empty"))).count() == 0
