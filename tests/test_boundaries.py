"""Verdicts exactly at, just below and just above their thresholds; NULL; zero denominators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import (
    at,
    band,
    boundary_diff,
    format_bytes,
    format_rate_mb,
    ratio,
    truncated_div,
    type_text,
)
from fleetspan.operators import aggregates, ingest, joins, rankings, rows

NOW = datetime(2024, 1, 31)


def ago(**kw):
    return NOW - timedelta(**kw)


def frame(spark, data, schema):
    """Rows with naive timestamps kept zone-free."""
    return spark.createDataFrame(data, schema)


def column(df, name):
    return [r[name] for r in df.collect()]


LADDERS = [
    (rules.SPACE_BAND["inclusive"], "OK", [(None, "OK"), (79.99, "OK"), (80.0, "WARNING"), (89.99, "WARNING"), (90.0, "CRITICAL")]),
    (rules.SPACE_BAND["strict"], "OK", [(80.0, "OK"), (80.01, "WARNING"), (90.0, "WARNING"), (90.01, "CRITICAL")]),
    (rules.FRAGMENTATION, "OK", [(4.99, "OK"), (5.0, "REORGANIZE"), (29.99, "REORGANIZE"), (30.0, "REBUILD")]),
    (rules.ROW_CHAINING, "OK", [(5.0, "OK"), (5.01, "MONITOR"), (10.0, "MONITOR"), (10.01, "REBUILD NEEDED")]),
    (rules.FILE_RISK, "OK", [(9.99, "CRITICAL"), (10.0, "WARNING"), (19.99, "WARNING"), (20.0, "OK"), (None, "OK")]),
    (rules.CONTENTION_SEVERITY, "LOW", [(10.0, "LOW"), (10.01, "MEDIUM"), (100.0, "MEDIUM"), (100.01, "HIGH")]),
    (rules.RECOMMENDATION_PRIORITY, "LOW", [(24.9, "LOW"), (25.0, "MEDIUM"), (49.9, "MEDIUM"), (50.0, "HIGH")]),
    (rules.GROWTH_CONFIDENCE, "LOW", [(13.0, "LOW"), (14.0, "MEDIUM"), (29.0, "MEDIUM"), (30.0, "HIGH"), (None, "LOW")]),
    (rules.EXHAUSTION_BAND, "OK", [(7.0, "CRITICAL"), (8.0, "WARNING"), (30.0, "WARNING"), (31.0, "MONITOR"), (60.0, "MONITOR"), (61.0, "OK"), (None, "OK")]),
    (rules.GROWTH_BAND, "OK", [(100.0, "OK"), (100.1, "MONITOR"), (512.0, "MONITOR"), (512.1, "WARNING"), (1024.0, "WARNING"), (1024.1, "CRITICAL")]),
    (rules.CONNECTION_BAND, "OK", [(75.0, "OK"), (75.1, "WARNING"), (90.0, "WARNING"), (90.1, "CRITICAL")]),
    (rules.ERROR_PRIORITY, "LOW", [(9.0, "LOW"), (10.0, "MEDIUM"), (16.0, "MEDIUM"), (17.0, "HIGH"), (19.0, "HIGH"), (20.0, "CRITICAL")]),
    (rules.REPLICATION_LAG_BYTES, "OK", [(104857600.0, "OK"), (104857601.0, "WARNING"), (1073741824.0, "WARNING"), (1073741825.0, "CRITICAL")]),
    (rules.INDEX_USAGE["detail"], "ACTIVE", [(0.0, "UNUSED - CONSIDER DROP"), (1.0, "LOW USAGE"), (99.0, "LOW USAGE"), (100.0, "ACTIVE"), (None, "ACTIVE")]),
    (rules.INDEX_USAGE["health"], "ACTIVE", [(0.0, "UNUSED"), (9.0, "LOW USAGE"), (10.0, "ACTIVE")]),
]


@pytest.mark.parametrize("ladder,default,cases", LADDERS)
def test_ladders(spark, ladder, default, cases):
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(cases)], "i int, v double")
    got = df.select("i", band(F.col("v"), ladder, default).alias("b")).orderBy("i")
    assert column(got, "b") == [label for _, label in cases]


def test_boundary_diff_counts_crossings(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-01-01 00:59:59' a, timestamp_ntz'2024-01-01 01:00:01' b, timestamp_ntz'2024-01-02 00:00:00' c"
    )
    row = df.select(
        boundary_diff("hour", F.col("a"), F.col("b")).alias("h"),
        boundary_diff("minute", F.col("a"), F.col("b")).alias("m"),
        boundary_diff("day", F.col("b"), F.col("c")).alias("d"),
        boundary_diff("hour", F.col("b"), F.col("a")).alias("neg"),
        boundary_diff("hour", F.lit(None).cast("timestamp_ntz"), F.col("a")).alias("nul"),
    ).first()
    assert (row.h, row.m, row.d, row.neg, row.nul) == (1, 1, 1, -1, None)


def test_ratio_and_division(spark):
    row = spark.range(1).select(
        ratio(F.lit(1), F.lit(0)).alias("zero"), ratio(F.lit(1), F.lit(3), 100).alias("third"),
        truncated_div(F.lit(7), F.lit(2)).alias("half"), truncated_div(F.lit(7), F.lit(0)).alias("none"),
    ).first()
    assert (row.zero, row.third, row.half, row.none) == (None, 33.33, 3, None)
    big = 9007199254740993
    row = spark.range(1).select(truncated_div(F.lit(-7), F.lit(2)).alias("minus"), truncated_div(F.lit(big), F.lit(1)).alias("big")).first()
    assert (row.minus, row.big) == (-3, big)


def test_text_formats(spark):
    sizes = spark.createDataFrame([(1023,), (1024,), (1536,), (1048576,), (1073741824,), (1099511627776,), (None,)], "b long")
    assert column(sizes.select(format_bytes(F.col("b")).alias("t")), "t") == [
        "1023 bytes", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 GB", "1.00 TB", None
    ]
    rates = spark.createDataFrame([(1024.0,), (1024.5,), (2048.0,), (12.345,)], "r double")
    assert column(rates.select(format_rate_mb(F.col("r")).alias("t")), "t") == [
        "1024.00 MB/day", "1.00 GB/day", "2.00 GB/day", "12.35 MB/day"
    ]
    types = spark.createDataFrame([("varchar", 10, None, None), ("decimal", None, 18, 2), ("int", None, None, None)], "b string, l int, p int, s int")
    assert column(types.select(type_text(F.col("b"), F.col("l"), F.col("p"), F.col("s")).alias("t")), "t") == [
        "varchar(10)", "decimal(18,2)", "int"
    ]


def test_wait_categories_test_lwlock_before_lock(spark):
    df = spark.createDataFrame([("LWLock:WALWrite",), ("Lock:tuple",), ("IO:DataFileRead",), ("Activity",), ("Client:x",)], "w string")
    assert column(df.select(rows.wait_category(F.col("w"), "events").alias("c")), "c") == ["LWLock", "Lock", "IO", "Idle", "Other"]


def test_like_underscore_is_a_wildcard(spark):
    df = spark.createDataFrame([("LCKXM_S",), ("LCK_M_S",), ("SOS_SCHEDULER_YIELD",), (None,)], "w string")
    assert column(df.select(rows.wait_category(F.col("w"), "diagnostic").alias("c")), "c") == ["LOCKS", "LOCKS", "MEMORY", "OTHER"]


SEVERITIES = [
    ("Error: 1, Severity 16, State 1", "ERROR", 16), ("Error: 1, severity 17", "ERROR", 17), ("ERROR Severity 18", "ERROR", 18),
    ("error Severity 19", "ERROR", 19), ("error Severity 20", "ERROR", 20), ("error Severity 24", "ERROR", 20),
    ("error Severity 25", "ERROR", 25), ("error Severity 26", "ERROR", 16), ("error without level", "ERROR", 16),
    ("DEADLOCK found error Severity 13", "Deadlock", 10), ("Warning: cannot open", "WARNING", 10), ("login failed", "INFO", 10),
]


def test_log_severity(spark):
    lines = spark.createDataFrame([(i, "s", t) for i, (t, _, _) in enumerate(SEVERITIES)], "log_id int, server_name string, log_text string")
    out = rows.classify_log(lines.withColumn("log_date", at(ago(hours=1))), NOW).orderBy("log_id").collect()
    assert [(r.log_text, r.log_type, r.severity) for r in out] == SEVERITIES
    noise = spark.createDataFrame([("Recovery completed",)], "log_text string").withColumn("log_date", at(ago(hours=1)))
    assert rows.classify_log(noise, NOW).count() == 0


def test_job_status_codes(spark):
    df = spark.createDataFrame([(i, i) for i in (0, 1, 2, 3, 4, 9)], "run_id long, run_status int").selectExpr(
        "*", "'s' server_name", "'j' job_name", "timestamp_ntz'2024-01-30 12:00:00' run_time", "1L duration_s", "0L step_id"
    )
    assert column(rows.job_runs(df, NOW).orderBy("run_id"), "status") == [
        "Failed", "Succeeded", "Retry", "Canceled", "In Progress", "Unknown"
    ]


def _backups(spark, data):
    return spark.createDataFrame(
        [("s", db, kind, start, finish, 1, status) for db, kind, start, finish, status in data],
        "server_name string, database_name string, backup_type string, backup_start timestamp_ntz, backup_finish timestamp_ntz, "
        "backup_size_mb long, status string",
    )


def test_backup_chain_states(spark):
    data = []

    def add(db, full=None, diff=None, log=None):
        for kind, when in (("D", full), ("I", diff), ("L", log)):
            if when is not None:
                data.append((db, kind, when, when, "Success"))

    add("never", diff=ago(hours=1), log=ago(minutes=5))
    add("gap", full=ago(hours=1), diff=ago(hours=1), log=ago(minutes=61))
    add("edge", full=ago(hours=1), diff=ago(hours=24), log=ago(minutes=60))
    add("nodiff", full=ago(hours=1), log=ago(minutes=5))
    add("olddiff", full=ago(hours=1), diff=ago(hours=25), log=ago(minutes=5))
    add("oldfull", full=ago(days=2), log=ago(minutes=5))
    backups = _backups(spark, data)
    anystatus = {r.database_name: r.chain_status for r in aggregates.backup_chain(backups, NOW).collect()}
    assert anystatus == {
        "never": "NO_BACKUP", "gap": "LOG_GAP", "edge": "OK", "nodiff": "NO_DIFF", "olddiff": "NO_DIFF", "oldfull": "NO_DIFF"
    }
    success = {r.database_name: r.chain_status for r in aggregates.backup_chain(backups, NOW, "success_only").collect()}
    assert success == {
        "never": "NO_BACKUP", "gap": "LOG_GAP", "edge": "OK", "nodiff": "OK", "olddiff": "OK", "oldfull": "NO_RECENT_DIFF"
    }


def test_backup_status_edges(spark):
    backups = _backups(
        spark,
        [
            ("a", "D", ago(hours=12), ago(hours=12), "Success"), ("b", "D", ago(hours=13), ago(hours=13), "Success"),
            ("c", "D", ago(hours=24), ago(hours=24), "Success"), ("d", "D", ago(hours=25), ago(hours=25), "Success"),
            ("e", "D", ago(hours=1), None, "Success"),
        ],
    )
    out = {r.database_name: r.backup_status for r in aggregates.backup_status(backups, NOW).collect()}
    assert out == {"a": "OK", "b": "WARNING", "c": "WARNING", "d": "OVERDUE", "e": "NO BACKUP"}
    server = backups.first().server_name
    names = spark.createDataFrame(
        [(server, "a"), (server, "zz"), (server, "tempdb"), ("other", "a"), (server, None)], "server_name string, database_name string"
    )
    health = {(r.server_name, r.database_name): r.backup_status for r in aggregates.database_backup_status(names, backups, NOW).collect()}
    assert health == {(server, "a"): "OK", (server, "zz"): "NO BACKUP", ("other", "a"): "NO BACKUP", (server, None): "NO BACKUP"}


def test_last_size_is_the_newest_backups(spark):
    backups = spark.createDataFrame(
        [("s", "db", "D", ago(hours=9), ago(hours=9), 500), ("s", "db", "D", ago(hours=2), ago(hours=2), 7)],
        "server_name string, database_name string, backup_type string, backup_start timestamp_ntz, backup_finish timestamp_ntz, backup_size_mb long",
    )
    assert aggregates.backup_status(backups, NOW).first().last_size_mb == 7


def test_unhealthy_primary_without_a_state(spark):
    row = spark.createDataFrame(
        [("ag", "r", "PRIMARY", ago(hours=1), None, "Healthy", "Online", 1, 1)],
        "ag_name string, replica_name string, replica_role string, capture_time timestamp_ntz, operational_state string, sync_health string, "
        "recovery_health string, redo_queue_mb long, send_queue_mb long",
    )
    out = rows.replica_health(row.withColumn("server_name", F.lit("s")), NOW).first()
    assert (out.health_status, out.action_required) == ("UNHEALTHY", "ACTION REQUIRED")


def test_quiet_server_keeps_its_statements(spark):
    raw = spark.createDataFrame(
        [("busy", i, "x" * 2000, 10, 10**6 + i, 1) for i in range(150)] + [("quiet", 1, "y", 10, 1000, 1)],
        "server_name string, query_hash long, query_text string, exec_count long, total_elapsed_ms long, logical_reads long",
    )
    out = ingest.capture_query_stats(raw, NOW).collect()
    assert sum(r.server_name == "busy" for r in out) == 100 and sum(r.server_name == "quiet" for r in out) == 1
    assert max(len(r.query_text) for r in out) == 2000


def test_a_missing_name_is_kept(spark):
    events = spark.createDataFrame(
        [(None, None, None, None, "FAILED_LOGIN"), ("sa", "h", "p", "i", "LOGIN")],
        "login_name string, host_name string, program_name string, ip_address string, event_type string",
    )
    assert [r.login_name for r in ingest.append_audit_events(events, ["sa"]).collect()] == [None]
    waits = spark.createDataFrame([(None,), ("CXPACKET",)], "wait_type string")
    assert [r.wait_type for r in rows.exclude_benign(waits, "wait_type", ["CXPACKET"]).collect()] == [None]


def test_overview_takes_the_worst_backup_by_rank(spark):
    status = spark.createDataFrame([("s", "WARNING", 13), ("s", "OVERDUE", 30), ("s", "OK", 1)], "server_name string, backup_status string, hours_since_backup long")
    inventory = spark.createDataFrame([("s",), ("silent",)], "server_name string")
    counters = spark.sql("SELECT 's' server_name, timestamp_ntz'2024-01-30' capture_time")
    audit = spark.sql("SELECT 's' server_name, 'FAILED_LOGIN' event_type, timestamp_ntz'2024-01-30 23:00:00' login_time")
    out = {r.server_name: r for r in joins.server_overview(inventory, status, counters, audit, NOW).collect()}
    assert out["s"].worst_backup_status == "OVERDUE"
    assert (out["silent"].worst_backup_status, out["silent"].failed_logins_24h) == (None, 0)


def test_query_issue_profiles(spark):
    schema = "server_name string, database_name string, query_hash long, query_text string, exec_count long, total_elapsed_ms long, logical_reads long"
    stats = spark.createDataFrame(
        [
            ("s", "d", 1, "q", 1, 1, 100001), ("s", "d", 2, "q", 1, 10001, 1), ("s", "d", 3, "q", 1001, 1, 1),
            ("s", "d", 4, "q", 1000, 1, 1), ("s", "d", 5, "q", 0, 1, 1),
        ],
        schema,
    )
    got = {r.query_hash: r.issue_type for r in rows.query_issue(stats, "reads_first").collect()}
    assert got == {1: "High Reads", 2: "High Duration", 3: "High Frequency", 4: "Other", 5: "Other"}


def test_row_chaining_and_vacuum(spark):
    tables = spark.createDataFrame([("a", "t1", 10001, 1001), ("a", "t2", 10000, 5000), ("SYS", "t3", 20000, 9000)], "schema_name string, table_name string, n_live long, chained_rows long")
    where = {"server_name": F.lit("s"), "database_name": F.lit("d")}
    out = rows.row_chaining(tables.withColumns(where)).collect()
    assert [(r.table_name, r.status) for r in out] == [("t1", "REBUILD NEEDED")]
    vac = spark.createDataFrame(
        [("s", "a", 10, 1000, ago(days=9)), ("s", "b", 10, 10001, ago(days=2)), ("s", "c", 10, 10001, ago(hours=2)),
         ("s", "d", 10, 50001, ago(hours=2)), ("s", "e", 0, 50001, None)],
        "schema_name string, table_name string, n_live long, n_dead long, last_autovacuum timestamp_ntz",
    )
    got = {r.table_name: (r.recommendation, r.dead_pct) for r in rows.vacuum_recommendation(vac.withColumns(where), NOW).collect()}
    assert set(got) == {"b", "c", "d", "e"}
    assert got["b"][0] == "AUTOVACUUM NEEDED" and got["c"][0] == "OK" and got["d"][0] == "MANUAL VACUUM RECOMMENDED"
    assert got["e"] == ("MANUAL VACUUM RECOMMENDED", 0.0)


def test_alert_never_triggered_is_stale(spark):
    config = spark.createDataFrame(
        [("a", 1, ago(minutes=59)), ("b", 1, ago(hours=1)), ("c", 1, ago(days=1)), ("d", 1, None), ("e", 0, ago(minutes=1))],
        "alert_name string, is_enabled int, last_triggered timestamp_ntz",
    )
    out = {r.alert_name: r.trigger_status for r in rows.active_alerts(config, NOW).collect()}
    assert out == {"a": "RECENT", "b": "TODAY", "c": "STALE", "d": "STALE"}


def test_zero_baseline_is_dropped(spark):
    current = spark.createDataFrame([("s", "m0", 5.0), ("s", "m1", 125.0), ("s", "m2", 126.0), ("s", "m3", 49.0)], "server_name string, metric_name string, current_value double")
    base = spark.sql(
        "SELECT 's' server_name, m metric_name, v metric_value, date'2024-01-31' baseline_date FROM VALUES ('m0', 0D), ('m1', 100D), ('m2', 100D), ('m3', 100D) AS t(m, v) "
        "UNION ALL SELECT 's', 'm1', 1D, date'2024-01-01'"
    )
    out = {r.metric_name: r.variance_pct for r in aggregates.baseline_compare(current, base).collect()}
    assert out == {"m2": 26.0, "m3": -51.0}


def test_shares_sum_to_hundred_and_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0), (None, 5)], "g string, v long")
    got = [(r.g, r.v, r.pct) for r in rankings.share_of_total(df, "v", by=["g"]).collect()]
    assert sorted(got, key=str) == sorted([("a", 1, 25.0), ("a", 3, 75.0), ("b", 0, None), (None, 5, 100.0)], key=str)
    assert rankings.share_of_total(df.where("v = 0"), "v").first().pct is None


def test_latest_keeps_ties(spark):
    df = spark.createDataFrame([("a", 1, NOW), ("a", 2, NOW), ("a", 3, ago(hours=1)), ("b", 4, ago(hours=5))], "server_name string, v int, capture_time timestamp_ntz")
    assert sorted(column(rankings.latest_snapshot(df), "v")) == [1, 2, 4]
    assert sorted(column(rankings.latest_snapshot(df, by=()), "v")) == [1, 2]


def test_capture_rules(spark):
    waits = spark.createDataFrame([("s", "a", 1, 1, 1), ("s", "b", 0, 1, 1), ("s", "c", 1, 1, 0)], "server_name string, wait_type string, wait_time_ms long, signal_wait_ms long, waiting_tasks long")
    out = ingest.capture_waits(waits, NOW, server="x").collect()
    assert [(r.server_name, r.wait_type, r.capture_time) for r in out] == [("x", "a", NOW)]
    keep = spark.createDataFrame([(1, ago(days=30)), (2, ago(days=30, seconds=1)), (3, None)], "i int, t timestamp_ntz")
    assert sorted(column(ingest.purge_keep(keep, "t", NOW), "i")) == [1, 3]


def test_upsert_replaces_and_inserts(spark):
    old = spark.createDataFrame([(1, ago(hours=2), 5), (2, ago(hours=2), 6)], "k int, capture_time timestamp_ntz, v int")
    new = spark.createDataFrame([(2, ago(hours=1), 7), (3, ago(hours=1), 8)], "k int, capture_time timestamp_ntz, v int")
    assert sorted((r.k, r.v) for r in ingest.upsert_latest(old, new, ["k"]).collect()) == [(1, 5), (2, 7), (3, 8)]


def test_setting_changes_across_slices(spark):
    hour = lambda d, h: datetime(2024, 1, d, h)
    data = [
        ("s", "a", hour(1, 1), "x"), ("s", "a", hour(1, 2), "x"), ("s", "a", hour(1, 3), "y"), ("s", "a", hour(4, 1), "y"),
        ("s", "a", hour(6, 1), None), ("s", "a", hour(6, 2), None), ("s", "a", hour(7, 0), "z"), ("s", "b", hour(7, 0), "z"),
    ]
    snaps = spark.createDataFrame(data, "server_name string, setting_name string, capture_time timestamp_ntz, setting_value string")
    want = [(hour(1, 3), "x", "y"), (hour(6, 1), "y", None), (hour(7, 0), None, "z")]
    for unit in ("day", "hour"):
        out = rows.setting_changes(snaps, slice_unit=unit).orderBy("change_time").collect()
        assert [(r.change_time, r.old_value, r.new_value) for r in out] == want
