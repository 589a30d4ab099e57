"""Two servers with the same ids, names and schemas: nothing is joined across them and no two rows look alike."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import aggregates, joins, rankings, rows
from fleetspan.plans import alerts, dictionary

NOW = datetime(2024, 1, 31)
SERVERS = ("s1", "s2")


def frame(spark, schema, data):
    return spark.createDataFrame(data, schema)


def test_roles_and_permissions_stay_on_their_server(spark):
    principals = frame(spark, "server_name string, principal_id long, login_name string, login_type string", [(s, i, f"{s}-login{i}", "SQL_LOGIN") for s in SERVERS for i in (1, 2)])
    roles = frame(spark, "server_name string, role_id long, role_name string", [(s, 9, f"{s}-role") for s in SERVERS])
    links = frame(spark, "server_name string, role_id long, member_id long", [("s1", 9, 1), ("s2", 9, 1), ("s2", 9, 2)])
    got = {(r.server_name, r.role_name, r.member_name) for r in joins.role_members(links, roles, principals).collect()}
    assert got == {("s1", "s1-role", "s1-login1"), ("s2", "s2-role", "s2-login1"), ("s2", "s2-role", "s2-login2")}
    grants = frame(
        spark, "server_name string, grant_id long, grantee_id long, grantor_id long, permission_name string, state_desc string, class_id int",
        [(s, 5, 1, 2, "CONNECT SQL", "GRANT", 100) for s in SERVERS],
    )
    out = joins.permissions(grants, principals).collect()
    assert {(r.server_name, r.grantee_name, r.grantor_name) for r in out} == {(s, f"{s}-login1", f"{s}-login2") for s in SERVERS} and len(out) == 2


def test_channels_and_handles_stay_on_their_server(spark):
    config = frame(spark, "server_name string, channel_name string, source_host string", [(s, "ch", f"{s}-host") for s in SERVERS])
    state = frame(spark, "server_name string, channel_name string, io_state string", [(s, "ch", f"{s}-io") for s in SERVERS])
    lag = frame(spark, "server_name string, channel_name string, seconds_behind long", [("s1", "ch", 1), ("s2", "ch", 2)])
    out = joins.replication_channels(config, state, lag).collect()
    assert {(r.server_name, r.source_host, r.io_state, r.seconds_behind) for r in out} == {("s1", "s1-host", "s1-io", 1), ("s2", "s2-host", "s2-io", 2)}
    details = frame(
        spark, "server_name string, index_handle long, database_name string, schema_name string, table_name string, equality_columns string, inequality_columns string, included_columns string",
        [(s, 1, "db", "dbo", f"{s}_t", "[a]", None, None) for s in SERVERS],
    )
    groups = frame(spark, "server_name string, index_handle long, group_handle long", [(s, 1, 7) for s in SERVERS])
    stats = frame(spark, "server_name string, group_handle long, user_seeks long, avg_user_cost long, avg_user_impact long", [("s1", 7, 100, 10, 50), ("s2", 7, 200, 10, 90)])
    out = joins.missing_indexes(details, groups, stats).collect()
    assert {(r.server_name, r.table_name, r.user_seeks) for r in out} == {("s1", "s1_t", 100), ("s2", "s2_t", 200)} and len(out) == 2


INDEXES = (
    "server_name string, database_name string, schema_name string, table_name string, index_name string, is_unique int, is_primary_key int, used_pages long, "
    "user_seeks long, user_scans long, last_used timestamp_ntz, frag_pct long"
)


def test_statements_name_the_schema(spark):
    data = [(s, "db", schema, "t", "ix", 0, 0, 2000, 0, 0, NOW - timedelta(days=60), 40) for s in SERVERS for schema in ("dbo", "sales")]
    indexes = frame(spark, INDEXES, data)
    drops = joins.unused_index_script(indexes, NOW).collect()
    assert {(r.server_name, r.schema_name, r.drop_statement) for r in drops} == {
        (s, schema, f"USE [db]; DROP INDEX [ix] ON [{schema}].[t];") for s in SERVERS for schema in ("dbo", "sales")
    }
    plans = rows.maintenance_plan(indexes, NOW).collect()
    assert {(r.server_name, r.statement) for r in plans} == {(s, f"ALTER INDEX [ix] ON [db].[{schema}].[t] REBUILD;") for s in SERVERS for schema in ("dbo", "sales")}
    for listing in (rows.fragmentation_action(indexes), rows.index_usage_status(indexes), rows.index_review(indexes), rows.scan_heavy_indexes(indexes, min_mb=1)):
        assert listing.count() == listing.distinct().count() == 4


def test_newest_sizes_of_servers_that_report_at_different_times(spark):
    sizes = frame(spark, "server_name string, database_name string, capture_time timestamp_ntz, total_mb long", [
        ("s1", "db", NOW - timedelta(hours=1), 5000), ("s1", "db", NOW - timedelta(hours=9), 9000), ("s2", "db", NOW, 10), ("s2", "old", NOW - timedelta(days=3), 7),
    ])
    assert [(r.server_name, r.database_name, r.total_mb) for r in rankings.largest_databases(sizes).collect()] == [("s1", "db", 5000), ("s2", "db", 10), ("s2", "old", 7)]


def test_captures_are_not_counted_together(spark):
    data = [(s, NOW - timedelta(hours=h), i, "running", "login", "app", "host", "W", NOW - timedelta(hours=h, minutes=5)) for s in SERVERS for h in (0, 1) for i in (51, 52)]
    sessions = frame(
        spark, "server_name string, capture_time timestamp_ntz, session_id long, status string, login_name string, program_name string, host_name string, wait_type string, query_start timestamp_ntz", data
    )
    out = aggregates.connection_summary(sessions, NOW).collect()
    assert len(out) == 4 and {(r.connections, r.unique_users, r.unique_apps) for r in out} == {(2, 1, 1)}
    assert {r.wait_count for r in aggregates.wait_event_counts(sessions).collect()} == {2}
    assert {r.session_count for r in aggregates.connections_by_origin(sessions).collect()} == {2}


@pytest.fixture
def checks(spark):
    """Inputs on which every alert has a value that can be told."""
    hours = lambda h: NOW - timedelta(hours=h)
    sessions = frame(spark, "server_name string, capture_time timestamp_ntz, status string, query_start timestamp_ntz, blocking_session_id long", [
        ("s1", hours(1), "running", hours(3), 5), ("s1", hours(2), "running", hours(50), 6), ("s2", NOW, "idle", hours(90), 0)])
    audit = frame(spark, "event_type string, login_time timestamp_ntz", [("FAILED_LOGIN", hours(0.5))] * 6)
    backups = frame(spark, "server_name string, database_name string, backup_type string, backup_finish timestamp_ntz", [
        ("s1", "a", "D", hours(30)), ("s1", "a", "D", hours(300)), ("s2", "a", "D", hours(40)), ("s1", "a", "L", hours(7)), ("s2", "a", "L", hours(1))])
    jobs = frame(spark, "run_status int, run_time timestamp_ntz", [(0, hours(2)), (1, hours(2))])
    waits = frame(spark, "server_name string, capture_time timestamp_ntz, wait_type string, wait_time_ms long, waiting_tasks long", [
        ("s1", hours(1), "LCK_M_X", 9000, 3), ("s1", hours(2), "LCK_M_X", 900000, 1), ("s2", NOW, "PAGELATCH_EX", 450, 3), ("s2", NOW, "IDLE", 5, 0)])
    errors = frame(spark, "severity int, log_date timestamp_ntz", [(16, hours(0.5)), (20, hours(0.2)), (10, hours(0.2)), (25, hours(3))])
    files = frame(spark, "server_name string, tablespace_name string, used_mb long, size_mb long", [("s1", "ts", 10, 100), ("s2", "ts", 50, 60), ("s2", "ts", 45, 40)])
    return sessions, audit, backups, jobs, waits, errors, files


def test_all_ten_alerts_are_checked(spark, checks):
    found = alerts.run_checks(*checks, NOW)
    values = {r.alert_name: (r.current_value, r.detail) for r in found.collect()}
    config = alerts.alert_configuration(spark)
    assert set(values) == {r.alert_name for r in config.collect()}
    assert {k: v for k, (v, _) in values.items()} == {
        "Long Running Query": 7200 + 3600, "Blocking Chain": 1, "Failed Logins": 6, "Database Full Backup Overdue": 40, "Log Backup Overdue": 7,
        "High Wait Time": 3000, "Error Log Error": 2, "Disk Space Low": 95, "TempDB Contention": 150, "Job Failed": 1,
    }
    assert values["Log Backup Overdue"][1] == "Database s1/a: 7 hours since log backup"
    sent = {r.alert_name: r.notification for r in alerts.check_alerts(config, found).collect()}
    assert sent["High Wait Time"] == "Wait type LCK_M_X exceeds 1000ms" and sent["Disk Space Low"] == "Disk s2/ts is 95% full"
    assert sent["Log Backup Overdue"] == "7 hours since last log backup" and "Blocking Chain" not in sent


def test_alerts_without_any_data(spark, checks):
    found = alerts.run_checks(*(df.limit(0) for df in checks), NOW)
    assert {r.alert_name: r.current_value for r in found.collect() if r.current_value} == {}
    assert alerts.check_alerts(alerts.alert_configuration(spark), found).count() == 0


def test_documentation_has_all_sections(spark):
    columns = frame(
        spark, "server_name string, database_name string, schema_name string, object_name string, column_name string, column_id long, data_type string, max_length long, "
        "num_precision long, num_scale long, is_nullable int, is_primary_key int, is_foreign_key int, is_identity int, default_value string",
        [(s, "db", "dbo", "t", c, i, "int", None, None, None, 0, int(i < 3), int(i == 2), 0, None) for s in SERVERS for i, c in enumerate("abc", 1)],
    )
    kinds = ["VIEW", "PROCEDURE", "FUNCTION", "PACKAGE BODY", "SEQUENCE", "TRIGGER"]
    objects = frame(spark, "server_name string, database_name string, owner string, object_type string, object_name string", [("s1", "db", "o", k, k.lower()) for k in kinds])
    key = "server_name string, database_name string, schema_name string, table_name string, index_id long"
    indexes = frame(spark, key + ", index_name string, is_unique int, is_primary_key int", [("s1", "db", "dbo", "t", 1, "pk", 1, 1), ("s1", "db", "dbo", "t", 2, "ux", 1, 0)])
    index_columns = frame(spark, key + ", key_ordinal long, column_name string", [("s1", "db", "dbo", "t", 1, 1, "a"), ("s1", "db", "dbo", "t", 2, 2, "a"), ("s1", "db", "dbo", "t", 2, 1, "b")])
    doc = dictionary.documentation(columns, objects, indexes, index_columns, NOW)
    out = dictionary.markdown(doc)
    lines = {(r.server_name, r.section_no, r.line) for r in out.collect()}
    assert {(s, 8, "- PRIMARY KEY (a, b)") for s in SERVERS} | {(s, 8, "- FOREIGN KEY (b)") for s in SERVERS} <= lines
    assert {("s1", 7, "- pk (a) PRIMARY KEY"), ("s1", 7, "- ux (b, a) UNIQUE"), ("s1", 5, "- o.package body"), ("s1", 6, "- o.sequence")} <= lines
    assert not any("trigger" in line for _, _, line in lines)
    assert out.count() == out.distinct().count()
    assert {(r.server_name, r.column_count) for r in dictionary.quick_reference(doc).where(F.col("object_type") == "TABLE").collect()} == {(s, 3) for s in SERVERS}
