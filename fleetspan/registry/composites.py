"""Composite jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.operators import joins
from fleetspan.plans import alerts, dictionary, reports, statements
from fleetspan.registry import Entry, with_views
from fleetspan.registry.aggregates import SQL_EXHAUST_BAND, sql_backup, sql_growth
from fleetspan.registry.joins import SQL_DUPLICATES, SQL_SESSIONS_NOW, free_extents
from fleetspan.registry.rows import NOW, SQL_WAIT_CATEGORY, classified, names, sql_classified
from fleetspan.sources.views import AS_OF


def fleet(t) -> reports.FleetTelemetry:
    return reports.FleetTelemetry(
        databases=t.database_catalog, sessions=t.session_requests, waits=t.wait_stats_history, backups=t.backup_history,
        files=t.file_space, free=free_extents(t),
        tables=t.table_stats.withColumns(
            {"free_bytes": F.col("n_dead") * 40, "idx_blks_hit": F.col("blks_hit"), "idx_blks_read": F.col("blks_read")}
        ), indexes=t.index_catalog, jobs=t.job_history,
        errors=classified(t), replicas=t.replica_lag, audit=t.login_audit, objects=t.object_catalog,
        sizes=t.database_size_history, maintenance=t.index_maintenance_log, query_stats=t.query_stats_snapshot,
        missing=joins.missing_indexes(t.missing_index_details, t.missing_index_groups, t.missing_index_stats), redo=t.redo_log,
        archive=t.backup_history.where(F.col("backup_type") == "L").select(
            "server_name", F.col("backup_start").alias("first_time"), F.col("backup_size_mb").alias("size_mb")
        ),
        locks=t.lock_table, channels=t.replication_channel, counters=t.perf_counters,
    )


def checks(t):
    return alerts.run_checks(
        t.session_requests, t.login_audit, t.backup_history, t.job_history, t.wait_stats_history, classified(t, 1), t.file_space, AS_OF
    )


def triggered(t):
    return alerts.check_alerts(alerts.alert_configuration(t.spark), checks(t))


def _parsed_blocking(t):
    """The alert's documents read back into columns."""
    schema = "server_name string, blocked_session bigint, blocking_session bigint, blocker_login string, wait_time_ms bigint, wait_type string"
    doc = F.from_json("details", schema)
    return alerts.blocking_alert(t.session_requests, threshold_s=5).select("status", doc.alias("d")).select("status", "d.*")


def documented(t):
    return dictionary.documentation(t.column_catalog, t.object_catalog, t.index_catalog, t.index_columns, AS_OF)


def _sql_overdue(kind: str, label: str, text: str) -> str:
    return f"""SELECT '{label}' AS alert_name, CAST(h AS BIGINT) AS v, 'Database ' || db || ': ' || h || ' hours since {text}' AS detail,
            CAST(NULL AS VARCHAR) AS arg0, CAST(NULL AS VARCHAR) AS arg1
        FROM (SELECT server_name || '/' || database_name AS db, date_diff('hour', max(backup_finish), {NOW}) AS h FROM backup_history
              WHERE backup_type = '{kind}' GROUP BY server_name, database_name ORDER BY h DESC, db DESC LIMIT 1) b"""


SQL_CHECKS = f"""w AS (SELECT server_name, wait_type, CAST(floor(wait_time_ms / nullif(waiting_tasks, 0)) AS BIGINT) AS ms FROM wait_stats_history h
             WHERE capture_time = (SELECT max(capture_time) FROM wait_stats_history x WHERE x.server_name = h.server_name)),
    disk AS (SELECT server_name || '/' || tablespace_name AS name, CAST(floor(CAST(sum(used_mb) AS DOUBLE) * 100 / sum(size_mb)) AS BIGINT) AS pct
             FROM file_space GROUP BY server_name, tablespace_name),
    errs AS ({sql_classified(1)}),
    checks AS (
        SELECT 'Long Running Query' AS alert_name, CAST(max(date_diff('second', query_start, {NOW})) AS BIGINT) AS v,
               'Query running for ' || max(date_diff('second', query_start, {NOW})) || ' seconds' AS detail, CAST(NULL AS VARCHAR) AS arg0, CAST(NULL AS VARCHAR) AS arg1
        FROM {SQL_SESSIONS_NOW} q WHERE status <> 'idle' AND query_start < {NOW} - INTERVAL '5' MINUTE
        UNION ALL SELECT 'Blocking Chain', CAST(count(*) AS BIGINT), count(*) || ' sessions in blocking chain', NULL, NULL FROM {SQL_SESSIONS_NOW} q WHERE blocking_session_id > 0
        UNION ALL SELECT 'Failed Logins', CAST(count(*) AS BIGINT), count(*) || ' failed logins in last hour', NULL, NULL FROM login_audit
                  WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '1' HOUR
        UNION ALL {_sql_overdue('D', 'Database Full Backup Overdue', 'backup')}
        UNION ALL {_sql_overdue('L', 'Log Backup Overdue', 'log backup')}
        UNION ALL SELECT 'Job Failed', CAST(count(*) AS BIGINT), 'Recent job failures detected', NULL, NULL FROM job_history
                  WHERE run_status = 0 AND run_time >= TIMESTAMP '2024-01-30 00:00:00'
        UNION ALL SELECT 'High Wait Time', ms, server_name || ': ' || wait_type || ' waits ' || ms || ' ms on average', wait_type, NULL
                  FROM (SELECT * FROM w WHERE ms IS NOT NULL ORDER BY ms DESC, server_name || ': ' || wait_type DESC LIMIT 1) x
        UNION ALL SELECT 'Error Log Error', CAST(count(*) AS BIGINT), count(*) || ' errors in last hour', NULL, NULL FROM errs
                  WHERE severity >= 16 AND log_date > {NOW} - INTERVAL '1' HOUR
        UNION ALL SELECT 'Disk Space Low', pct, name || ' is ' || pct || '% full', name, CAST(pct AS VARCHAR)
                  FROM (SELECT * FROM disk WHERE pct IS NOT NULL ORDER BY pct DESC, name DESC LIMIT 1) x
        UNION ALL SELECT 'TempDB Contention', ms, server_name || ': ' || wait_type || ' waits ' || ms || ' ms on average', wait_type, NULL
                  FROM (SELECT * FROM w WHERE wait_type LIKE 'PAGELATCH%' AND ms IS NOT NULL ORDER BY ms DESC, server_name || ': ' || wait_type DESC LIMIT 1) x),
    config(alert_name, alert_type, threshold_value, message) AS (VALUES {", ".join(
        "('%s', '%s', CAST(%d AS BIGINT), '%s')" % a for a in rules.ALERTS)}),
    hits AS (SELECT c.alert_name, k.alert_type, c.v AS current_value, k.threshold_value, c.detail,
             replace(replace(k.message, '{{0}}', coalesce(c.arg0, CAST(c.v AS VARCHAR))), '{{1}}', coalesce(c.arg1, CAST(k.threshold_value AS VARCHAR))) AS notification
             FROM checks c JOIN config k ON c.alert_name = k.alert_name WHERE c.v >= k.threshold_value)"""


def _sec(no, title, item, metric, value, status, tail, row_no="CAST(0 AS BIGINT)"):
    return (
        f"SELECT CAST({no} AS BIGINT) AS section_no, '{title}' AS section, {row_no} AS row_no, CAST({item} AS VARCHAR) AS item, "
        f"'{metric}' AS metric, CAST({value} AS VARCHAR) AS value, CAST({status} AS VARCHAR) AS status {tail}"
    )


def _top(no, title, item, metric, value, status, source, order, n):
    inner = f"(SELECT *, row_number() OVER (ORDER BY {order}) AS rk FROM {source}) z WHERE rk <= {n}"
    return _sec(no, title, item, metric, value, status, f"FROM {inner}", row_no="CAST(rk AS BIGINT)")


SQL_HEALTH = f"""WITH errs AS ({sql_classified(7)}),
    sess AS {SQL_SESSIONS_NOW},
    lk AS (SELECT l.* FROM lock_table l WHERE l.capture_time = (SELECT max(x.capture_time) FROM lock_table x WHERE x.server_name = l.server_name)),
    bs AS (SELECT d.server_name || '/' || d.database_name AS database_name, CAST(date_diff('hour', b.f, {NOW}) AS BIGINT) AS h,
                  CASE WHEN b.f IS NULL THEN 'NO BACKUP' WHEN date_diff('hour', b.f, {NOW}) > 24 THEN 'OVERDUE' ELSE 'OK' END AS s
           FROM (SELECT DISTINCT server_name, database_name FROM database_catalog) d
           LEFT JOIN (SELECT server_name, database_name, max(backup_finish) AS f FROM backup_history WHERE backup_type = 'D' GROUP BY 1, 2) b
             ON b.database_name = d.database_name AND b.server_name = d.server_name),
    sp AS (SELECT server_name || '/' || tablespace_name AS tablespace_name, sum(least(used_mb, size_mb)) AS used_mb,
                  CAST(sum(least(used_mb, size_mb)) AS DOUBLE) / sum(size_mb) * 100 AS p FROM file_space GROUP BY server_name, tablespace_name),
    ix AS (SELECT * REPLACE (server_name || '/' || database_name || '/' || schema_name || '/' || table_name || '/' || index_name AS index_name) FROM index_catalog),
    lag AS (SELECT r.* FROM replica_lag r WHERE r.capture_time = (SELECT max(x.capture_time) FROM replica_lag x
            WHERE x.server_name = r.server_name AND x.ag_name = r.ag_name AND x.replica_name = r.replica_name)),
    st AS (SELECT * FROM query_stats_snapshot WHERE capture_time >= {NOW} - INTERVAL '24' HOUR),
    wt AS (SELECT wait_type, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms FROM wait_stats_history
           WHERE capture_time >= {NOW} - INTERVAL '24' HOUR GROUP BY 1)
    """ + "\n    UNION ALL ".join([
    _sec(1, "OVERVIEW", "'Databases'", "count", "count(*)", "NULL", "FROM database_catalog WHERE state_desc = 'ONLINE'"),
    _sec(1, "OVERVIEW", "'Active Sessions'", "count", "count(*)", "NULL", "FROM sess WHERE status = 'running'"),
    _sec(1, "OVERVIEW", "'Blocked Requests'", "count", "count(*)", "NULL", "FROM sess WHERE blocking_session_id > 0"),
    _sec(1, "OVERVIEW", "'Backups (24h)'", "count", "count(*)", "NULL", f"FROM backup_history WHERE backup_start > {NOW} - INTERVAL '1' DAY"),
    _sec(2, "DATABASE STATUS", "server_name || '/' || database_name", "recovery_model", "recovery_model", "state_desc", "FROM database_catalog WHERE state_desc <> 'ONLINE'"),
    _sec(3, "BACKUP STATUS", "database_name", "hours_since_backup", "h", "s", "FROM bs WHERE s <> 'OK'"),
    _top(4, "ACTIVE SESSIONS", "server_name || '/' || session_id", "wait_time_ms", "wait_time_ms", "status", "sess WHERE status <> 'idle'",
         "wait_time_ms DESC, server_name, session_id", 20),
    _top(5, "TOP WAITS", "wait_type", "wait_time_ms", "wait_time_ms", SQL_WAIT_CATEGORY["history"], "wt", "wait_time_ms DESC, wait_type", 15),
    _top(6, "BLOCKING", "server_name || '/' || session_id", "blocking_session", "blocking_session_id", "status", "sess WHERE blocking_session_id > 0",
         "wait_time_ms DESC, server_name, session_id", 10),
    _sec(7, "TABLESPACE USAGE", "tablespace_name", "used_mb", "used_mb",
         "CASE WHEN p > 90 THEN 'CRITICAL' WHEN p > 80 THEN 'WARNING' ELSE 'OK' END", "FROM sp"),
    _top(8, "LARGE TABLE SCANS", "index_name", "user_scans", "user_scans",
         "CASE WHEN user_scans > user_seeks * 10 THEN 'SCAN HEAVY' ELSE 'OK' END",
         "ix WHERE floor(used_pages * 8 / 1024) > 1", "user_scans DESC, index_name", 10),
    _top(9, "UNUSED INDEXES", "index_name", "size_kb", "used_pages * 8",
         "CASE WHEN user_scans = 0 THEN 'UNUSED' WHEN user_scans < 10 THEN 'LOW USAGE' ELSE 'ACTIVE' END", "ix",
         "user_scans, used_pages DESC, index_name", 20),
    _top(10, "JOB RUNS", "server_name || '/' || job_name", "run_id", "run_id",
         "CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled' ELSE 'Unknown' END",
         "job_history WHERE step_id = 0 AND run_time >= TIMESTAMP '2024-01-30 00:00:00'", "run_time DESC, run_id DESC", 10),
    _top(11, "RECENT ERRORS", "log_id", "severity", "severity",
         "CASE WHEN severity >= 20 THEN 'CRITICAL' WHEN severity >= 17 THEN 'HIGH' ELSE 'MEDIUM' END",
         f"errs WHERE log_date >= {NOW} - INTERVAL '24' HOUR", "log_date DESC, severity DESC, log_id", 20),
    _sec(12, "CONNECTIONS", "server_name || '/' || status", "connections", "count(*)", "NULL", "FROM sess GROUP BY sess.server_name, sess.status"),
    _top(13, "REPLICATION LAG", "server_name || '/' || ag_name || '/' || replica_name", "lag_bytes", "sent_lsn - replay_lsn",
         "CASE WHEN sent_lsn - replay_lsn > 1073741824 THEN 'CRITICAL' WHEN sent_lsn - replay_lsn > 104857600 THEN 'WARNING' ELSE 'OK' END",
         "lag", "sent_lsn - replay_lsn DESC, capture_time, server_name, replica_name", 10),
    _top(14, "LARGEST TABLES", "server_name || '/' || database_name || '/' || schema_name || '/' || table_name", "table_rows", "n_live", "NULL",
         "(SELECT * FROM table_stats ORDER BY table_bytes + index_bytes DESC, server_name, database_name, schema_name, table_name LIMIT 20) q",
         "CAST(round(CAST(CAST(table_bytes + index_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) DESC, server_name, database_name, schema_name, table_name", 20),
    _sec(15, "INVALID OBJECTS", "server_name || '/' || database_name || '/' || owner || '/' || object_name", "object_type", "object_type", "status",
         f"FROM object_catalog WHERE status <> 'VALID' AND object_type IN ({names(rules.CHECKED_OBJECT_TYPES)}) AND owner NOT IN ({names(rules.SYSTEM_OWNERS_OBJECTS)})"),
    _sec(16, "LONG RUNNING QUERIES", "server_name || '/' || session_id", "duration_s", f"date_diff('second', query_start, {NOW})", "status",
         f"FROM sess WHERE status <> 'idle' AND query_start < {NOW} - INTERVAL '300' SECOND"),
    _top(17, "MISSING INDEXES", "server_name || '/' || index_handle", "user_seeks", "user_seeks", "NULL",
         "(SELECT g.server_name, g.index_handle, s.user_seeks, CAST(round(CAST(CAST(s.avg_user_cost AS DOUBLE) * s.avg_user_impact / 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS imp FROM missing_index_stats s "
         "JOIN missing_index_groups g ON s.group_handle = g.group_handle AND s.server_name = g.server_name WHERE s.avg_user_impact > 10 AND s.user_seeks > 50) q",
         "imp DESC, server_name, index_handle", 10),
    _sec(18, "FILE USAGE", "server_name || '/' || database_name || '/' || file_name", "used_mb", "used_mb", "file_type", "FROM file_space"),
    _sec(19, "REDO LOG", "group_no", "members", "members", "status", "FROM redo_log"),
    _sec(20, "ARCHIVE LOGS", "server_name || '/' || strftime(date_trunc('hour', backup_start), '%Y-%m-%d %H')", "archive_logs", "count(*)", "NULL",
         f"FROM backup_history WHERE backup_type = 'L' AND backup_start > {NOW} - INTERVAL '24' HOUR GROUP BY server_name, date_trunc('hour', backup_start)"),
    *[_sec(21, "BACKUP TOTALS", f"'{n}'", "count", "count(*)", "NULL",
           f"FROM backup_history WHERE backup_type = '{k}' AND backup_finish > {NOW} - INTERVAL '7' DAY")
      for n, k in (("full_backups", "D"), ("incr_backups", "I"))],
    _top(22, "TOP SQL BY READS", "server_name || '/' || database_name || '/' || query_hash", "logical_reads", "logical_reads", "NULL", "st WHERE exec_count > 10",
         "logical_reads DESC, server_name, database_name, query_hash, exec_count, total_elapsed_ms", 10),
    _top(23, "SLOW QUERIES", "server_name || '/' || database_name || '/' || query_hash", "total_elapsed_ms", "total_elapsed_ms", "NULL", "st",
         "total_elapsed_ms DESC, server_name, database_name, query_hash, exec_count, logical_reads", 20),
    _sec(24, "WAIT EVENTS", "server_name || '/' || status || ':' || wait_type", "wait_count", "count(*)", "NULL",
         "FROM sess WHERE wait_type IS NOT NULL GROUP BY sess.server_name, sess.status, wait_type"),
    _top(25, "TABLE BLOAT", "server_name || '/' || database_name || '/' || schema_name || '/' || table_name", "n_dead", "n_dead",
         "CASE WHEN n_dead > 0 AND table_bytes > 0 AND CAST(n_dead * 40 AS DOUBLE) / table_bytes * 100 > 20 THEN 'CLEANUP NEEDED' ELSE 'OK' END",
         "table_stats", "n_dead DESC, server_name, database_name, schema_name, table_name", 20),
    _top(26, "CACHE HIT RATIO", "server_name || '/' || database_name || '/' || schema_name || '/' || table_name", "blks_read", "blks_read", "NULL", "table_stats WHERE blks_read > 0",
         "CAST(round(CAST(CAST(blks_hit AS DOUBLE) * 100 / nullif(blks_hit + blks_read, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) NULLS LAST, server_name, database_name, schema_name, table_name", 10),
    _sec(27, "STORAGE BY SCHEMA", "server_name || '/' || database_name || '/' || schema_name", "table_count", "count(*)", "NULL",
         "FROM table_stats GROUP BY server_name, database_name, schema_name"),
    _top(28, "TABLE LOCKS", "server_name || '/' || coalesce(CAST(relation_id AS VARCHAR), '-')", "lock_count", "n", "lock_status",
         "(SELECT server_name, relation_id, locktype, lock_mode, CASE WHEN granted = 1 THEN 'GRANTED' ELSE 'WAITING' END AS lock_status, count(*) AS n FROM lk GROUP BY 1, 2, 3, 4, 5) q",
         "n DESC, server_name, relation_id NULLS FIRST, locktype, lock_mode, lock_status", 20),
    _sec(29, "REPLICATION CHANNELS", "server_name || '/' || channel_name", "seconds_behind", "seconds_behind", "io_state", "FROM replication_channel"),
    _sec(30, "COUNTERS", "server_name || '/' || counter_name", "counter_value", "counter_value", "NULL",
         "FROM perf_counters p WHERE capture_time = (SELECT max(capture_time) FROM perf_counters x WHERE x.server_name = p.server_name)"),
])

SQL_WEEKLY = f"""WITH {sql_growth()}, b AS ({sql_backup('weekly')})
    SELECT CAST(1 AS BIGINT) AS section_no, 'TOP WAIT EVENTS' AS section, wait_type AS item, 'total_wait_ms' AS metric,
           CAST(CAST(sum(wait_time_ms) AS BIGINT) AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS status
    FROM (SELECT wait_type, sum(wait_time_ms) AS wait_time_ms FROM wait_stats_history WHERE capture_time >= {NOW} - INTERVAL '7' DAY GROUP BY wait_type
          ORDER BY 2 DESC, 1 LIMIT 10) w GROUP BY wait_type
    UNION ALL SELECT 2, 'BACKUP STATUS', server_name || '/' || database_name || '/' || backup_type, 'hours_since_backup',
           CAST(hours_since_backup AS VARCHAR), backup_status FROM b
    UNION ALL SELECT 3, 'FAILED LOGINS', login_name || '@' || host_name, 'failed_attempts', CAST(count(*) AS VARCHAR), NULL
    FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '168' HOUR GROUP BY login_name, host_name HAVING count(*) >= 3
    UNION ALL SELECT 4, 'GROWTH PROJECTION', server_name || '/' || database_name, 'days_to_double', CAST(days_to_double AS VARCHAR), {SQL_EXHAUST_BAND}
    FROM d WHERE {SQL_EXHAUST_BAND} <> 'OK'
    UNION ALL SELECT 5, 'INDEX MAINTENANCE', database_name || '/' || operation_type, 'operations', CAST(count(*) AS VARCHAR),
           CASE WHEN sum(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) > 0 THEN sum(CASE WHEN status = 'Failed' THEN 1 ELSE 0 END) || ' failed' END
    FROM index_maintenance_log WHERE operation_start >= {NOW} - INTERVAL '7' DAY GROUP BY database_name, operation_type"""

SQL_WEEKLY_LINES = f"""
    SELECT CAST(1 AS BIGINT) AS section_no, '=== SERVER OVERVIEW ===' AS report_section, '' AS report_line
    UNION ALL SELECT 1, 'Current Connections: ', CAST(count(*) AS VARCHAR) FROM {SQL_SESSIONS_NOW} q
    UNION ALL SELECT 2, '=== TOP WAITS (Last 24h) ===', ''
    UNION ALL SELECT 2, wait_type, 'Count: ' || CAST(sum(waiting_tasks) AS BIGINT) || ', Total: ' || CAST(sum(wait_time_ms) AS BIGINT) || 'ms'
    FROM (SELECT wait_type, sum(waiting_tasks) AS waiting_tasks, sum(wait_time_ms) AS wait_time_ms FROM wait_stats_history
          WHERE capture_time >= {NOW} - INTERVAL '24' HOUR GROUP BY wait_type ORDER BY 3 DESC, 1 LIMIT 10) w GROUP BY wait_type
    UNION ALL SELECT 3, '=== DATABASE SIZES ===', ''
    UNION ALL SELECT 3, server_name || '/' || database_name, printf('%.2f', CAST(round(CAST(CAST(total_mb AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' GB' FROM database_size_history d
    WHERE capture_time = (SELECT max(capture_time) FROM database_size_history x WHERE x.server_name = d.server_name AND x.database_name = d.database_name)
    UNION ALL SELECT 4, '=== FAILED LOGINS (Last 7 days) ===', ''
    UNION ALL SELECT 4, login_name, n || ' attempts' FROM (SELECT login_name, count(*) AS n FROM login_audit
        WHERE event_type = 'FAILED_LOGIN' AND login_time >= {NOW} - INTERVAL '7' DAY GROUP BY 1 ORDER BY n DESC, login_name LIMIT 10) f"""

SQL_TYPE = """CASE WHEN max_length IS NOT NULL THEN data_type || '(' || max_length || ')'
        WHEN num_precision IS NOT NULL THEN data_type || '(' || num_precision || ',' || num_scale || ')' ELSE data_type END"""
SQL_DOC_TAIL = """
        UNION ALL SELECT server_name, database_name, CAST(CASE object_type WHEN 'VIEW' THEN 2 WHEN 'PROCEDURE' THEN 3 WHEN 'FUNCTION' THEN 4 WHEN 'PACKAGE BODY' THEN 5 ELSE 6 END AS BIGINT),
               owner || '.' || object_name, CAST(0 AS BIGINT), '- ' || owner || '.' || object_name FROM object_catalog
        WHERE object_type IN ('VIEW', 'PROCEDURE', 'FUNCTION', 'PACKAGE BODY', 'SEQUENCE')
        UNION ALL SELECT i.server_name, i.database_name, 7, i.schema_name || '.' || i.table_name, i.index_id, '- ' || i.index_name || ' (' || k.cols || ')'
                   || CASE WHEN i.is_primary_key = 1 THEN ' PRIMARY KEY' WHEN i.is_unique = 1 THEN ' UNIQUE' ELSE '' END
        FROM index_catalog i JOIN (SELECT server_name, database_name, schema_name, table_name, index_id, string_agg(column_name, ', ' ORDER BY key_ordinal) AS cols
             FROM index_columns GROUP BY 1, 2, 3, 4, 5) k USING (server_name, database_name, schema_name, table_name, index_id)
        UNION ALL SELECT server_name, database_name, 8, schema_name || '.' || object_name, line_no, '- ' || kind || ' (' || string_agg(column_name, ', ' ORDER BY column_id) || ')'
        FROM (SELECT *, 'PRIMARY KEY' AS kind, 1 AS line_no FROM column_catalog WHERE is_primary_key = 1
              UNION ALL SELECT *, 'FOREIGN KEY', 2 FROM column_catalog WHERE is_foreign_key = 1) x GROUP BY server_name, database_name, schema_name, object_name, kind, line_no"""

ENTRIES = {
    "c01_check_alerts": Entry(triggered, with_views(f"WITH {SQL_CHECKS} SELECT * FROM hits")),
    "c01_record_triggers": Entry(
        lambda t: alerts.record_triggers(
            alerts.alert_configuration(t.spark).select(
                "alert_name", F.lit(None).cast("timestamp_ntz").alias("last_triggered"), F.lit(3).cast("bigint").alias("trigger_count")
            ),
            triggered(t),
            AS_OF,
        ),
        with_views(f"""WITH {SQL_CHECKS}
        SELECT k.alert_name, CASE WHEN h.alert_name IS NOT NULL THEN {NOW} END AS last_triggered,
               CAST(CASE WHEN h.alert_name IS NOT NULL THEN 4 ELSE 3 END AS BIGINT) AS trigger_count
        FROM config k LEFT JOIN hits h ON h.alert_name = k.alert_name"""),
    ),
    "c01_check_limits": Entry(
        lambda t: alerts.check_limits(t.session_requests, 270, t.login_audit, t.replica_lag, AS_OF),
        with_views(f"""
        SELECT 'Connection Limit' AS alert_name, server_name || ': Current: ' || n || ', Max: 270' AS alert_message,
               CASE WHEN n * 100.0 / 270 > 95 THEN 'CRITICAL' ELSE 'WARNING' END AS severity
        FROM (SELECT server_name, count(*) AS n FROM {SQL_SESSIONS_NOW} q GROUP BY 1) s WHERE n * 100.0 / 270 > 80
        UNION ALL SELECT 'Failed Logins', n || ' failed login attempts in last hour', 'WARNING' FROM (SELECT count(*) AS n FROM login_audit
            WHERE event_type = 'FAILED_LOGIN' AND login_time >= {NOW} - INTERVAL '1' HOUR) f WHERE n >= 5
        UNION ALL SELECT 'Replication Lag', 'Replication lag exceeds 100MB on one or more standbys', 'WARNING'
        FROM (SELECT max(sent_lsn - replay_lsn) AS lag FROM replica_lag r WHERE capture_time = (SELECT max(capture_time) FROM replica_lag x
              WHERE x.server_name = r.server_name AND x.ag_name = r.ag_name AND x.replica_name = r.replica_name)) r WHERE lag > 104857600"""),
    ),
    "c02_blocking_alert": Entry(
        _parsed_blocking,
        with_views(f"""WITH sess AS {SQL_SESSIONS_NOW}
        SELECT 'ALERT_TRIGGERED' AS status, w.server_name, w.session_id AS blocked_session, b.session_id AS blocking_session, b.login_name AS blocker_login,
               w.wait_time_ms, w.wait_type
        FROM sess w JOIN sess b ON w.blocking_session_id = b.session_id AND w.server_name = b.server_name
        WHERE w.blocking_session_id > 0 AND w.wait_time_ms > 5000"""),
    ),
    "c03_health_report": Entry(lambda t: reports.health_report(fleet(t), AS_OF), with_views(SQL_HEALTH)),
    "c04_weekly_summary": Entry(lambda t: reports.weekly_summary(fleet(t), AS_OF), with_views(SQL_WEEKLY)),
    "c04_weekly_lines": Entry(lambda t: reports.weekly_lines(fleet(t), AS_OF), with_views(SQL_WEEKLY_LINES)),
    "c05_data_dictionary": Entry(
        lambda t: dictionary.markdown(documented(t)),
        with_views(f"""
        SELECT DISTINCT server_name, database_name, CAST(1 AS BIGINT) AS section_no, schema_name || '.' || object_name AS object_name, CAST(0 AS BIGINT) AS line_no,
               '## ' || schema_name || '.' || object_name AS line FROM column_catalog
        UNION ALL SELECT server_name, database_name, 1, schema_name || '.' || object_name, column_id + 3,
               column_name || ' (' || {SQL_TYPE} || CASE WHEN is_primary_key = 1 THEN ' PK' ELSE '' END || CASE WHEN is_foreign_key = 1 THEN ' FK' ELSE '' END
                   || CASE WHEN is_nullable = 0 THEN ' NOT NULL' ELSE '' END || CASE WHEN is_identity = 1 THEN ' IDENTITY' ELSE '' END
                   || coalesce(' DEFAULT ' || default_value, '') || ')' FROM column_catalog {SQL_DOC_TAIL}"""),
    ),
    "c05_data_dictionary_table": Entry(
        lambda t: dictionary.markdown(documented(t), style="table"),
        with_views(f"""WITH h AS (SELECT DISTINCT server_name, database_name, schema_name || '.' || object_name AS n FROM column_catalog)
        SELECT server_name, database_name, CAST(1 AS BIGINT) AS section_no, n AS object_name, CAST(0 AS BIGINT) AS line_no, '### ' || n AS line FROM h
        UNION ALL SELECT server_name, database_name, 1, n, 1, '| Column | Type | Nullable | Default |' FROM h
        UNION ALL SELECT server_name, database_name, 1, n, 2, '|--------|------|----------|---------|' FROM h
        UNION ALL SELECT server_name, database_name, 1, schema_name || '.' || object_name, column_id + 3,
               '| ' || column_name || ' | ' || {SQL_TYPE} || ' | ' || CASE WHEN is_nullable = 0 THEN 'NO' ELSE 'YES' END || ' | ' || coalesce(default_value, '') || ' |'
        FROM column_catalog {SQL_DOC_TAIL}"""),
    ),
    "c05_quick_reference": Entry(
        lambda t: dictionary.quick_reference(documented(t)),
        with_views("""
        SELECT server_name, database_name, schema_name || '.' || object_name AS object_name, CAST(count(*) AS BIGINT) AS column_count, 'TABLE' AS object_type
        FROM column_catalog GROUP BY 1, 2, 3
        UNION ALL SELECT server_name, database_name, owner || '.' || object_name, NULL, object_type FROM object_catalog WHERE object_type IN ('PROCEDURE', 'FUNCTION')"""),
    ),
    "c06_analyze_statements": Entry(
        lambda t: statements.maintenance_statements(t.table_stats, "analyze"),
        with_views("SELECT server_name, schema_name, table_name, 'ANALYZE VERBOSE ' || schema_name || '.' || table_name || ';' AS statement FROM table_stats"),
    ),
    "c06_gather_stats_statements": Entry(
        lambda t: statements.maintenance_statements(t.table_stats, "gather_stats", min_rows=10000),
        with_views("""SELECT server_name, schema_name, table_name, 'BEGIN DBMS_STATS.GATHER_TABLE_STATS(''' || schema_name || ''', ''' || table_name || '''); END;' AS statement
        FROM table_stats WHERE n_live > 10000"""),
    ),
    "c06_update_statistics_statements": Entry(
        lambda t: statements.maintenance_statements(t.table_stats, "update_statistics", min_rows=1000),
        with_views("""SELECT server_name, schema_name, table_name, 'UPDATE STATISTICS ' || schema_name || '.' || table_name || ' WITH FULLSCAN;' AS statement
        FROM table_stats WHERE n_live > 1000"""),
    ),
    "c06_analyze_table_statements": Entry(
        lambda t: statements.maintenance_statements(t.table_stats, "analyze_table"),
        with_views("""SELECT server_name, schema_name, table_name, 'ANALYZE TABLE ' || schema_name || '.' || table_name || ';' AS statement FROM table_stats"""),
    ),
    "c06_drop_unused_statements": Entry(
        lambda t: statements.maintenance_statements(
            t.index_catalog.where("user_seeks = 0 AND user_scans = 0 AND is_unique = 0 AND is_primary_key = 0"), "drop_unused"
        ),
        with_views("""SELECT server_name, database_name, index_name, schema_name, table_name,
               'USE [' || database_name || ']; DROP INDEX [' || index_name || '] ON [' || schema_name || '].[' || table_name || '];' AS statement
        FROM index_catalog WHERE user_seeks = 0 AND user_scans = 0 AND is_unique = 0 AND is_primary_key = 0"""),
    ),
    "c06_create_index_statements": Entry(
        lambda t: statements.maintenance_statements(
            joins.missing_indexes(t.missing_index_details, t.missing_index_groups, t.missing_index_stats), "create_index"
        ),
        with_views("""SELECT d.server_name, 'IX_' || d.table_name || '_' || replace(replace(d.equality_columns, '[', ''), ']', '') AS index_name, d.schema_name, d.table_name,
               d.equality_columns || coalesce(', ' || d.inequality_columns, '') AS index_columns,
               'CREATE INDEX [IX_' || d.table_name || '_' || replace(replace(d.equality_columns, '[', ''), ']', '') || '] ON [' || d.schema_name || '].['
                   || d.table_name || '] (' || d.equality_columns || coalesce(', ' || d.inequality_columns, '') || ');' AS statement
        FROM missing_index_stats s JOIN missing_index_groups g ON s.group_handle = g.group_handle AND s.server_name = g.server_name
        JOIN missing_index_details d ON d.index_handle = g.index_handle AND d.server_name = g.server_name WHERE s.avg_user_impact > 10 AND s.user_seeks > 50"""),
    ),
    "c06_drop_duplicate_statements": Entry(
        lambda t: statements.maintenance_statements(
            joins.duplicate_indexes(t.index_columns, t.index_catalog).where(F.col("recommendation") == "DROP Index2").select(
                *joins.TABLE, "index2_name"
            ).distinct(),
            "drop_duplicate",
        ),
        with_views(f"""WITH {SQL_DUPLICATES}
        SELECT DISTINCT server_name, database_name, index2_name, schema_name, table_name,
               'USE [' || database_name || ']; DROP INDEX [' || index2_name || '] ON [' || schema_name || '].[' || table_name || '];' AS statement
        FROM dup WHERE recommendation = 'DROP Index2'"""),
    ),
    "u01_union_sections": Entry(
        lambda t: reports.union_sections(
            [
                t.spark.range(1).select(F.lit(0).alias("line_kind"), F.lit("## Views").alias("line")),
                t.object_catalog.where(F.col("object_type") == "VIEW").select(
                    F.lit(1).alias("line_kind"), F.concat(F.lit("- "), F.concat_ws(".", "owner", "object_name")).alias("line")
                ),
            ]
        ),
        with_views("""
        SELECT 0 AS line_kind, '## Views' AS line UNION ALL SELECT 1, '- ' || owner || '.' || object_name FROM object_catalog WHERE object_type = 'VIEW'"""),
    ),
}
