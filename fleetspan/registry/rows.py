"""Row-level queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import (
    boundary_diff,
    fill_template,
    format_bytes,
    format_rate_mb,
    ratio,
    seconds_between,
    truncated_div,
    type_text,
)
from fleetspan.operators import ingest, rows
from fleetspan.registry import Entry, with_views
from fleetspan.sources.views import AS_OF

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_bytes(col: str) -> str:
    """SQL text of the rounded byte formatter."""
    rungs = "".join(
        f"WHEN {col} >= {size} THEN printf('%.2f', CAST(round(CAST(CAST({col} AS DOUBLE) / {size} AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' {unit}' "
        for size, unit in [(1099511627776, "TB"), (1073741824, "GB"), (1048576, "MB"), (1024, "KB")]
    )
    return f"CASE {rungs} ELSE CAST({col} AS VARCHAR) || ' bytes' END"


def sql_minutes(start: str, end: str) -> str:
    return f"CAST(date_diff('minute', {start}, {end}) AS BIGINT)"


def sql_case(pairs, default: str) -> str:
    """CASE text over (condition, label) pairs."""
    return "CASE " + " ".join(f"WHEN {test} THEN '{label}'" for test, label in pairs) + f" ELSE '{default}' END"


def sql_band(value: str, ladder, default: str) -> str:
    """CASE text of a threshold ladder."""
    return sql_case([(f"{value} {'=' if op == '==' else op} {limit}", label) for op, limit, label in ladder], default)


def _names_or_pattern(col: str, match) -> str:
    return f"{col} IN ({names(match)})" if isinstance(match, list) else f"{col} LIKE '{match}'"


SQL_WAIT_CATEGORY = {
    profile: sql_case([(_names_or_pattern("wait_type", m), label) for m, label in table], default)
    for profile, table, default in (
        ("history", rules.WAIT_CATEGORIES_HISTORY, rules.WAIT_CATEGORIES_HISTORY_DEFAULT),
        ("diagnostic", rules.WAIT_CATEGORIES_DIAGNOSTIC, rules.WAIT_CATEGORIES_DIAGNOSTIC_DEFAULT),
        ("contention", rules.WAIT_CATEGORIES_CONTENTION, rules.WAIT_CATEGORIES_CONTENTION_DEFAULT),
        ("events", rules.WAIT_CATEGORIES_EVENTS, rules.WAIT_CATEGORIES_EVENTS_DEFAULT),
    )
}

SQL_LOG_TYPE = sql_case(
    [(" OR ".join(f"log_text ILIKE '{p}'" for p in patterns), label) for patterns, label in rules.LOG_TYPES], rules.LOG_TYPE_DEFAULT
)
SQL_LOG_SEVERITY = (
    "CASE "
    + " ".join(f"WHEN regexp_matches(log_text, '{pattern}') THEN {level}" for pattern, level in rules.LOG_SEVERITIES)
    + f" WHEN log_type = 'ERROR' THEN {rules.LOG_SEVERITY_ERROR} ELSE {rules.LOG_SEVERITY_DEFAULT} END"
)


# Classified log rows as a CTE body; ``days`` is the window.
def sql_classified(days: int) -> str:
    relevant = " OR ".join(f"log_text ILIKE '{p}'" for p in rules.LOG_RELEVANT)
    return f"""SELECT log_id, server_name, log_date, process_info, log_text, log_type, {SQL_LOG_SEVERITY} AS severity
        FROM (SELECT *, {SQL_LOG_TYPE} AS log_type FROM error_log
              WHERE log_date >= {NOW} - INTERVAL '{days}' DAY AND ({relevant})) c"""


def classified(t, days: int = 7):
    return rows.classify_log(t.error_log, AS_OF, days)


def slow_log(t):
    return t.trace_events.select(
        "event_id", "start_time", F.col("server_name").alias("user_host"), F.col("duration_ms").alias("query_time"),
        F.col("changed_pages").alias("rows_examined"),
    )


def alert_states(t):
    """Alert configuration with the last failed login per server as its trigger time."""
    last = t.login_audit.where(F.col("event_type") == "FAILED_LOGIN").groupBy("login_name").agg(
        F.max("login_time").alias("last_triggered"), F.count("*").alias("trigger_count")
    )
    return last.select(
        F.concat(F.lit("Failed Logins "), "login_name").alias("alert_name"),
        F.when(F.col("login_name") == "login7", 0).otherwise(1).alias("is_enabled"),
        F.when(F.col("login_name") != "login3", F.col("last_triggered")).alias("last_triggered"),
        "trigger_count",
    )


def recommendations(t):
    """Index recommendations as landed rows."""
    return t.missing_index_stats.select(
        F.concat_ws("/", "server_name", "group_handle").alias("rec_id"),
        "capture_time",
        F.col("avg_user_impact").alias("estimated_impact"),
        "user_seeks",
        F.when(F.col("avg_user_impact") % 10 == 3, 1).otherwise(0).alias("is_implemented"),
    )


def latest_settings(t):
    return ingest.upsert_latest(
        t.settings_snapshot.limit(0), t.settings_snapshot, ["server_name", "setting_name"]
    )


def recommended_settings(t):
    return t.spark.createDataFrame(rules.RECOMMENDED_SETTINGS, "setting_name string, recommended string")


def contention(t):
    return ingest.capture_contention(t.wait_stats_history, AS_OF)


def channels(t):
    return t.replica_lag.select(
        "server_name", "capture_time", "replica_name", F.floor((F.col("sent_lsn") - F.col("replay_lsn")) / 1000000).alias("seconds_behind")
    )


SQL_DEAD_PCT = "CASE WHEN n_live > 0 THEN CAST(round(CAST(CAST(n_dead AS DOUBLE) * 100 / nullif(n_live + n_dead, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) ELSE 0.0 END"

ENTRIES = {
    "p01_status_band": Entry(
        lambda t: t.file_space.select(
            "file_name",
            (F.col("used_mb") * 100 / F.col("size_mb") >= 0).alias("measured"),
            rows.status_band(F.col("used_mb").cast("double") * 100 / F.col("size_mb"), "inclusive").alias("inclusive_status"),
            rows.status_band(F.col("used_mb").cast("double") * 100 / F.col("size_mb"), "strict").alias("strict_status"),
        ),
        with_views(f"""
        SELECT file_name, used_mb >= 0 AS measured,
               {sql_band('used_mb * 100.0 / size_mb', rules.SPACE_BAND['inclusive'], 'OK')} AS inclusive_status,
               {sql_band('used_mb * 100.0 / size_mb', rules.SPACE_BAND['strict'], 'OK')} AS strict_status
        FROM file_space"""),
    ),
    "p02_wait_category": Entry(
        lambda t: t.wait_stats_history.select(
            "server_name", "capture_time", "wait_type",
            *[rows.wait_category(F.col("wait_type"), p).alias(f"{p}_category") for p in SQL_WAIT_CATEGORY],
        ),
        with_views(
            "SELECT server_name, capture_time, wait_type, "
            + ", ".join(f"{text} AS {p}_category" for p, text in SQL_WAIT_CATEGORY.items())
            + " FROM wait_stats_history"
        ),
    ),
    "p03_exclude_benign": Entry(
        lambda t: rows.exclude_benign(t.wait_stats_history, "wait_type", [*rules.BENIGN_WAITS, "CXPACKET"]),
        with_views("SELECT * FROM wait_stats_history WHERE wait_type <> 'CXPACKET'"),
    ),
    "p04_connection_detail": Entry(
        lambda t: rows.connection_detail(t.session_requests, AS_OF),
        with_views(f"""
        SELECT server_name, capture_time, session_id, login_name, program_name, status, wait_type, query_start, left(query_text, 200) AS current_query,
               CASE WHEN status = 'running' AND query_start < {NOW} - INTERVAL '5' MINUTE THEN 'Long Running'
                    WHEN status = 'idle in transaction' AND query_start < {NOW} - INTERVAL '5' MINUTE THEN 'Idle in Transaction'
                    WHEN status = 'idle' THEN 'Idle' ELSE 'Active' END AS connection_status
        FROM session_requests"""),
    ),
    "p05_long_running": Entry(
        lambda t: rows.long_running(t.session_requests, AS_OF, seconds=300),
        with_views(f"""
        SELECT server_name, capture_time, session_id, login_name, program_name, status, CAST(date_diff('second', query_start, {NOW}) AS BIGINT) AS duration_s,
               left(query_text, 100) AS query_preview
        FROM session_requests WHERE status <> 'idle' AND query_start < {NOW} - INTERVAL '300' SECOND"""),
    ),
    "p06_active_sessions": Entry(
        lambda t: rows.active_sessions(t.session_requests, AS_OF),
        with_views(f"""
        SELECT server_name, capture_time, session_id, login_name, host_name, program_name, status, wait_type, wait_time_ms, blocking_session_id AS blocked_by,
               CAST(date_diff('second', query_start, {NOW}) AS BIGINT) AS duration_s,
               CASE WHEN status = 'idle' THEN CAST(date_diff('second', query_start, {NOW}) AS BIGINT) END AS idle_s,
               left(query_text, 100) AS current_query, CASE WHEN status = 'idle' THEN 1 ELSE 0 END AS idle_rank
        FROM session_requests"""),
    ),
    "p07_slow_queries": Entry(
        lambda t: rows.slow_queries(slow_log(t), AS_OF),
        with_views(f"""
        SELECT event_id, start_time, server_name AS user_host, duration_ms AS query_time, changed_pages AS rows_examined
        FROM trace_events WHERE start_time >= {NOW} - INTERVAL '24' HOUR ORDER BY duration_ms DESC, event_id LIMIT 50"""),
    ),
    "p08_invalid_objects": Entry(
        lambda t: rows.invalid_objects(t.object_catalog),
        with_views(f"""
        SELECT server_name, database_name, owner, object_type, object_name, object_id, status, strftime(last_ddl_time, '%Y-%m-%d %H:%M:%S') AS last_ddl
        FROM object_catalog WHERE status <> 'VALID' AND object_type IN ({names(rules.CHECKED_OBJECT_TYPES)})
          AND owner NOT IN ({names(rules.SYSTEM_OWNERS_OBJECTS)})"""),
    ),
    "p09_recent_errors": Entry(
        lambda t: rows.recent_errors(classified(t), AS_OF, hours=24, n=100),
        with_views(f"""WITH c AS ({sql_classified(7)})
        SELECT *, {sql_band('severity', rules.ERROR_PRIORITY, 'LOW')} AS priority
        FROM c WHERE severity >= 10 AND log_date >= {NOW} - INTERVAL '24' HOUR
        ORDER BY log_date DESC, severity DESC, log_id LIMIT 100"""),
    ),
    "p10_deadlocks": Entry(
        lambda t: rows.deadlocks(classified(t), AS_OF),
        with_views(f"""
        SELECT log_id, server_name, log_date, left(log_text, 2000) AS deadlock_snippet FROM error_log
        WHERE log_text ILIKE '%deadlock%' AND log_date >= {NOW} - INTERVAL '7' DAY"""),
    ),
    "p11_classify_log": Entry(
        lambda t: classified(t, days=30),
        with_views(sql_classified(30)),
    ),
    "p12_autogrowth_events": Entry(
        lambda t: rows.autogrowth_events(t.trace_events, AS_OF),
        with_views(f"""
        SELECT server_name, event_id, database_name, CASE file_type_code WHEN 0 THEN 'Row Data' WHEN 1 THEN 'Log' END AS file_type, start_time,
               CASE event_class WHEN 92 THEN 'Autogrowth' WHEN 93 THEN 'Shrink' END AS event_type,
               CASE WHEN event_class = 92 THEN CAST(round(CAST(CAST(changed_pages AS DOUBLE) * 8 / 1024 AS DECIMAL(38, 10)), 4) AS DOUBLE) END AS growth_mb
        FROM trace_events WHERE event_class IN (92, 93) AND date_diff('day', start_time, {NOW}) <= 7"""),
    ),
    "p13_job_runs": Entry(
        lambda t: rows.job_runs(t.job_history, AS_OF),
        with_views(f"""
        SELECT run_id, server_name, job_name, run_time, CAST(strftime(run_time, '%Y%m%d') AS BIGINT) AS run_date_key,
               CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled'
                    WHEN 4 THEN 'In Progress' ELSE 'Unknown' END AS status, duration_s
        FROM job_history WHERE CAST(strftime(run_time, '%Y%m%d') AS BIGINT) >= 20240130"""),
    ),
    "p13_job_runs_whole": Entry(
        lambda t: rows.job_runs(t.job_history, AS_OF, hours=72, whole_job_only=True),
        with_views(f"""
        SELECT run_id, server_name, job_name, run_time, CAST(strftime(run_time, '%Y%m%d') AS BIGINT) AS run_date_key,
               CASE run_status WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled'
                    WHEN 4 THEN 'In Progress' ELSE 'Unknown' END AS status, duration_s
        FROM job_history WHERE step_id = 0 AND CAST(strftime(run_time, '%Y%m%d') AS BIGINT) >= 20240128"""),
    ),
    "p14_databases_not_online": Entry(
        lambda t: rows.databases_not_online(t.database_catalog),
        with_views("""SELECT server_name, database_name, state_desc, recovery_model, is_read_only FROM database_catalog WHERE state_desc <> 'ONLINE'"""),
    ),
    "p14_recovery_model_counts": Entry(
        lambda t: rows.recovery_model_counts(t.database_catalog),
        with_views("""
        SELECT server_name, CAST(count(*) AS BIGINT) AS databases, CAST(sum(CASE WHEN recovery_model = 'FULL' THEN 1 ELSE 0 END) AS BIGINT) AS full_recovery,
               CAST(sum(CASE WHEN recovery_model = 'SIMPLE' THEN 1 ELSE 0 END) AS BIGINT) AS simple_recovery,
               CAST(sum(CASE WHEN recovery_model = 'BULK_LOGGED' THEN 1 ELSE 0 END) AS BIGINT) AS bulk_logged
        FROM database_catalog GROUP BY server_name"""),
    ),
    "p15_fragmentation_action": Entry(
        lambda t: rows.fragmentation_action(t.index_catalog),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, frag_pct, used_pages,
               {sql_band('frag_pct', rules.FRAGMENTATION, 'OK')} AS recommended_action
        FROM index_catalog WHERE frag_pct > 0 AND used_pages > 1000"""),
    ),
    "p15_maintenance_plan": Entry(
        lambda t: rows.maintenance_plan(t.index_catalog, AS_OF, min_pages=400),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, CASE WHEN frag_pct >= 30 THEN 'REBUILD' ELSE 'REORGANIZE' END AS operation_type,
               frag_pct AS frag_before, used_pages AS pages_before, {NOW} AS operation_start,
               'ALTER INDEX [' || index_name || '] ON [' || database_name || '].[' || schema_name || '].[' || table_name || '] '
                   || CASE WHEN frag_pct >= 30 THEN 'REBUILD' ELSE 'REORGANIZE' END || ';' AS statement
        FROM index_catalog WHERE used_pages > 400 AND frag_pct BETWEEN 5 AND 100"""),
    ),
    "p16_index_usage_status": Entry(
        lambda t: rows.index_usage_status(t.index_catalog, "detail"),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, user_scans, used_pages * 8 AS size_kb,
               {sql_band('user_scans', rules.INDEX_USAGE['detail'], 'ACTIVE')} AS status
        FROM index_catalog WHERE index_name NOT LIKE '%pkey%'"""),
    ),
    "p16_index_usage_health": Entry(
        lambda t: rows.index_usage_status(t.index_catalog, "health"),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, user_scans, used_pages * 8 AS size_kb,
               {sql_band('user_scans', rules.INDEX_USAGE['health'], 'ACTIVE')} AS status
        FROM index_catalog"""),
    ),
    "p16_index_read_verdict": Entry(
        lambda t: rows.index_read_verdict(t.index_catalog, t.index_columns),
        with_views("""
        SELECT i.server_name, i.database_name, i.schema_name, i.table_name, i.index_name, k.indexed_columns, user_seeks, user_scans, user_lookups, user_updates, is_primary_key, is_unique,
               CASE WHEN user_seeks = 0 AND user_scans = 0 AND user_lookups = 0 THEN 'UNUSED - DROP CANDIDATE'
                    WHEN user_seeks = 0 AND user_scans < 10 THEN 'RARELY USED' ELSE 'IN USE' END AS recommendation
        FROM index_catalog i LEFT JOIN (SELECT server_name, database_name, schema_name, table_name, index_id,
             string_agg(column_name, ', ' ORDER BY key_ordinal) AS indexed_columns FROM index_columns GROUP BY 1, 2, 3, 4, 5) k
             ON k.server_name = i.server_name AND k.database_name = i.database_name AND k.schema_name = i.schema_name
             AND k.table_name = i.table_name AND k.index_id = i.index_id"""),
    ),
    "p17_index_review": Entry(
        lambda t: rows.index_review(t.index_catalog.withColumn("used_pages", F.col("used_pages") * 2)),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, index_name, user_scans, CAST(floor(used_pages * 16 / 1024) AS BIGINT) AS index_size_mb,
               CASE WHEN user_scans = 0 AND floor(used_pages * 16 / 1024) > 10 THEN 'DROP - Unused and large'
                    WHEN user_scans < 100 AND floor(used_pages * 16 / 1024) > 5 THEN 'Review - Low usage' ELSE 'OK' END AS recommendation
        FROM index_catalog WHERE is_primary_key = 0"""),
    ),
    "p18_index_selectivity": Entry(
        lambda t: rows.index_selectivity(
            t.index_catalog.select(
                "server_name", "database_name", "schema_name", "table_name", "index_name", (F.col("user_seeks") % 40).alias("cardinality"),
                (1 - F.col("is_unique")).alias("non_unique"), F.col("last_used").alias("capture_time"),
            ),
            t.index_catalog.select(
                "server_name", "database_name", "schema_name", "table_name", (F.col("used_pages") * 20).alias("n_rows"),
                F.col("last_used").alias("capture_time"),
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT i.server_name, i.database_name, i.schema_name, i.table_name, i.index_name, i.user_seeks % 40 AS cardinality, s.table_rows,
               CASE WHEN i.user_seeks % 40 = 0 THEN 'UNUSED'
                    WHEN s.table_rows > 0 AND CAST(i.user_seeks % 40 AS DOUBLE) / s.table_rows < 0.01 THEN 'LOW SELECTIVITY' ELSE 'OK' END AS status
        FROM index_catalog i JOIN (SELECT server_name, database_name, schema_name, table_name, max(used_pages * 20) AS table_rows FROM index_catalog
             WHERE last_used >= {NOW} - INTERVAL '1' DAY GROUP BY 1, 2, 3, 4) s ON i.table_name = s.table_name AND i.server_name = s.server_name
             AND i.database_name = s.database_name AND i.schema_name = s.schema_name
        WHERE i.last_used >= {NOW} - INTERVAL '1' DAY AND i.is_unique = 0"""),
    ),
    "p19_scan_heavy_tables": Entry(
        lambda t: rows.scan_heavy_tables(
            t.table_stats.select(
                "server_name", "database_name", "schema_name", "table_name", F.col("blks_hit").alias("seq_scan"), F.col("blks_read").alias("idx_scan"), F.col("n_dead").alias("writes")
            )
        ),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, blks_hit AS seq_scan, blks_read AS idx_scan, n_dead AS writes FROM table_stats
        WHERE n_dead > 1000 AND blks_hit > blks_read * 10"""),
    ),
    "p19_scan_heavy_indexes": Entry(
        lambda t: rows.scan_heavy_indexes(t.index_catalog, min_mb=2),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, index_name, user_scans, user_seeks, CAST(floor(used_pages * 8 / 1024) AS BIGINT) AS table_size_mb,
               CASE WHEN user_scans > user_seeks * 10 THEN 'SCAN HEAVY' ELSE 'OK' END AS recommendation
        FROM index_catalog WHERE floor(used_pages * 8 / 1024) > 2"""),
    ),
    "p20_table_bloat": Entry(
        lambda t: rows.table_bloat(t.table_stats.withColumn("free_bytes", F.col("n_dead") * 40)),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, n_live, n_dead, {SQL_DEAD_PCT} AS dead_pct,
               {sql_bytes('(table_bytes + index_bytes)')} AS total_size, {sql_bytes('table_bytes')} AS table_size,
               CASE WHEN n_dead > 0 AND table_bytes > 0 THEN CAST(round(CAST(CAST(n_dead * 40 AS DOUBLE) / table_bytes * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) ELSE 0.0 END AS bloat_ratio,
               CASE WHEN n_dead > 0 AND table_bytes > 0 AND CAST(n_dead * 40 AS DOUBLE) / table_bytes * 100 > 20 THEN 'CLEANUP NEEDED' ELSE 'OK' END AS status,
               CASE WHEN table_bytes + index_bytes > 0 THEN CAST(round(CAST(CAST(index_bytes AS DOUBLE) * 100 / (table_bytes + index_bytes) AS DECIMAL(38, 10)), 1) AS DOUBLE) ELSE 0.0 END AS overhead_pct
        FROM table_stats"""),
    ),
    "p21_vacuum_recommendation": Entry(
        lambda t: rows.vacuum_recommendation(t.table_stats, AS_OF),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, n_dead, n_live, {SQL_DEAD_PCT} AS dead_pct, last_autovacuum,
               CASE WHEN n_dead > 10000 AND last_autovacuum < {NOW} - INTERVAL '1' DAY THEN 'AUTOVACUUM NEEDED'
                    WHEN n_dead > 50000 THEN 'MANUAL VACUUM RECOMMENDED' ELSE 'OK' END AS recommendation
        FROM table_stats WHERE n_dead > 1000"""),
    ),
    "p22_cache_hit_ratio": Entry(
        lambda t: rows.cache_hit_ratio(
            t.table_stats.withColumns({"idx_blks_hit": F.col("chained_rows"), "idx_blks_read": F.col("blks_read") * 2}), n=25
        ),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, blks_hit, blks_read, blks_hit + blks_read AS total_blks,
               CAST(round(CAST(CAST(blks_hit AS DOUBLE) * 100 / nullif(blks_hit + blks_read, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS cache_hit_ratio,
               CAST(round(CAST(CAST(chained_rows AS DOUBLE) * 100 / nullif(chained_rows + blks_read * 2, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS idx_cache_ratio
        FROM table_stats WHERE blks_read > 0 ORDER BY cache_hit_ratio NULLS LAST, server_name, database_name, schema_name, table_name LIMIT 25"""),
    ),
    "p23_row_chaining": Entry(
        lambda t: rows.row_chaining(t.table_stats),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, n_live, chained_rows, CAST(round(CAST(CAST(chained_rows AS DOUBLE) * 100 / nullif(n_live, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS chain_pct,
               CASE WHEN CAST(round(CAST(CAST(chained_rows AS DOUBLE) * 100 / nullif(n_live, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) > 10 THEN 'REBUILD NEEDED'
                    WHEN CAST(round(CAST(CAST(chained_rows AS DOUBLE) * 100 / nullif(n_live, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) > 5 THEN 'MONITOR' ELSE 'OK' END AS status
        FROM table_stats WHERE chained_rows > 0 AND n_live > 10000"""),
    ),
    "p24_index_bloat": Entry(
        lambda t: rows.index_bloat(t.table_stats),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, index_bytes,
               CAST(round(CAST(CASE WHEN n_live > 0 THEN (1 - CAST(n_live AS DOUBLE) / (n_live + n_dead + 1)) * 100 ELSE 0.0 END AS DECIMAL(38, 10)), 2) AS DOUBLE) AS bloat_pct
        FROM table_stats WHERE floor(index_bytes / 1048576) >= 1
          AND CASE WHEN n_live > 0 THEN (1 - CAST(n_live AS DOUBLE) / (n_live + n_dead + 1)) * 100 ELSE 0.0 END >= 20"""),
    ),
    "p24_clustering_verdict": Entry(
        lambda t: rows.clustering_verdict(
            t.table_stats.select(
                "server_name", "database_name", "schema_name", "table_name", "n_live", F.floor(F.col("index_bytes") / 8192).alias("leaf_blocks"),
                F.floor(F.col("n_dead") / 20).alias("clustering_factor"),
            )
        ),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, CAST(floor(index_bytes / 8192) AS BIGINT) AS leaf_blocks,
               CAST(floor(n_dead / 20) AS BIGINT) AS clustering_factor,
               CAST(round(CAST(floor(index_bytes / 8192) * 8192 / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS size_mb,
               CASE WHEN floor(n_dead / 20) > n_live * 0.1 THEN 'HIGH' ELSE 'OK' END AS recommendation
        FROM table_stats"""),
    ),
    "p25_file_usage": Entry(
        lambda t: rows.file_usage(
            t.file_space.withColumns({"size_pages": F.col("size_mb") * 128 + 7, "used_pages": F.col("used_mb") * 128 + 3})
        ),
        with_views("""
        SELECT server_name, database_name, file_name, CASE WHEN file_type = 'ROWS' THEN 'Data' ELSE 'Log' END AS file_type,
               CAST(round(CAST(CAST(size_mb * 128 + 7 AS DOUBLE) / 128 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS size_mb, CAST(round(CAST(CAST(used_mb * 128 + 3 AS DOUBLE) / 128 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_mb,
               CAST(round(CAST(CAST((size_mb - used_mb) * 128 + 4 AS DOUBLE) / 128 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS free_mb,
               CAST(round(CAST(CAST((size_mb - used_mb) * 128 + 4 AS DOUBLE) * 100 / (size_mb * 128 + 7) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS free_pct,
               CAST(round(CAST(CAST(used_mb * 128 + 3 AS DOUBLE) * 100 / (size_mb * 128 + 7) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct
        FROM file_space"""),
    ),
    "p26_file_capacity_risk": Entry(
        lambda t: rows.file_capacity_risk(t.file_space),
        with_views("""
        SELECT server_name, database_name, file_name, size_mb - used_mb AS free_mb, max_size_mb,
               CAST(round(CAST(CAST(size_mb - used_mb AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS free_gb,
               CAST(round(CAST(CAST(max_size_mb - (size_mb - used_mb) AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_gb,
               CAST(round(CAST(CAST(size_mb - used_mb AS DOUBLE) * 100 / nullif(max_size_mb, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS free_pct,
               CASE WHEN CAST(size_mb - used_mb AS DOUBLE) * 100 / nullif(max_size_mb, 0) < 10 THEN 'CRITICAL'
                    WHEN CAST(size_mb - used_mb AS DOUBLE) * 100 / nullif(max_size_mb, 0) < 20 THEN 'WARNING' ELSE 'OK' END AS status
        FROM file_space WHERE max_size_mb > 0"""),
    ),
    "p27_settings_drift": Entry(
        lambda t: rows.settings_drift(latest_settings(t), recommended_settings(t)),
        with_views(
            "WITH wanted(setting_name, recommended) AS (VALUES "
            + ", ".join(f"('{a}', '{b}')" for a, b in rules.RECOMMENDED_SETTINGS)
            + """),
        cur AS (SELECT server_name, setting_name, setting_value FROM settings_snapshot s WHERE capture_time =
                (SELECT max(capture_time) FROM settings_snapshot x WHERE x.server_name = s.server_name AND x.setting_name = s.setting_name)),
        grid AS (SELECT s.server_name, w.setting_name, w.recommended FROM (SELECT DISTINCT server_name FROM cur) s CROSS JOIN wanted w)
        SELECT coalesce(g.server_name, c.server_name) AS server_name, coalesce(g.setting_name, c.setting_name) AS setting_name,
               g.recommended, c.setting_value,
               CASE WHEN c.setting_value IS NULL THEN 'MISSING' WHEN g.recommended IS NULL THEN 'NOT COVERED' ELSE 'DIFFERENT' END AS drift
        FROM grid g FULL JOIN cur c ON g.server_name = c.server_name AND g.setting_name = c.setting_name
        WHERE c.setting_value IS DISTINCT FROM g.recommended"""
        ),
    ),
    "p28_replication_lag": Entry(
        lambda t: rows.replication_lag(t.replica_lag),
        with_views(f"""
        SELECT server_name, ag_name, replica_name, capture_time, sent_lsn, replay_lsn, sent_lsn - replay_lsn AS lag_bytes,
               {sql_bytes('(sent_lsn - replay_lsn)')} AS lag_size,
               CASE WHEN sent_lsn - replay_lsn > 1073741824 THEN 'CRITICAL' WHEN sent_lsn - replay_lsn > 104857600 THEN 'WARNING' ELSE 'OK' END AS status
        FROM replica_lag r WHERE capture_time = (SELECT max(capture_time) FROM replica_lag x
            WHERE x.server_name = r.server_name AND x.ag_name = r.ag_name AND x.replica_name = r.replica_name)"""),
    ),
    "p28_recent_channel_lag": Entry(
        lambda t: rows.recent_channel_lag(channels(t), AS_OF, hours=12),
        with_views(f"""
        SELECT server_name, capture_time, replica_name, CAST(floor((sent_lsn - replay_lsn) / 1000000) AS BIGINT) AS seconds_behind
        FROM replica_lag WHERE capture_time >= {NOW} - INTERVAL '12' HOUR"""),
    ),
    "p29_replica_health": Entry(
        lambda t: rows.replica_health(t.replica_lag, AS_OF),
        with_views(f"""WITH h AS (SELECT *, operational_state = 'Online' AND sync_health = 'Healthy' AND recovery_health = 'Online' AS ok FROM replica_lag)
        SELECT server_name, ag_name, replica_name, replica_role, capture_time, operational_state, sync_health,
               CASE WHEN redo_queue_mb > 100 THEN 'HIGH LAG' WHEN send_queue_mb > 50 THEN 'SEND LAG' ELSE 'OK' END AS lag_status,
               CASE WHEN ok THEN 'HEALTHY' ELSE 'UNHEALTHY' END AS health_status,
               CASE WHEN replica_role = 'PRIMARY' AND NOT ok THEN 'ACTION REQUIRED' ELSE '' END AS action_required
        FROM h WHERE capture_time >= {NOW} - INTERVAL '24' HOUR"""),
    ),
    "p30_sync_lag_minutes": Entry(
        lambda t: rows.sync_lag_minutes(t.replica_lag, AS_OF),
        with_views(f"""
        SELECT server_name, ag_name, database_name, replica_name, capture_time, last_commit_time, {sql_minutes('last_commit_time', NOW)} AS sync_lag_minutes
        FROM replica_lag WHERE capture_time >= {NOW} - INTERVAL '24' HOUR"""),
    ),
    "p31_query_issue_reads_first": Entry(
        lambda t: rows.query_issue(t.query_stats_snapshot, "reads_first"),
        with_views("""
        SELECT server_name, database_name, query_hash, left(query_text, 200) AS query_preview, exec_count,
               CAST(floor(total_elapsed_ms / nullif(exec_count, 0)) AS BIGINT) AS avg_elapsed_ms,
               CAST(floor(logical_reads / nullif(exec_count, 0)) AS BIGINT) AS avg_logical_reads, total_elapsed_ms, logical_reads,
               CASE WHEN floor(logical_reads / nullif(exec_count, 0)) > 100000 THEN 'High Reads'
                    WHEN floor(total_elapsed_ms / nullif(exec_count, 0)) > 10000 THEN 'High Duration'
                    WHEN exec_count > 1000 THEN 'High Frequency' ELSE 'Other' END AS issue_type
        FROM query_stats_snapshot ORDER BY total_elapsed_ms DESC, server_name, database_name, query_hash, exec_count, logical_reads LIMIT 50"""),
    ),
    "p31_query_issue_duration_first": Entry(
        lambda t: rows.query_issue(t.query_stats_snapshot, "duration_first", n=200),
        with_views("""
        SELECT server_name, database_name, query_hash, left(query_text, 200) AS query_preview, exec_count,
               CAST(floor(total_elapsed_ms / nullif(exec_count, 0)) AS BIGINT) AS avg_elapsed_ms,
               CAST(floor(logical_reads / nullif(exec_count, 0)) AS BIGINT) AS avg_logical_reads, total_elapsed_ms, logical_reads,
               CASE WHEN CAST(total_elapsed_ms AS DOUBLE) / nullif(exec_count, 0) > 1000 THEN 'HIGH DURATION'
                    WHEN logical_reads > 10000 THEN 'HIGH READS'
                    WHEN exec_count > 10000 THEN 'HIGH FREQUENCY' ELSE 'Other' END AS issue_type
        FROM query_stats_snapshot ORDER BY total_elapsed_ms DESC, server_name, database_name, query_hash, exec_count, logical_reads LIMIT 200"""),
    ),
    "p32_object_wait_time": Entry(
        lambda t: rows.object_wait_time(
            t.table_stats.select(
                "schema_name", "table_name", F.col("chained_rows").alias("lock_count"), (F.col("n_dead") * 123456789).alias("wait_ps")
            )
        ),
        with_views("""
        SELECT schema_name, table_name, chained_rows AS lock_count, CAST(round(CAST(CAST(n_dead * 123456789 AS DOUBLE) / 1e12 AS DECIMAL(38, 10)), 6) AS DOUBLE) AS total_wait_s,
               CAST(round(CAST(CAST(n_dead * 123456789 AS DOUBLE) / 1e12 / nullif(chained_rows, 0) AS DECIMAL(38, 10)), 6) AS DOUBLE) AS avg_wait_s
        FROM table_stats ORDER BY n_dead DESC, schema_name, table_name LIMIT 30"""),
    ),
    "p33_contention_severity": Entry(
        lambda t: rows.contention_severity(contention(t), AS_OF, hours=48),
        with_views(f"""WITH c AS (SELECT server_name, capture_time, wait_type, wait_time_ms,
                   CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) / nullif(waiting_tasks, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_ms
                   FROM wait_stats_history WHERE wait_type IN ({names(rules.CONTENTION_WAITS)}))
        SELECT *, {SQL_WAIT_CATEGORY['contention']} AS category,
               {sql_band('avg_wait_ms', rules.CONTENTION_SEVERITY, 'LOW')} AS severity
        FROM c WHERE capture_time >= {NOW} - INTERVAL '48' HOUR"""),
    ),
    "p33_contention_summary": Entry(
        lambda t: rows.contention_summary(contention(t), AS_OF, hours=48),
        with_views(f"""WITH c AS (SELECT server_name, capture_time, wait_type, wait_time_ms,
                   CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) / nullif(waiting_tasks, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_ms
                   FROM wait_stats_history WHERE wait_type IN ({names(rules.CONTENTION_WAITS)}))
        SELECT *, CASE WHEN avg_wait_ms > 100 THEN 'CRITICAL - Investigate immediately'
                       WHEN avg_wait_ms > 10 THEN 'WARNING - Monitor closely' ELSE 'OK' END AS recommendation
        FROM c WHERE capture_time >= {NOW} - INTERVAL '48' HOUR
        ORDER BY avg_wait_ms DESC NULLS LAST, server_name, capture_time, wait_type LIMIT 10"""),
    ),
    "p33_latch_waits": Entry(
        lambda t: rows.latch_waits(t.wait_stats_history),
        with_views("""
        SELECT server_name, capture_time, wait_type, waiting_tasks, wait_time_ms,
               CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) / nullif(waiting_tasks, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_ms
        FROM wait_stats_history WHERE wait_type LIKE 'PAGELATCH%' AND wait_time_ms > 0"""),
    ),
    "p34_active_alerts": Entry(
        lambda t: rows.active_alerts(alert_states(t), AS_OF),
        with_views(f"""WITH s AS (SELECT login_name, max(login_time) AS lt, CAST(count(*) AS BIGINT) AS trigger_count FROM login_audit
                   WHERE event_type = 'FAILED_LOGIN' GROUP BY login_name),
        c AS (SELECT 'Failed Logins ' || login_name AS alert_name, CASE WHEN login_name = 'login7' THEN 0 ELSE 1 END AS is_enabled,
                     CASE WHEN login_name <> 'login3' THEN lt END AS last_triggered, trigger_count FROM s)
        SELECT *, CASE WHEN last_triggered > {NOW} - INTERVAL '1' HOUR THEN 'RECENT'
                       WHEN last_triggered > {NOW} - INTERVAL '1' DAY THEN 'TODAY' ELSE 'STALE' END AS trigger_status
        FROM c WHERE is_enabled = 1"""),
    ),
    "p35_frag_delta": Entry(
        lambda t: rows.frag_delta(
            t.index_maintenance_log.select("server_name", "index_name", "operation_start", "frag_before", "frag_after")
        ),
        with_views("""
        SELECT server_name, index_name, operation_start, frag_before, frag_after,
               coalesce(frag_before, 0) - coalesce(frag_after, 0) AS frag_delta FROM index_maintenance_log"""),
    ),
    "p36_recommendations_open": Entry(
        lambda t: rows.recommendations_open(recommendations(t), AS_OF),
        with_views(f"""WITH r AS (SELECT server_name || '/' || group_handle AS rec_id, capture_time, avg_user_impact AS estimated_impact, user_seeks,
                   CASE WHEN avg_user_impact % 10 = 3 THEN 1 ELSE 0 END AS is_implemented FROM missing_index_stats)
        SELECT *, {sql_band('estimated_impact', rules.RECOMMENDATION_PRIORITY, 'LOW')} AS priority
        FROM r WHERE is_implemented = 0 AND capture_time >= {NOW} - INTERVAL '7' DAY
        ORDER BY estimated_impact DESC, user_seeks DESC, rec_id LIMIT 100"""),
    ),
    "p36_mark_resolved": Entry(
        lambda t: rows.mark_resolved(
            recommendations(t).withColumns(
                {"implemented_date": F.lit(None).cast("timestamp_ntz"), "notes": F.lit(None).cast("string")}
            ),
            t.missing_index_stats.where(F.col("user_seeks") > 130).select(
                F.concat_ws("/", "server_name", "group_handle").alias("rec_id"), F.concat(F.lit("seeks "), "user_seeks").alias("notes")
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT server_name || '/' || group_handle AS rec_id, capture_time, avg_user_impact AS estimated_impact, user_seeks,
               CASE WHEN user_seeks > 130 OR avg_user_impact % 10 = 3 THEN 1 ELSE 0 END AS is_implemented,
               CASE WHEN user_seeks > 130 THEN {NOW} END AS implemented_date,
               CASE WHEN user_seeks > 130 THEN 'seeks ' || user_seeks END AS notes
        FROM missing_index_stats"""),
    ),
    "p37_redo_log_groups": Entry(
        lambda t: rows.redo_log_groups(t.redo_log),
        with_views("""
        SELECT group_no, thread_no, sequence_no, CAST(bytes AS DOUBLE) / 1024 / 1024 AS size_mb, members, status FROM redo_log"""),
    ),
    "p38_setting_changes": Entry(
        lambda t: rows.setting_changes(t.settings_snapshot),
        with_views("""
        SELECT server_name, setting_name, capture_time AS change_time, prev AS old_value, setting_value AS new_value FROM (
            SELECT *, lag(setting_value) OVER (PARTITION BY server_name, setting_name ORDER BY capture_time) AS prev,
                   row_number() OVER (PARTITION BY server_name, setting_name ORDER BY capture_time) AS rn FROM settings_snapshot) x
        WHERE rn > 1 AND prev IS DISTINCT FROM setting_value"""),
    ),
    "fx_text": Entry(
        lambda t: t.missing_index_details.select(
            "index_handle",
            F.regexp_replace("equality_columns", r"[\[\]]", "").alias("bare_columns"),
            F.concat(F.col("table_name"), F.lit("."), F.col("inequality_columns")).alias("joined"),
            F.concat_ws(".", "schema_name", "table_name").alias("qualified"),
            F.repeat(F.lit("  "), (F.col("index_handle") % 4).cast("int")).alias("indent"),
            fill_template(F.lit("Job {0} failed"), F.col("table_name")).alias("message"),
            F.substring("equality_columns", 1, 4).alias("preview"),
            F.col("equality_columns").like("[c1]%").alias("starts_with_c1"),
        ),
        with_views("""
        SELECT index_handle, replace(replace(equality_columns, '[', ''), ']', '') AS bare_columns, table_name || '.' || inequality_columns AS joined,
               schema_name || '.' || table_name AS qualified, repeat('  ', CAST(index_handle % 4 AS INT)) AS indent,
               'Job ' || table_name || ' failed' AS message, left(equality_columns, 4) AS preview, equality_columns LIKE '[c1]%' AS starts_with_c1
        FROM missing_index_details"""),
    ),
    "fx_dates": Entry(
        lambda t: t.replica_lag.select(
            "capture_time",
            *[boundary_diff(u, F.col("last_commit_time"), F.col("capture_time")).alias(f"{u}s_crossed") for u in ("minute", "hour", "day")],
            seconds_between(F.col("last_commit_time"), F.col("capture_time")).alias("lag_s"),
            F.date_format("capture_time", "yyyyMMdd").cast("bigint").alias("date_key"),
            F.date_format("capture_time", "yyyy-MM-dd HH").alias("hour_text"),
            F.make_date(F.year("capture_time"), F.month("capture_time"), F.lit(1)).alias("month_start"),
            (F.col("capture_time") - F.expr("INTERVAL '1' DAY")).alias("day_earlier"),
        ),
        with_views("""
        SELECT capture_time, CAST(date_diff('minute', last_commit_time, capture_time) AS BIGINT) AS minutes_crossed,
               CAST(date_diff('hour', last_commit_time, capture_time) AS BIGINT) AS hours_crossed,
               CAST(date_diff('day', last_commit_time, capture_time) AS BIGINT) AS days_crossed,
               CAST(date_diff('second', last_commit_time, capture_time) AS BIGINT) AS lag_s,
               CAST(strftime(capture_time, '%Y%m%d') AS BIGINT) AS date_key, strftime(capture_time, '%Y-%m-%d %H') AS hour_text,
               CAST(date_trunc('month', capture_time) AS DATE) AS month_start, capture_time - INTERVAL '1' DAY AS day_earlier
        FROM replica_lag"""),
    ),
    "fx_nulls_and_math": Entry(
        lambda t: t.index_maintenance_log.select(
            "index_name",
            "operation_start",
            "duration_s",
            F.coalesce("frag_before", F.lit(0).cast("bigint")).alias("frag_or_zero"),
            F.nullif("frag_after", F.lit(0).cast("bigint")).alias("frag_or_null"),
            F.abs(F.col("frag_after") - F.col("frag_before")).alias("change"),
            ratio(F.col("frag_before"), F.col("frag_after")).alias("ratio"),
            truncated_div(F.col("duration_s"), F.col("frag_after")).alias("whole"),
            F.col("frag_before").eqNullSafe(F.col("frag_after")).alias("same"),
        ),
        with_views("""
        SELECT index_name, operation_start, duration_s, coalesce(frag_before, 0) AS frag_or_zero, nullif(frag_after, 0) AS frag_or_null,
               abs(frag_after - frag_before) AS change, CAST(round(CAST(CAST(frag_before AS DOUBLE) / nullif(frag_after, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS ratio,
               CAST(floor(duration_s / nullif(frag_after, 0)) AS BIGINT) AS whole, frag_before IS NOT DISTINCT FROM frag_after AS same
        FROM index_maintenance_log"""),
    ),
    "fx_rate_and_type_text": Entry(
        lambda t: t.column_catalog.select(
            "column_id",
            type_text(F.col("data_type"), F.col("max_length"), F.col("num_precision"), F.col("num_scale")).alias("type_text"),
            format_rate_mb((F.col("column_id") * 3).cast("double")).alias("rate_text"),
        ),
        with_views("""
        SELECT column_id, CASE WHEN max_length IS NOT NULL THEN data_type || '(' || max_length || ')'
                    WHEN num_precision IS NOT NULL THEN data_type || '(' || num_precision || ',' || num_scale || ')' ELSE data_type END AS type_text,
               CASE WHEN column_id * 3 > 1024 THEN printf('%.2f', CAST(round(CAST(CAST(column_id * 3 AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' GB/day'
                    ELSE printf('%.2f', CAST(column_id * 3 AS DOUBLE)) || ' MB/day' END AS rate_text
        FROM column_catalog"""),
    ),
    "fx_format_bytes": Entry(
        lambda t: t.table_stats.select("table_name", format_bytes(F.col("table_bytes") * F.col("n_live")).alias("size_text")),
        with_views(f"SELECT table_name, {sql_bytes('(table_bytes * n_live)')} AS size_text FROM table_stats"),
    ),
}
