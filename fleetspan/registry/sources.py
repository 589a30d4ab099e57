"""Capture, retention and sink queries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from fleetspan.functions.rules import CONTENTION_WAITS
from fleetspan.operators import ingest
from fleetspan.registry import Entry, with_views
from fleetspan.session import scratch_path
from fleetspan.sources import landing, logfiles
from fleetspan.sources.versioned import VersionedTable
from fleetspan.sources.views import AS_OF

NOW = "TIMESTAMP '2024-01-31 00:00:00'"


def _names(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _free(t):
    return t.file_space.select("server_name", "tablespace_name", (F.col("size_mb") - F.col("used_mb")).alias("free_mb"))


def _variables(t):
    """Counters as key/value status variables."""
    return t.perf_counters.select(
        "server_name",
        F.concat(F.lit("Innodb_"), F.regexp_replace(F.lower("counter_name"), "[ /]", "_")).alias("variable_name"),
        F.col("counter_value").cast("string").alias("variable_value"),
    )


def _slow_log(t):
    return t.trace_events.select(
        "event_id", F.col("start_time"), F.col("server_name").alias("user_host"), F.col("duration_ms").alias("query_time"),
        F.col("changed_pages").alias("rows_examined"),
    )


def _log_files(t):
    """The connection log as text files in which failures have a detail of two lines, read back as records."""
    prefix = F.regexp_extract("line", r"^(.*?\] \S+ )", 1)
    rule = F.concat(F.lit("DETAIL:  Connection matched rule "), F.regexp_extract("line", r"\[(\d+)\]", 1), F.lit("\n\tof the host file"))
    text = F.when(F.col("line").contains("FATAL"), F.concat("line", F.lit("\n"), prefix, rule)).otherwise(F.col("line"))
    path = scratch_path(t.spark, "server-log")
    t.connection_log.select(text.alias("value")).write.text(path)
    records = logfiles.log_records(logfiles.read_lines(t.spark, path))
    return ingest.parse_connection_log(records, AS_OF, days_back=20, keep=["added"])


def _upsert(t):
    stats = t.query_stats_snapshot.select("server_name", "query_hash", "capture_time", "exec_count", "total_elapsed_ms")
    cut = AS_OF - timedelta(hours=2, minutes=30)
    literal = F.lit(cut.isoformat(sep=" ")).cast("timestamp_ntz")
    store = VersionedTable(t.spark, scratch_path(t.spark, "query-store"))
    for batch in (stats.where(F.col("capture_time") < literal), stats.where(F.col("capture_time") >= literal)):
        store.upsert(batch, ["server_name", "query_hash"], buckets=8, time_col="capture_time")
    return store.read()


def _history_round_trip(t):
    path = scratch_path(t.spark, "wait-history")
    landing.append_history(ingest.capture_waits(t.wait_stats_history.drop("capture_time"), AS_OF), path)
    landing.append_history(t.wait_stats_history, path)
    return landing.read_history(t.spark, path, since=AS_OF - timedelta(days=7), until=AS_OF).select(
        "server_name", "capture_time", "wait_type", "wait_time_ms"
    )


def _report(t):
    path = scratch_path(t.spark, "report")
    totals = t.wait_stats_history.groupBy("server_name", "wait_type").agg(
        F.sum("wait_time_ms").cast("bigint").alias("wait_time_ms")
    )
    landing.write_report(totals, path, "srv0", AS_OF)
    return t.spark.read.parquet(path)


ENTRIES = {
    "s01_capture_waits": Entry(
        lambda t: ingest.capture_waits(t.wait_stats_history.drop("capture_time"), AS_OF),
        with_views(f"""
        SELECT server_name, wait_type, wait_time_ms, signal_wait_ms, waiting_tasks, {NOW} AS capture_time
        FROM wait_stats_history WHERE wait_time_ms > 0 AND waiting_tasks > 0"""),
    ),
    "s01_capture_wait_classes": Entry(
        lambda t: ingest.capture_wait_classes(
            t.wait_stats_history.drop("capture_time").withColumn(
                "wait_class", F.when(F.col("wait_type").like("ASYNC%"), "Idle").otherwise("Work")
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT server_name, wait_type, wait_time_ms, signal_wait_ms, waiting_tasks, 'Work' AS wait_class, {NOW} AS capture_time
        FROM wait_stats_history WHERE waiting_tasks > 0 AND wait_type NOT LIKE 'ASYNC%'"""),
    ),
    "s01_capture_wait_events": Entry(
        lambda t: ingest.capture_wait_events(
            t.session_requests.select(
                F.col("host_name").alias("server_name"),
                F.col("status").alias("wait_event_type"),
                F.col("wait_type").alias("wait_event"),
                F.lit(1).alias("wait_count"),
                "wait_time_ms",
                F.floor(F.col("wait_time_ms") / 2).alias("signal_wait_ms"),
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT host_name AS server_name, status || ':' || coalesce(wait_type, 'None') AS wait_type,
               CAST(count(*) AS BIGINT) AS wait_count, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms,
               CAST(sum(CAST(floor(wait_time_ms / 2) AS BIGINT)) AS BIGINT) AS signal_wait_ms, {NOW} AS capture_time
        FROM session_requests GROUP BY 1, 2"""),
    ),
    "s01_history_round_trip": Entry(
        _history_round_trip,
        with_views(f"""
        SELECT server_name, capture_time, wait_type, wait_time_ms FROM wait_stats_history
        WHERE capture_time >= {NOW} - INTERVAL '7' DAY AND capture_time < {NOW}"""),
    ),
    "s02_capture_perf_counters": Entry(
        lambda t: ingest.capture_perf_counters(t.perf_counters.drop("capture_time"), AS_OF),
        with_views(f"""
        SELECT server_name, counter_name, counter_value, {NOW} AS capture_time FROM perf_counters WHERE counter_value > 0"""),
    ),
    "s03_capture_sessions": Entry(
        lambda t: ingest.capture_sessions(
            t.session_requests.select("session_id", "login_name", "program_name", "status", "query_start", "query_text"),
            AS_OF,
            server="srv0",
            own_session=51,
        ),
        with_views(f"""
        SELECT session_id, login_name, program_name, status, query_start, query_text,
               'srv0' AS server_name, {NOW} AS capture_time
        FROM session_requests WHERE login_name IS NOT NULL AND session_id <> 51"""),
    ),
    "s04_capture_connection_counts": Entry(
        lambda t: ingest.capture_connection_counts(t.session_requests, AS_OF),
        with_views(f"""
        SELECT server_name, login_name, status AS command, CAST(count(*) AS BIGINT) AS connections, {NOW} AS capture_time
        FROM session_requests GROUP BY server_name, login_name, status"""),
    ),
    "s05_capture_database_sizes": Entry(
        lambda t: ingest.capture_database_sizes(t.file_space, t.database_catalog, AS_OF),
        with_views(f"""
        SELECT f.server_name, f.database_name,
               CAST(sum(CASE WHEN f.file_type = 'ROWS' THEN f.size_mb ELSE 0 END) AS BIGINT) AS data_mb,
               CAST(sum(CASE WHEN f.file_type = 'LOG' THEN f.size_mb ELSE 0 END) AS BIGINT) AS log_mb,
               CAST(sum(f.used_mb) AS BIGINT) AS used_mb, CAST(sum(f.size_mb - f.used_mb) AS BIGINT) AS free_mb,
               CAST(sum(f.size_mb) AS BIGINT) AS total_mb, {NOW} AS capture_time
        FROM file_space f WHERE EXISTS (SELECT 1 FROM database_catalog d WHERE f.database_name = d.database_name AND f.server_name = d.server_name
            AND d.state_desc = 'ONLINE' AND d.is_read_only = 0) GROUP BY f.server_name, f.database_name"""),
    ),
    "s05_capture_tablespace_sizes": Entry(
        lambda t: ingest.capture_tablespace_sizes(t.file_space, _free(t), AS_OF),
        with_views(f"""
        SELECT server_name, tablespace_name, CAST(sum(size_mb) AS BIGINT) AS total_mb, CAST(sum(used_mb) AS BIGINT) AS used_mb,
               CAST(sum(size_mb - used_mb) AS BIGINT) AS free_mb,
               CAST(round(CAST(CAST(sum(used_mb) AS DOUBLE) * 100 / sum(size_mb) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS pct_used, {NOW} AS capture_time
        FROM file_space GROUP BY server_name, tablespace_name"""),
    ),
    "s06_capture_table_sizes": Entry(
        lambda t: ingest.capture_table_sizes(t.table_stats, AS_OF, skip_schemas=["schema3"]),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, table_bytes, index_bytes, table_bytes + index_bytes AS total_bytes,
               CAST(round(CAST(CAST(table_bytes AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS table_mb, CAST(round(CAST(CAST(index_bytes AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS index_mb,
               CAST(round(CAST(CAST(table_bytes + index_bytes AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS total_mb, n_live, n_dead, {NOW} AS capture_time
        FROM table_stats WHERE schema_name <> 'schema3'"""),
    ),
    "s06_capture_segment_sizes": Entry(
        lambda t: ingest.capture_segment_sizes(
            t.table_stats.select(
                "server_name",
                F.col("schema_name").alias("owner"),
                F.concat(F.lit("seg"), F.floor(F.col("n_live") / 1000)).alias("table_name"),
                F.lit("USERS").alias("tablespace_name"),
                F.col("table_bytes").alias("bytes"),
                F.col("n_live").alias("num_rows"),
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT server_name, schema_name AS owner, 'seg' || CAST(floor(n_live / 1000) AS BIGINT) AS table_name, 'USERS' AS tablespace_name,
               CAST(round(CAST(CAST(sum(table_bytes) AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS size_mb, CAST(sum(n_live) AS BIGINT) AS num_rows,
               {NOW} AS capture_time
        FROM table_stats GROUP BY 1, 2, 3, 4"""),
    ),
    "s07_capture_index_stats": Entry(
        lambda t: ingest.capture_index_stats(t.index_catalog, AS_OF),
        with_views(f"""
        SELECT server_name, database_name, schema_name, table_name, index_name, is_unique, used_pages, user_seeks, user_scans, user_lookups, user_updates,
               {NOW} AS capture_time FROM index_catalog"""),
    ),
    "s08_capture_query_stats": Entry(
        lambda t: ingest.capture_query_stats(
            t.query_stats_snapshot.drop("capture_time"), AS_OF, min_calls=10,
            key=["database_name", "query_hash", "exec_count", "logical_reads"],
        ),
        with_views(f"""
        SELECT server_name, database_name, query_hash, query_text, exec_count, total_elapsed_ms, logical_reads,
               total_elapsed_ms // nullif(exec_count, 0) AS avg_elapsed_ms, logical_reads // nullif(exec_count, 0) AS avg_logical_reads, {NOW} AS capture_time
        FROM (SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY total_elapsed_ms DESC, database_name, query_hash, exec_count, logical_reads) AS place
              FROM query_stats_snapshot WHERE total_elapsed_ms >= 1000 AND exec_count >= 10) x WHERE place <= 100"""),
    ),
    "s08_upsert_query_stats": Entry(
        _upsert,
        with_views("""
        SELECT server_name, query_hash, capture_time, exec_count, total_elapsed_ms FROM (
            SELECT server_name, query_hash, capture_time, exec_count, total_elapsed_ms,
                   row_number() OVER (PARTITION BY server_name, query_hash ORDER BY capture_time DESC, exec_count DESC, total_elapsed_ms DESC) AS rn
            FROM query_stats_snapshot) x WHERE rn = 1"""),
    ),
    "s09_capture_slow_queries": Entry(
        lambda t: ingest.capture_slow_queries(_slow_log(t), AS_OF, hours_back=48),
        with_views(f"""
        SELECT event_id, start_time, server_name AS user_host, duration_ms AS query_time, changed_pages AS rows_examined
        FROM trace_events WHERE start_time > {NOW} - INTERVAL '48' HOUR"""),
    ),
    "s10_capture_status_variables": Entry(
        lambda t: ingest.capture_status_variables(_variables(t), AS_OF, prefix="Innodb_page"),
        with_views(f"""
        SELECT server_name, 'Innodb_' || regexp_replace(lower(counter_name), '[ /]', '_', 'g') AS variable_name,
               CAST(counter_value AS VARCHAR) AS variable_value, CAST(counter_value AS DOUBLE) AS parsed_value, {NOW} AS capture_time
        FROM perf_counters WHERE counter_name LIKE 'Page%'"""),
    ),
    "s10_capture_named_variables": Entry(
        lambda t: ingest.capture_status_variables(
            _variables(t), AS_OF, names=["Innodb_page_splits_sec", "Innodb_batch_requests_sec", "Innodb_buffer_pool_size"]
        ),
        with_views(f"""
        SELECT server_name, 'Innodb_' || regexp_replace(lower(counter_name), '[ /]', '_', 'g') AS variable_name,
               CAST(counter_value AS VARCHAR) AS variable_value, CAST(counter_value AS DOUBLE) AS parsed_value, {NOW} AS capture_time
        FROM perf_counters WHERE counter_name IN ('Page Splits/sec', 'Batch Requests/sec')"""),
    ),
    "s10_capture_sizes_in_gb": Entry(
        lambda t: ingest.capture_status_variables(
            t.file_space.select(
                "server_name", F.lit("innodb_buffer_pool_size").alias("variable_name"), (F.col("size_mb") * 1048576).cast("string").alias("variable_value")
            ),
            AS_OF,
            prefix="innodb",
        ),
        with_views(f"""
        SELECT server_name, 'innodb_buffer_pool_size' AS variable_name, CAST(size_mb * 1048576 AS VARCHAR) AS variable_value,
               CAST(round(CAST(CAST(size_mb AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS parsed_value, {NOW} AS capture_time FROM file_space"""),
    ),
    "s10_buffer_pool": Entry(
        lambda t: ingest.buffer_pool_mb(
            t.perf_counters.where(F.col("counter_name") == "Page Life Expectancy").select(
                "server_name",
                F.lit("Innodb_buffer_pool_bytes_data").alias("variable_name"),
                (F.col("counter_value") * 1048576).cast("string").alias("variable_value"),
            )
        ),
        with_views("""
        SELECT server_name, CAST(counter_value AS DOUBLE) AS buffer_pool_mb FROM perf_counters
        WHERE counter_name = 'Page Life Expectancy'"""),
    ),
    "s11_capture_replicas": Entry(
        lambda t: ingest.capture_replicas(
            t.replica_lag.select("ag_name", "replica_name", "capture_time", "sent_lsn", "replay_lsn"), AS_OF
        ),
        with_views(f"""
        SELECT ag_name, replica_name, capture_time, sent_lsn, replay_lsn, sent_lsn - replay_lsn AS lag_bytes, {NOW} AS recorded_at
        FROM replica_lag"""),
    ),
    "s11_capture_channels": Entry(
        lambda t: ingest.capture_channels(t.replication_channel, AS_OF),
        with_views(f"""
        SELECT server_name, channel_name, source_host, io_state, sql_state, seconds_behind, events_read, last_error, {NOW} AS recorded_at FROM replication_channel"""),
    ),
    "s11_capture_database_sync": Entry(
        lambda t: ingest.capture_database_sync(t.replica_lag, AS_OF),
        with_views(f"""
        SELECT server_name, ag_name, replica_name, database_name, capture_time, sync_health, redo_queue_mb, send_queue_mb, last_commit_time,
               CASE WHEN sync_health = 'Healthy' THEN 1 ELSE 0 END AS is_synchronized, {NOW} AS recorded_at FROM replica_lag"""),
    ),
    "s11_capture_replica_groups": Entry(
        lambda t: ingest.capture_replica_groups(
            t.replica_lag.select("ag_name").distinct(),
            t.replica_lag.select("ag_name", "replica_name", "replica_role").distinct(),
            t.replica_lag.select(
                "ag_name", "replica_name", "capture_time", "operational_state", "sync_health", "recovery_health", "redo_queue_mb"
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT ag_name, replica_name, replica_role, capture_time, operational_state, sync_health, recovery_health, redo_queue_mb,
               CASE WHEN operational_state = 'Online' AND sync_health = 'Healthy' AND recovery_health = 'Online' THEN 1 ELSE 0 END AS is_healthy,
               CASE WHEN replica_role = 'PRIMARY' THEN 1 ELSE 0 END AS is_primary, {NOW} AS recorded_at
        FROM replica_lag"""),
    ),
    "s12_capture_contention": Entry(
        lambda t: ingest.capture_contention(
            t.wait_stats_history.select("server_name", "capture_time", "wait_type", "waiting_tasks", "wait_time_ms"), AS_OF
        ),
        with_views(f"""
        SELECT server_name, capture_time, wait_type, waiting_tasks, wait_time_ms,
               CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) / nullif(waiting_tasks, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_wait_ms, {NOW} AS recorded_at
        FROM wait_stats_history WHERE wait_type IN ({_names(CONTENTION_WAITS)})"""),
    ),
    "s13_append_audit_events": Entry(
        lambda t: ingest.append_audit_events(t.raw_logins),
        with_views("""
        SELECT audit_id, server_name, login_name, coalesce(host_name, 'Unknown') AS host_name,
               coalesce(program_name, 'Unknown') AS program_name, coalesce(ip_address, 'Unknown') AS ip_address,
               login_time, event_type, CASE WHEN event_type = 'FAILED_LOGIN' THEN 0 ELSE 1 END AS is_successful
        FROM raw_logins WHERE login_name <> 'sa'"""),
    ),
    "s14_parse_connection_log": Entry(
        lambda t: ingest.parse_connection_log(t.connection_log, AS_OF, days_back=20),
        with_views(f"""
        SELECT CAST(regexp_extract(line, '^(\\S+ \\S+) UTC', 1) AS TIMESTAMP) AS log_time,
               regexp_extract(line, '\\] (\\w+)@', 1) AS username, regexp_extract(line, '@(\\w+) ', 1) AS database_name,
               nullif(regexp_extract(line, 'host=(\\S+)', 1), '') AS client_addr,
               CASE WHEN line LIKE '%connection received%' THEN 'LOGIN' WHEN line LIKE '%disconnection%' THEN 'LOGOUT'
                    ELSE 'FAILED_LOGIN' END AS event_type,
               CAST(regexp_extract(line, '\\[(\\d+)\\]', 1) AS BIGINT) AS process_id
        FROM connection_log WHERE line NOT LIKE '%checkpoint%'
          AND CAST(regexp_extract(line, '^(\\S+ \\S+) UTC', 1) AS TIMESTAMP) >= {NOW} - INTERVAL '20' DAY"""),
    ),
    "s14_log_files": Entry(
        _log_files,
        with_views(f"""
        SELECT CAST(regexp_extract(line, '^(\\S+ \\S+) UTC', 1) AS TIMESTAMP) AS log_time,
               regexp_extract(line, '\\] (\\w+)@', 1) AS username, regexp_extract(line, '@(\\w+) ', 1) AS database_name,
               nullif(regexp_extract(line, 'host=(\\S+)', 1), '') AS client_addr,
               CASE WHEN line LIKE '%connection received%' THEN 'LOGIN' WHEN line LIKE '%disconnection%' THEN 'LOGOUT'
                    ELSE 'FAILED_LOGIN' END AS event_type,
               CAST(regexp_extract(line, '\\[(\\d+)\\]', 1) AS BIGINT) AS process_id,
               CASE WHEN line LIKE '%FATAL%' THEN 'DETAIL: Connection matched rule ' || regexp_extract(line, '\\[(\\d+)\\]', 1) || chr(10) || chr(9) || 'of the host file' END AS added
        FROM connection_log WHERE line NOT LIKE '%checkpoint%'
          AND CAST(regexp_extract(line, '^(\\S+ \\S+) UTC', 1) AS TIMESTAMP) >= {NOW} - INTERVAL '20' DAY"""),
    ),
    "s15_purge_keep": Entry(
        lambda t: ingest.purge_keep(t.login_audit, "login_time", AS_OF, retention_days=14),
        with_views(f"""SELECT * FROM login_audit WHERE login_time >= {NOW} - INTERVAL '14' DAY"""),
    ),
    "s15_purge_counts": Entry(
        lambda t: ingest.purge_counts(
            {
                "wait_stats_history": (t.wait_stats_history, "capture_time"),
                "login_audit": (t.login_audit, "login_time"),
                "database_size_history": (t.database_size_history, "capture_time"),
                "query_stats_snapshot": (t.query_stats_snapshot, "capture_time"),
            },
            AS_OF,
            retention_days=14,
        ),
        with_views(f"""
        SELECT purged_table, CAST(count(*) AS BIGINT) AS rows_deleted FROM (
            SELECT 'wait_stats' || '_history' AS purged_table, capture_time AS t FROM wait_stats_history
            UNION ALL SELECT 'login' || '_audit', login_time FROM login_audit
            UNION ALL SELECT 'database_size' || '_history', capture_time FROM database_size_history
            UNION ALL SELECT 'query_stats' || '_snapshot', capture_time FROM query_stats_snapshot) x
        WHERE t < {NOW} - INTERVAL '14' DAY GROUP BY purged_table"""),
    ),
    "s16_write_report": Entry(
        _report,
        with_views(f"""
        SELECT server_name, wait_type, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms, 'srv0' AS report_server, {NOW} AS report_time
        FROM wait_stats_history GROUP BY server_name, wait_type"""),
    ),
}
