"""Canonical history schemas, one per metric family, and the column names each platform lands them under.

Columns that a platform computes from others (total size, duration, healthy flag)
are derived when a history is read, not stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.functions.expr import seconds_between

SCHEMAS: dict[str, dict[str, str]] = {
    "waits": {
        "server_name": "string", "capture_time": "timestamp_ntz", "wait_type": "string", "wait_time_ms": "bigint",
        "signal_wait_ms": "bigint", "waiting_tasks": "bigint",
    },
    "counters": {
        "server_name": "string", "capture_time": "timestamp_ntz", "counter_name": "string", "counter_value": "bigint",
    },
    "logins": {
        "server_name": "string", "login_time": "timestamp_ntz", "login_name": "string", "host_name": "string",
        "program_name": "string", "ip_address": "string", "event_type": "string", "is_successful": "int",
    },
    "sizes": {
        "server_name": "string", "database_name": "string", "capture_time": "timestamp_ntz", "data_mb": "bigint",
        "log_mb": "bigint", "used_mb": "bigint", "free_mb": "bigint",
    },
    "backups": {
        "server_name": "string", "database_name": "string", "backup_type": "string", "backup_start": "timestamp_ntz",
        "backup_finish": "timestamp_ntz", "backup_size_mb": "bigint", "status": "string",
    },
    "maintenance": {
        "server_name": "string", "database_name": "string", "table_name": "string", "index_name": "string",
        "operation_type": "string", "operation_start": "timestamp_ntz", "duration_s": "bigint",
        "frag_before": "decimal(5,2)", "frag_after": "decimal(5,2)", "status": "string",
    },
    "queries": {
        "server_name": "string", "database_name": "string", "capture_time": "timestamp_ntz", "query_hash": "string",
        "query_text": "string", "exec_count": "bigint", "total_elapsed_ms": "bigint", "logical_reads": "bigint",
    },
    "sessions": {
        "server_name": "string", "capture_time": "timestamp_ntz", "session_id": "bigint",
        "blocking_session_id": "bigint", "login_name": "string", "program_name": "string", "host_name": "string",
        "status": "string", "wait_type": "string", "wait_time_ms": "bigint", "query_start": "timestamp_ntz",
        "query_text": "string",
    },
    "tables": {
        "server_name": "string", "capture_time": "timestamp_ntz", "schema_name": "string", "table_name": "string",
        "table_bytes": "bigint", "index_bytes": "bigint", "n_live": "bigint", "n_dead": "bigint",
    },
    "replicas": {
        "server_name": "string", "capture_time": "timestamp_ntz", "ag_name": "string", "replica_name": "string",
        "replica_role": "string", "operational_state": "string", "recovery_health": "string", "sync_health": "string",
        "redo_queue_mb": "bigint", "send_queue_mb": "bigint", "sent_lsn": "bigint", "replay_lsn": "bigint",
    },
    "errors": {
        "server_name": "string", "log_date": "timestamp_ntz", "process_info": "string", "log_text": "string",
        "severity": "int", "log_type": "string", "is_processed": "int",
    },
    "principals": {
        "server_name": "string", "capture_time": "timestamp_ntz", "principal_id": "bigint", "login_name": "string",
        "login_type": "string", "is_disabled": "int",
    },
    "role_members": {
        "server_name": "string", "capture_time": "timestamp_ntz", "database_name": "string", "role_name": "string",
        "member_name": "string",
    },
}

# Platform column name -> canonical name, per (family, platform).
COLUMN_NAMES: dict[tuple[str, str], dict[str, str]] = {
    ("waits", "sqlserver"): {
        "ServerName": "server_name", "CaptureTime": "capture_time", "WaitType": "wait_type", "WaitTimeMs": "wait_time_ms",
        "SignalWaitTimeMs": "signal_wait_ms", "WaitingTasks": "waiting_tasks",
    },
    ("waits", "postgres"): {"signal_wait_time_ms": "signal_wait_ms", "wait_count": "waiting_tasks"},
    ("waits", "oracle"): {
        "sample_time": "capture_time", "event_name": "wait_type", "time_waited_ms": "wait_time_ms", "wait_count": "waiting_tasks",
    },
    ("counters", "sqlserver"): {
        "ServerName": "server_name", "CaptureTime": "capture_time", "CounterName": "counter_name", "CNTR_VALUE": "counter_value",
    },
    ("counters", "mysql"): {"sample_time": "capture_time", "variable_name": "counter_name", "variable_value": "counter_value"},
    ("logins", "sqlserver"): {
        "ServerName": "server_name", "LoginTime": "login_time", "LoginName": "login_name", "HostName": "host_name",
        "ProgramName": "program_name", "IPAddress": "ip_address", "EventType": "event_type", "IsSuccessful": "is_successful",
    },
    ("logins", "postgres"): {
        "audit_time": "login_time", "username": "login_name", "client_addr": "ip_address", "application_name": "program_name",
    },
    ("sizes", "sqlserver"): {
        "ServerName": "server_name", "DatabaseName": "database_name", "CaptureTime": "capture_time", "DataFileSizeMB": "data_mb",
        "LogFileSizeMB": "log_mb", "SpaceUsedMB": "used_mb", "SpaceAvailableMB": "free_mb",
    },
    ("sizes", "oracle"): {"sample_time": "capture_time", "tablespace_name": "database_name", "total_mb": "data_mb"},
    ("backups", "sqlserver"): {
        "ServerName": "server_name", "DatabaseName": "database_name", "BackupType": "backup_type", "BackupStart": "backup_start",
        "BackupFinish": "backup_finish", "BackupSizeMB": "backup_size_mb",
    },
    ("queries", "sqlserver"): {
        "ServerName": "server_name", "DatabaseName": "database_name", "CaptureTime": "capture_time", "QueryHash": "query_hash",
        "QueryText": "query_text", "ExecutionCount": "exec_count", "TotalElapsedMS": "total_elapsed_ms",
        "TotalLogicalReads": "logical_reads",
    },
    ("queries", "postgres"): {
        "queryid": "query_hash", "calls": "exec_count", "total_time_ms": "total_elapsed_ms", "shared_blks_read": "logical_reads",
    },
    ("queries", "oracle"): {
        "sample_time": "capture_time", "sql_id": "query_hash", "sql_text": "query_text", "executions": "exec_count",
        "elapsed_time_ns": "total_elapsed_ms", "buffer_gets": "logical_reads",
    },
    ("sessions", "postgres"): {
        "pid": "session_id", "usename": "login_name", "application_name": "program_name", "client_addr": "host_name",
        "state": "status", "wait_event": "wait_type",
    },
    ("sessions", "oracle"): {
        "sample_time": "capture_time", "sid": "session_id", "username": "login_name", "program": "program_name",
        "machine": "host_name", "event": "wait_type",
    },
    ("tables", "postgres"): {
        "schemaname": "schema_name", "tablename": "table_name", "table_size_bytes": "table_bytes", "index_size_bytes": "index_bytes",
        "tuple_count": "n_live", "dead_tuple_count": "n_dead",
    },
    ("tables", "mysql"): {
        "sample_time": "capture_time", "table_schema": "schema_name", "data_length": "table_bytes", "index_length": "index_bytes",
        "table_rows": "n_live",
    },
}

# Divisors that bring a platform's unit to the canonical one (nanoseconds to milliseconds).
UNIT_DIVISORS: dict[tuple[str, str], dict[str, int]] = {("queries", "oracle"): {"total_elapsed_ms": 1000000}}


def ddl(family: str) -> str:
    """Schema text for readers and writers."""
    return ", ".join(f"{name} {kind}" for name, kind in SCHEMAS[family].items())


def to_canonical(df: DataFrame, family: str, platform: str, server: str | None = None) -> DataFrame:
    """Rename a platform's columns and bring them to the canonical order and types; absent columns become NULL."""
    names = COLUMN_NAMES.get((family, platform), {})
    renamed = df.withColumnsRenamed(names)
    if server is not None:
        renamed = renamed.withColumn("server_name", F.lit(server))
    for name, divisor in UNIT_DIVISORS.get((family, platform), {}).items():
        renamed = renamed.withColumn(name, F.floor(F.col(name) / divisor))
    present = set(renamed.columns)
    return renamed.select(
        *[
            (F.col(name).cast(kind) if name in present else F.lit(None).cast(kind)).alias(name)
            for name, kind in SCHEMAS[family].items()
        ]
    )


def with_derived(df: DataFrame, family: str) -> DataFrame:
    """Add the columns the platforms compute: total size, backup duration, replica health, table total."""
    if family == "sizes":
        return df.withColumn("total_mb", F.col("data_mb") + F.coalesce("log_mb", F.lit(0)))
    if family == "backups":
        return df.withColumn("duration_s", seconds_between(F.col("backup_start"), F.col("backup_finish")))
    if family == "tables":
        return df.withColumn("total_bytes", F.col("table_bytes") + F.col("index_bytes"))
    if family == "replicas":
        from fleetspan.operators.ingest import healthy

        return df.withColumn("is_healthy", F.when(healthy(), 1).otherwise(0))
    return df


def read_landed(spark: SparkSession, path: str, family: str) -> DataFrame:
    """A landed batch or history of a family, read with its declared schema (nothing is inferred)."""
    return with_derived(spark.read.schema(ddl(family)).parquet(path), family)
