"""Capture: normalise one raw batch into history rows; retention."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import any_like, at, before, first_match, not_in, total, truncated_div
from fleetspan.operators.grouping import newest_per_key

MB = 1024 * 1024


def stamp(df: DataFrame, as_of: datetime, server: str | None = None) -> DataFrame:
    """Add capture time, and the server when the batch comes from a single one."""
    if server is not None:
        df = df.withColumn("server_name", F.lit(server))
    return df.withColumn("capture_time", at(as_of))


def capture_waits(raw: DataFrame, as_of: datetime, server: str | None = None) -> DataFrame:
    """Counters that have accumulated any wait."""
    return stamp(raw.where((F.col("wait_time_ms") > 0) & (F.col("waiting_tasks") > 0)), as_of, server)


def capture_wait_classes(raw: DataFrame, as_of: datetime, server: str | None = None) -> DataFrame:
    """Variant for sources that label waits with a class: idle classes are left out."""
    return stamp(raw.where((F.col("waiting_tasks") > 0) & (F.col("wait_class") != "Idle")), as_of, server)


def capture_wait_events(raw: DataFrame, as_of: datetime, server: str | None = None) -> DataFrame:
    """Variant keyed by event type and event: ``type:event``, a missing event is ``None``."""
    name = F.concat(F.col("wait_event_type"), F.lit(":"), F.coalesce("wait_event", F.lit("None")))
    keys = ["server_name"] if server is None else []
    summed = raw.groupBy(*keys, name.alias("wait_type")).agg(
        total(F.col("wait_count")).alias("wait_count"),
        total(F.col("wait_time_ms")).alias("wait_time_ms"),
        total(F.col("signal_wait_ms")).alias("signal_wait_ms"),
    )
    return stamp(summed, as_of, server)


def capture_perf_counters(raw: DataFrame, as_of: datetime, server: str | None = None) -> DataFrame:
    return stamp(raw.where(F.col("counter_value") > 0), as_of, server)


def capture_sessions(
    raw: DataFrame,
    as_of: datetime,
    server: str | None = None,
    own_session: int | None = None,
) -> DataFrame:
    """Session rows with their whole text; the capturing session and rows without a user are left out."""
    kept = raw.where(F.col("login_name").isNotNull())
    if own_session is not None:
        kept = kept.where(F.col("session_id") != own_session)
    return stamp(kept, as_of, server)


def capture_connection_counts(raw: DataFrame, as_of: datetime) -> DataFrame:
    counted = raw.groupBy("server_name", "login_name", F.col("status").alias("command")).agg(F.count("*").alias("connections"))
    return stamp(counted, as_of)


def capture_database_sizes(
    files: DataFrame, databases: DataFrame, as_of: datetime, skip: Sequence[str] = ()
) -> DataFrame:
    """Data, log, used and free MB per online, writable database of each server.

    Files are summed per database before the join, so the join carries one row per database.
    """
    key = ["server_name", "database_name"]
    per_db = files.groupBy(*key).agg(
        total(F.when(F.col("file_type") == "ROWS", F.col("size_mb")).otherwise(0)).alias("data_mb"),
        total(F.when(F.col("file_type") == "LOG", F.col("size_mb")).otherwise(0)).alias("log_mb"),
        total(F.col("used_mb")).alias("used_mb"),
        total(F.col("size_mb") - F.col("used_mb")).alias("free_mb"),
    )
    usable = databases.where(
        (F.col("state_desc") == "ONLINE") & (F.col("is_read_only") == 0) & not_in(F.col("database_name"), skip)
    ).select(*key)
    sized = per_db.join(usable, key, "left_semi")
    return stamp(sized.withColumn("total_mb", F.col("data_mb") + F.col("log_mb")), as_of)


def capture_tablespace_sizes(files: DataFrame, free: DataFrame, as_of: datetime) -> DataFrame:
    """Total, used and free MB per server and tablespace, each side summed before the join; used = total - free."""
    allocated = files.groupBy("server_name", "tablespace_name").agg(total(F.col("size_mb")).alias("total_mb"))
    spare = free.groupBy("server_name", "tablespace_name").agg(total(F.col("free_mb")).alias("free_mb"))
    joined = allocated.join(spare, ["server_name", "tablespace_name"], "left").withColumn(
        "free_mb", F.coalesce("free_mb", F.lit(0).cast("bigint"))
    )
    used = F.col("total_mb") - F.col("free_mb")
    return stamp(
        joined.withColumns(
            {"used_mb": used, "pct_used": F.round(used.cast("double") * 100 / F.nullif("total_mb", F.lit(0)), 2)}
        ),
        as_of,
    )


def capture_table_sizes(tables: DataFrame, as_of: datetime, skip_schemas: Sequence[str] = rules.SYSTEM_SCHEMAS) -> DataFrame:
    """Bytes and MB of table, indexes and both, with row counts."""
    mb = lambda c: F.round(c.cast("double") / MB, 2)
    both = F.col("table_bytes") + F.col("index_bytes")
    return stamp(
        tables.where(not_in(F.col("schema_name"), skip_schemas)).select(
            "server_name",
            "database_name",
            "schema_name",
            "table_name",
            "table_bytes",
            "index_bytes",
            both.alias("total_bytes"),
            mb(F.col("table_bytes")).alias("table_mb"),
            mb(F.col("index_bytes")).alias("index_mb"),
            mb(both).alias("total_mb"),
            "n_live",
            "n_dead",
        ),
        as_of,
    )


def capture_segment_sizes(segments: DataFrame, as_of: datetime, skip_owners: Sequence[str] = ("SYS", "SYSTEM")) -> DataFrame:
    """Variant that sums partitioned tables per owner, table and tablespace."""
    summed = (
        segments.where(not_in(F.col("owner"), skip_owners))
        .groupBy("server_name", "owner", "table_name", "tablespace_name")
        .agg(
            F.round(total(F.col("bytes")).cast("double") / MB, 2).alias("size_mb"),
            total(F.col("num_rows")).alias("num_rows"),
        )
    )
    return stamp(summed, as_of)


def capture_index_stats(indexes: DataFrame, as_of: datetime) -> DataFrame:
    """Usage and shape of every index at one instant."""
    return stamp(
        indexes.select(
            "server_name", "database_name", "schema_name", "table_name", "index_name", "is_unique", "used_pages", "user_seeks", "user_scans", "user_lookups", "user_updates"
        ),
        as_of,
    )


def capture_query_stats(
    raw: DataFrame,
    as_of: datetime,
    server: str | None = None,
    top: int = 100,
    min_elapsed: int = 1000,
    min_calls: int = 0,
    key: Sequence[str] = ("query_hash",),
) -> DataFrame:
    """Each server's ``top`` heaviest statements by total elapsed time, whole texts, with per-execution averages.

    ``top`` is a length per server, so a quiet server keeps its statements beside a busy one. Spark takes the first
    rows of each server in every task before the shuffle.
    """
    named = raw if server is None else raw.withColumn("server_name", F.lit(server))
    order = W.partitionBy("server_name").orderBy(F.desc("total_elapsed_ms"), *key)
    heavy = (
        named.where((F.col("total_elapsed_ms") >= min_elapsed) & (F.col("exec_count") >= min_calls))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= top)
        .drop("place")
    )
    return stamp(
        heavy.withColumns(
            {
                "avg_elapsed_ms": truncated_div(F.col("total_elapsed_ms"), F.col("exec_count")),
                "avg_logical_reads": truncated_div(F.col("logical_reads"), F.col("exec_count")),
            }
        ),
        as_of,
    )


def upsert_latest(stored: DataFrame, batch: DataFrame, keys: Sequence[str], time_col: str = "capture_time") -> DataFrame:
    """Insert new keys and replace known ones: the newest row of every key, of several the largest by its other columns."""
    return newest_per_key(stored.unionByName(batch), list(keys), time_col)


def capture_slow_queries(log: DataFrame, as_of: datetime, hours_back: int) -> DataFrame:
    """Log rows newer than the window start."""
    return log.where(F.col("start_time") > before(as_of, hours=hours_back))


def capture_status_variables(
    variables: DataFrame, as_of: datetime, prefix: str | None = None, names: Sequence[str] | None = None
) -> DataFrame:
    """Key/value metrics by prefix or by name (the standard list unless told otherwise); size-like names also in GB."""
    kept = variables
    if prefix is not None:
        kept = kept.where(F.col("variable_name").startswith(prefix))
    if names is not None or prefix is None:
        kept = kept.where(F.col("variable_name").isin(list(rules.STATUS_VARIABLES if names is None else names)))
    value = F.col("variable_value").cast("double")
    parsed = F.when(F.col("variable_name").ilike("%buffer_pool_size%"), F.round(value / 1024 / 1024 / 1024, 2)).otherwise(value)
    return stamp(kept.withColumn("parsed_value", parsed), as_of)


def capture_channels(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Channel positions: states, seconds behind and events read, as of now."""
    return raw.select("server_name", "channel_name", "source_host", "io_state", "sql_state", "seconds_behind", "events_read", "last_error").withColumn(
        "recorded_at", at(as_of)
    )


def capture_database_sync(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Synchronisation state per group, replica and database, with whether it is in step."""
    return raw.select(
        "server_name", "ag_name", "replica_name", "database_name", "capture_time", "sync_health", "redo_queue_mb", "send_queue_mb", "last_commit_time"
    ).withColumns({"is_synchronized": F.when(F.col("sync_health") == "Healthy", 1).otherwise(0), "recorded_at": at(as_of)})


def buffer_pool_mb(variables: DataFrame) -> DataFrame:
    """Bytes held by the buffer pool in MB."""
    value = F.col("variable_value").cast("double")
    return variables.where(F.col("variable_name") == "Innodb_buffer_pool_bytes_data").select(
        "server_name", F.round(value / 1024 / 1024, 2).alias("buffer_pool_mb")
    )


def capture_replicas(raw: DataFrame, as_of: datetime) -> DataFrame:
    """Replica rows with byte lag = sent position - replayed position."""
    return raw.withColumns(
        {"lag_bytes": F.col("sent_lsn") - F.col("replay_lsn"), "recorded_at": at(as_of)}
    )


def capture_replica_groups(groups: DataFrame, replicas: DataFrame, states: DataFrame, as_of: datetime) -> DataFrame:
    """Group, replica and replica-state rows joined into one health record."""
    joined = groups.join(replicas, "ag_name").join(states, ["ag_name", "replica_name"])
    return joined.withColumns(
        {
            "is_healthy": F.when(healthy(), 1).otherwise(0),
            "is_primary": F.when(F.col("replica_role") == "PRIMARY", 1).otherwise(0),
            "recorded_at": at(as_of),
        }
    )


def healthy() -> Column:
    return (
        (F.col("operational_state") == "Online")
        & (F.col("sync_health") == "Healthy")
        & (F.col("recovery_health") == "Online")
    )


def capture_contention(raw: DataFrame, as_of: datetime, names: Sequence[str] = rules.CONTENTION_WAITS) -> DataFrame:
    """Named latch, I/O and CPU waits with the average per wait."""
    avg = F.col("wait_time_ms").cast("double") / F.nullif(F.col("waiting_tasks").cast("double"), F.lit(0.0))
    return raw.where(F.col("wait_type").isin(list(names))).withColumns(
        {"avg_wait_ms": F.round(avg, 2), "recorded_at": at(as_of)}
    )


def append_audit_events(events: DataFrame, skip_logins: Sequence[str] = rules.SERVICE_LOGINS) -> DataFrame:
    """Login events in one shape: unknown origin filled in, service accounts left out, success flag set."""
    unknown = F.lit("Unknown")
    return events.where(not_in(F.col("login_name"), skip_logins)).withColumns(
        {
            "host_name": F.coalesce("host_name", unknown),
            "program_name": F.coalesce("program_name", unknown),
            "ip_address": F.coalesce("ip_address", unknown),
            "is_successful": F.when(F.col("event_type") == "FAILED_LOGIN", 0).otherwise(1),
        }
    )


# Log line prefix "<time> <zone> [<pid>] <user>@<database> " and the messages that matter.
LOG_PREFIX = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d+) \S+ \[(\d+)\] ([^@\s]*)@(\S*) "
LOG_EVENTS = [
    ("connection received|connection authorized", "LOGIN"),
    ("disconnection:", "LOGOUT"),
    ("authentication failed", "FAILED_LOGIN"),
]


def parse_connection_log(
    lines: DataFrame, as_of: datetime | None = None, days_back: int | None = None, keep: Sequence[str] = ()
) -> DataFrame:
    """Connection events out of server log lines or records: (log_time, username, database, client, event type, pid), and the columns to ``keep``."""
    line = F.col("line")
    part = lambda i: F.nullif(F.regexp_extract(line, LOG_PREFIX, i), F.lit(""))
    event = first_match([(line.rlike(pattern), label) for pattern, label in LOG_EVENTS], None)
    parsed = lines.where(any_like(line, ["%connection%", "%authentication failed%"])).select(
        part(1).try_cast("timestamp_ntz").alias("log_time"),
        part(3).alias("username"),
        part(4).alias("database_name"),
        F.nullif(F.regexp_extract(line, r"host=(\S+)", 1), F.lit("")).alias("client_addr"),
        event.alias("event_type"),
        part(2).try_cast("bigint").alias("process_id"),
        *keep,
    )
    parsed = parsed.where(F.col("log_time").isNotNull() & F.col("event_type").isNotNull())
    if as_of is not None and days_back is not None:
        parsed = parsed.where(F.col("log_time") >= before(as_of, days=days_back))
    return parsed


def purge_keep(history: DataFrame, time_col: str, as_of: datetime, retention_days: int = 30) -> DataFrame:
    """Rows that survive retention: only rows strictly older than the cutoff go."""
    return history.where(~F.coalesce(F.col(time_col) < before(as_of, days=retention_days), F.lit(False)))


def purge_counts(
    histories: dict[str, tuple[DataFrame, str]], as_of: datetime, retention_days: int = 30, tables: Sequence[str] | None = None
) -> DataFrame:
    """(table, rows deleted) for the tables that lose rows; the time column differs per table."""
    parts = [
        df.where(F.col(time_col) < before(as_of, days=retention_days)).select(F.lit(name).alias("purged_table"))
        for name, (df, time_col) in histories.items()
        if tables is None or name in tables
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy("purged_table").agg(F.count("*").alias("rows_deleted"))
