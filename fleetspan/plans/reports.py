"""Reports as one long table: sections are DataFrames with a common shape, put together by union."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.functions.expr import before, count_if
from fleetspan.operators import aggregates, joins, rankings, rows
from fleetspan.operators.grouping import latest_snapshot
from fleetspan.session import ensure_checkpoint_dir


def union_sections(sections: list[DataFrame]) -> DataFrame:
    """All sections below each other; order columns inside the rows keep them sortable.

    Merged in pairs, so that no section is analysed more than log2(n) times.
    """
    while len(sections) > 1:
        pairs = zip(sections[::2], sections[1::2])
        rest = sections[-1:] if len(sections) % 2 else []
        sections = [a.unionByName(b) for a, b in pairs] + rest
    return sections[0]


def section(df: DataFrame, number: int, title: str, item: Column, metric: str, value: Column, status: Column) -> DataFrame:
    """One report section: (section_no, section, item, metric, value, status)."""
    return df.select(
        F.lit(number).cast("bigint").alias("section_no"),
        F.lit(title).alias("section"),
        item.cast("string").alias("item"),
        F.lit(metric).alias("metric"),
        value.cast("string").alias("value"),
        status.cast("string").alias("status"),
    )


def numbered(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """The first n rows with their rank; n is a report length, and the one task that ranks sees n rows only."""
    top = df.orderBy(*order).limit(n)
    return top.withColumn("row_no", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(*order)).cast("bigint"))


@dataclass
class FleetTelemetry:
    """Inputs of the reports."""

    databases: DataFrame
    sessions: DataFrame
    waits: DataFrame
    backups: DataFrame
    files: DataFrame
    free: DataFrame
    tables: DataFrame
    indexes: DataFrame
    jobs: DataFrame
    errors: DataFrame
    replicas: DataFrame
    audit: DataFrame
    objects: DataFrame
    sizes: DataFrame
    maintenance: DataFrame
    query_stats: DataFrame
    missing: DataFrame
    redo: DataFrame
    archive: DataFrame
    locks: DataFrame
    channels: DataFrame
    counters: DataFrame


def health_report(t: FleetTelemetry, as_of: datetime, hours: int = 24) -> DataFrame:
    """Health check of the whole fleet now. Listings keep their report length; summaries keep every row.

    Sessions, locks, counters and replicas count as of their newest capture, waits and statements
    over the last ``hours``. Where several sections need the newest or recent rows of a history, or its
    totals, those are written to the shared folder and the sections read them; catalogs are not copied. ``row_no`` ranks the rows of a
    listing and is 0 elsewhere.
    """
    ensure_checkpoint_dir(t.sessions.sparkSession)
    none = F.lit(None).cast("string")
    c = F.col

    def listing(df: DataFrame, order: list[Column], n: int, number, title, item, metric, value, status) -> DataFrame:
        ranked = numbered(df, n, order)
        return ranked.select(
            F.lit(number).cast("bigint").alias("section_no"),
            F.lit(title).alias("section"),
            "row_no",
            item.cast("string").alias("item"),
            F.lit(metric).alias("metric"),
            value.cast("string").alias("value"),
            status.cast("string").alias("status"),
        )

    def summary(df: DataFrame, *args) -> DataFrame:
        return section(df, *args).withColumn("row_no", F.lit(0).cast("bigint"))

    recent = lambda df: df.where(c("capture_time") >= before(as_of, hours=hours))
    sessions = latest_snapshot(t.sessions).checkpoint()
    statements = recent(t.query_stats).checkpoint()
    tables, indexes, databases = t.tables, t.indexes, t.databases
    backups = (
        t.backups.groupBy("server_name", "database_name", "backup_type")
        .agg(
            F.max("backup_finish").alias("backup_finish"),
            count_if(c("backup_start") > before(as_of, days=1)).alias("day"),
            count_if(c("backup_finish") > before(as_of, days=7)).alias("week"),
        )
        .checkpoint()
    )
    # Several counters of one input come out of a single pass over it.
    overview = [
        _counters(databases, {"Databases": count_if(c("state_desc") == "ONLINE")}),
        _counters(
            sessions,
            {"Active Sessions": count_if(c("status") == "running"), "Blocked Requests": count_if(c("blocking_session_id") > 0)},
        ),
        _counters(backups, {"Backups (24h)": F.coalesce(F.sum("day"), F.lit(0))}),
    ]
    week = lambda kind: F.coalesce(F.sum(F.when(c("backup_type") == kind, c("week"))), F.lit(0))
    totals = backups.agg(week("D").alias("full_backups"), week("I").alias("incr_backups"))
    backup_state = aggregates.database_backup_status(databases, backups, as_of)
    pairs = joins.blocking_pairs(sessions, how="left")
    waits = recent(t.waits).groupBy("wait_type").agg(F.sum("wait_time_ms").cast("bigint").alias("wait_time_ms"))
    space = joins.space_usage(t.files, t.free, "strict")
    errors = rows.recent_errors(t.errors, as_of, hours=24, n=20)
    lag = rows.replication_lag(t.replicas)
    used = rows.index_usage_status(indexes.withColumn("index_name", _path(*joins.TABLE, "index_name")), "health")
    parts = [
        *[summary(df, 1, "OVERVIEW", c("name"), "count", c("n"), none) for df in overview],
        summary(
            rows.databases_not_online(databases), 2, "DATABASE STATUS", _path("server_name", "database_name"), "recovery_model",
            c("recovery_model"), c("state_desc"),
        ),
        summary(
            backup_state.where(c("backup_status") != "OK"), 3, "BACKUP STATUS", _path("server_name", "database_name"), "hours_since_backup",
            c("hours_since_backup"), c("backup_status"),
        ),
        listing(
            sessions.where(c("status") != "idle"), [F.desc("wait_time_ms"), F.asc("server_name"), F.asc("session_id")], 20,
            4, "ACTIVE SESSIONS", _path("server_name", "session_id"), "wait_time_ms", c("wait_time_ms"), c("status"),
        ),
        listing(
            rankings.share_of_total(waits, "wait_time_ms").withColumn("category", rows.wait_category(c("wait_type"))),
            [F.desc("wait_time_ms"), F.asc("wait_type")], 15,
            5, "TOP WAITS", c("wait_type"), "wait_time_ms", c("wait_time_ms"), c("category"),
        ),
        listing(
            pairs, [F.desc("wait_time_ms"), F.asc("server_name"), F.asc("blocked_session")], 10,
            6, "BLOCKING", _path("server_name", "blocked_session"), "blocking_session", c("blocking_session"), c("blocked_status"),
        ),
        summary(space, 7, "TABLESPACE USAGE", _path("server_name", "tablespace_name"), "used_mb", c("used_mb"), c("alert_status")),
        listing(
            rows.scan_heavy_indexes(indexes.withColumn("index_name", _path(*joins.TABLE, "index_name")), min_mb=1), [F.desc("user_scans"), F.asc("index_name")], 10,
            8, "LARGE TABLE SCANS", c("index_name"), "user_scans", c("user_scans"), c("recommendation"),
        ),
        listing(
            used, [F.asc_nulls_first("user_scans"), F.desc("size_kb"), F.asc("index_name")], 20,
            9, "UNUSED INDEXES", c("index_name"), "size_kb", c("size_kb"), c("status"),
        ),
        listing(
            rows.job_runs(t.jobs, as_of, whole_job_only=True), [F.desc("run_time"), F.desc("run_id")], 10,
            10, "JOB RUNS", _path("server_name", "job_name"), "run_id", c("run_id"), c("status"),
        ),
        listing(
            errors, [F.desc("log_date"), F.desc("severity"), F.asc("log_id")], 20,
            11, "RECENT ERRORS", c("log_id"), "severity", c("severity"), c("priority"),
        ),
        summary(
            aggregates.connection_summary(sessions, as_of), 12, "CONNECTIONS", _path("server_name", "status"), "connections", c("connections"), none
        ),
        listing(
            lag, [F.desc("lag_bytes"), F.asc("capture_time"), F.asc("server_name"), F.asc("replica_name")], 10,
            13, "REPLICATION LAG", _path("server_name", "ag_name", "replica_name"), "lag_bytes", c("lag_bytes"), c("status"),
        ),
        listing(
            rankings.largest_tables(tables, n=20), [F.desc("total_mb"), *_in_order(joins.TABLE)], 20,
            14, "LARGEST TABLES", _path(*joins.TABLE), "table_rows", c("table_rows"), none,
        ),
        summary(
            rows.invalid_objects(t.objects), 15, "INVALID OBJECTS", _path("server_name", "database_name", "owner", "object_name"), "object_type", c("object_type"), c("status")
        ),
        summary(
            rows.long_running(sessions, as_of, seconds=300), 16, "LONG RUNNING QUERIES", _path("server_name", "session_id"), "duration_s",
            c("duration_s"), c("status"),
        ),
        listing(
            t.missing, [F.desc("improvement"), F.asc("server_name"), F.asc("index_handle")], 10,
            17, "MISSING INDEXES", _path("server_name", "index_handle"), "user_seeks", c("user_seeks"), none,
        ),
        summary(t.files, 18, "FILE USAGE", _path("server_name", "database_name", "file_name"), "used_mb", c("used_mb"), c("file_type")),
        summary(rows.redo_log_groups(t.redo), 19, "REDO LOG", c("group_no"), "members", c("members"), c("status")),
        summary(
            aggregates.archive_rate(t.archive, as_of), 20, "ARCHIVE LOGS", F.concat_ws("/", "server_name", F.date_format("hour", "yyyy-MM-dd HH")), "archive_logs",
            c("archive_logs"), none,
        ),
        summary(_stacked(totals, ["full_backups", "incr_backups"]), 21, "BACKUP TOTALS", c("name"), "count", c("n"), none),
        listing(
            rankings.top_queries(statements, "logical_reads", 10, min_calls=10), _heaviest("logical_reads"), 10,
            22, "TOP SQL BY READS", _path("server_name", "database_name", "query_hash"), "logical_reads", c("logical_reads"), none,
        ),
        listing(
            rankings.top_queries(statements, "total_elapsed_ms", 20), _heaviest("total_elapsed_ms"), 20,
            23, "SLOW QUERIES", _path("server_name", "database_name", "query_hash"), "total_elapsed_ms", c("total_elapsed_ms"), none,
        ),
        summary(
            aggregates.wait_event_counts(sessions), 24, "WAIT EVENTS", F.concat_ws("/", "server_name", F.concat_ws(":", "wait_event_type", "wait_type")),
            "wait_count", c("wait_count"), none,
        ),
        listing(
            rows.table_bloat(tables), [F.desc("n_dead"), *_in_order(joins.TABLE)], 20,
            25, "TABLE BLOAT", _path(*joins.TABLE), "n_dead", c("n_dead"), c("status"),
        ),
        listing(
            rows.cache_hit_ratio(tables, n=10), [F.asc_nulls_last("cache_hit_ratio"), *_in_order(joins.TABLE)], 10,
            26, "CACHE HIT RATIO", _path(*joins.TABLE), "blks_read", c("blks_read"), none,
        ),
        summary(
            aggregates.storage_by_schema(tables), 27, "STORAGE BY SCHEMA", _path("server_name", "database_name", "schema_name"), "table_count", c("table_count"), none
        ),
        listing(
            aggregates.lock_summary(latest_snapshot(t.locks)),
            [F.desc("lock_count"), F.asc("server_name"), F.asc_nulls_first("relation_id"), F.asc("locktype"), F.asc("lock_mode"), F.asc("lock_status")],
            20,
            28, "TABLE LOCKS", F.concat_ws("/", "server_name", F.coalesce(c("relation_id").cast("string"), F.lit("-"))), "lock_count", c("lock_count"), c("lock_status"),
        ),
        summary(t.channels, 29, "REPLICATION CHANNELS", _path("server_name", "channel_name"), "seconds_behind", c("seconds_behind"), c("io_state")),
        summary(
            rankings.latest_snapshot(t.counters), 30, "COUNTERS", F.concat_ws("/", "server_name", "counter_name"), "counter_value",
            c("counter_value"), none,
        ),
    ]
    return union_sections(parts)


def _in_order(names: list[str]) -> list[Column]:
    return [F.asc(n) for n in names]


def _path(*names: str) -> Column:
    return F.concat_ws("/", *names)


def _stacked(one_row: DataFrame, names: list[str]) -> DataFrame:
    """(name, n) rows out of the columns of a one-row frame."""
    pairs = [F.struct(F.lit(name).alias("name"), F.col(f"`{name}`").cast("bigint").alias("n")) for name in names]
    return one_row.select(F.inline(F.array(*pairs)))


def _counters(df: DataFrame, counts: dict[str, Column]) -> DataFrame:
    return _stacked(df.agg(*[expr.alias(name) for name, expr in counts.items()]), list(counts))


def _heaviest(by: str) -> list[Column]:
    keys = ["server_name", "database_name", "query_hash", "exec_count", "total_elapsed_ms", "logical_reads"]
    return [F.desc(by), *[F.asc(k) for k in keys]]


def weekly_summary(t: FleetTelemetry, as_of: datetime) -> DataFrame:
    """Top waits, backups, failed logins, growth concerns and maintenance of the last week."""
    c = F.col
    waits = rankings.recent_wait_totals(t.waits, as_of, days=7, n=10)
    backups = aggregates.backup_status(t.backups, as_of, "weekly")
    failures = aggregates.failed_logins(t.audit, as_of, hours=168, keys=["login_name", "host_name"])
    growth = aggregates.growth_projection(t.sizes, as_of).where(c("status") != "OK")
    upkeep = aggregates.index_maintenance_summary(t.maintenance, ["database_name", "operation_type"], as_of, days=7)
    none = F.lit(None).cast("string")
    return union_sections(
        [
            section(waits, 1, "TOP WAIT EVENTS", c("wait_type"), "total_wait_ms", c("total_wait_ms"), none),
            section(
                backups, 2, "BACKUP STATUS", F.concat_ws("/", "server_name", "database_name", "backup_type"), "hours_since_backup",
                c("hours_since_backup"), c("backup_status"),
            ),
            section(
                failures, 3, "FAILED LOGINS", F.concat_ws("@", "login_name", "host_name"), "failed_attempts", c("failed_attempts"), none
            ),
            section(
                growth, 4, "GROWTH PROJECTION", F.concat_ws("/", "server_name", "database_name"), "days_to_double", c("days_to_double"),
                c("status"),
            ),
            section(
                upkeep, 5, "INDEX MAINTENANCE", F.concat_ws("/", "database_name", "operation_type"), "operations", c("operations"),
                F.when(c("failures") > 0, F.concat(c("failures").cast("string"), F.lit(" failed"))),
            ),
        ]
    )


def weekly_lines(t: FleetTelemetry, as_of: datetime) -> DataFrame:
    """Variant as (section, line) text: connections, waits of the day, sizes, failed logins."""
    c = F.col

    def lines(number: int, title: str, df: DataFrame, head: Column, text: Column) -> list[DataFrame]:
        heading = t.sessions.sparkSession.range(1).select(
            F.lit(number).cast("bigint").alias("section_no"),
            F.lit(f"=== {title} ===").alias("report_section"),
            F.lit("").alias("report_line"),
        )
        body = df.select(
            F.lit(number).cast("bigint").alias("section_no"), head.alias("report_section"), text.alias("report_line")
        )
        return [heading, body]

    connections = latest_snapshot(t.sessions).agg(F.count("*").alias("n"))
    waits = (
        t.waits.where(c("capture_time") >= before(as_of, hours=24))
        .groupBy("wait_type")
        .agg(F.sum("waiting_tasks").cast("bigint").alias("n"), F.sum("wait_time_ms").cast("bigint").alias("ms"))
        .orderBy(F.desc("ms"), "wait_type")
        .limit(10)
    )
    sizes = latest_snapshot(t.sizes, ["server_name", "database_name"])
    failures = (
        t.audit.where((c("event_type") == "FAILED_LOGIN") & (c("login_time") >= before(as_of, days=7)))
        .groupBy("login_name")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "login_name")
        .limit(10)
    )
    return union_sections(
        [
            *lines(1, "SERVER OVERVIEW", connections, F.lit("Current Connections: "), c("n").cast("string")),
            *lines(
                2, "TOP WAITS (Last 24h)", waits, c("wait_type"),
                F.concat(F.lit("Count: "), c("n").cast("string"), F.lit(", Total: "), c("ms").cast("string"), F.lit("ms")),
            ),
            *lines(
                3, "DATABASE SIZES", sizes, _path("server_name", "database_name"),
                F.concat(F.format_string("%.2f", F.round(c("total_mb") / 1024, 2)), F.lit(" GB")),
            ),
            *lines(
                4, "FAILED LOGINS (Last 7 days)", failures, c("login_name"), F.concat(c("n").cast("string"), F.lit(" attempts"))
            ),
        ]
    )
