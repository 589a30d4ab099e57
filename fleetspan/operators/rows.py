"""Row-level operators: filters, listings and verdict columns."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import (
    any_like,
    at,
    band,
    before,
    boundary_diff,
    count_if,
    decode,
    first_match,
    format_bytes,
    not_in,
    not_like,
    ordered_names,
    ratio,
    seconds_between,
    truncated_div,
)
from fleetspan.operators.grouping import join_groups, latest_snapshot
from fleetspan.operators.ingest import healthy


# What a row is identified by across a fleet.
CAPTURE = ["server_name", "capture_time"]
DATABASE = ["server_name", "database_name"]
TABLE = ["server_name", "database_name", "schema_name", "table_name"]


def status_band(value: Column, platform: str = "inclusive") -> Column:
    """Space usage verdict; some platforms include the threshold and some do not. NULL is OK."""
    return band(value, rules.SPACE_BAND[platform], "OK")


def wait_category(col: Column, profile: str = "history") -> Column:
    """Wait type to category: the first matching pattern or exact name wins."""
    table, default = {
        "diagnostic": (rules.WAIT_CATEGORIES_DIAGNOSTIC, rules.WAIT_CATEGORIES_DIAGNOSTIC_DEFAULT),
        "history": (rules.WAIT_CATEGORIES_HISTORY, rules.WAIT_CATEGORIES_HISTORY_DEFAULT),
        "contention": (rules.WAIT_CATEGORIES_CONTENTION, rules.WAIT_CATEGORIES_CONTENTION_DEFAULT),
        "events": (rules.WAIT_CATEGORIES_EVENTS, rules.WAIT_CATEGORIES_EVENTS_DEFAULT),
    }[profile]
    return first_match(
        [(col.isin(m) if isinstance(m, list) else col.like(m), label) for m, label in table], default
    )


def exclude_benign(df: DataFrame, col: str, names: Sequence[str] = rules.BENIGN_WAITS) -> DataFrame:
    return df.where(not_in(F.col(col), names))


def connection_detail(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Long Running / Idle in Transaction (both over five minutes) / Idle / Active."""
    old = F.col("query_start") < before(as_of, minutes=5)
    return sessions.select(
        *CAPTURE,
        "session_id",
        "login_name",
        "program_name",
        "status",
        "wait_type",
        "query_start",
        F.substring("query_text", 1, 200).alias("current_query"),
        first_match(
            [
                ((F.col("status") == "running") & old, "Long Running"),
                ((F.col("status") == "idle in transaction") & old, "Idle in Transaction"),
                (F.col("status") == "idle", "Idle"),
            ],
            "Active",
        ).alias("connection_status"),
    )


def long_running(sessions: DataFrame, as_of: datetime, seconds: int = 30) -> DataFrame:
    """Sessions that are not idle and started before ``as_of - seconds``."""
    return sessions.where((F.col("status") != "idle") & (F.col("query_start") < before(as_of, seconds=seconds))).select(
        *CAPTURE,
        "session_id",
        "login_name",
        "program_name",
        "status",
        seconds_between(F.col("query_start"), at(as_of)).alias("duration_s"),
        F.substring("query_text", 1, 100).alias("query_preview"),
    )


def active_sessions(sessions: DataFrame, as_of: datetime, text_len: int = 100, idle_state: str = "idle") -> DataFrame:
    """Session listing of every server; sort it by (idle_rank, duration_s descending) when it is cut to a length."""
    idle_last = F.when(F.col("status") == idle_state, 1).otherwise(0)
    duration = seconds_between(F.col("query_start"), at(as_of))
    return (
        sessions.select(
            "server_name",
            "capture_time",
            "session_id",
            "login_name",
            "host_name",
            "program_name",
            "status",
            "wait_type",
            "wait_time_ms",
            F.col("blocking_session_id").alias("blocked_by"),
            duration.alias("duration_s"),
            F.when(F.col("status") == idle_state, duration).alias("idle_s"),
            F.substring("query_text", 1, text_len).alias("current_query"),
            idle_last.alias("idle_rank"),
        )
    )


def slow_queries(log: DataFrame, as_of: datetime, hours: int = 24, n: int = 50) -> DataFrame:
    """Slowest log rows of the window."""
    return (
        log.where(F.col("start_time") >= before(as_of, hours=hours))
        .orderBy(F.desc("query_time"), F.asc("event_id"))
        .limit(n)
    )


def invalid_objects(
    objects: DataFrame,
    types: Sequence[str] = rules.CHECKED_OBJECT_TYPES,
    skip_owners: Sequence[str] = rules.SYSTEM_OWNERS_OBJECTS,
) -> DataFrame:
    return objects.where(
        (F.col("status") != "VALID") & F.col("object_type").isin(list(types)) & not_in(F.col("owner"), skip_owners)
    ).select(
        *DATABASE,
        "owner",
        "object_type",
        "object_name",
        "object_id",
        "status",
        F.date_format("last_ddl_time", "yyyy-MM-dd HH:mm:ss").alias("last_ddl"),
    )


def classify_log(lines: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Relevant log rows of the window with their type and severity."""
    text = F.col("log_text")
    log_type = first_match(
        [(any_like(text, patterns, ignore_case=True), label) for patterns, label in rules.LOG_TYPES], rules.LOG_TYPE_DEFAULT
    )
    severity = None
    for pattern, level in rules.LOG_SEVERITIES:
        severity = F.when(text.rlike(pattern), level) if severity is None else severity.when(text.rlike(pattern), level)
    severity = severity.when(F.col("log_type") == "ERROR", rules.LOG_SEVERITY_ERROR).otherwise(rules.LOG_SEVERITY_DEFAULT)
    return (
        lines.where((F.col("log_date") >= before(as_of, days=days)) & any_like(text, rules.LOG_RELEVANT, ignore_case=True))
        .withColumn("log_type", log_type)
        .withColumn("severity", severity)
    )


def recent_errors(classified: DataFrame, as_of: datetime, hours: int = 24, n: int = 100) -> DataFrame:
    """Newest rows of severity 10 and up with a priority."""
    return (
        classified.where((F.col("severity") >= 10) & (F.col("log_date") >= before(as_of, hours=hours)))
        .withColumn("priority", band(F.col("severity"), rules.ERROR_PRIORITY, rules.ERROR_PRIORITY_DEFAULT))
        .orderBy(F.desc("log_date"), F.desc("severity"), "log_id")
        .limit(n)
    )


def deadlocks(classified: DataFrame, as_of: datetime, days: int = 7, snippet: int = 2000) -> DataFrame:
    return classified.where((F.col("log_type") == "Deadlock") & (F.col("log_date") >= before(as_of, days=days))).select(
        "log_id", "server_name", "log_date", F.substring("log_text", 1, snippet).alias("deadlock_snippet")
    )


def autogrowth_events(trace: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Grow and shrink events with decoded types; growth in MB from 8 KiB pages, for growth rows only."""
    recent = boundary_diff("day", F.col("start_time"), at(as_of)) <= days
    # The scan-level bound is one day wider than the calendar-day rule above.
    return trace.where(
        F.col("event_class").isin(list(rules.TRACE_EVENTS)) & (F.col("start_time") >= before(as_of, days=days + 1)) & recent
    ).select(
        *DATABASE,
        "event_id",
        decode(F.col("file_type_code"), rules.FILE_TYPES).alias("file_type"),
        "start_time",
        decode(F.col("event_class"), rules.TRACE_EVENTS).alias("event_type"),
        F.when(F.col("event_class") == 92, F.round(F.col("changed_pages").cast("double") * 8 / 1024, 4)).alias("growth_mb"),
    )


def job_runs(history: DataFrame, as_of: datetime, hours: int = 24, whole_job_only: bool = False) -> DataFrame:
    """Recent runs with a decoded status; step 0 stands for the whole job."""
    since = before(as_of, hours=hours)
    kept = history.where(F.col("run_time") >= F.to_date(since).cast("timestamp_ntz"))
    if whole_job_only:
        kept = kept.where(F.col("step_id") == 0)
    return kept.select(
        "run_id",
        "server_name",
        "job_name",
        "run_time",
        F.date_format("run_time", "yyyyMMdd").cast("bigint").alias("run_date_key"),
        decode(F.col("run_status"), rules.JOB_STATUS, "Unknown").alias("status"),
        "duration_s",
    )


def databases_not_online(databases: DataFrame) -> DataFrame:
    return databases.where(F.col("state_desc") != "ONLINE").select(
        *DATABASE, "state_desc", "recovery_model", "is_read_only"
    )


def recovery_model_counts(databases: DataFrame) -> DataFrame:
    """Database count of each server, and how many use each recovery model."""
    model = F.col("recovery_model")
    return databases.groupBy("server_name").agg(
        F.count("*").alias("databases"),
        count_if(model == "FULL").alias("full_recovery"),
        count_if(model == "SIMPLE").alias("simple_recovery"),
        count_if(model == "BULK_LOGGED").alias("bulk_logged"),
    )


def fragmentation_action(indexes: DataFrame, min_pages: int = 1000) -> DataFrame:
    """REBUILD / REORGANIZE / OK for fragmented indexes above the page floor."""
    return indexes.where((F.col("frag_pct") > 0) & (F.col("used_pages") > min_pages)).select(
        *TABLE,
        "index_name",
        "frag_pct",
        "used_pages",
        band(F.col("frag_pct"), rules.FRAGMENTATION, "OK").alias("recommended_action"),
    )


def maintenance_plan(
    indexes: DataFrame, as_of: datetime, min_frag: int = 5, max_frag: int = 100, rebuild_at: int = 30, min_pages: int = 1000
) -> DataFrame:
    """One planned operation per index in the fragmentation range. Nothing is executed."""
    operation = F.when(F.col("frag_pct") >= rebuild_at, "REBUILD").otherwise("REORGANIZE")
    return indexes.where((F.col("used_pages") > min_pages) & F.col("frag_pct").between(min_frag, max_frag)).select(
        *TABLE,
        "index_name",
        operation.alias("operation_type"),
        F.col("frag_pct").alias("frag_before"),
        F.col("used_pages").alias("pages_before"),
        at(as_of).alias("operation_start"),
        F.concat(
            F.lit("ALTER INDEX ["), "index_name", F.lit("] ON ["), "database_name", F.lit("].["), "schema_name", F.lit("].["), "table_name",
            F.lit("] "), operation, F.lit(";"),
        ).alias("statement"),
    )


def index_usage_status(indexes: DataFrame, profile: str = "detail", skip_like: str | None = "%pkey%") -> DataFrame:
    """UNUSED / LOW USAGE / ACTIVE from scan counts; the limit and labels depend on the report."""
    kept = indexes if skip_like is None else indexes.where(not_like(F.col("index_name"), skip_like))
    return kept.select(
        *TABLE,
        "index_name",
        "user_scans",
        (F.col("used_pages") * 8).alias("size_kb"),
        band(F.col("user_scans"), rules.INDEX_USAGE[profile], rules.INDEX_USAGE_DEFAULT[profile]).alias("status"),
    )


def index_read_verdict(indexes: DataFrame, index_columns: DataFrame) -> DataFrame:
    """Verdict over seeks, scans and lookups together, with the key columns in order."""
    no_seeks = F.col("user_seeks") == 0
    index = ["server_name", "database_name", "schema_name", "table_name", "index_id"]
    keys = index_columns.groupBy(*index).agg(
        F.array_join(ordered_names(F.col("key_ordinal"), F.col("column_name")), ", ").alias("indexed_columns")
    )
    return indexes.join(keys, index, "left").select(
        *index[:-1],
        "index_name",
        "indexed_columns",
        "user_seeks",
        "user_scans",
        "user_lookups",
        "user_updates",
        "is_primary_key",
        "is_unique",
        first_match(
            [
                (no_seeks & (F.col("user_scans") == 0) & (F.col("user_lookups") == 0), "UNUSED - DROP CANDIDATE"),
                (no_seeks & (F.col("user_scans") < 10), "RARELY USED"),
            ],
            "IN USE",
        ).alias("recommendation"),
    )


def index_review(indexes: DataFrame) -> DataFrame:
    """Drop when unused and over 10 MB, review when below 100 scans and over 5 MB; keys are left out."""
    size_mb = F.floor(F.col("used_pages") * 8 / 1024)
    return indexes.where((F.col("is_primary_key") == 0) & not_like(F.col("index_name"), "%fkey%")).select(
        *TABLE,
        "index_name",
        "user_scans",
        size_mb.alias("index_size_mb"),
        first_match(
            [
                ((F.col("user_scans") == 0) & (size_mb > 10), "DROP - Unused and large"),
                ((F.col("user_scans") < 100) & (size_mb > 5), "Review - Low usage"),
            ],
            "OK",
        ).alias("recommendation"),
    )


def index_selectivity(index_stats: DataFrame, table_sizes: DataFrame, as_of: datetime) -> DataFrame:
    """UNUSED without cardinality, LOW SELECTIVITY below 1 % of the table's rows in the last day."""
    day = before(as_of, days=1)
    table = ["server_name", "database_name", "schema_name", "table_name"]
    rows = (
        table_sizes.where(F.col("capture_time") >= day).groupBy(*table).agg(F.max("n_rows").alias("table_rows"))
    )
    share = F.col("cardinality").cast("double") / F.nullif(F.col("table_rows"), F.lit(0))
    recent = index_stats.where((F.col("capture_time") >= day) & (F.col("non_unique") == 1))
    return (
        join_groups(recent, rows, table)
        .select(
            *table,
            "index_name",
            "cardinality",
            "table_rows",
            first_match(
                [
                    ((F.col("cardinality") == 0) | F.col("cardinality").isNull(), "UNUSED"),
                    ((F.col("table_rows") > 0) & (share < 0.01), "LOW SELECTIVITY"),
                ],
                "OK",
            ).alias("status"),
        )
    )


def scan_heavy_tables(stats: DataFrame, factor: int = 10, min_writes: int = 1000) -> DataFrame:
    """Written tables read mostly by full scans."""
    return stats.where((F.col("writes") > min_writes) & (F.col("seq_scan") > F.col("idx_scan") * factor))


def scan_heavy_indexes(indexes: DataFrame, factor: int = 10, min_mb: int = 1000) -> DataFrame:
    """Scan/seek verdict for indexes of large tables."""
    size_mb = F.floor(F.col("used_pages") * 8 / 1024)
    return indexes.where(size_mb > min_mb).select(
        *TABLE,
        "index_name",
        "user_scans",
        "user_seeks",
        size_mb.alias("table_size_mb"),
        F.when(F.col("user_scans") > F.col("user_seeks") * factor, "SCAN HEAVY").otherwise("OK").alias("recommendation"),
    )


def _dead_pct() -> Column:
    live, dead = F.col("n_live"), F.col("n_dead")
    return F.when(live > 0, ratio(dead, live + dead, 100)).otherwise(F.lit(0.0))


def table_bloat(tables: DataFrame, limit_pct: float = 20) -> DataFrame:
    """Dead-row share, free/physical share with a clean-up verdict, and index overhead share."""
    total_bytes = F.col("table_bytes") + F.col("index_bytes")
    free = F.col("free_bytes")
    filled = (free > 0) & (F.col("table_bytes") > 0)
    bloat = free.cast("double") / F.nullif(F.col("table_bytes"), F.lit(0)) * 100
    return tables.select(
        *TABLE,
        "n_live",
        "n_dead",
        _dead_pct().alias("dead_pct"),
        format_bytes(total_bytes).alias("total_size"),
        format_bytes(F.col("table_bytes")).alias("table_size"),
        F.when(filled, F.round(bloat, 2)).otherwise(F.lit(0.0)).alias("bloat_ratio"),
        F.when(filled & (bloat > limit_pct), "CLEANUP NEEDED").otherwise("OK").alias("status"),
        F.when(total_bytes > 0, ratio(F.col("index_bytes"), total_bytes, 100, 1)).otherwise(F.lit(0.0)).alias("overhead_pct"),
    )


def vacuum_recommendation(tables: DataFrame, as_of: datetime) -> DataFrame:
    dead = F.col("n_dead")
    return tables.where(dead > 1000).select(
        *TABLE,
        "n_dead",
        "n_live",
        _dead_pct().alias("dead_pct"),
        "last_autovacuum",
        first_match(
            [
                ((dead > 10000) & (F.col("last_autovacuum") < before(as_of, days=1)), "AUTOVACUUM NEEDED"),
                (dead > 50000, "MANUAL VACUUM RECOMMENDED"),
            ],
            "OK",
        ).alias("recommendation"),
    )


def cache_hit_ratio(io: DataFrame, n: int = 25) -> DataFrame:
    """Buffer hit share of heap and index reads; tables that never read are left out, worst first."""
    heap = F.col("blks_hit") + F.col("blks_read")
    idx = F.col("idx_blks_hit") + F.col("idx_blks_read")
    return (
        io.where(F.col("blks_read") > 0)
        .select(
            *TABLE,
            "blks_hit",
            "blks_read",
            heap.alias("total_blks"),
            ratio(F.col("blks_hit"), heap, 100).alias("cache_hit_ratio"),
            ratio(F.col("idx_blks_hit"), idx, 100).alias("idx_cache_ratio"),
        )
        .orderBy(F.asc_nulls_last("cache_hit_ratio"), *TABLE)
        .limit(n)
    )


def row_chaining(tables: DataFrame, min_rows: int = 10000, skip_owners: Sequence[str] = ("SYS", "SYSTEM")) -> DataFrame:
    pct = ratio(F.col("chained_rows"), F.col("n_live"), 100)
    return tables.where(
        not_in(F.col("schema_name"), skip_owners) & (F.col("chained_rows") > 0) & (F.col("n_live") > min_rows)
    ).select(
        *TABLE,
        "n_live",
        "chained_rows",
        pct.alias("chain_pct"),
        band(pct, rules.ROW_CHAINING, "OK").alias("status"),
    )


def index_bloat(indexes: DataFrame, min_pct: float = 20, min_mb: float = 1) -> DataFrame:
    """Dead share of index entries, for indexes above the size and share floors."""
    live, dead = F.col("n_live"), F.col("n_dead")
    raw = F.when(live > 0, (1 - live.cast("double") / (live + dead + 1)) * 100).otherwise(F.lit(0.0))
    return indexes.where((F.floor(F.col("index_bytes") / (1024 * 1024)) >= min_mb) & (raw >= min_pct)).select(
        *TABLE, "index_bytes", F.round(raw, 2).alias("bloat_pct")
    )


def clustering_verdict(indexes: DataFrame) -> DataFrame:
    """Variant on clustering factor: HIGH above 10 % of the table's rows; size from 8 KiB leaf blocks."""
    return indexes.select(
        *TABLE,
        "leaf_blocks",
        "clustering_factor",
        F.round(F.col("leaf_blocks").cast("double") * 8192 / 1024 / 1024, 2).alias("size_mb"),
        F.when(F.col("clustering_factor") > F.col("n_live") * 0.1, "HIGH").otherwise("OK").alias("recommendation"),
    )


def file_usage(files: DataFrame) -> DataFrame:
    """Size, used and free MB from 8 KiB pages, and the free share."""
    mb = lambda c: F.round(c.cast("double") / 128, 2)
    free = F.col("size_pages") - F.col("used_pages")
    return files.select(
        *DATABASE,
        "file_name",
        F.when(F.col("file_type") == "ROWS", "Data").otherwise("Log").alias("file_type"),
        mb(F.col("size_pages")).alias("size_mb"),
        mb(F.col("used_pages")).alias("used_mb"),
        mb(free).alias("free_mb"),
        ratio(free, F.col("size_pages"), 100).alias("free_pct"),
        ratio(F.col("used_pages"), F.col("size_pages"), 100).alias("used_pct"),
    )


def file_capacity_risk(files: DataFrame) -> DataFrame:
    """Free share of the maximum size; files without a maximum are left out."""
    free = F.col("size_mb") - F.col("used_mb")
    raw = free.cast("double") * 100 / F.nullif(F.col("max_size_mb"), F.lit(0))
    return files.where(F.col("max_size_mb") > 0).select(
        *DATABASE,
        "file_name",
        free.alias("free_mb"),
        "max_size_mb",
        F.round(free.cast("double") / 1024, 2).alias("free_gb"),
        F.round((F.col("max_size_mb") - free).cast("double") / 1024, 2).alias("used_gb"),
        F.round(raw, 2).alias("free_pct"),
        band(raw, rules.FILE_RISK, "OK").alias("status"),
    )


MOST_SETTINGS = 10_000


def settings_drift(current: DataFrame, recommended: DataFrame) -> DataFrame:
    """Settings of every server that differ from, or lack, the recommendation.

    ``recommended`` is a fixed list of at most ``MOST_SETTINGS`` settings, which is checked, so the servers x settings
    grid is built by exploding that list on the one row kept per server.
    """
    if recommended.limit(MOST_SETTINGS + 1).count() > MOST_SETTINGS:
        raise ValueError(f"more than {MOST_SETTINGS} recommended settings")
    wanted = recommended.agg(F.collect_list(F.struct("setting_name", "recommended")).alias("w")).select("w").scalar()
    grid = (
        current.select("server_name")
        .distinct()
        .select("server_name", F.explode(wanted).alias("w"))
        .select("server_name", "w.setting_name", "w.recommended")
    )
    return (
        grid.join(current.select("server_name", "setting_name", "setting_value"), ["server_name", "setting_name"], "full")
        .where(~F.col("setting_value").eqNullSafe(F.col("recommended")))
        .withColumn(
            "drift",
            first_match(
                [(F.col("setting_value").isNull(), "MISSING"), (F.col("recommended").isNull(), "NOT COVERED")], "DIFFERENT"
            ),
        )
    )


def replication_lag(replicas: DataFrame) -> DataFrame:
    """Byte lag of every replica's newest state with its verdict."""
    lag = F.col("sent_lsn") - F.col("replay_lsn")
    return latest_snapshot(replicas, ["server_name", "ag_name", "replica_name"]).select(
        "server_name",
        "ag_name",
        "replica_name",
        "capture_time",
        "sent_lsn",
        "replay_lsn",
        lag.alias("lag_bytes"),
        format_bytes(lag).alias("lag_size"),
        band(lag, rules.REPLICATION_LAG_BYTES, "OK").alias("status"),
    )


def recent_channel_lag(channels: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    """Seconds-behind rows of the last hours, newest first."""
    return channels.where(F.col("capture_time") >= before(as_of, hours=hours)).select(
        "server_name", "capture_time", "replica_name", "seconds_behind"
    )


def replica_health(replicas: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Lag verdict, health verdict, and the call to act on an unhealthy primary."""
    ok = healthy()
    return replicas.where(F.col("capture_time") >= before(as_of, hours=hours)).select(
        "server_name",
        "ag_name",
        "replica_name",
        "replica_role",
        "capture_time",
        "operational_state",
        "sync_health",
        first_match(
            [(F.col("redo_queue_mb") > 100, "HIGH LAG"), (F.col("send_queue_mb") > 50, "SEND LAG")], "OK"
        ).alias("lag_status"),
        F.when(ok, "HEALTHY").otherwise("UNHEALTHY").alias("health_status"),
        F.when((F.col("replica_role") == "PRIMARY") & ~F.coalesce(ok, F.lit(False)), "ACTION REQUIRED").otherwise("").alias("action_required"),
    )


def sync_lag_minutes(syncs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Minute boundaries crossed since the last commit."""
    return syncs.where(F.col("capture_time") >= before(as_of, hours=hours)).select(
        "server_name",
        "ag_name",
        "database_name",
        "replica_name",
        "capture_time",
        "last_commit_time",
        boundary_diff("minute", F.col("last_commit_time"), at(as_of)).alias("sync_lag_minutes"),
    )


def query_issue(stats: DataFrame, profile: str = "reads_first", n: int = 50) -> DataFrame:
    """Heaviest statements with the first issue that applies; the order of tests depends on the platform."""
    runs = F.nullif(F.col("exec_count"), F.lit(0))
    avg_reads = truncated_div(F.col("logical_reads"), F.col("exec_count"))
    avg_ms = truncated_div(F.col("total_elapsed_ms"), F.col("exec_count"))
    checks = {
        "reads_first": [
            (avg_reads > 100000, "High Reads"),
            (avg_ms > 10000, "High Duration"),
            (F.col("exec_count") > 1000, "High Frequency"),
        ],
        "duration_first": [
            (F.col("total_elapsed_ms").cast("double") / runs > 1000, "HIGH DURATION"),
            (F.col("logical_reads") > 10000, "HIGH READS"),
            (F.col("exec_count") > 10000, "HIGH FREQUENCY"),
        ],
    }[profile]
    keys = ["server_name", "database_name", "query_hash"]
    return (
        stats.select(
            *keys,
            F.substring("query_text", 1, 200).alias("query_preview"),
            "exec_count",
            avg_ms.alias("avg_elapsed_ms"),
            avg_reads.alias("avg_logical_reads"),
            "total_elapsed_ms",
            "logical_reads",
            first_match(checks, "Other").alias("issue_type"),
        )
        .orderBy(F.desc("total_elapsed_ms"), *keys, "exec_count", "logical_reads")
        .limit(n)
    )


def object_wait_time(stats: DataFrame, n: int = 30, skip_schemas: Sequence[str] = rules.SYSTEM_SCHEMAS) -> DataFrame:
    """Picoseconds of wait as seconds, and seconds per lock."""
    seconds = F.col("wait_ps").cast("double") / 1e12
    return (
        stats.where(not_in(F.col("schema_name"), skip_schemas))
        .select(
            "schema_name",
            "table_name",
            "lock_count",
            "wait_ps",
            F.round(seconds, 6).alias("total_wait_s"),
            F.round(seconds / F.nullif(F.col("lock_count"), F.lit(0)), 6).alias("avg_wait_s"),
        )
        .orderBy(F.desc("wait_ps"), "schema_name", "table_name")
        .limit(n)
        .drop("wait_ps")
    )


def contention_severity(history: DataFrame, as_of: datetime, hours: int = 1) -> DataFrame:
    """Category and severity of the recent contention samples."""
    return history.where(F.col("capture_time") >= before(as_of, hours=hours)).select(
        "server_name",
        "capture_time",
        "wait_type",
        "wait_time_ms",
        "avg_wait_ms",
        wait_category(F.col("wait_type"), "contention").alias("category"),
        band(F.col("avg_wait_ms"), rules.CONTENTION_SEVERITY, "LOW").alias("severity"),
    )


def contention_summary(history: DataFrame, as_of: datetime, hours: int = 1, n: int = 10) -> DataFrame:
    """Worst recent contention samples with advice."""
    return (
        contention_severity(history, as_of, hours)
        .select(
            "server_name",
            "capture_time",
            "wait_type",
            "wait_time_ms",
            "avg_wait_ms",
            band(F.col("avg_wait_ms"), rules.CONTENTION_ADVICE, "OK").alias("recommendation"),
        )
        .orderBy(F.desc_nulls_last("avg_wait_ms"), "server_name", "capture_time", "wait_type")
        .limit(n)
    )


def latch_waits(waits: DataFrame) -> DataFrame:
    """Latch waits only, with the average per task."""
    return waits.where(F.col("wait_type").like("PAGELATCH%") & (F.col("wait_time_ms") > 0)).select(
        "server_name",
        "capture_time",
        "wait_type",
        "waiting_tasks",
        "wait_time_ms",
        ratio(F.col("wait_time_ms"), F.col("waiting_tasks")).alias("avg_wait_ms"),
    )


def active_alerts(config: DataFrame, as_of: datetime) -> DataFrame:
    """Enabled alerts: RECENT within the hour, TODAY within the day, else STALE (also when never triggered)."""
    last = F.col("last_triggered")
    return config.where(F.col("is_enabled") == 1).withColumn(
        "trigger_status",
        first_match([(last > before(as_of, hours=1), "RECENT"), (last > before(as_of, days=1), "TODAY")], "STALE"),
    )


def frag_delta(log: DataFrame) -> DataFrame:
    """Fragmentation before minus after; an unknown side counts as 0."""
    zero = F.lit(0).cast("bigint")
    return log.withColumn("frag_delta", F.coalesce("frag_before", zero) - F.coalesce("frag_after", zero))


def recommendations_open(recs: DataFrame, as_of: datetime, days: int = 7, n: int = 100) -> DataFrame:
    """Open recommendations of the last days with a priority."""
    return (
        recs.where((F.col("is_implemented") == 0) & (F.col("capture_time") >= before(as_of, days=days)))
        .withColumn("priority", band(F.col("estimated_impact"), rules.RECOMMENDATION_PRIORITY, "LOW"))
        .orderBy(F.desc("estimated_impact"), F.desc("user_seeks"), "rec_id")
        .limit(n)
    )


def mark_resolved(recs: DataFrame, resolved: DataFrame, as_of: datetime, key: str = "rec_id") -> DataFrame:
    """Set flag, date and notes of the listed rows (``resolved``: key, notes); the result replaces the table."""
    marks = resolved.groupBy(key).agg(F.max("notes").alias("new_notes")).withColumn("hit", F.lit(True))
    hit = F.col("hit").eqNullSafe(True)
    return (
        recs.join(marks, key, "left")
        .withColumns(
            {
                "is_implemented": F.when(hit, 1).otherwise(F.col("is_implemented")),
                "implemented_date": F.when(hit, at(as_of)).otherwise(F.col("implemented_date")),
                "notes": F.when(hit, F.col("new_notes")).otherwise(F.col("notes")),
            }
        )
        .drop("hit", "new_notes")
    )


def redo_log_groups(logs: DataFrame) -> DataFrame:
    return logs.select(
        "group_no", "thread_no", "sequence_no", (F.col("bytes") / 1024 / 1024).alias("size_mb"), "members", "status"
    )


def setting_changes(snapshots: DataFrame, time_col: str = "capture_time", slice_unit: str = "day") -> DataFrame:
    """Old and new value whenever a captured setting differs from the previous snapshot.

    Long series are cut into slices (days, or hours for dense captures): ``lag`` runs
    inside (server, setting, slice), and the first row of a slice gets the last value
    of the latest earlier slice, taken from a table with one row per series and slice.
    So no task ever sorts the whole history of one busy series.
    """
    keys = ["server_name", "setting_name"]
    sliced = snapshots.select(*keys, F.col(time_col).alias("t"), "setting_value").withColumn(
        "slice", F.date_trunc(slice_unit, "t")
    )
    inside = W.partitionBy(*keys, "slice").orderBy("t")
    stepped = sliced.withColumn("lagged", F.lag(F.struct("setting_value")).over(inside))
    slice_last = sliced.groupBy(*keys, "slice").agg(F.max_by(F.struct("setting_value"), "t").alias("last_value"))
    across = W.partitionBy(*keys).orderBy("slice")
    carried = slice_last.select(*keys, "slice", F.lag("last_value").over(across).alias("carried"))
    return (
        stepped.join(carried, [*keys, "slice"])
        .withColumn("previous", F.coalesce("lagged", "carried"))
        .where(F.col("previous").isNotNull() & ~F.col("previous.setting_value").eqNullSafe(F.col("setting_value")))
        .select(
            *keys,
            F.col("t").alias("change_time"),
            F.col("previous.setting_value").alias("old_value"),
            F.col("setting_value").alias("new_value"),
        )
    )
