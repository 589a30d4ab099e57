"""Grouped summaries. All are plain hash aggregates: combined per task before the shuffle."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import (
    at,
    band,
    before,
    boundary_diff,
    count_if,
    first_match,
    format_rate_mb,
    not_in,
    not_like,
    ratio,
    total,
    trunc_ts,
    truncated_div,
)
from fleetspan.operators.partials import distinct_connections_exact
from fleetspan.operators.rows import wait_category

MB = 1024 * 1024


def _mean(col: str | Column) -> Column:
    """Average as DOUBLE, not rounded and not truncated."""
    return F.avg(col)


def wait_summary(history: DataFrame, as_of: datetime, hours: int = 1, profile: str = "events") -> DataFrame:
    """Totals and averages per wait type over the window, with the category."""
    return (
        history.where(F.col("capture_time") >= before(as_of, hours=hours))
        .groupBy("wait_type")
        .agg(
            total(F.col("waiting_tasks")).alias("total_waits"),
            total(F.col("wait_time_ms")).alias("total_wait_ms"),
            _mean("wait_time_ms").alias("avg_wait_ms"),
            total(F.col("signal_wait_ms")).alias("total_signal_ms"),
            F.count("*").alias("samples"),
        )
        .withColumn("category", wait_category(F.col("wait_type"), profile))
    )


def wait_trend(history: DataFrame) -> DataFrame:
    """Per day and type: total, number of snapshots, average with the fraction dropped."""
    return (
        history.groupBy(F.to_date("capture_time").alias("snapshot_date"), "wait_type")
        .agg(total(F.col("wait_time_ms")).alias("total_wait_ms"), F.count("*").alias("snapshots"))
        .withColumn("avg_wait_ms", truncated_div(F.col("total_wait_ms"), F.col("snapshots")))
    )


def _hours_since(finish: Column, as_of: datetime) -> Column:
    return boundary_diff("hour", finish, at(as_of))


def backup_status(
    backups: DataFrame,
    as_of: datetime,
    profile: str = "history",
    keys: Sequence[str] = ("server_name", "database_name", "backup_type"),
) -> DataFrame:
    """Newest backup per key, hours since (boundaries crossed), verdict. Never finished counts as NO BACKUP."""
    # Of several backups that end at the newest time the largest counts.
    ended = backups.groupBy(*keys, "backup_finish").agg(
        F.max("backup_start").alias("backup_start"), F.max("backup_size_mb").alias("backup_size_mb")
    )
    newest = ended.groupBy(*keys).agg(
        F.max("backup_start").alias("last_start"),
        F.max("backup_finish").alias("last_finish"),
        F.max_by("backup_size_mb", "backup_finish").alias("last_size_mb"),
    )
    return _judge(newest, as_of, profile)


def _judge(newest: DataFrame, as_of: datetime, profile: str) -> DataFrame:
    hours = _hours_since(F.col("last_finish"), as_of)
    verdict = F.when(F.col("last_finish").isNull(), "NO BACKUP").otherwise(band(hours, rules.BACKUP_BAND[profile], "OK"))
    return newest.withColumns({"hours_since_backup": hours, "backup_status": verdict})


def database_backup_status(
    databases: DataFrame, backups: DataFrame, as_of: datetime, skip: Sequence[str] = ("model", "tempdb")
) -> DataFrame:
    """Every database of every server with its newest full backup, also those that have none."""
    newest = (
        backups.where(F.col("backup_type") == "D")
        .groupBy("server_name", "database_name")
        .agg(F.max("backup_finish").alias("last_finish"))
    )
    named = not_in(F.col("database_name"), skip)
    listed = databases.where(named).select("server_name", "database_name").distinct()
    return _judge(listed.join(newest, ["server_name", "database_name"], "left"), as_of, "health")


def backup_chain(backups: DataFrame, as_of: datetime, profile: str = "any_status") -> DataFrame:
    """Chain state per database from the newest full, differential and log backup, all in one aggregate."""
    kept = backups if profile == "any_status" else backups.where(F.col("status") == "Success")
    newest = lambda code: F.max(F.when(F.col("backup_type") == code, F.col("backup_start")))
    found = kept.groupBy("server_name", "database_name").agg(
        newest("D").alias("last_full"), newest("I").alias("last_diff"), newest("L").alias("last_log")
    )
    full, diff, log = F.col("last_full"), F.col("last_diff"), F.col("last_log")
    now = at(as_of)
    rules_by_profile = {
        "any_status": [
            (full.isNull(), "NO_BACKUP"),
            (log.isNull() | (boundary_diff("minute", log, now) > 60), "LOG_GAP"),
            (diff.isNull() | (boundary_diff("hour", diff, now) > 24), "NO_DIFF"),
        ],
        "success_only": [
            (full.isNull(), "NO_BACKUP"),
            (log.isNull() | (log < before(as_of, hours=1)), "LOG_GAP"),
            (diff.isNull() & (full < before(as_of, days=1)), "NO_RECENT_DIFF"),
        ],
    }
    return found.withColumn("chain_status", first_match(rules_by_profile[profile], "OK"))


def database_age(backups: DataFrame, as_of: datetime) -> DataFrame:
    """Days since the oldest full backup."""
    return (
        backups.where(F.col("backup_type") == "D")
        .groupBy("server_name", "database_name")
        .agg(F.min("backup_start").alias("oldest_full"))
        .withColumn("age_days", F.datediff(F.to_date(at(as_of)), F.to_date("oldest_full")).cast("bigint"))
    )


def backup_totals(backups: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Total and average GB, last time, full and incremental counts of the window."""
    return backups.where(F.col("backup_finish") > before(as_of, days=days)).agg(
        F.round(total(F.col("backup_size_mb")).cast("double") / 1024, 2).alias("total_gb"),
        F.max("backup_finish").alias("last_backup"),
        F.round(F.avg("backup_size_mb") / 1024, 2).alias("avg_gb"),
        count_if(F.col("backup_type") == "D").alias("full_backups"),
        count_if(F.col("backup_type") == "I").alias("incr_backups"),
    )


def size_trend(history: DataFrame) -> DataFrame:
    """Per database and day: average, smallest and largest size, average used and free."""
    return history.groupBy("server_name", "database_name", F.to_date("capture_time").alias("snapshot_date")).agg(
        _mean("total_mb").alias("avg_size_mb"),
        F.min("total_mb").alias("min_size_mb"),
        F.max("total_mb").alias("max_size_mb"),
        _mean("used_mb").alias("avg_used_mb"),
        _mean(F.col("total_mb") - F.col("used_mb")).alias("avg_free_mb"),
    )


def growth_summary(history: DataFrame, as_of: datetime, by: Sequence[str], value: str, days: int = 7) -> DataFrame:
    """Growth of a group's total: sizes are summed per sample first, then compared over the window."""
    per_sample = (
        history.where(F.col("capture_time") >= before(as_of, days=days))
        .groupBy(*by, "capture_time")
        .agg(total(F.col(value)).alias("size_mb"))
    )
    return per_sample.groupBy(*by).agg(
        F.min("capture_time").alias("first_sample"),
        F.max("capture_time").alias("last_sample"),
        F.min("size_mb").alias("min_mb"),
        F.max("size_mb").alias("max_mb"),
        (F.max("size_mb") - F.min("size_mb")).alias("growth_mb"),
        _mean("size_mb").alias("avg_mb"),
    )


def growth_projection(history: DataFrame, as_of: datetime, days: int = 30, limits: DataFrame | None = None) -> DataFrame:
    """Daily growth of growing databases, days until the size doubles, and, where a maximum
    is known (``limits``: server_name, database_name, max_mb), days until it is reached."""
    spans = (
        history.where(F.col("capture_time") >= before(as_of, days=days))
        .groupBy("server_name", "database_name")
        .agg(
            F.min("total_mb").alias("first_mb"),
            F.max("total_mb").alias("current_mb"),
            F.datediff(F.to_date(F.max("capture_time")), F.to_date(F.min("capture_time"))).cast("bigint").alias("days_between"),
        )
        .where(F.col("first_mb") < F.col("current_mb"))
    )
    growth = F.round(
        (F.col("current_mb") - F.col("first_mb")).cast("double") / F.nullif(F.col("days_between"), F.lit(0)), 2
    )
    out = spans.withColumn("daily_growth_mb", growth)
    per_day = F.when(F.col("daily_growth_mb") > 0, F.col("daily_growth_mb"))
    out = out.withColumn("days_to_double", F.floor(F.col("current_mb") / per_day))
    if limits is not None:
        room = limits.groupBy("server_name", "database_name").agg(F.max("max_mb").alias("max_mb"))
        out = out.join(room, ["server_name", "database_name"], "left")
    else:
        out = out.withColumn("max_mb", F.lit(None).cast("bigint"))
    return out.select(
        "server_name",
        "database_name",
        "current_mb",
        "daily_growth_mb",
        "days_to_double",
        F.date_add(F.to_date(at(as_of)), F.col("days_to_double").cast("int")).alias("projected_date"),
        F.when(
            F.col("max_mb").isNotNull(), F.floor(F.greatest(F.col("max_mb") - F.col("current_mb"), F.lit(0)) / per_day)
        ).alias("days_to_exhaustion"),
        band(F.col("days_between"), rules.GROWTH_CONFIDENCE, "LOW").alias("confidence"),
        band(F.col("days_to_double"), rules.EXHAUSTION_BAND, "OK").alias("status"),
        format_rate_mb(F.col("daily_growth_mb")).alias("growth_text"),
    )


def days_to_double(history: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Size over daily growth, judged by growth in MB per day."""
    grown = (
        history.where(F.col("capture_time") >= before(as_of, days=days))
        .groupBy("server_name", "database_name")
        .agg(
            F.max("total_mb").alias("current_size_mb"),
            (F.max("total_mb") - F.min("total_mb")).alias("growth_mb"),
            F.floor((F.unix_timestamp(F.max("capture_time")) - F.unix_timestamp(F.min("capture_time"))) / 86400).alias("whole_days"),
        )
    )
    rate = F.col("growth_mb").cast("double") / F.nullif(F.col("whole_days"), F.lit(0))
    return grown.select(
        "server_name",
        "database_name",
        "current_size_mb",
        F.round(rate, 2).alias("daily_growth_mb"),
        F.when(rate > 0, F.round(F.col("current_size_mb") / rate, 0)).alias("days_to_double"),
        band(rate, rules.GROWTH_BAND, "OK").alias("status"),
    )


def growth_rate(history: DataFrame) -> DataFrame:
    """(last - first) per day, first and last in time order."""
    ends = history.groupBy("server_name", "database_name").agg(
        F.min_by("total_mb", "capture_time").alias("first_mb"),
        F.max_by("total_mb", "capture_time").alias("last_mb"),
        F.min("capture_time").alias("first_time"),
        F.max("capture_time").alias("last_time"),
    )
    elapsed = (F.unix_timestamp("last_time") - F.unix_timestamp("first_time")).cast("double") / 86400
    return ends.withColumn(
        "mb_per_day", F.round((F.col("last_mb") - F.col("first_mb")).cast("double") / F.nullif(elapsed, F.lit(0.0)), 2)
    )


def storage_by_schema(tables: DataFrame, skip_schemas: Sequence[str] = rules.SYSTEM_SCHEMAS) -> DataFrame:
    """Total, data and index MB and table count per server, database and schema."""
    mb = lambda c: F.round(total(c).cast("double") / MB, 2)
    return (
        tables.where(not_in(F.col("schema_name"), skip_schemas))
        .groupBy("server_name", "database_name", "schema_name")
        .agg(
            mb(F.col("table_bytes") + F.col("index_bytes")).alias("total_mb"),
            mb(F.col("table_bytes")).alias("data_mb"),
            mb(F.col("index_bytes")).alias("index_mb"),
            F.count("*").alias("table_count"),
        )
    )


def storage_by_file_kind(files: DataFrame, by: str = "database_name") -> DataFrame:
    """Data and log size and used share per server and database (or tablespace)."""
    return files.groupBy("server_name", by).agg(
        total(F.when(F.col("file_type") == "ROWS", F.col("size_mb")).otherwise(0)).alias("data_mb"),
        total(F.when(F.col("file_type") == "LOG", F.col("size_mb")).otherwise(0)).alias("log_mb"),
        total(F.col("size_mb")).alias("total_mb"),
        ratio(total(F.col("used_mb")), total(F.col("size_mb")), 100).alias("used_pct"),
        F.count("*").alias("file_count"),
    )


def baseline(waits: DataFrame, counters: DataFrame, queries: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Mean of waits by type, of the named counters and of query elapsed time, per server.

    ``metric_source`` is a constant per branch, so a filter on it drops the other branches from the plan.
    """
    recent = lambda df: df.where(F.col("capture_time") >= before(as_of, days=days))
    mean = lambda c: F.round(F.avg(c), 4).alias("metric_value")
    source = lambda name: F.lit(name).alias("metric_source")
    parts = [
        recent(waits)
        .groupBy("server_name", source("wait"), F.concat(F.lit("Wait_"), "wait_type").alias("metric_name"))
        .agg(mean("wait_time_ms")),
        recent(counters)
        .where(F.col("counter_name").isin(rules.BASELINE_COUNTERS))
        .groupBy("server_name", source("counter"), F.col("counter_name").alias("metric_name"))
        .agg(mean("counter_value")),
        recent(queries)
        .groupBy("server_name", source("query"), F.concat(F.lit("Query_AvgElapsed_"), "database_name").alias("metric_name"))
        .agg(mean(truncated_div(F.col("total_elapsed_ms"), F.col("exec_count")))),
    ]
    merged = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return merged.withColumns({"metric_type": F.lit("AVG"), "baseline_date": F.to_date(at(as_of))})


def baseline_compare(current: DataFrame, base: DataFrame, pct: float = 25) -> DataFrame:
    """Metrics further than ``pct`` percent from their newest baseline; a zero baseline is left out."""
    newest = base.groupBy("server_name").agg(F.max("baseline_date").alias("baseline_date"))
    latest = base.join(newest, ["server_name", "baseline_date"], "left_semi").select(
        "server_name", "metric_name", F.col("metric_value").alias("baseline_value")
    )
    change = F.col("current_value") - F.col("baseline_value")
    share = change / F.nullif(F.col("baseline_value"), F.lit(0.0)) * 100
    percent = F.round(share, 2)
    return (
        current.join(latest, ["server_name", "metric_name"])
        .where(F.abs(share) > pct)
        .select(
            "server_name",
            "metric_name",
            F.round("current_value", 4).alias("current_value"),
            "baseline_value",
            F.round(change, 4).alias("variance"),
            percent.alias("variance_pct"),
        )
    )


def baseline_variance(waits: DataFrame, base: DataFrame, as_of: datetime, pct: float = 25) -> DataFrame:
    """Last day's mean wait against its baseline, flagged beyond 50 percent, with the direction."""
    current = (
        waits.where(F.col("capture_time") >= before(as_of, hours=24))
        .groupBy("server_name", F.concat(F.lit("Wait_"), "wait_type").alias("metric_name"))
        .agg(F.avg("wait_time_ms").alias("current_value"))
    )
    found = baseline_compare(current, base.where((F.col("metric_type") == "AVG") & (F.col("metric_source") == "wait")), pct)
    p = F.col("variance_pct")
    return found.withColumns(
        {
            "alert_triggered": F.when(F.abs(p) > 50, 1).otherwise(0),
            "status": first_match(
                [(p > 50, "SIGNIFICANT INCREASE"), (p > pct, "INCREASE"), (p < -50, "SIGNIFICANT DECREASE")], "DECREASE"
            ),
        }
    )


def significant_variances(variances: DataFrame) -> DataFrame:
    """Stored variances beyond 25 percent with a severity."""
    return variances.where(F.abs("variance_pct") > 25).select(
        "server_name", "metric_name", "variance_pct", band(F.col("variance_pct"), rules.VARIANCE_SEVERITY, "INFO").alias("severity")
    )


def index_maintenance_summary(
    log: DataFrame,
    keys: Sequence[str] = ("server_name", "database_name", "table_name", "index_name", "operation_type"),
    as_of: datetime | None = None,
    days: int | None = None,
) -> DataFrame:
    """Operations, span, duration, mean fragmentation and outcomes; optionally of the last days only."""
    kept = log if days is None else log.where(F.col("operation_start") >= before(as_of, days=days))
    return kept.groupBy(*keys).agg(
        F.count("*").alias("operations"),
        F.min("operation_start").alias("first_operation"),
        F.max("operation_start").alias("last_operation"),
        total(F.col("duration_s")).alias("total_duration_s"),
        _mean("frag_before").alias("avg_frag_before"),
        _mean("frag_after").alias("avg_frag_after"),
        count_if(F.col("status") == "Success").alias("successes"),
        count_if(F.col("status") == "Failed").alias("failures"),
    )


def login_summary(audit: DataFrame) -> DataFrame:
    """Events, successes and failures per day, login and event type."""
    return audit.groupBy(F.to_date("login_time").alias("login_date"), "login_name", "event_type").agg(
        F.count("*").alias("event_count"),
        count_if(F.col("is_successful") == 1).alias("successful_count"),
        count_if(F.col("is_successful") == 0).alias("failed_count"),
    )


def failed_logins(
    audit: DataFrame,
    as_of: datetime,
    hours: int = 24,
    min_attempts: int = 3,
    keys: Sequence[str] = ("login_name", "host_name", "ip_address"),
) -> DataFrame:
    """Repeated failures per origin within the window."""
    return (
        audit.where((F.col("event_type") == "FAILED_LOGIN") & (F.col("login_time") > before(as_of, hours=hours)))
        .groupBy(*keys)
        .agg(
            F.count("*").alias("failed_attempts"),
            F.min("login_time").alias("first_attempt"),
            F.max("login_time").alias("last_attempt"),
        )
        .where(F.col("failed_attempts") >= min_attempts)
        .withColumn("minutes_ago", boundary_diff("minute", F.col("last_attempt"), at(as_of)))
    )


def connection_summary(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Connections, distinct users and applications and longest time per server, capture and state."""
    return distinct_connections_exact(sessions, as_of, ["server_name", "capture_time", "status"])


def connections_by_origin(sessions: DataFrame, skip_program_like: str = "%(PZ%)") -> DataFrame:
    """Sessions per capture of a server, user, program, machine and state; parallel workers are left out."""
    return (
        sessions.where(F.col("login_name").isNotNull() & not_like(F.col("program_name"), skip_program_like))
        .groupBy("server_name", "capture_time", "login_name", "program_name", "host_name", "status")
        .agg(F.count("*").alias("session_count"), F.max("query_start").alias("last_start"))
    )


def state_pivot(df: DataFrame, by: Sequence[str | Column], state: str, states: dict[str, str]) -> DataFrame:
    """One count column per state (``states``: value -> column name), and the total, per group."""
    return df.groupBy(*by).agg(
        *[count_if(F.col(state) == value).alias(name) for value, name in states.items()], F.count("*").alias("total")
    )


def connection_limit(sessions: DataFrame, max_connections: int) -> DataFrame:
    """Connections of each server at each capture against the limit of a server; ``usage`` is unrounded, for comparisons."""
    used = sessions.groupBy("server_name", "capture_time").agg(F.count("*").alias("current_connections"))
    pct = F.col("current_connections").cast("double") * 100 / F.lit(max_connections)
    return used.select(
        "server_name",
        "capture_time",
        "current_connections",
        F.lit(max_connections).cast("bigint").alias("max_connections"),
        pct.alias("usage"),
        F.round(pct, 2).alias("usage_pct"),
        band(pct, rules.CONNECTION_BAND, "OK").alias("status"),
    )


def wait_event_counts(sessions: DataFrame) -> DataFrame:
    """Sessions per server, capture, wait event type and event."""
    return sessions.where(F.col("wait_type").isNotNull()).groupBy("server_name", "capture_time", F.col("status").alias("wait_event_type"), "wait_type").agg(
        F.count("*").alias("wait_count")
    )


def lock_summary(locks: DataFrame) -> DataFrame:
    """Lock count per server, capture, relation, type, mode and state."""
    return locks.groupBy(
        "server_name", "capture_time", "relation_id", "locktype", "lock_mode",
        F.when(F.col("granted") == 1, "GRANTED").otherwise("WAITING").alias("lock_status"),
    ).agg(F.count("*").alias("lock_count"))


def lock_monitor(locks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Total locks, blocked sessions and the highest blocking session, one row per server and capture."""
    key = ["server_name", "capture_time"]
    blocked = sessions.where(F.col("blocking_session_id") > 0).groupBy(*key).agg(
        F.count("*").alias("blocked_sessions"), F.max("blocking_session_id").alias("top_blocking_session")
    )
    totals = locks.groupBy(*key).agg(F.count("*").alias("total_locks"))
    return totals.join(blocked, key, "left").withColumn("blocked_sessions", F.coalesce("blocked_sessions", F.lit(0).cast("bigint")))


def lock_details(locks: DataFrame, sessions: DataFrame) -> DataFrame:
    """One line of text per lock of a blocked session (the monitor's details, a row each)."""
    key = ["server_name", "capture_time"]
    blocked = sessions.where(F.col("blocking_session_id") > 0).select(*key, F.col("session_id").alias("pid"), "blocking_session_id")
    where = F.coalesce(F.concat(F.lit(" on relation "), F.col("relation_id").cast("string")), F.lit(""))
    return locks.join(blocked, [*key, "pid"]).select(
        *key,
        "pid",
        F.concat(
            F.col("pid").cast("string"), F.lit(" blocked by "), F.col("blocking_session_id").cast("string"), where
        ).alias("detail"),
    )


def archive_rate(logs: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Archived files and MB per server and hour."""
    return (
        logs.where(F.col("first_time") > before(as_of, hours=hours))
        .groupBy("server_name", trunc_ts("hour", F.col("first_time")).alias("hour"))
        .agg(F.count("*").alias("archive_logs"), total(F.col("size_mb")).alias("size_mb"))
    )


def error_summary(classified: DataFrame) -> DataFrame:
    """Rows per server, day, type and severity with first and last time."""
    return classified.groupBy("server_name", F.to_date("log_date").alias("error_date"), "log_type", "severity").agg(
        F.count("*").alias("error_count"), F.min("log_date").alias("first_error"), F.max("log_date").alias("last_error")
    )


def unprocessed_error_summary(archive: DataFrame, as_of: datetime, sample_len: int = 500) -> DataFrame:
    """Summary of the day's rows that no earlier capture has processed."""
    return (
        archive.where((F.col("is_processed") == 0) & (F.to_date("log_date") == F.to_date(at(as_of))))
        .groupBy("server_name", "log_type")
        .agg(
            F.count("*").alias("error_count"),
            F.min("log_date").alias("first_occurrence"),
            F.max("log_date").alias("last_occurrence"),
            F.substring(F.min("log_text"), 1, sample_len).alias("sample_message"),
            F.max("severity").cast("bigint").alias("severity"),
        )
        .withColumn("capture_date", F.to_date(at(as_of)))
    )


def mark_processed(archive: DataFrame, as_of: datetime) -> DataFrame:
    """The archive after a capture: every open row is flagged and dated. Written back in place of the old one."""
    fresh = F.col("is_processed") == 0
    return archive.withColumns(
        {"processed_date": F.when(fresh, at(as_of)).otherwise(F.col("processed_date")), "is_processed": F.lit(1)}
    )


def job_summary(history: DataFrame) -> DataFrame:
    """Runs per server, job and day with outcomes, mean duration and the last run.

    The buffers hold numbers only: the last run is the largest (time, run id), its status comes back by a join.
    """
    status = F.col("run_status")
    key = ["server_name", "job_name", "run_date"]
    runs = history.withColumn("run_date", F.to_date("run_time"))
    out = runs.groupBy(*key).agg(
        F.count("*").alias("total_runs"),
        count_if(status == 1).alias("succeeded_runs"),
        count_if(status == 0).alias("failed_runs"),
        count_if(status == 3).alias("canceled_runs"),
        _mean("duration_s").alias("avg_duration_s"),
        F.max("run_time").alias("last_run_time"),
    )
    newest = out.select(*key, F.col("last_run_time").alias("run_time"))
    ended = runs.join(newest, [*key, "run_time"]).groupBy(*key).agg(F.max_by("run_status", "run_id").alias("last_status"))
    label = first_match([(F.col("last_status") == code, text) for code, text in rules.JOB_STATUS.items()], "Unknown")
    return out.join(ended, key).withColumn("last_run_status", label).drop("last_status")


def duplicate_savings(duplicates: DataFrame, by: Sequence[str] = ("server_name", "database_name")) -> DataFrame:
    """Space to gain per group; an index found redundant in two ways counts once."""
    index = ["server_name", "database_name", "schema_name", "table_name", "index2_name"]
    once = duplicates.groupBy(*index).agg(
        F.max("savings_kb").alias("savings_kb"), F.max((F.col("recommendation") == "DROP Index2").cast("int")).alias("drop_it")
    )
    return once.groupBy(*by).agg(
        total(F.col("savings_kb")).alias("total_savings_kb"),
        F.count("*").alias("redundant_indexes"),
        count_if(F.col("drop_it") == 1).alias("actionable"),
    )


def open_duplicates(found: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Recorded redundant indexes of the last days that nobody has dealt with (``detected``, ``is_resolved``)."""
    return found.where((F.col("is_resolved") == 0) & (F.col("detected") >= before(as_of, days=days)))


def alert_history(audit: DataFrame) -> DataFrame:
    """Alert occurrences per server, day, alert and detail."""
    return (
        audit.where(F.col("event_type") == "ALERT")
        .groupBy("server_name", F.to_date("login_time").alias("alert_date"), F.col("login_name").alias("alert_name"), "details")
        .agg(F.count("*").alias("occurrences"))
    )


def doc_summary(columns: DataFrame) -> DataFrame:
    """Column count per table."""
    return (
        columns.where(F.col("object_type") == "COLUMN")
        .groupBy("server_name", "database_name", F.concat_ws(".", "schema_name", "object_name").alias("table_name"))
        .agg(F.count("*").alias("column_count"))
    )


def _cents(col: str) -> Column:
    return F.round(F.col(col) * 100).cast("bigint")


def daily_sales(orders: DataFrame, lines: DataFrame, products: DataFrame) -> DataFrame:
    """Day total, order count, distinct customers and the product that earned most.

    Line revenue is summed per order and product first; names join the one winner of each day.
    """
    day = orders.select("order_id", F.to_date("order_time").alias("report_date"), "customer_id", "total_due")
    totals = day.groupBy("report_date").agg(
        F.sum(_cents("total_due")).cast("bigint").alias("cents"),
        F.count("*").alias("order_count"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    earned = (
        lines.join(day.select("order_id", "report_date"), "order_id")
        .groupBy("report_date", "product_id")
        .agg(total(_cents("amount")).alias("amount"))
    )
    best = earned.groupBy("report_date").agg(
        F.max(F.struct("amount", F.negative("product_id").alias("minus_id"))).alias("best")
    )
    named = best.select("report_date", F.negative("best.minus_id").alias("product_id")).join(products, "product_id")
    return (
        totals.join(named.select("report_date", F.col("product_name").alias("top_product")), "report_date", "left")
        .select(
            "report_date", (F.col("cents").cast("double") / 100).alias("total_sales"), "order_count", "unique_customers", "top_product"
        )
    )


def period_kpis(orders: DataFrame, as_of: datetime) -> DataFrame:
    """Month to date against the same span one month earlier: revenue, customers, order value, change."""
    now = at(as_of)
    start = F.date_trunc("month", now).cast("timestamp_ntz")
    prev_start = F.add_months(start, -1).cast("timestamp_ntz")
    month_earlier = now - F.expr("INTERVAL '1' MONTH")
    when = F.col("order_time")
    current = (when >= start) & (when < now)
    previous = (when >= prev_start) & (when < month_earlier)
    sums = orders.where((when >= prev_start) & (when < now)).agg(
        *[
            agg.alias(f"{name}_{span}")
            for span, rows in (("cur", current), ("prev", previous))
            for name, agg in (
                ("cents", F.coalesce(total(F.when(rows, _cents("total_due"))), F.lit(0).cast("bigint"))),
                ("orders", count_if(rows)),
                ("customers", F.countDistinct(F.when(rows, F.col("customer_id")))),
            )
        ]
    )
    money = lambda span: F.col(f"cents_{span}").cast("double") / 100
    value = lambda span: F.round(money(span) / F.nullif(F.col(f"orders_{span}"), F.lit(0)), 2)
    metrics = F.array(
        F.struct(F.lit("TotalRevenue").alias("metric_name"), money("cur").alias("current_value"), money("prev").alias("previous_value")),
        F.struct(
            F.lit("ActiveCustomers").alias("metric_name"),
            F.col("customers_cur").cast("double").alias("current_value"),
            F.col("customers_prev").cast("double").alias("previous_value"),
        ),
        F.struct(F.lit("AvgOrderValue").alias("metric_name"), value("cur").alias("current_value"), value("prev").alias("previous_value")),
    )
    change = (F.col("current_value") - F.col("previous_value")) / F.nullif(F.col("previous_value"), F.lit(0.0)) * 100
    return sums.select(F.inline(metrics)).withColumn("change_pct", F.round(change, 2))


def index_usage_ratio(usage: DataFrame) -> DataFrame:
    """Share of seeks among reads and the last access, per index."""
    summed = usage.groupBy("server_name", "database_name", "schema_name", "table_name", "index_name").agg(
        F.max("user_seeks").alias("user_seeks"),
        F.max("user_scans").alias("user_scans"),
        F.max("user_updates").alias("user_updates"),
        F.max("last_used").alias("last_access"),
    )
    reads = F.col("user_seeks") + F.col("user_scans")
    return summed.withColumn("usage_ratio", F.coalesce(ratio(F.col("user_seeks"), reads, 1, 4), F.lit(0.0)))
