"""Alert evaluation: every check is a one-row aggregate, joined to the configuration."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import at, before, boundary_diff, fill_template, seconds_between, total, truncated_div
from fleetspan.operators import aggregates, joins
from fleetspan.operators.grouping import latest_snapshot


def alert_configuration(spark: SparkSession) -> DataFrame:
    """The ten standard alerts, all enabled."""
    fixed = spark.createDataFrame(
        rules.ALERTS, "alert_name string, alert_type string, threshold_value bigint, message_template string"
    )
    return fixed.withColumn("is_enabled", F.lit(1))


def _check(df: DataFrame, name: str, value: Column, message: Column, *args: Column) -> DataFrame:
    """``args`` fill the configured message; by default it is filled with the value and the threshold."""
    given = [*args, None, None][:2]
    return df.select(
        F.lit(name).alias("alert_name"), value.cast("bigint").alias("current_value"), message.alias("detail"),
        *[(F.lit(None) if a is None else a).cast("string").alias(f"arg{i}") for i, a in enumerate(given)],
    )


def _worst(df: DataFrame, value: Column, name: Column) -> DataFrame:
    """The largest value with its name, as one row; ties by name. None if nothing has a value."""
    found = df.select(value.cast("bigint").alias("n"), name.alias("name")).where("n IS NOT NULL")
    return found.agg(F.max(F.struct("n", "name")).alias("w")).select("w.n", "w.name")


def run_checks(
    sessions: DataFrame, audit: DataFrame, backups: DataFrame, jobs: DataFrame, waits: DataFrame, errors: DataFrame, files: DataFrame, as_of: datetime
) -> DataFrame:
    """(alert_name, current_value, detail, arg0, arg1), one row for each of the configured alerts.

    Sessions and waits count as of the newest capture of their server. The backup checks take the newest
    backup of every database of every server first and then report the one waiting longest. Waits
    are judged by their mean per waiting task, disks by the share of a tablespace that is used, and the error
    log (``errors``: classified rows) by the errors of the last hour.
    """
    sessions, waits = latest_snapshot(sessions), latest_snapshot(waits)
    now = at(as_of)
    n = F.col("n")
    text = n.cast("string")

    running = sessions.where((F.col("status") != "idle") & (F.col("query_start") < before(as_of, minutes=5))).agg(
        F.max(seconds_between(F.col("query_start"), now)).alias("n")
    )
    blocked = sessions.where(F.col("blocking_session_id") > 0).agg(F.count("*").alias("n"))
    failures = audit.where(
        (F.col("event_type") == "FAILED_LOGIN") & (F.col("login_time") > before(as_of, hours=1))
    ).agg(F.count("*").alias("n"))
    newest = backups.groupBy("server_name", "database_name", "backup_type").agg(F.max("backup_finish").alias("last_finish"))
    waited = boundary_diff("hour", F.col("last_finish"), now)
    overdue = lambda kind: _worst(newest.where(F.col("backup_type") == kind), waited, F.concat_ws("/", "server_name", "database_name"))
    per_task = truncated_div(F.col("wait_time_ms"), F.col("waiting_tasks"))
    wait_name = F.concat_ws(": ", "server_name", "wait_type")
    slowest = _worst(waits, per_task, wait_name)
    latch = _worst(waits.where(F.col("wait_type").like("PAGELATCH%")), per_task, wait_name)
    logged = errors.where((F.col("severity") >= 16) & (F.col("log_date") > before(as_of, hours=1))).agg(F.count("*").alias("n"))
    spaces = files.groupBy("server_name", "tablespace_name").agg(total(F.col("used_mb")).alias("used"), total(F.col("size_mb")).alias("size"))
    fullest = _worst(
        spaces, F.floor(F.col("used").cast("double") * 100 / F.nullif(F.col("size"), F.lit(0))), F.concat_ws("/", "server_name", "tablespace_name")
    )
    failed_jobs = jobs.where(
        (F.col("run_status") == 0) & (F.col("run_time") >= F.to_date(before(as_of, days=1)).cast("timestamp_ntz"))
    ).agg(F.count("*").alias("n"))

    name = F.col("name")
    late = lambda what: F.concat(F.lit("Database "), name, F.lit(": "), text, F.lit(f" hours since {what}"))
    waiting = F.concat(name, F.lit(" waits "), text, F.lit(" ms on average"))
    parts = [
        _check(running, "Long Running Query", n, F.concat(F.lit("Query running for "), text, F.lit(" seconds"))),
        _check(blocked, "Blocking Chain", n, F.concat(text, F.lit(" sessions in blocking chain"))),
        _check(failures, "Failed Logins", n, F.concat(text, F.lit(" failed logins in last hour"))),
        _check(overdue("D"), "Database Full Backup Overdue", n, late("backup")),
        _check(overdue("L"), "Log Backup Overdue", n, late("log backup")),
        _check(slowest, "High Wait Time", n, waiting, F.substring_index("name", ": ", -1)),
        _check(logged, "Error Log Error", n, F.concat(text, F.lit(" errors in last hour"))),
        _check(fullest, "Disk Space Low", n, F.concat(name, F.lit(" is "), text, F.lit("% full")), name, text),
        _check(latch, "TempDB Contention", n, waiting, F.substring_index("name", ": ", -1)),
        _check(failed_jobs, "Job Failed", n, F.lit("Recent job failures detected")),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


def check_alerts(config: DataFrame, checks: DataFrame) -> DataFrame:
    """Enabled alerts whose value reaches the threshold, with the configured message filled in."""
    return (
        checks.join(config.where(F.col("is_enabled") == 1), "alert_name")
        .where(F.col("current_value") >= F.col("threshold_value"))
        .select(
            "alert_name",
            "alert_type",
            "current_value",
            "threshold_value",
            "detail",
            fill_template(
                F.col("message_template"),
                F.coalesce("arg0", F.col("current_value").cast("string")),
                F.coalesce("arg1", F.col("threshold_value").cast("string")),
            ).alias("notification"),
        )
    )


def record_triggers(state: DataFrame, triggered: DataFrame, as_of: datetime) -> DataFrame:
    """Alert state after a run: count and time move for the triggered alerts. Replaces the stored state."""
    hits = triggered.select("alert_name").distinct().withColumn("hit", F.lit(True))
    hit = F.col("hit").eqNullSafe(True)
    return (
        state.join(hits, "alert_name", "left")
        .withColumns(
            {
                "last_triggered": F.when(hit, at(as_of)).otherwise(F.col("last_triggered")),
                "trigger_count": F.col("trigger_count") + F.when(hit, 1).otherwise(0),
            }
        )
        .drop("hit")
    )


def check_limits(
    sessions: DataFrame, max_connections: int, audit: DataFrame, replicas: DataFrame, as_of: datetime
) -> DataFrame:
    """Variant with built-in limits: connections of a server over 80/95 % of its limit, five failures in an hour, lag over 100 MiB.

    Connections count at each server's newest capture, one alert per server; the unrounded share is
    compared. Lag counts at the newest state of each replica.
    """
    limit = aggregates.connection_limit(latest_snapshot(sessions), max_connections)
    connections = limit.where(F.col("usage") > 80).select(
        F.lit("Connection Limit").alias("alert_name"),
        F.concat(
            F.col("server_name"), F.lit(": Current: "), F.col("current_connections").cast("string"), F.lit(", Max: "),
            F.col("max_connections").cast("string"),
        ).alias("alert_message"),
        F.when(F.col("usage") > 95, "CRITICAL").otherwise("WARNING").alias("severity"),
    )
    failures = (
        audit.where((F.col("event_type") == "FAILED_LOGIN") & (F.col("login_time") >= before(as_of, hours=1)))
        .agg(F.count("*").alias("n"))
        .where(F.col("n") >= 5)
        .select(
            F.lit("Failed Logins").alias("alert_name"),
            F.concat(F.col("n").cast("string"), F.lit(" failed login attempts in last hour")).alias("alert_message"),
            F.lit("WARNING").alias("severity"),
        )
    )
    lag = (
        latest_snapshot(replicas, ["server_name", "ag_name", "replica_name"])
        .agg(F.max(F.col("sent_lsn") - F.col("replay_lsn")).alias("lag"))
        .where(F.col("lag") > 104857600)
        .select(
            F.lit("Replication Lag").alias("alert_name"),
            F.lit("Replication lag exceeds 100MB on one or more standbys").alias("alert_message"),
            F.lit("WARNING").alias("severity"),
        )
    )
    return connections.unionByName(failures).unionByName(lag)


def blocking_alert(sessions: DataFrame, threshold_s: int = 30) -> DataFrame:
    """One JSON document per session blocked beyond the threshold at its server's newest capture, or a single OK row.

    A document per row instead of one array over all rows: the alert may cover any number of sessions.
    """
    pairs = joins.blocking_pairs(latest_snapshot(sessions), min_wait_ms=threshold_s * 1000 + 1, text_len=200)
    fields = [
        "server_name", "blocked_session", "blocking_session", "blocker_login", "blocker_program", "blocker_query", "wait_time_ms", "wait_type"
    ]
    found = pairs.select(
        F.lit("ALERT_TRIGGERED").alias("status"), F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("details")
    )
    quiet = pairs.agg(F.count("*").alias("n")).where(F.col("n") == 0).select(
        F.lit("OK").alias("status"), F.lit(None).cast("string").alias("details")
    )
    return found.unionByName(quiet)
