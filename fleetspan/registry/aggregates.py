"""Grouped-summary queries."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from fleetspan.functions.rules import BASELINE_COUNTERS
from fleetspan.operators import aggregates as agg
from fleetspan.operators import joins, partials
from fleetspan.registry import Entry, with_views
from fleetspan.registry.joins import SQL_DUPLICATES, TBL, same_table
from fleetspan.registry.rows import NOW, SQL_WAIT_CATEGORY, classified, names, sql_classified
from fleetspan.session import scratch_path
from fleetspan.sources.versioned import VersionedTable
from fleetspan.sources.views import AS_OF

KPI_AS_OF = datetime(2001, 7, 20, 12)
PREVIOUS_DAY = AS_OF - timedelta(hours=12)


def limits(t):
    return t.file_space.groupBy("server_name", "database_name").agg((F.sum("max_size_mb") * 3).cast("bigint").alias("max_mb"))


def base(t):
    return agg.baseline(t.wait_stats_history, t.perf_counters, t.query_stats_snapshot, AS_OF)


def archive(t):
    return classified(t).withColumns(
        {
            "is_processed": F.when(F.col("process_info").isin("spid1", "spid2", "spid3"), 1).otherwise(0),
            "processed_date": F.lit(None).cast("timestamp_ntz"),
        }
    )


def alert_audit(t):
    """Failed logins logged as alerts."""
    return t.login_audit.select(
        "server_name",
        "login_time",
        F.when(F.col("event_type") == "FAILED_LOGIN", "ALERT").otherwise(F.col("event_type")).alias("event_type"),
        F.lit("Failed Logins").alias("login_name"),
        F.col("host_name").alias("details"),
    )


def sales(t):
    orders = t.table("orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("order_time"), F.col("o_custkey").alias("customer_id"),
        F.col("o_totalprice").alias("total_due"),
    )
    lines = t.table("lineitem").select(
        F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_extendedprice").alias("amount")
    )
    products = t.table("part").select(
        F.col("p_partkey").alias("product_id"), F.concat_ws(" #", "p_name", F.col("p_partkey").cast("string")).alias("product_name")
    )
    return orders, lines, products


def _days_of(t, history, series, value):
    """Day states as they are kept: stored once, then the days of the newest rows built again as if those had come late."""
    table = VersionedTable(t.spark, scratch_path(t.spark, "day-states"))
    late = F.col("capture_time") >= F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")
    partials.store_days(table, partials.day_states(history.where(~late), series, value))
    partials.patch_days(table, history, history.where(late), series, value)
    return table.read()


def _baseline_from_days(t):
    measures = partials.baseline_measures(t.wait_stats_history, t.perf_counters, t.query_stats_snapshot)
    return partials.baseline_from_states(_days_of(t, measures, partials.BASELINE_SERIES, "measure"), measures, AS_OF)


def _growth_from_days(t):
    return partials.growth_from_states(_days_of(t, t.database_size_history, partials.DATABASE, "total_mb"), t.database_size_history, AS_OF)


def _sketched(t):
    """Sketch states per capture, merged, next to the exact counts: whether they lie within four standard errors."""
    by = ["server_name", "status"]
    exact = partials.distinct_connections_exact(t.session_requests, AS_OF).select(*by, F.col("unique_users").alias("users"), F.col("unique_apps").alias("apps"))
    merged = partials.distinct_connections(partials.connection_states(t.session_requests, AS_OF))
    close = lambda n: F.abs(F.col(f"unique_{n}") - F.col(n)) <= F.greatest(F.lit(0.0), F.ceil(F.col(n) * 4 * 1.04 / 64))
    return merged.join(exact, by).select(*by, "connections", "max_duration_s", close("users").alias("users_close"), close("apps").alias("apps_close"))


SQL_BASELINE = f"""base AS (
        SELECT server_name, 'Wait_' || wait_type AS metric_name, CAST(round(CAST(avg(wait_time_ms) AS DECIMAL(38, 10)), 4) AS DOUBLE) AS metric_value FROM wait_stats_history
        WHERE capture_time >= {NOW} - INTERVAL '30' DAY GROUP BY 1, 2
        UNION ALL SELECT server_name, counter_name, CAST(round(CAST(avg(counter_value) AS DECIMAL(38, 10)), 4) AS DOUBLE) FROM perf_counters
        WHERE capture_time >= {NOW} - INTERVAL '30' DAY AND counter_name IN ({names(BASELINE_COUNTERS)}) GROUP BY 1, 2
        UNION ALL SELECT server_name, 'Query_AvgElapsed_' || database_name,
                         CAST(round(CAST(avg(CAST(floor(total_elapsed_ms / nullif(exec_count, 0)) AS BIGINT)) AS DECIMAL(38, 10)), 4) AS DOUBLE)
        FROM query_stats_snapshot WHERE capture_time >= {NOW} - INTERVAL '30' DAY GROUP BY 1, 2)"""
SQL_VARIANCE = f"""{SQL_BASELINE},
        cur AS (SELECT server_name, 'Wait_' || wait_type AS metric_name, avg(wait_time_ms) AS v FROM wait_stats_history
                WHERE capture_time >= {NOW} - INTERVAL '24' HOUR GROUP BY 1, 2),
        var AS (SELECT c.server_name, c.metric_name, CAST(round(CAST(c.v AS DECIMAL(38, 10)), 4) AS DOUBLE) AS current_value, b.metric_value AS baseline_value,
                       CAST(round(CAST(c.v - b.metric_value AS DECIMAL(38, 10)), 4) AS DOUBLE) AS variance, CAST(round(CAST((c.v - b.metric_value) / nullif(b.metric_value, 0) * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS variance_pct
                FROM cur c JOIN base b ON c.server_name = b.server_name AND c.metric_name = b.metric_name
                WHERE abs((c.v - b.metric_value) / nullif(b.metric_value, 0) * 100) > 25)"""


def sql_growth(days: int = 30) -> str:
    return f"""g AS (SELECT server_name, database_name, min(total_mb) AS first_mb, max(total_mb) AS current_mb,
               CAST(date_diff('day', min(capture_time), max(capture_time)) AS BIGINT) AS days_between
        FROM database_size_history WHERE capture_time >= {NOW} - INTERVAL '{days}' DAY GROUP BY 1, 2 HAVING min(total_mb) < max(total_mb)),
    r AS (SELECT *, CAST(round(CAST(CAST(current_mb - first_mb AS DOUBLE) / nullif(days_between, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS daily_growth_mb FROM g),
    d AS (SELECT *, CASE WHEN daily_growth_mb > 0 THEN CAST(floor(current_mb / daily_growth_mb) AS BIGINT) END AS days_to_double FROM r)"""


SQL_EXHAUST_BAND = (
    "CASE WHEN days_to_double <= 7 THEN 'CRITICAL' WHEN days_to_double <= 30 THEN 'WARNING' WHEN days_to_double <= 60 THEN 'MONITOR' ELSE 'OK' END"
)


def recorded_duplicates(t):
    """Redundant indexes as recorded: when they were found, and every fourth already dealt with."""
    marks = t.index_catalog.select(
        *joins.TABLE, F.col("index_name").alias("index2_name"), F.col("last_used").alias("detected"),
        (F.col("index_id") % 4 == 0).cast("int").alias("is_resolved"),
    )
    return joins.duplicate_indexes(t.index_columns, t.index_catalog).join(marks, [*joins.TABLE, "index2_name"])


def sql_backup(profile: str) -> str:
    high, low = {"history": (24, 12), "weekly": (48, 24)}[profile]
    return f"""
        SELECT server_name, database_name, backup_type, max(backup_start) AS last_start, max(backup_finish) AS last_finish,
               arg_max(backup_size_mb, (backup_finish, backup_size_mb)) AS last_size_mb, CAST(date_diff('hour', max(backup_finish), {NOW}) AS BIGINT) AS hours_since_backup,
               CASE WHEN max(backup_finish) IS NULL THEN 'NO BACKUP' WHEN date_diff('hour', max(backup_finish), {NOW}) > {high} THEN 'OVERDUE'
                    WHEN date_diff('hour', max(backup_finish), {NOW}) > {low} THEN 'WARNING' ELSE 'OK' END AS backup_status
        FROM backup_history GROUP BY 1, 2, 3"""


def sql_count(condition: str) -> str:
    return f"CAST(sum(CASE WHEN {condition} THEN 1 ELSE 0 END) AS BIGINT)"


def sql_wait_summary(hours: int) -> str:
    return f"""
        SELECT wait_type, CAST(sum(waiting_tasks) AS BIGINT) AS total_waits, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_ms,
               avg(wait_time_ms) AS avg_wait_ms, CAST(sum(signal_wait_ms) AS BIGINT) AS total_signal_ms, CAST(count(*) AS BIGINT) AS samples,
               {SQL_WAIT_CATEGORY['history']} AS category
        FROM wait_stats_history WHERE capture_time >= {NOW} - INTERVAL '{hours}' HOUR GROUP BY wait_type"""


ENTRIES = {
    "a01_wait_summary_hour": Entry(
        lambda t: agg.wait_summary(t.wait_stats_history, AS_OF, hours=1, profile="history"), with_views(sql_wait_summary(1))
    ),
    "a01_wait_summary_day": Entry(
        lambda t: agg.wait_summary(t.wait_stats_history, AS_OF, hours=24, profile="history"), with_views(sql_wait_summary(24))
    ),
    "a01_wait_summary_week": Entry(
        lambda t: agg.wait_summary(t.wait_stats_history, AS_OF, hours=168, profile="history"), with_views(sql_wait_summary(168))
    ),
    "a02_wait_trend": Entry(
        lambda t: agg.wait_trend(t.wait_stats_history),
        with_views("""
        SELECT CAST(capture_time AS DATE) AS snapshot_date, wait_type, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_ms,
               CAST(count(*) AS BIGINT) AS snapshots, CAST(floor(sum(wait_time_ms) / count(*)) AS BIGINT) AS avg_wait_ms
        FROM wait_stats_history GROUP BY 1, 2"""),
    ),
    "a03_backup_status": Entry(lambda t: agg.backup_status(t.backup_history, AS_OF), with_views(sql_backup("history"))),
    "a03_backup_status_weekly": Entry(
        lambda t: agg.backup_status(t.backup_history, AS_OF, "weekly"), with_views(sql_backup("weekly"))
    ),
    "a03_database_backup_status": Entry(
        lambda t: agg.database_backup_status(
            t.database_size_history.select("server_name", "database_name"), t.backup_history, AS_OF
        ),
        with_views(f"""
        SELECT d.server_name, d.database_name, max(b.backup_finish) AS last_finish, CAST(date_diff('hour', max(b.backup_finish), {NOW}) AS BIGINT) AS hours_since_backup,
               CASE WHEN count(b.backup_id) = 0 THEN 'NO BACKUP' WHEN date_diff('hour', max(b.backup_finish), {NOW}) > 24 THEN 'OVERDUE' ELSE 'OK' END AS backup_status
        FROM (SELECT DISTINCT server_name, database_name FROM database_size_history) d
        LEFT JOIN backup_history b ON b.database_name = d.database_name AND b.server_name = d.server_name AND b.backup_type = 'D'
        GROUP BY d.server_name, d.database_name"""),
    ),
    "a04_backup_chain": Entry(
        lambda t: agg.backup_chain(t.backup_history, AS_OF),
        with_views(f"""WITH m AS (SELECT server_name, database_name, max(CASE WHEN backup_type = 'D' THEN backup_start END) AS last_full,
            max(CASE WHEN backup_type = 'I' THEN backup_start END) AS last_diff, max(CASE WHEN backup_type = 'L' THEN backup_start END) AS last_log
            FROM backup_history GROUP BY 1, 2)
        SELECT *, CASE WHEN last_full IS NULL THEN 'NO_BACKUP' WHEN last_log IS NULL OR date_diff('minute', last_log, {NOW}) > 60 THEN 'LOG_GAP'
                       WHEN last_diff IS NULL OR date_diff('hour', last_diff, {NOW}) > 24 THEN 'NO_DIFF' ELSE 'OK' END AS chain_status FROM m"""),
    ),
    "a04_backup_chain_success": Entry(
        lambda t: agg.backup_chain(t.backup_history, AS_OF, "success_only"),
        with_views(f"""WITH m AS (SELECT server_name, database_name, max(CASE WHEN backup_type = 'D' THEN backup_start END) AS last_full,
            max(CASE WHEN backup_type = 'I' THEN backup_start END) AS last_diff, max(CASE WHEN backup_type = 'L' THEN backup_start END) AS last_log
            FROM backup_history WHERE status = 'Success' GROUP BY 1, 2)
        SELECT *, CASE WHEN last_full IS NULL THEN 'NO_BACKUP' WHEN last_log IS NULL OR last_log < {NOW} - INTERVAL '1' HOUR THEN 'LOG_GAP'
                       WHEN last_diff IS NULL AND last_full < {NOW} - INTERVAL '1' DAY THEN 'NO_RECENT_DIFF' ELSE 'OK' END AS chain_status FROM m"""),
    ),
    "a05_database_age": Entry(
        lambda t: agg.database_age(t.backup_history, AS_OF),
        with_views(f"""
        SELECT server_name, database_name, min(backup_start) AS oldest_full,
               CAST(date_diff('day', CAST(min(backup_start) AS DATE), DATE '2024-01-31') AS BIGINT) AS age_days
        FROM backup_history WHERE backup_type = 'D' GROUP BY 1, 2"""),
    ),
    "a06_backup_totals": Entry(
        lambda t: agg.backup_totals(t.backup_history, AS_OF),
        with_views(f"""
        SELECT CAST(round(CAST(CAST(sum(backup_size_mb) AS DOUBLE) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS total_gb, max(backup_finish) AS last_backup,
               CAST(round(CAST(avg(backup_size_mb) / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS avg_gb, {sql_count("backup_type = 'D'")} AS full_backups, {sql_count("backup_type = 'I'")} AS incr_backups
        FROM backup_history WHERE backup_finish > {NOW} - INTERVAL '7' DAY"""),
    ),
    "a07_size_trend": Entry(
        lambda t: agg.size_trend(t.database_size_history),
        with_views("""
        SELECT server_name, database_name, CAST(capture_time AS DATE) AS snapshot_date, avg(total_mb) AS avg_size_mb,
               min(total_mb) AS min_size_mb, max(total_mb) AS max_size_mb, avg(used_mb) AS avg_used_mb,
               avg(total_mb - used_mb) AS avg_free_mb
        FROM database_size_history GROUP BY 1, 2, 3"""),
    ),
    "a08_growth_summary": Entry(
        lambda t: agg.growth_summary(t.database_size_history, AS_OF, by=["server_name"], value="total_mb"),
        with_views(f"""WITH s AS (SELECT server_name, capture_time, CAST(sum(total_mb) AS BIGINT) AS size_mb FROM database_size_history
            WHERE capture_time >= {NOW} - INTERVAL '7' DAY GROUP BY 1, 2)
        SELECT server_name, min(capture_time) AS first_sample, max(capture_time) AS last_sample, min(size_mb) AS min_mb, max(size_mb) AS max_mb,
               max(size_mb) - min(size_mb) AS growth_mb, avg(size_mb) AS avg_mb FROM s GROUP BY 1"""),
    ),
    "a08_growth_by_database": Entry(
        lambda t: agg.growth_summary(t.database_size_history, AS_OF, by=["server_name", "database_name"], value="used_mb", days=14),
        with_views(f"""WITH s AS (SELECT server_name, database_name, capture_time, CAST(sum(used_mb) AS BIGINT) AS size_mb FROM database_size_history
            WHERE capture_time >= {NOW} - INTERVAL '14' DAY GROUP BY 1, 2, 3)
        SELECT server_name, database_name, min(capture_time) AS first_sample, max(capture_time) AS last_sample, min(size_mb) AS min_mb, max(size_mb) AS max_mb,
               max(size_mb) - min(size_mb) AS growth_mb, avg(size_mb) AS avg_mb FROM s GROUP BY 1, 2"""),
    ),
    "a09_growth_projection": Entry(
        lambda t: agg.growth_projection(t.database_size_history, AS_OF, limits=limits(t)),
        with_views(f"""WITH {sql_growth()},
        m AS (SELECT server_name, database_name, CAST(sum(max_size_mb) * 3 AS BIGINT) AS max_mb FROM file_space GROUP BY 1, 2)
        SELECT d.server_name, d.database_name, d.current_mb, d.daily_growth_mb, d.days_to_double,
               DATE '2024-01-31' + CAST(d.days_to_double AS INT) AS projected_date,
               CASE WHEN m.max_mb IS NOT NULL AND daily_growth_mb > 0 THEN CAST(floor(greatest(m.max_mb - d.current_mb, 0) / d.daily_growth_mb) AS BIGINT) END AS days_to_exhaustion,
               CASE WHEN days_between >= 30 THEN 'HIGH' WHEN days_between >= 14 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
               {SQL_EXHAUST_BAND} AS status,
               CASE WHEN daily_growth_mb > 1024 THEN printf('%.2f', CAST(round(CAST(daily_growth_mb / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' GB/day'
                    ELSE printf('%.2f', CAST(round(CAST(daily_growth_mb AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' MB/day' END AS growth_text
        FROM d LEFT JOIN m ON d.database_name = m.database_name AND d.server_name = m.server_name"""),
    ),
    "a09_growth_from_days": Entry(
        _growth_from_days,
        with_views(f"""WITH {sql_growth()}
        SELECT server_name, database_name, current_mb, daily_growth_mb, days_to_double, DATE '2024-01-31' + CAST(days_to_double AS INT) AS projected_date,
               CASE WHEN days_between >= 30 THEN 'HIGH' WHEN days_between >= 14 THEN 'MEDIUM' ELSE 'LOW' END AS confidence, {SQL_EXHAUST_BAND} AS status,
               CASE WHEN daily_growth_mb > 1024 THEN printf('%.2f', CAST(round(CAST(daily_growth_mb / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' GB/day'
                    ELSE printf('%.2f', CAST(round(CAST(daily_growth_mb AS DECIMAL(38, 10)), 2) AS DOUBLE)) || ' MB/day' END AS growth_text FROM d"""),
    ),
    "a08_growth_from_days": Entry(
        lambda t: partials.growth_summary_from_states(_days_of(t, partials.group_samples(t.database_size_history, ["server_name"], "total_mb"), ["server_name"], "size_mb"),
            partials.group_samples(t.database_size_history, ["server_name"], "total_mb"), AS_OF, ["server_name"]).withColumn("avg_mb", F.round("avg_mb", 4)),
        with_views(f"""WITH s AS (SELECT server_name, capture_time, CAST(sum(total_mb) AS BIGINT) AS size_mb FROM database_size_history
            WHERE capture_time >= {NOW} - INTERVAL '7' DAY GROUP BY 1, 2)
        SELECT server_name, min(capture_time) AS first_sample, max(capture_time) AS last_sample, min(size_mb) AS min_mb, max(size_mb) AS max_mb,
               max(size_mb) - min(size_mb) AS growth_mb, CAST(round(CAST(avg(size_mb) AS DECIMAL(38, 10)), 4) AS DOUBLE) AS avg_mb FROM s GROUP BY 1"""),
    ),
    "a07_size_trend_from_days": Entry(
        lambda t: partials.size_trend_from_states(_days_of(t, t.database_size_history, partials.DATABASE, "total_mb")),
        with_views("""
        SELECT server_name, database_name, CAST(capture_time AS DATE) AS snapshot_date, avg(total_mb) AS avg_size_mb, min(total_mb) AS min_size_mb, max(total_mb) AS max_size_mb
        FROM database_size_history GROUP BY 1, 2, 3"""),
    ),
    "a10_days_to_double": Entry(
        lambda t: agg.days_to_double(t.database_size_history, AS_OF),
        with_views(f"""WITH g AS (SELECT server_name, database_name, max(total_mb) AS current_size_mb, max(total_mb) - min(total_mb) AS growth_mb,
            CAST(floor(date_diff('second', min(capture_time), max(capture_time)) / 86400) AS BIGINT) AS whole_days
            FROM database_size_history WHERE capture_time >= {NOW} - INTERVAL '30' DAY GROUP BY 1, 2),
        r AS (SELECT *, CAST(growth_mb AS DOUBLE) / nullif(whole_days, 0) AS rate FROM g)
        SELECT server_name, database_name, current_size_mb, CAST(round(CAST(rate AS DECIMAL(38, 10)), 2) AS DOUBLE) AS daily_growth_mb,
               CASE WHEN rate > 0 THEN CAST(round(CAST(current_size_mb / rate AS DECIMAL(38, 10)), 0) AS DOUBLE) END AS days_to_double,
               CASE WHEN rate > 1024 THEN 'CRITICAL' WHEN rate > 512 THEN 'WARNING' WHEN rate > 100 THEN 'MONITOR' ELSE 'OK' END AS status FROM r"""),
    ),
    "a11_growth_rate": Entry(
        lambda t: agg.growth_rate(t.database_size_history),
        with_views("""WITH e AS (SELECT server_name, database_name, arg_min(total_mb, capture_time) AS first_mb, arg_max(total_mb, capture_time) AS last_mb,
            min(capture_time) AS first_time, max(capture_time) AS last_time FROM database_size_history GROUP BY 1, 2)
        SELECT *, CAST(round(CAST(CAST(last_mb - first_mb AS DOUBLE) / nullif(CAST(date_diff('second', first_time, last_time) AS DOUBLE) / 86400, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS mb_per_day FROM e"""),
    ),
    "a12_storage_by_schema": Entry(
        lambda t: agg.storage_by_schema(t.table_stats),
        with_views("""
        SELECT server_name, database_name, schema_name, CAST(round(CAST(CAST(sum(table_bytes + index_bytes) AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS total_mb,
               CAST(round(CAST(CAST(sum(table_bytes) AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS data_mb, CAST(round(CAST(CAST(sum(index_bytes) AS DOUBLE) / 1048576 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS index_mb,
               CAST(count(*) AS BIGINT) AS table_count FROM table_stats GROUP BY 1, 2, 3"""),
    ),
    "a12_storage_by_database": Entry(
        lambda t: agg.storage_by_file_kind(t.file_space),
        with_views("""
        SELECT server_name, database_name, CAST(sum(CASE WHEN file_type = 'ROWS' THEN size_mb ELSE 0 END) AS BIGINT) AS data_mb,
               CAST(sum(CASE WHEN file_type = 'LOG' THEN size_mb ELSE 0 END) AS BIGINT) AS log_mb, CAST(sum(size_mb) AS BIGINT) AS total_mb,
               CAST(round(CAST(CAST(sum(used_mb) AS DOUBLE) * 100 / sum(size_mb) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct, CAST(count(*) AS BIGINT) AS file_count
        FROM file_space GROUP BY 1, 2"""),
    ),
    "a12_storage_by_tablespace": Entry(
        lambda t: agg.storage_by_file_kind(t.file_space, by="tablespace_name"),
        with_views("""
        SELECT server_name, tablespace_name, CAST(sum(CASE WHEN file_type = 'ROWS' THEN size_mb ELSE 0 END) AS BIGINT) AS data_mb,
               CAST(sum(CASE WHEN file_type = 'LOG' THEN size_mb ELSE 0 END) AS BIGINT) AS log_mb, CAST(sum(size_mb) AS BIGINT) AS total_mb,
               CAST(round(CAST(CAST(sum(used_mb) AS DOUBLE) * 100 / sum(size_mb) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS used_pct, CAST(count(*) AS BIGINT) AS file_count
        FROM file_space GROUP BY 1, 2"""),
    ),
    "a13_baseline": Entry(
        base,
        with_views(f"""WITH {SQL_BASELINE} SELECT *, CASE WHEN metric_name LIKE 'Wait%' THEN 'wait' WHEN metric_name LIKE 'Query%' THEN 'query' ELSE 'counter' END AS metric_source,
               'AVG' AS metric_type, DATE '2024-01-31' AS baseline_date FROM base"""),
    ),
    "a13_baseline_from_days": Entry(
        _baseline_from_days,
        with_views(f"""WITH {SQL_BASELINE} SELECT *, CASE WHEN metric_name LIKE 'Wait%' THEN 'wait' WHEN metric_name LIKE 'Query%' THEN 'query' ELSE 'counter' END AS metric_source,
               'AVG' AS metric_type, DATE '2024-01-31' AS baseline_date FROM base"""),
    ),
    "a14_variance_from_days": Entry(
        lambda t: agg.baseline_variance(t.wait_stats_history, _baseline_from_days(t), AS_OF),
        with_views(f"""WITH {SQL_VARIANCE}
        SELECT *, CASE WHEN abs(variance_pct) > 50 THEN 1 ELSE 0 END AS alert_triggered,
               CASE WHEN variance_pct > 50 THEN 'SIGNIFICANT INCREASE' WHEN variance_pct > 25 THEN 'INCREASE'
                    WHEN variance_pct < -50 THEN 'SIGNIFICANT DECREASE' ELSE 'DECREASE' END AS status FROM var"""),
    ),
    "a14_baseline_variance": Entry(
        lambda t: agg.baseline_variance(t.wait_stats_history, base(t), AS_OF),
        with_views(f"""WITH {SQL_VARIANCE}
        SELECT *, CASE WHEN abs(variance_pct) > 50 THEN 1 ELSE 0 END AS alert_triggered,
               CASE WHEN variance_pct > 50 THEN 'SIGNIFICANT INCREASE' WHEN variance_pct > 25 THEN 'INCREASE'
                    WHEN variance_pct < -50 THEN 'SIGNIFICANT DECREASE' ELSE 'DECREASE' END AS status FROM var"""),
    ),
    "a14_significant_variances": Entry(
        lambda t: agg.significant_variances(agg.baseline_variance(t.wait_stats_history, base(t), AS_OF)),
        with_views(f"""WITH {SQL_VARIANCE}
        SELECT server_name, metric_name, variance_pct, CASE WHEN variance_pct > 50 THEN 'CRITICAL' WHEN variance_pct > 25 THEN 'WARNING' ELSE 'INFO' END AS severity
        FROM var WHERE abs(variance_pct) > 25"""),
    ),
    "j12_baseline_compare": Entry(
        lambda t: agg.baseline_compare(
            t.perf_counters.where(F.col("capture_time") >= F.lit("2024-01-30 00:00:00").cast("timestamp_ntz"))
            .groupBy("server_name", F.col("counter_name").alias("metric_name"))
            .agg(F.avg("counter_value").alias("current_value")),
            base(t).where(F.col("metric_source") == "counter"),
            pct=5,
        ),
        with_views(f"""WITH {SQL_BASELINE},
        cur AS (SELECT server_name, counter_name AS metric_name, avg(counter_value) AS v FROM perf_counters
                WHERE capture_time >= {NOW} - INTERVAL '24' HOUR GROUP BY 1, 2)
        SELECT c.server_name, c.metric_name, CAST(round(CAST(c.v AS DECIMAL(38, 10)), 4) AS DOUBLE) AS current_value, b.metric_value AS baseline_value,
               CAST(round(CAST(c.v - b.metric_value AS DECIMAL(38, 10)), 4) AS DOUBLE) AS variance, CAST(round(CAST((c.v - b.metric_value) / nullif(b.metric_value, 0) * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS variance_pct
        FROM cur c JOIN base b ON c.server_name = b.server_name AND c.metric_name = b.metric_name
        WHERE abs((c.v - b.metric_value) / nullif(b.metric_value, 0) * 100) > 5"""),
    ),
    "a15_index_maintenance_summary": Entry(
        lambda t: agg.index_maintenance_summary(t.index_maintenance_log),
        with_views(f"""
        SELECT server_name, database_name, table_name, index_name, operation_type, CAST(count(*) AS BIGINT) AS operations,
               min(operation_start) AS first_operation, max(operation_start) AS last_operation, CAST(sum(duration_s) AS BIGINT) AS total_duration_s,
               avg(frag_before) AS avg_frag_before, avg(frag_after) AS avg_frag_after,
               {sql_count("status = 'Success'")} AS successes, {sql_count("status = 'Failed'")} AS failures
        FROM index_maintenance_log GROUP BY 1, 2, 3, 4, 5"""),
    ),
    "a15_maintenance_week": Entry(
        lambda t: agg.index_maintenance_summary(t.index_maintenance_log, ["database_name", "operation_type"], AS_OF, days=7),
        with_views(f"""
        SELECT database_name, operation_type, CAST(count(*) AS BIGINT) AS operations,
               min(operation_start) AS first_operation, max(operation_start) AS last_operation, CAST(sum(duration_s) AS BIGINT) AS total_duration_s,
               avg(frag_before) AS avg_frag_before, avg(frag_after) AS avg_frag_after,
               {sql_count("status = 'Success'")} AS successes, {sql_count("status = 'Failed'")} AS failures
        FROM index_maintenance_log WHERE operation_start >= {NOW} - INTERVAL '7' DAY GROUP BY 1, 2"""),
    ),
    "a16_login_summary": Entry(
        lambda t: agg.login_summary(t.login_audit),
        with_views(f"""
        SELECT CAST(login_time AS DATE) AS login_date, login_name, event_type, CAST(count(*) AS BIGINT) AS event_count,
               {sql_count('is_successful = 1')} AS successful_count, {sql_count('is_successful = 0')} AS failed_count
        FROM login_audit GROUP BY 1, 2, 3"""),
    ),
    "a17_failed_logins": Entry(
        lambda t: agg.failed_logins(t.login_audit, AS_OF),
        with_views(f"""
        SELECT login_name, host_name, ip_address, CAST(count(*) AS BIGINT) AS failed_attempts, min(login_time) AS first_attempt, max(login_time) AS last_attempt,
               CAST(date_diff('minute', max(login_time), {NOW}) AS BIGINT) AS minutes_ago
        FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '24' HOUR GROUP BY 1, 2, 3 HAVING count(*) >= 3"""),
    ),
    "a17_failed_logins_week": Entry(
        lambda t: agg.failed_logins(t.login_audit, AS_OF, hours=168, keys=["login_name", "host_name"]),
        with_views(f"""
        SELECT login_name, host_name, CAST(count(*) AS BIGINT) AS failed_attempts, min(login_time) AS first_attempt, max(login_time) AS last_attempt,
               CAST(date_diff('minute', max(login_time), {NOW}) AS BIGINT) AS minutes_ago
        FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '168' HOUR GROUP BY 1, 2 HAVING count(*) >= 3"""),
    ),
    "a17_failed_logins_top": Entry(
        lambda t: agg.failed_logins(t.login_audit, AS_OF, hours=168, min_attempts=1, keys=["login_name"])
        .orderBy(F.desc("failed_attempts"), "login_name")
        .limit(10),
        with_views(f"""
        SELECT login_name, CAST(count(*) AS BIGINT) AS failed_attempts, min(login_time) AS first_attempt, max(login_time) AS last_attempt,
               CAST(date_diff('minute', max(login_time), {NOW}) AS BIGINT) AS minutes_ago
        FROM login_audit WHERE event_type = 'FAILED_LOGIN' AND login_time > {NOW} - INTERVAL '168' HOUR GROUP BY 1
        ORDER BY failed_attempts DESC, login_name LIMIT 10"""),
    ),
    "a18_connection_summary": Entry(
        lambda t: agg.connection_summary(t.session_requests, AS_OF),
        with_views(f"""
        SELECT server_name, capture_time, status, CAST(count(*) AS BIGINT) AS connections, CAST(count(DISTINCT login_name) AS BIGINT) AS unique_users,
               CAST(count(DISTINCT program_name) AS BIGINT) AS unique_apps, CAST(date_diff('second', min(query_start), {NOW}) AS BIGINT) AS max_duration_s
        FROM session_requests GROUP BY 1, 2, 3"""),
    ),
    "a18_distinct_connections": Entry(
        lambda t: partials.distinct_connections_exact(t.session_requests, AS_OF),
        with_views(f"""
        SELECT server_name, status, CAST(count(*) AS BIGINT) AS connections, CAST(count(DISTINCT login_name) AS BIGINT) AS unique_users,
               CAST(count(DISTINCT program_name) AS BIGINT) AS unique_apps, CAST(date_diff('second', min(query_start), {NOW}) AS BIGINT) AS max_duration_s
        FROM session_requests GROUP BY 1, 2"""),
    ),
    "a18_distinct_sketches": Entry(
        _sketched,
        with_views(f"""WITH e AS (
        SELECT server_name, status, CAST(count(*) AS BIGINT) AS connections, CAST(count(DISTINCT login_name) AS BIGINT) AS unique_users,
               CAST(count(DISTINCT program_name) AS BIGINT) AS unique_apps, CAST(date_diff('second', min(query_start), {NOW}) AS BIGINT) AS max_duration_s
        FROM session_requests GROUP BY 1, 2)
        SELECT server_name, status, connections, max_duration_s, true AS users_close, true AS apps_close FROM e"""),
    ),
    "a18_connections_by_origin": Entry(
        lambda t: agg.connections_by_origin(t.session_requests, skip_program_like="app6%"),
        with_views("""
        SELECT server_name, capture_time, login_name, program_name, host_name, status, CAST(count(*) AS BIGINT) AS session_count, max(query_start) AS last_start
        FROM session_requests WHERE program_name NOT LIKE 'app6%' GROUP BY 1, 2, 3, 4, 5, 6"""),
    ),
    "a19_state_pivot": Entry(
        lambda t: agg.state_pivot(
            t.login_audit,
            [F.date_trunc("hour", "login_time").cast("timestamp_ntz").alias("sample_time")],
            "event_type",
            {"LOGIN": "logins", "LOGOUT": "logouts", "FAILED_LOGIN": "failures"},
        ),
        with_views(f"""
        SELECT date_trunc('hour', login_time) AS sample_time, {sql_count("event_type = 'LOGIN'")} AS logins, {sql_count("event_type = 'LOGOUT'")} AS logouts,
               {sql_count("event_type = 'FAILED_LOGIN'")} AS failures, CAST(count(*) AS BIGINT) AS total FROM login_audit GROUP BY 1"""),
    ),
    "a19_session_pivot": Entry(
        lambda t: agg.state_pivot(
            t.session_requests, ["program_name"], "status", {"running": "active", "idle": "inactive", "suspended": "waiting"}
        ),
        with_views(f"""
        SELECT program_name, {sql_count("status = 'running'")} AS active, {sql_count("status = 'idle'")} AS inactive,
               {sql_count("status = 'suspended'")} AS waiting, CAST(count(*) AS BIGINT) AS total FROM session_requests GROUP BY 1"""),
    ),
    "a20_connection_limit": Entry(
        lambda t: agg.connection_limit(t.session_requests, 300).drop("usage"),
        with_views("""
        SELECT server_name, capture_time, CAST(count(*) AS BIGINT) AS current_connections, CAST(300 AS BIGINT) AS max_connections,
               CAST(round(CAST(CAST(count(*) AS DOUBLE) * 100 / 300 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS usage_pct,
               CASE WHEN CAST(count(*) AS DOUBLE) * 100 / 300 > 90 THEN 'CRITICAL' WHEN CAST(count(*) AS DOUBLE) * 100 / 300 > 75 THEN 'WARNING' ELSE 'OK' END AS status
        FROM session_requests GROUP BY 1, 2"""),
    ),
    "a21_wait_event_counts": Entry(
        lambda t: agg.wait_event_counts(t.session_requests),
        with_views("""
        SELECT server_name, capture_time, status AS wait_event_type, wait_type, CAST(count(*) AS BIGINT) AS wait_count
        FROM session_requests WHERE wait_type IS NOT NULL GROUP BY 1, 2, 3, 4"""),
    ),
    "a22_lock_summary": Entry(
        lambda t: agg.lock_summary(t.lock_table),
        with_views("""
        SELECT server_name, capture_time, relation_id, locktype, lock_mode, CASE WHEN granted = 1 THEN 'GRANTED' ELSE 'WAITING' END AS lock_status, CAST(count(*) AS BIGINT) AS lock_count
        FROM lock_table GROUP BY 1, 2, 3, 4, 5, 6"""),
    ),
    "a22_lock_monitor": Entry(
        lambda t: agg.lock_monitor(t.lock_table, t.session_requests),
        with_views("""
        SELECT l.server_name, l.capture_time, l.n AS total_locks, coalesce(s.n, 0) AS blocked_sessions, s.top AS top_blocking_session
        FROM (SELECT server_name, capture_time, CAST(count(*) AS BIGINT) AS n FROM lock_table GROUP BY 1, 2) l
        LEFT JOIN (SELECT server_name, capture_time, CAST(count(*) AS BIGINT) AS n, max(blocking_session_id) AS top FROM session_requests
                   WHERE blocking_session_id > 0 GROUP BY 1, 2) s ON s.server_name = l.server_name AND s.capture_time = l.capture_time"""),
    ),
    "a22_lock_details": Entry(
        lambda t: agg.lock_details(t.lock_table, t.session_requests),
        with_views("""
        SELECT l.server_name, l.capture_time, l.pid, l.pid || ' blocked by ' || s.blocking_session_id || coalesce(' on relation ' || CAST(l.relation_id AS VARCHAR), '') AS detail
        FROM lock_table l JOIN session_requests s ON s.session_id = l.pid AND s.server_name = l.server_name
          AND s.capture_time = l.capture_time WHERE s.blocking_session_id > 0"""),
    ),
    "a23_archive_rate": Entry(
        lambda t: agg.archive_rate(
            t.backup_history.where(F.col("backup_type") == "L").select(
                "server_name", F.col("backup_start").alias("first_time"), F.col("backup_size_mb").alias("size_mb")
            ),
            AS_OF,
        ),
        with_views(f"""
        SELECT server_name, date_trunc('hour', backup_start) AS hour, CAST(count(*) AS BIGINT) AS archive_logs, CAST(sum(backup_size_mb) AS BIGINT) AS size_mb
        FROM backup_history WHERE backup_type = 'L' AND backup_start > {NOW} - INTERVAL '24' HOUR GROUP BY 1, 2"""),
    ),
    "a24_error_summary": Entry(
        lambda t: agg.error_summary(classified(t, 30)),
        with_views(f"""WITH c AS ({sql_classified(30)})
        SELECT server_name, CAST(log_date AS DATE) AS error_date, log_type, severity, CAST(count(*) AS BIGINT) AS error_count,
               min(log_date) AS first_error, max(log_date) AS last_error FROM c GROUP BY 1, 2, 3, 4"""),
    ),
    "a24_unprocessed_error_summary": Entry(
        lambda t: agg.unprocessed_error_summary(archive(t), PREVIOUS_DAY),
        with_views(f"""WITH c AS ({sql_classified(7)})
        SELECT server_name, log_type, CAST(count(*) AS BIGINT) AS error_count, min(log_date) AS first_occurrence, max(log_date) AS last_occurrence,
               left(min(log_text), 500) AS sample_message, CAST(max(severity) AS BIGINT) AS severity, DATE '2024-01-30' AS capture_date
        FROM c WHERE process_info NOT IN ('spid1', 'spid2', 'spid3') AND CAST(log_date AS DATE) = DATE '2024-01-30' GROUP BY 1, 2"""),
    ),
    "a24_mark_processed": Entry(
        lambda t: agg.mark_processed(archive(t), PREVIOUS_DAY),
        with_views(f"""WITH c AS ({sql_classified(7)})
        SELECT *, 1 AS is_processed, CASE WHEN process_info NOT IN ('spid1', 'spid2', 'spid3') THEN TIMESTAMP '2024-01-30 12:00:00' END AS processed_date FROM c"""),
    ),
    "a25_job_summary": Entry(
        lambda t: agg.job_summary(t.job_history),
        with_views(f"""
        SELECT server_name, job_name, CAST(run_time AS DATE) AS run_date, CAST(count(*) AS BIGINT) AS total_runs,
               {sql_count('run_status = 1')} AS succeeded_runs, {sql_count('run_status = 0')} AS failed_runs, {sql_count('run_status = 3')} AS canceled_runs,
               avg(duration_s) AS avg_duration_s,
               CASE arg_max(run_status, (run_time, run_id)) WHEN 0 THEN 'Failed' WHEN 1 THEN 'Succeeded' WHEN 2 THEN 'Retry' WHEN 3 THEN 'Canceled' ELSE 'Unknown' END AS last_run_status,
               max(run_time) AS last_run_time
        FROM job_history GROUP BY 1, 2, 3"""),
    ),
    "a26_duplicate_savings": Entry(
        lambda t: agg.duplicate_savings(joins.duplicate_indexes(t.index_columns, t.index_catalog)),
        with_views(f"""WITH {SQL_DUPLICATES},
        once AS (SELECT {TBL}, index2_name, max(savings_kb) AS savings_kb, max(recommendation) AS recommendation FROM dup GROUP BY 1, 2, 3, 4, 5)
        SELECT server_name, database_name, CAST(sum(savings_kb) AS BIGINT) AS total_savings_kb, CAST(count(*) AS BIGINT) AS redundant_indexes,
               {sql_count("recommendation = 'DROP Index2'")} AS actionable FROM once GROUP BY 1, 2"""),
    ),
    "a26_open_duplicate_savings": Entry(
        lambda t: agg.duplicate_savings(agg.open_duplicates(recorded_duplicates(t), AS_OF)),
        with_views(f"""WITH {SQL_DUPLICATES},
        seen AS (SELECT d.*, c.last_used AS detected, CAST(c.index_id % 4 = 0 AS INT) AS is_resolved
                 FROM dup d JOIN index_catalog c ON {same_table('c', 'd')} AND c.index_name = d.index2_name),
        once AS (SELECT {TBL}, index2_name, max(savings_kb) AS savings_kb, max(recommendation) AS recommendation FROM seen
                 WHERE is_resolved = 0 AND detected >= {NOW} - INTERVAL '30' DAY GROUP BY 1, 2, 3, 4, 5)
        SELECT server_name, database_name, CAST(sum(savings_kb) AS BIGINT) AS total_savings_kb, CAST(count(*) AS BIGINT) AS redundant_indexes,
               {sql_count("recommendation = 'DROP Index2'")} AS actionable FROM once GROUP BY 1, 2"""),
    ),
    "a27_alert_history": Entry(
        lambda t: agg.alert_history(alert_audit(t)),
        with_views("""
        SELECT server_name, CAST(login_time AS DATE) AS alert_date, 'Failed Logins' AS alert_name, host_name AS details, CAST(count(*) AS BIGINT) AS occurrences
        FROM login_audit WHERE event_type = 'FAILED_LOGIN' GROUP BY 1, 2, 4"""),
    ),
    "a28_doc_summary": Entry(
        lambda t: agg.doc_summary(t.column_catalog),
        with_views("""
        SELECT server_name, database_name, schema_name || '.' || object_name AS table_name, CAST(count(*) AS BIGINT) AS column_count FROM column_catalog GROUP BY 1, 2, 3"""),
    ),
    "a29_daily_sales": Entry(
        lambda t: agg.daily_sales(*sales(t)),
        """WITH e AS (SELECT CAST(o_orderdate AS DATE) AS report_date, l_partkey AS pid, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS BIGINT) AS amount
            FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
        b AS (SELECT report_date, pid FROM (SELECT *, row_number() OVER (PARTITION BY report_date ORDER BY amount DESC, pid) AS rn FROM e) x WHERE rn = 1),
        d AS (SELECT CAST(o_orderdate AS DATE) AS report_date, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / 100 AS total_sales,
                     CAST(count(*) AS BIGINT) AS order_count, CAST(count(DISTINCT o_custkey) AS BIGINT) AS unique_customers FROM orders GROUP BY 1)
        SELECT d.*, p.p_name || ' #' || p.p_partkey AS top_product FROM d LEFT JOIN b ON b.report_date = d.report_date LEFT JOIN part p ON p.p_partkey = b.pid""",
    ),
    "a30_period_kpis": Entry(
        lambda t: agg.period_kpis(sales(t)[0], KPI_AS_OF),
        """WITH o AS (SELECT CASE WHEN o_orderdate >= TIMESTAMP '2001-07-01' AND o_orderdate < TIMESTAMP '2001-07-20 12:00:00' THEN 'cur'
                               WHEN o_orderdate >= TIMESTAMP '2001-06-01' AND o_orderdate < TIMESTAMP '2001-06-20 12:00:00' THEN 'prev' END AS span,
                          CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_custkey FROM orders),
        s AS (SELECT CAST(coalesce(sum(cents) FILTER (span = 'cur'), 0) AS DOUBLE) / 100 AS rc, CAST(coalesce(sum(cents) FILTER (span = 'prev'), 0) AS DOUBLE) / 100 AS rp,
                     count(DISTINCT o_custkey) FILTER (span = 'cur') AS cc, count(DISTINCT o_custkey) FILTER (span = 'prev') AS cp,
                     count(*) FILTER (span = 'cur') AS nc, count(*) FILTER (span = 'prev') AS np FROM o),
        m AS (SELECT 'TotalRevenue' AS metric_name, rc AS current_value, rp AS previous_value FROM s
              UNION ALL SELECT 'ActiveCustomers', CAST(cc AS DOUBLE), CAST(cp AS DOUBLE) FROM s
              UNION ALL SELECT 'AvgOrderValue', CAST(round(CAST(rc / nullif(nc, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE), CAST(round(CAST(rp / nullif(np, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) FROM s)
        SELECT *, CAST(round(CAST((current_value - previous_value) / nullif(previous_value, 0) * 100 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS change_pct FROM m""",
    ),
    "a31_index_usage_ratio": Entry(
        lambda t: agg.index_usage_ratio(t.index_catalog),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, index_name, max(user_seeks) AS user_seeks, max(user_scans) AS user_scans, max(user_updates) AS user_updates, max(last_used) AS last_access,
               coalesce(CAST(round(CAST(CAST(max(user_seeks) AS DOUBLE) / nullif(max(user_seeks) + max(user_scans), 0) AS DECIMAL(38, 10)), 4) AS DOUBLE), 0.0) AS usage_ratio
        FROM index_catalog GROUP BY 1, 2, 3, 4, 5"""),
    ),
}
