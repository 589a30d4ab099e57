"""Share, latest-snapshot and top-k queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.functions.rules import BENIGN_WAITS
from fleetspan.operators import rankings
from fleetspan.operators.rows import exclude_benign, wait_category
from fleetspan.registry import Entry, with_views
from fleetspan.registry.rows import SQL_WAIT_CATEGORY, sql_bytes
from fleetspan.session import scratch_path
from fleetspan.sources import landing, newest
from fleetspan.sources.views import AS_OF


def fleet_waits(t):
    """Wait totals per server and type, busy waits only."""
    return exclude_benign(t.wait_stats_history, "wait_type", BENIGN_WAITS).groupBy("server_name", "wait_type").agg(
        F.sum("waiting_tasks").cast("bigint").alias("waiting_tasks"),
        F.sum("wait_time_ms").cast("bigint").alias("wait_time_ms"),
        F.sum("signal_wait_ms").cast("bigint").alias("signal_wait_ms"),
    )


SQL_FLEET = """f AS (SELECT server_name, wait_type, CAST(sum(waiting_tasks) AS BIGINT) AS waiting_tasks, CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms,
        CAST(sum(signal_wait_ms) AS BIGINT) AS signal_wait_ms FROM wait_stats_history GROUP BY 1, 2)"""

STATS_ORDER = "server_name, database_name, query_hash, exec_count"


def sql_top(by: str, n: int, floor: int = 0) -> str:
    return f"""WITH m AS (SELECT server_name, database_name, query_hash, exec_count, left(query_text, 100) AS query_text, total_elapsed_ms, logical_reads,
               CAST(round(CAST(CAST(total_elapsed_ms AS DOUBLE) / nullif(exec_count, 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS mean_elapsed_ms,
               CAST(round(CAST(CAST(logical_reads AS DOUBLE) / nullif(exec_count, 0) AS DECIMAL(38, 10)), 0) AS DOUBLE) AS reads_per_exec FROM query_stats_snapshot WHERE exec_count > {floor})
        SELECT * FROM m ORDER BY {by} DESC NULLS LAST, {STATS_ORDER}, total_elapsed_ms, logical_reads LIMIT {n}"""


def _newest_first(t):
    """The history in date folders, probed for every server that ever reported and one that never did."""
    path = scratch_path(t.spark, "wait-days")
    landing.append_history(t.wait_stats_history, path)
    known = t.wait_stats_history.select("server_name").union(t.spark.range(1).select(F.lit("silent")))
    return newest.latest_rows(t.spark, path, known).drop(landing.DATE_COL)


ENTRIES = {
    "w01_share_of_total": Entry(
        lambda t: rankings.share_of_total(fleet_waits(t), "wait_time_ms", top=20, tie=["server_name", "wait_type"])
        .withColumns(
            {
                "resource_wait_ms": F.col("wait_time_ms") - F.col("signal_wait_ms"),
                "category": wait_category(F.col("wait_type"), "diagnostic"),
            }
        ),
        with_views(f"""WITH {SQL_FLEET}
        SELECT *, CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) * 100 / nullif((SELECT sum(wait_time_ms) FROM f), 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS pct,
               wait_time_ms - signal_wait_ms AS resource_wait_ms, {SQL_WAIT_CATEGORY['diagnostic']} AS category
        FROM f ORDER BY wait_time_ms DESC, server_name, wait_type LIMIT 20"""),
    ),
    "w01_share_by_server": Entry(
        lambda t: rankings.share_of_total(fleet_waits(t), "wait_time_ms", by=["server_name"]),
        with_views(f"""WITH {SQL_FLEET}
        SELECT *, CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) * 100 / nullif(sum(wait_time_ms) OVER (PARTITION BY server_name), 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS pct FROM f"""),
    ),
    "w02_share_of_top": Entry(
        lambda t: rankings.share_of_top(fleet_waits(t), "wait_time_ms", 10, tie=["server_name", "wait_type"]),
        with_views(f"""WITH {SQL_FLEET}, top AS (SELECT * FROM f ORDER BY wait_time_ms DESC, server_name, wait_type LIMIT 10)
        SELECT *, CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) * 100 / nullif(sum(wait_time_ms) OVER (), 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS pct FROM top"""),
    ),
    "w03_share_per_snapshot": Entry(
        lambda t: rankings.share_per_snapshot(t.wait_stats_history),
        with_views("""
        SELECT *, CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) * 100 / nullif(sum(wait_time_ms) OVER (PARTITION BY server_name, capture_time), 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS wait_pct
        FROM wait_stats_history"""),
    ),
    "w04_latest_snapshot": Entry(
        lambda t: rankings.latest_snapshot(t.database_size_history, by=["server_name", "database_name"]),
        with_views("""
        SELECT * FROM database_size_history d WHERE capture_time = (SELECT max(capture_time) FROM database_size_history x
            WHERE x.server_name = d.server_name AND x.database_name = d.database_name)"""),
    ),
    "w04_newest_first": Entry(
        _newest_first,
        with_views("""
        SELECT * FROM wait_stats_history w WHERE capture_time = (SELECT max(capture_time) FROM wait_stats_history x WHERE x.server_name = w.server_name)"""),
    ),
    "w04_latest_snapshot_global": Entry(
        lambda t: rankings.latest_snapshot(t.query_stats_snapshot, by=()),
        with_views("SELECT * FROM query_stats_snapshot WHERE capture_time = (SELECT max(capture_time) FROM query_stats_snapshot)"),
    ),
    "w04_current_waits": Entry(
        lambda t: rankings.current_waits(t.wait_stats_history),
        with_views(f"""
        SELECT *, CAST(round(CAST(CAST(wait_time_ms AS DOUBLE) * 100 / nullif(sum(wait_time_ms) OVER (PARTITION BY server_name, capture_time), 0) AS DECIMAL(38, 10)), 2) AS DOUBLE) AS wait_pct,
               {SQL_WAIT_CATEGORY['history']} AS category
        FROM wait_stats_history w WHERE wait_time_ms > 0 AND capture_time = (SELECT max(capture_time) FROM wait_stats_history x WHERE x.server_name = w.server_name)"""),
    ),
    "w05_query_patterns": Entry(
        lambda t: rankings.query_patterns(t.query_stats_snapshot),
        with_views(f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY total_elapsed_ms DESC, {STATS_ORDER}, logical_reads) AS rn FROM query_stats_snapshot)
        SELECT CASE WHEN count(*) > 100 THEN 'Frequent Query - Consider indexing' ELSE 'Occasional Query' END AS recommendation,
               left(string_agg(query_text, '; ' ORDER BY rn) FILTER (rn <= 20), 500) AS query_pattern, CAST(count(*) AS BIGINT) AS execution_count,
               CAST(sum(total_elapsed_ms) AS BIGINT) AS total_elapsed_ms, avg(total_elapsed_ms) AS avg_elapsed_ms, max(capture_time) AS last_execution FROM o"""),
    ),
    "t01_top_queries": Entry(lambda t: rankings.top_queries(t.query_stats_snapshot), with_views(sql_top("total_elapsed_ms", 20))),
    "t01_top_queries_mean": Entry(
        lambda t: rankings.top_queries(t.query_stats_snapshot, "mean_elapsed_ms", 10), with_views(sql_top("mean_elapsed_ms", 10))
    ),
    "t01_top_queries_reads": Entry(
        lambda t: rankings.top_queries(t.query_stats_snapshot, "logical_reads", 10, min_calls=10),
        with_views(sql_top("logical_reads", 10, 10)),
    ),
    "t02_largest_tables": Entry(
        lambda t: rankings.largest_tables(t.table_stats),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, CAST(round(CAST(CAST(table_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS data_mb, CAST(round(CAST(CAST(index_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS index_mb,
               CAST(round(CAST(CAST(table_bytes + index_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS total_mb, n_live AS table_rows
        FROM table_stats ORDER BY table_bytes + index_bytes DESC, server_name, database_name, schema_name, table_name LIMIT 20"""),
    ),
    "t02_tables_above": Entry(
        lambda t: rankings.largest_tables(t.table_stats, n=None, min_mb=20),
        with_views("""
        SELECT server_name, database_name, schema_name, table_name, CAST(round(CAST(CAST(table_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS data_mb, CAST(round(CAST(CAST(index_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS index_mb,
               CAST(round(CAST(CAST(table_bytes + index_bytes AS DOUBLE) / 1024 / 1024 AS DECIMAL(38, 10)), 2) AS DOUBLE) AS total_mb, n_live AS table_rows
        FROM table_stats WHERE CAST(table_bytes + index_bytes AS DOUBLE) / 1024 / 1024 > 20"""),
    ),
    "t03_largest_databases": Entry(
        lambda t: rankings.largest_databases(t.database_size_history),
        with_views(f"""
        SELECT server_name, database_name, total_mb, {sql_bytes('(total_mb * 1024 * 1024)')} AS size_text FROM database_size_history d
        WHERE capture_time = (SELECT max(capture_time) FROM database_size_history x WHERE x.server_name = d.server_name AND x.database_name = d.database_name)
        ORDER BY total_mb DESC, server_name, database_name LIMIT 10"""),
    ),
    "t04_index_listing": Entry(
        lambda t: rankings.index_listing(t.index_columns),
        with_views("SELECT * FROM index_columns ORDER BY server_name, database_name, schema_name, table_name, index_id, key_ordinal LIMIT 50"),
    ),
    "t04_recent_wait_totals": Entry(
        lambda t: rankings.recent_wait_totals(t.wait_stats_history, AS_OF),
        with_views("""
        SELECT wait_type, CAST(sum(wait_time_ms) AS BIGINT) AS total_wait_ms, avg(wait_time_ms) AS avg_wait_ms, CAST(count(*) AS BIGINT) AS samples
        FROM wait_stats_history WHERE capture_time >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"""),
    ),
}
