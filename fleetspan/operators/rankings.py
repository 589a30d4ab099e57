"""Shares, latest snapshots and top-k listings."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.functions.expr import before, format_bytes, ratio, total
from fleetspan.operators.grouping import join_groups, latest_snapshot
from fleetspan.operators.rows import TABLE, wait_category


def _top(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def share_of_total(
    df: DataFrame,
    value: str,
    by: Sequence[str] | None = None,
    top: int | None = None,
    tie: Sequence[str] = (),
    name: str = "pct",
) -> DataFrame:
    """Each row's percentage of the total of all given rows; the top rows are cut afterwards.

    The total is an aggregate of its own (a scalar, or one row per group), never an
    unpartitioned window, so no single task sees all rows.
    """
    if by is None:
        whole = df.select(total(F.col(value))).scalar()
        shared = df.withColumn(name, ratio(F.col(value), whole, 100))
    else:
        sums = df.groupBy(*by).agg(total(F.col(value)).alias("group_total"))
        shared = join_groups(df, sums, by, null_safe=True).withColumn(name, ratio(F.col(value), F.col("group_total"), 100)).drop("group_total")
    return _top(shared, [F.desc(value), *[F.asc(c) for c in tie]], top)


def share_of_top(df: DataFrame, value: str, n: int, tie: Sequence[str]) -> DataFrame:
    """Percentage of the total of the n largest rows only."""
    return share_of_total(_top(df, [F.desc(value), *[F.asc(c) for c in tie]], n), value)


def share_per_snapshot(history: DataFrame) -> DataFrame:
    """Percentage within server and capture time."""
    return share_of_total(history, "wait_time_ms", by=["server_name", "capture_time"], name="wait_pct")


def current_waits(history: DataFrame) -> DataFrame:
    """Newest wait snapshot per server with shares and categories."""
    newest = latest_snapshot(history).where(F.col("wait_time_ms") > 0)
    return share_per_snapshot(newest).withColumn("category", wait_category(F.col("wait_type"), "history"))


def query_patterns(stats: DataFrame, n: int = 20, text_len: int = 500, frequent: int = 100) -> DataFrame:
    """Totals over all statements beside the text of the n slowest, and advice on frequency.

    The totals are the same for every statement, so the report has one row.
    """
    totals = stats.agg(
        F.count("*").alias("execution_count"),
        total(F.col("total_elapsed_ms")).alias("total_elapsed_ms"),
        F.avg("total_elapsed_ms").alias("avg_elapsed_ms"),
        F.max("capture_time").alias("last_execution"),
    )
    order = [F.desc("total_elapsed_ms"), "server_name", "database_name", "query_hash", "exec_count", "logical_reads"]
    slowest = stats.orderBy(*order).limit(n)
    key = F.struct(
        F.negative("total_elapsed_ms").alias("k1"), F.col("server_name").alias("k2"), F.col("database_name").alias("k3"),
        F.col("query_hash").alias("k4"), F.col("exec_count").alias("k5"), F.col("logical_reads").alias("k6"),
        F.col("query_text").alias("text"),
    )
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(key)), lambda s: s["text"]), "; ")
    return totals.select(
        F.when(F.col("execution_count") > frequent, "Frequent Query - Consider indexing")
        .otherwise("Occasional Query")
        .alias("recommendation"),
        F.substring(slowest.select(texts).scalar(), 1, text_len).alias("query_pattern"),
        "execution_count",
        "total_elapsed_ms",
        "avg_elapsed_ms",
        "last_execution",
    )


def top_queries(stats: DataFrame, by: str = "total_elapsed_ms", n: int = 20, min_calls: int = 0, text_len: int = 100) -> DataFrame:
    """Heaviest statements by total time, mean time or reads, with per-execution figures."""
    keys = ["server_name", "database_name", "query_hash", "exec_count"]
    measured = stats.where(F.col("exec_count") > min_calls).select(
        *keys,
        F.substring("query_text", 1, text_len).alias("query_text"),
        "total_elapsed_ms",
        "logical_reads",
        ratio(F.col("total_elapsed_ms"), F.col("exec_count")).alias("mean_elapsed_ms"),
        ratio(F.col("logical_reads"), F.col("exec_count"), 1, 0).alias("reads_per_exec"),
    )
    return measured.orderBy(F.desc_nulls_last(by), *keys, "total_elapsed_ms", "logical_reads").limit(n)


def largest_tables(tables: DataFrame, n: int | None = 20, min_mb: float | None = None) -> DataFrame:
    """Largest tables, or all above a size."""
    both = F.col("table_bytes") + F.col("index_bytes")
    mb = lambda c: F.round(c.cast("double") / 1024 / 1024, 2)
    sized = tables if min_mb is None else tables.where(both.cast("double") / 1024 / 1024 > min_mb)
    picked = _top(sized.withColumn("total_bytes", both), [F.desc("total_bytes"), *[F.asc(c) for c in TABLE]], n)
    return picked.select(
        *TABLE,
        mb(F.col("table_bytes")).alias("data_mb"),
        mb(F.col("index_bytes")).alias("index_mb"),
        mb(F.col("total_bytes")).alias("total_mb"),
        F.col("n_live").alias("table_rows"),
    )


def largest_databases(sizes: DataFrame, n: int = 10) -> DataFrame:
    """Newest size of every database, largest first, with readable text."""
    return (
        latest_snapshot(sizes, by=["server_name", "database_name"])
        .orderBy(F.desc("total_mb"), "server_name", "database_name")
        .limit(n)
        .select("server_name", "database_name", "total_mb", format_bytes(F.col("total_mb") * 1024 * 1024).alias("size_text"))
    )


def index_listing(columns: DataFrame, n: int = 50) -> DataFrame:
    """Index columns in table and key order."""
    return columns.orderBy("server_name", "database_name", "schema_name", "table_name", "index_id", "key_ordinal").limit(n)


def recent_wait_totals(history: DataFrame, as_of: datetime, days: int = 7, n: int = 10) -> DataFrame:
    """Largest wait types of the window."""
    return (
        history.where(F.col("capture_time") >= before(as_of, days=days))
        .groupBy("wait_type")
        .agg(
            total(F.col("wait_time_ms")).alias("total_wait_ms"),
            F.avg("wait_time_ms").alias("avg_wait_ms"),
            F.count("*").alias("samples"),
        )
        .orderBy(F.desc("total_wait_ms"), "wait_type")
        .limit(n)
    )
