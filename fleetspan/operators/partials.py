"""Day partials: mergeable states of a measure per series and day, kept beside the history.

A window of any number of days is answered from one state per series and day; only the day that the
window's start falls into is read from the history itself. States of a day are built from that day's
rows alone, so rows that arrive late are brought in by building the days they fall into again.
Distinct counts are kept as sketches, which merge over captures without counting anyone twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.functions import rules
from fleetspan.functions.expr import at, band, before, format_rate_mb, total, truncated_div
from fleetspan.sources.versioned import VersionedTable

DAY = "state_day"
# 2^12 registers: relative standard error 1.04 / sqrt(2^12), below 1.7 percent; exact for small counts.
SKETCH_BITS = 12


def day_states(history: DataFrame, series: Sequence[str | Column], value: Column | str, time_col: str = "capture_time") -> DataFrame:
    """One row per series and day: state_day, samples, sum, least and greatest value, first and last by time.

    Missing values count in no field but the times. Rows without a time belong to no day.
    """
    measured = history.where(F.col(time_col).isNotNull()).withColumn("measure", F.col(value) if isinstance(value, str) else value)
    return measured.groupBy(*series, F.to_date(time_col).alias(DAY)).agg(
        F.count("measure").alias("samples"),
        total(F.col("measure")).alias("sum_value"),
        F.min("measure").alias("least"),
        F.max("measure").alias("greatest"),
        F.min_by("measure", time_col).alias("first_value"),
        F.max_by("measure", time_col).alias("last_value"),
        F.min(time_col).alias("first_time"),
        F.max(time_col).alias("last_time"),
    )


def merge_states(states: DataFrame, series: Sequence[str]) -> DataFrame:
    """One state per series out of those of any days."""
    return states.groupBy(*series).agg(
        total(F.col("samples")).alias("samples"),
        total(F.col("sum_value")).alias("sum_value"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        F.min_by("first_value", "first_time").alias("first_value"),
        F.max_by("last_value", "last_time").alias("last_value"),
        F.min("first_time").alias("first_time"),
        F.max("last_time").alias("last_time"),
    )


def store_days(table: VersionedTable, states: DataFrame) -> int:
    """Put the states of the days in ``states`` in place of the stored ones, all days at once."""
    return table.replace_parts(states, DAY)


def patch_days(table: VersionedTable, history: DataFrame, late: DataFrame, series: Sequence[str], value: Column | str, time_col: str = "capture_time") -> int:
    """Build the days again that the rows of ``late`` (already in ``history``) fall into; other days are not read."""
    days = [r[0] for r in late.select(F.to_date(time_col).alias("d")).where("d IS NOT NULL").distinct().collect()]  # days, not rows
    if not days:
        return table.manifest()["version"]
    low, high = at(datetime.combine(min(days), datetime.min.time())), at(datetime.combine(max(days), datetime.min.time()) + timedelta(days=1))
    touched = history.where((F.col(time_col) >= low) & (F.col(time_col) < high) & F.to_date(time_col).isin(days))
    return store_days(table, day_states(touched, series, value, time_col))


def window_states(
    states: DataFrame, history: DataFrame, series: Sequence[str], value: Column | str, as_of: datetime, days: int, time_col: str = "capture_time"
) -> DataFrame:
    """State per series of the rows since ``as_of`` - ``days``: whole days from ``states``, the first one from ``history``.

    A window that starts at midnight does not read the history.
    """
    start = as_of - timedelta(days=days)
    midnight = datetime.combine(start.date(), datetime.min.time())
    if start == midnight:
        return merge_states(states.where(F.col(DAY) >= F.lit(start.date())), series)
    edge = history.where((F.col(time_col) >= at(start)) & (F.col(time_col) < at(midnight + timedelta(days=1))))
    whole = states.where(F.col(DAY) > F.lit(start.date()))
    return merge_states(whole.unionByName(day_states(edge, series, value, time_col)), series)


def mean(digits: int = 4) -> Column:
    """Mean of a merged state."""
    return F.round(F.col("sum_value").cast("double") / F.nullif(F.col("samples"), F.lit(0)), digits)


# The measures of the baseline: source, name of the metric, its value.
def baseline_measures(waits: DataFrame, counters: DataFrame, queries: DataFrame) -> DataFrame:
    """server_name, metric_source, metric_name, capture_time, measure: the rows a baseline is made of."""
    named = lambda df, source, name, value: df.select(
        "server_name", F.lit(source).alias("metric_source"), name.alias("metric_name"), "capture_time", value.cast("bigint").alias("measure")
    )
    return (
        named(waits, "wait", F.concat(F.lit("Wait_"), "wait_type"), F.col("wait_time_ms"))
        .unionByName(named(counters.where(F.col("counter_name").isin(rules.BASELINE_COUNTERS)), "counter", F.col("counter_name"), F.col("counter_value")))
        .unionByName(
            named(queries, "query", F.concat(F.lit("Query_AvgElapsed_"), "database_name"), truncated_div(F.col("total_elapsed_ms"), F.col("exec_count")))
        )
    )


BASELINE_SERIES = ["server_name", "metric_source", "metric_name"]


def baseline_from_states(states: DataFrame, measures: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """The baseline (A13) of a window, from day states of ``baseline_measures``."""
    merged = window_states(states, measures, BASELINE_SERIES, "measure", as_of, days)
    return merged.select(*BASELINE_SERIES, mean().alias("metric_value"), F.lit("AVG").alias("metric_type"), F.to_date(at(as_of)).alias("baseline_date"))


DATABASE = ["server_name", "database_name"]


def growth_from_states(states: DataFrame, history: DataFrame, as_of: datetime, days: int = 30) -> DataFrame:
    """Growth and projection (A09) per database from day states of its size."""
    merged = window_states(states, history, DATABASE, "total_mb", as_of, days).where(F.col("least") < F.col("greatest"))
    between = F.datediff(F.to_date("last_time"), F.to_date("first_time")).cast("bigint")
    growth = F.round((F.col("greatest") - F.col("least")).cast("double") / F.nullif(between, F.lit(0)), 2)
    per_day = F.when(F.col("daily_growth_mb") > 0, F.col("daily_growth_mb"))
    out = merged.withColumns({"days_between": between, "daily_growth_mb": growth})
    out = out.withColumn("days_to_double", F.floor(F.col("greatest") / per_day))
    return out.select(
        *DATABASE,
        F.col("greatest").alias("current_mb"),
        "daily_growth_mb",
        "days_to_double",
        F.date_add(F.to_date(at(as_of)), F.col("days_to_double").cast("int")).alias("projected_date"),
        band(F.col("days_between"), rules.GROWTH_CONFIDENCE, "LOW").alias("confidence"),
        band(F.col("days_to_double"), rules.EXHAUSTION_BAND, "OK").alias("status"),
        format_rate_mb(F.col("daily_growth_mb")).alias("growth_text"),
    )


def size_trend_from_states(states: DataFrame) -> DataFrame:
    """Average, smallest and largest size per database and day (A07), read off the states."""
    return states.select(
        *DATABASE, F.col(DAY).alias("snapshot_date"), (F.col("sum_value").cast("double") / F.nullif(F.col("samples"), F.lit(0))).alias("avg_size_mb"),
        F.col("least").alias("min_size_mb"), F.col("greatest").alias("max_size_mb"),
    )


def growth_summary_from_states(states: DataFrame, history: DataFrame, as_of: datetime, by: Sequence[str], days: int = 7) -> DataFrame:
    """Growth of a group's total (A08) from day states of its summed samples (see ``group_samples``)."""
    merged = window_states(states, history, by, "size_mb", as_of, days)
    return merged.select(
        *by, F.col("first_time").alias("first_sample"), F.col("last_time").alias("last_sample"), F.col("least").alias("min_mb"),
        F.col("greatest").alias("max_mb"), (F.col("greatest") - F.col("least")).alias("growth_mb"), mean(10).alias("avg_mb"),
    )


def group_samples(history: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The total of a group at each capture."""
    return history.groupBy(*by, "capture_time").agg(total(F.col(value)).alias("size_mb"))


# -- distinct counts ------------------------------------------------------------------------------


def connection_states(sessions: DataFrame, as_of: datetime) -> DataFrame:
    """Per server, capture and session state: connections, oldest start, and sketches of users and applications.

    One pass; no row is copied per distinct count. A missing name is none.
    """
    return sessions.groupBy("server_name", "capture_time", "status").agg(
        F.count("*").alias("connections"),
        F.hll_sketch_agg("login_name", F.lit(SKETCH_BITS)).alias("users"),
        F.hll_sketch_agg("program_name", F.lit(SKETCH_BITS)).alias("apps"),
        F.min("query_start").alias("oldest"),
        F.max(F.unix_timestamp(at(as_of)) - F.unix_timestamp("query_start")).alias("max_duration_s"),
    )


def distinct_connections(states: DataFrame, by: Sequence[str] = ("server_name", "status")) -> DataFrame:
    """Connections with distinct users and applications over all captures of ``states``, merged per ``by``.

    Distinct counts are estimates with a relative standard error below 1.7 percent.
    """
    return states.groupBy(*by).agg(
        total(F.col("connections")).alias("connections"),
        F.hll_sketch_estimate(F.hll_union_agg("users")).alias("unique_users"),
        F.hll_sketch_estimate(F.hll_union_agg("apps")).alias("unique_apps"),
        F.max("max_duration_s").alias("max_duration_s"),
    )


def distinct_connections_exact(sessions: DataFrame, as_of: datetime, by: Sequence[str] = ("server_name", "status")) -> DataFrame:
    """The exact form: names are made distinct first, so each count is a plain one and rows are not copied."""
    names = sessions.groupBy(*by, "login_name", "program_name").agg(F.count("*").alias("n"), F.min("query_start").alias("oldest"))
    users = names.groupBy(*by, "login_name").agg(total(F.col("n")).alias("n"), F.min("oldest").alias("oldest"))
    apps = names.groupBy(*by, "program_name").agg(F.lit(1).alias("one")).groupBy(*by).agg(F.count("program_name").alias("unique_apps"))
    counted = users.groupBy(*by).agg(
        total(F.col("n")).alias("connections"), F.count("login_name").alias("unique_users"), F.min("oldest").alias("oldest")
    )
    return counted.join(apps, list(by)).select(
        *by, "connections", "unique_users", "unique_apps", (F.unix_timestamp(at(as_of)) - F.unix_timestamp("oldest")).alias("max_duration_s")
    )


def recent_states(table: VersionedTable, as_of: datetime, days: int) -> DataFrame:
    """Stored day states of a window, by day."""
    return table.read().where(F.col(DAY) >= F.to_date(before(as_of, days=days)))
