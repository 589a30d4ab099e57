"""Streaming queries (R01-R07): each drains the landed files once and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetspan.registry import Entry, with_views
from fleetspan.registry.joins import SQL_PAIR
from fleetspan.registry.rows import sql_classified
from fleetspan.session import scratch_path
from fleetspan.sources.landing import DATE_COL
from fleetspan.sources.versioned import VersionedTable
from fleetspan.sources.views import AS_OF, VIEWS, zone_free
from fleetspan.streaming import jobs, membership

STATE_PARTITIONS = 8  # enough for the state of the test tables


def landed(t, table: str):
    """A test table as a stream of files."""
    return jobs.snapshot_stream(t.spark, t.sf_dir, t.table(table).schema, glob=f"{table}.parquet")


def view_stream(t, view: str, table: str):
    """A row-wise view over a streamed table."""
    return zone_free(t.spark.sql(VIEWS[view], **{table: landed(t, table)}))


def wait_samples(t):
    """One wait sample per event."""
    return landed(t, "events").select(
        "event_id",
        F.concat(F.lit("srv"), (F.col("user_id") % 5).cast("string")).alias("server_name"),
        F.col("ts").alias("capture_time"),
        F.when(F.col("event_type") == "error", "LCK_M_X")
        .when(F.col("event_type") == "click", "PAGEIOLATCH_SH")
        .when(F.col("event_type") == "view", "PAGELATCH_EX")
        .when(F.col("event_type") == "signup", "ASYNC_NETWORK_IO")
        .otherwise("CXPACKET")
        .alias("wait_type"),
        F.round(F.col("value") * 100).cast("bigint").alias("wait_time_ms"),
        F.lit(1).cast("bigint").alias("waiting_tasks"),
    )


SQL_SAMPLES = """samples AS (SELECT event_id, 'srv' || (user_id % 5) AS server_name, ts AS capture_time,
        CASE event_type WHEN 'error' THEN 'LCK_M_X' WHEN 'click' THEN 'PAGEIOLATCH_SH' WHEN 'view' THEN 'PAGELATCH_EX'
             WHEN 'signup' THEN 'ASYNC_NETWORK_IO' ELSE 'CXPACKET' END AS wait_type,
        CAST(round(value * 100) AS BIGINT) AS wait_time_ms, CAST(1 AS BIGINT) AS waiting_tasks FROM events)"""


def _drain(t, stream, label, **kw):
    out = scratch_path(t.spark, label)
    jobs.run_append(stream, out, scratch_path(t.spark, f"{label}-progress"), STATE_PARTITIONS, **kw)
    return t.spark.read.parquet(out)


def _ingest(t):
    samples = wait_samples(t)
    doubled = samples.union(samples)  # the same landed rows delivered twice
    out = scratch_path(t.spark, "stream-ingest")
    handle = jobs.ingest_batches(
        out, lambda raw: raw.where((F.col("wait_time_ms") > 0) & (F.col("waiting_tasks") > 0)), ["event_id", "server_name", "wait_type"], "capture_time"
    )
    jobs.run_batches(doubled, handle, scratch_path(t.spark, "ingest-progress"), STATE_PARTITIONS)
    return t.spark.read.parquet(out).drop("capture_date")


def snapshots_of(t):
    """Each day's active users of a server as its membership snapshot."""
    return landed(t, "events").select(
        F.concat(F.lit("srv"), (F.col("user_id") % 5).cast("string")).alias("server_name"),
        F.concat(F.lit("login"), F.col("user_id").cast("string")).alias("principal"),
        F.date_trunc("day", "ts").alias("snapshot_time"),
    )


def _unique(t):
    """The same landed rows delivered twice; purchases are reported four days after they happened."""
    samples = wait_samples(t)
    doubled = samples.union(samples)
    arrival = F.col("capture_time") + F.when(F.col("wait_type") == "CXPACKET", F.expr("INTERVAL 4 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    keys = ["event_id", "server_name", "wait_type"]
    seen = jobs.ingest_unique(doubled, lambda raw: raw.where((F.col("wait_time_ms") > 0) & (F.col("waiting_tasks") > 0)), keys, "capture_time", "2 DAYS", arrival)
    out = scratch_path(t.spark, "stream-unique")
    jobs.run_batches(seen, jobs.unique_batches(out, "capture_time"), scratch_path(t.spark, "unique-progress"), STATE_PARTITIONS)
    jobs.merge_late(t.spark, out, keys)
    return VersionedTable(t.spark, f"{out}/history").read().drop(DATE_COL)


def _membership_state(t):
    with membership.rocksdb_state(t.spark):
        return _drain(t, membership.membership_changes(snapshots_of(t), delay="36 hours"), "membership-state")


def _membership(t):
    snapshots = snapshots_of(t)
    out = scratch_path(t.spark, "membership")
    jobs.run_batches(snapshots, jobs.membership_batches(out, complete=True), scratch_path(t.spark, "membership-progress"), STATE_PARTITIONS)
    return t.spark.read.parquet(f"{out}/changes").drop("batch_id")


def _alert_state(t):
    alerts = view_stream(t, "login_audit", "events").where(F.col("event_type") == "FAILED_LOGIN").select(
        F.concat(F.lit("Failed Logins "), "login_name").alias("alert_name"), F.col("login_time").alias("trigger_time")
    )
    out = scratch_path(t.spark, "alert-state")
    jobs.run_batches(jobs.alert_state(alerts), jobs.replace_table(out), scratch_path(t.spark, "alert-progress"), STATE_PARTITIONS, mode="complete")
    return jobs.read_newest(t.spark, out)


def _blocking(t):
    return _drain(t, jobs.blocking_stream(view_stream(t, "session_requests", "customer"), min_wait_ms=3000), "blocking")


SQL_SNAPSHOTS = """s AS (SELECT DISTINCT 'srv' || (user_id % 5) AS server_name, 'login' || user_id AS principal, date_trunc('day', ts) AS d FROM events),
        days AS (SELECT server_name, d, lag(d) OVER w AS prev_d, lead(d) OVER w AS next_d FROM (SELECT DISTINCT server_name, d FROM s) x
                 WINDOW w AS (PARTITION BY server_name ORDER BY d)),
        changes AS (SELECT s.server_name, s.principal, CAST(s.d AS TIMESTAMP) AS change_time, 'ADDED' AS action_type FROM s JOIN days y ON y.server_name = s.server_name AND y.d = s.d
        WHERE NOT EXISTS (SELECT 1 FROM s p WHERE p.server_name = s.server_name AND p.principal = s.principal AND p.d = y.prev_d)
        UNION ALL
        SELECT s.server_name, s.principal, CAST(y.next_d AS TIMESTAMP), 'REMOVED' FROM s JOIN days y ON y.server_name = s.server_name AND y.d = s.d
        WHERE y.next_d IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.server_name = s.server_name AND p.principal = s.principal AND p.d = y.next_d))"""

ENTRIES = {
    "r01_stream_ingest": Entry(_ingest, f"WITH {SQL_SAMPLES} SELECT * FROM samples WHERE wait_time_ms > 0"),
    "r01_stream_unique": Entry(_unique, f"WITH {SQL_SAMPLES} SELECT * FROM samples WHERE wait_time_ms > 0"),
    "r02_stream_wait_windows": Entry(
        lambda t: _drain(t, jobs.wait_windows(wait_samples(t)), "wait-windows"),
        f"""WITH {SQL_SAMPLES},
        w AS (SELECT server_name, wait_type, time_bucket(INTERVAL '15' MINUTE, capture_time) AS window_start,
                     CAST(sum(wait_time_ms) AS BIGINT) AS wait_time_ms, CAST(sum(waiting_tasks) AS BIGINT) AS waiting_tasks FROM samples GROUP BY 1, 2, 3)
        SELECT server_name, wait_type, window_start, window_start + INTERVAL '15' MINUTE AS window_end, wait_time_ms, waiting_tasks FROM w
        WHERE window_start + INTERVAL '15' MINUTE <= (SELECT max(capture_time) - INTERVAL '10' MINUTE FROM samples)""",
    ),
    "r03_stream_failed_logins": Entry(
        lambda t: _drain(t, jobs.failed_login_windows(view_stream(t, "login_audit", "events"), width="6 hours", slide="30 minutes", min_attempts=3), "failed-windows"),
        with_views("""WITH p AS (SELECT login_name, time_bucket(INTERVAL '30' MINUTE, login_time) AS pane FROM login_audit WHERE event_type = 'FAILED_LOGIN'),
        x AS (SELECT login_name, unnest(generate_series(pane - INTERVAL '330' MINUTE, pane, INTERVAL '30' MINUTE)) AS window_start FROM p),
        w AS (SELECT login_name, window_start, window_start + INTERVAL '6' HOUR AS window_end, CAST(count(*) AS BIGINT) AS failed_attempts FROM x GROUP BY 1, 2)
        SELECT * FROM w WHERE failed_attempts >= 3
          AND window_end <= (SELECT max(login_time) - INTERVAL '10' MINUTE FROM login_audit WHERE event_type = 'FAILED_LOGIN')"""),
    ),
    "r04_stream_membership_changes": Entry(
        _membership, f"WITH {SQL_SNAPSHOTS} SELECT * FROM changes"
    ),
    "r04_membership_state": Entry(
        _membership_state,
        f"""WITH {SQL_SNAPSHOTS}
        SELECT * FROM changes WHERE change_time <= (SELECT max(d) - INTERVAL '36' HOUR FROM s)""",
    ),
    "r05_stream_alert_state": Entry(
        _alert_state,
        with_views("""
        SELECT 'Failed Logins ' || login_name AS alert_name, CAST(count(*) AS BIGINT) AS trigger_count, max(login_time) AS last_triggered
        FROM login_audit WHERE event_type = 'FAILED_LOGIN' GROUP BY 1"""),
    ),
    "r06_stream_blocking": Entry(_blocking, with_views(SQL_PAIR.format(how="", floor=3000))),
    "r07_stream_log_classify": Entry(
        lambda t: _drain(t, jobs.classify_log_stream(view_stream(t, "error_log", "events"), AS_OF, days=10), "log-stream"),
        with_views(sql_classified(10)),
    ),
}
