"""Structured Streaming forms of the polled captures and checks.

Every job reads landed files, keeps its progress and state under the shared
folder, and writes parquet. A rerun after a lost executor or driver continues
from the checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspan.operators import joins, rows
from fleetspan.session import ensure_checkpoint_dir
from fleetspan.sources.landing import DATE_COL, append_new
from fleetspan.sources.versioned import VersionedTable


def snapshot_stream(
    spark: SparkSession,
    path: str,
    schema: StructType,
    glob: str | None = None,
    files_per_batch: int | None = None,
    bytes_per_batch: int = 8 << 30,
) -> DataFrame:
    """Landed parquet files as a stream, oldest first, in batches of at most so many files or bytes.

    A backlog is worked off in bounded batches, so a failure repeats one of them, not everything.
    """
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    else:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    return reader.parquet(path)


@contextmanager
def state_width(spark: SparkSession, partitions: int):
    """Number of state partitions for queries started inside.

    A query keeps the width of its first start for good, whatever cluster it starts on, so the number is
    always given: choose it for the state the query will hold at its largest.
    """
    key = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(key)
    spark.conf.set(key, str(partitions))
    try:
        yield
    finally:
        spark.conf.set(key, previous)


def run_append(
    stream: DataFrame, path: str, checkpoint: str, state_partitions: int, partition_by: str | None = None
) -> None:
    """Process what has landed, append to parquet, stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    with state_width(stream.sparkSession, state_partitions):
        writer.trigger(availableNow=True).start(path).awaitTermination()


def run_batches(
    stream: DataFrame,
    handle: Callable[[DataFrame, int], None],
    checkpoint: str,
    state_partitions: int,
    mode: str = "append",
) -> None:
    """Process what has landed batch by batch with a function, stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    with state_width(stream.sparkSession, state_partitions):
        writer.trigger(availableNow=True).start().awaitTermination()


def _event_time(col: str):
    """Watermarks and windows work on zoned timestamps (the session runs in UTC)."""
    return F.col(col).cast("timestamp")


def ingest_batches(
    path: str, capture: Callable[[DataFrame], DataFrame], keys: list[str], time_col: str
) -> Callable[[DataFrame, int], None]:
    """Batch handler for a capture: normalise, then append what is not stored yet under the same natural key.

    Rows are compared with the stored history itself, in the date folders that the batch touches. There is no
    watermark: however late a server delivers, its rows are kept, and a repeated batch adds nothing.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(df.sparkSession)
        append_new(df.sparkSession, capture(df), path, keys, time_col)

    return handle


def wait_windows(samples: DataFrame, width: str = "15 minutes", delay: str = "10 minutes") -> DataFrame:
    """Waits per server, type and tumbling window; samples later than the delay are dropped."""
    return (
        samples.withColumn("event_time", _event_time("capture_time"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", width).alias("w"), "server_name", "wait_type")
        .agg(
            F.sum("wait_time_ms").cast("bigint").alias("wait_time_ms"),
            F.sum("waiting_tasks").cast("bigint").alias("waiting_tasks"),
        )
        .select(
            "server_name",
            "wait_type",
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "wait_time_ms",
            "waiting_tasks",
        )
    )


def failed_login_windows(
    audit: DataFrame, width: str = "1 hour", slide: str = "5 minutes", min_attempts: int = 5, delay: str = "10 minutes"
) -> DataFrame:
    """Logins with repeated failures in a sliding window.

    Failures are first counted per slide-wide pane, so each pane (not each event)
    is copied into the windows that cover it.
    """
    panes = (
        audit.where(F.col("event_type") == "FAILED_LOGIN")
        .withColumn("event_time", _event_time("login_time"))
        .withWatermark("event_time", delay)
        .groupBy(F.window("event_time", slide).alias("pane"), "login_name")
        .agg(F.count("*").alias("attempts"))
    )
    return (
        panes.groupBy(F.window("pane", width, slide).alias("w"), "login_name")
        .agg(F.sum("attempts").cast("bigint").alias("failed_attempts"))
        .where(F.col("failed_attempts") >= min_attempts)
        .select(
            "login_name",
            F.col("w.start").cast("timestamp_ntz").alias("window_start"),
            F.col("w.end").cast("timestamp_ntz").alias("window_end"),
            "failed_attempts",
        )
    )


_MEMBERS = "server_name string, principal string, snapshot_time timestamp_ntz, compared boolean"


def membership_batches(path: str, complete: bool = False) -> Callable[[DataFrame, int], None]:
    """Batch handler: ADDED / REMOVED per (server, principal) from full snapshots (server_name, principal, snapshot_time).

    Each snapshot is compared with the one before it of the same server, so a server that misses a day or
    delivers late changes nothing for itself or others. A server's newest snapshot may still be arriving, in
    several files: it waits until a newer one lands, or until a call with ``complete``. Rows of a snapshot older than
    the last one compared go to ``path``/late. ``path``/changes holds the result, ``path``/state per batch the last
    compared and the waiting snapshots; a repeated batch replaces its own folders. A server's first
    snapshot adds all its principals.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        ensure_checkpoint_dir(spark)
        before = spark.read.schema(_MEMBERS).parquet(f"{path}/state/batch_id={batch_id - 1}") if batch_id else spark.createDataFrame([], _MEMBERS)
        landed = df.select("server_name", "principal", F.col("snapshot_time").cast("timestamp_ntz")).withColumn("compared", F.lit(False))
        done = before.where("compared").select("server_name", F.col("snapshot_time").alias("done_time")).distinct()
        fresh = landed.join(done, "server_name", "left")
        behind = F.coalesce(F.col("snapshot_time") <= F.col("done_time"), F.lit(False))
        fresh.where(behind).select("server_name", "principal", "snapshot_time").write.mode("overwrite").parquet(f"{path}/late/batch_id={batch_id}")
        rows_ = before.unionByName(fresh.where(~behind).drop("done_time")).distinct().checkpoint()
        times = rows_.select("server_name", "snapshot_time", "compared").distinct()
        order = W.partitionBy("server_name").orderBy("snapshot_time")
        times = times.select(
            "server_name", "snapshot_time", "compared",
            F.lag("snapshot_time").over(order).alias("prev_time"), F.lead("snapshot_time").over(order).alias("next_time"),
        ).checkpoint()
        ready = times.where(~F.col("compared")) if complete else times.where(~F.col("compared") & F.col("next_time").isNotNull())
        now = rows_.select("server_name", "principal", "snapshot_time")
        steps = ready.select("server_name", "snapshot_time", "prev_time")
        at_prev = now.withColumnRenamed("snapshot_time", "prev_time")
        added = now.join(steps, ["server_name", "snapshot_time"]).join(at_prev, ["server_name", "prev_time", "principal"], "left_anti")
        gone = at_prev.join(steps, ["server_name", "prev_time"]).join(now, ["server_name", "snapshot_time", "principal"], "left_anti")
        change = ["server_name", "principal", F.col("snapshot_time").alias("change_time")]
        changes = added.select(*change, F.lit("ADDED").alias("action_type")).unionByName(
            gone.select(*change, F.lit("REMOVED").alias("action_type"))
        )
        changes.write.mode("overwrite").parquet(f"{path}/changes/batch_id={batch_id}")
        last = times.where("compared").unionByName(ready).groupBy("server_name").agg(F.max("snapshot_time").alias("last_time"))
        kept = rows_.drop("compared").join(last, "server_name", "left").where(
            F.col("last_time").isNull() | (F.col("snapshot_time") >= F.col("last_time"))
        )
        kept.select(
            "server_name", "principal", "snapshot_time", F.coalesce(F.col("snapshot_time") == F.col("last_time"), F.lit(False)).alias("compared")
        ).write.mode("overwrite").parquet(f"{path}/state/batch_id={batch_id}")

    return handle


def alert_state(alerts: DataFrame) -> DataFrame:
    """Trigger count and last trigger per alert; as many rows of state as there are alerts."""
    return alerts.groupBy("alert_name").agg(
        F.count("*").alias("trigger_count"), F.max("trigger_time").alias("last_triggered")
    )


def _run_name(df: DataFrame) -> str:
    """The streaming query a batch belongs to: batch numbers count within it."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def replace_table(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """Batch handler that puts the newest complete result in place of the last; see ``read_newest``.

    A reader never meets a half-written table, repeating a batch is harmless, and versions before the
    last ``keep`` are removed.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        table = VersionedTable(df.sparkSession, path)
        table.replace(df, job=(_run_name(df), batch_id))
        table.clean(keep)

    return handle


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table written by ``replace_table``."""
    return VersionedTable(spark, path).read()


def blocking_stream(sessions: DataFrame, delay: str = "10 minutes", min_wait_ms: int = 30000) -> DataFrame:
    """Blocked sessions with their blocker, out of a stream of session captures in any number of files.

    Blocked rows and possible blockers meet as a stream-to-stream join on (server, capture, session).
    A capture's rows wait for each other until the watermark, the newest capture less ``delay``, has
    passed it, so state holds the open captures only and a batch reads nothing but its own files.
    """
    timed = sessions.withColumn("capture_time", _event_time("capture_time")).withWatermark("capture_time", delay)
    pairs = joins.blocking_pairs(timed, min_wait_ms=min_wait_ms)
    return pairs.withColumn("capture_time", F.col("capture_time").cast("timestamp_ntz"))


def ingest_unique(
    raw: DataFrame, capture: Callable[[DataFrame], DataFrame], keys: list[str], time_col: str, window: str, arrival: Column | None = None
) -> DataFrame:
    """A capture as a stream without repeated rows, as far as bounded state can tell.

    Rows that share the natural key are one row delivered several times. The watermark runs on the time of
    ``arrival`` (default: when the batch is read), not of capture, so no row is too late to be kept; keys are
    remembered for ``window`` after their arrival. A row that comes again later than that is older than
    ``window`` by its capture time: such rows have ``needs_merge`` set and have to be compared with the history.
    """
    when = F.current_timestamp() if arrival is None else arrival.cast("timestamp")
    seen = capture(raw).withColumn("arrived", when).withWatermark("arrived", window).dropDuplicatesWithinWatermark(keys)
    old = _event_time(time_col) < F.col("arrived") - F.expr(f"INTERVAL {window}")
    return seen.withColumn("needs_merge", F.coalesce(old, F.lit(True))).drop("arrived")


def unique_batches(path: str, time_col: str) -> Callable[[DataFrame, int], None]:
    """Batch handler for ``ingest_unique``: rows of their own go to the history, others to a side table until ``merge_late``.

    Both are versioned tables; a batch that is repeated after a failure adds nothing.
    """

    def handle(df: DataFrame, batch_id: int) -> None:
        ensure_checkpoint_dir(df.sparkSession)
        job = (_run_name(df), batch_id)
        rows_ = df.withColumn(DATE_COL, F.to_date(time_col)).persist()
        VersionedTable(df.sparkSession, f"{path}/history").append(rows_.where("NOT needs_merge").drop("needs_merge"), [DATE_COL], job)
        VersionedTable(df.sparkSession, f"{path}/late").append(rows_.where("needs_merge").drop("needs_merge"), [DATE_COL], job)
        rows_.unpersist()

    return handle


def merge_late(spark: SparkSession, path: str, keys: list[str]) -> int:
    """Move the rows of the side table that the history lacks into it, and empty the side table; returns how many moved.

    Only the days that late rows fall into are compared. If it fails between the two tables, the next run
    finds the rows stored and adds nothing.
    """
    ensure_checkpoint_dir(spark)
    history, late = VersionedTable(spark, f"{path}/history"), VersionedTable(spark, f"{path}/late")
    if not late.versions():
        return 0
    fresh = late.read().dropDuplicates(keys).checkpoint()
    days = [r[0] for r in fresh.select(DATE_COL).distinct().collect()]  # days, not rows
    if not days:
        return 0
    stored = history.read().where(F.col(DATE_COL).isin([d for d in days if d is not None]) | F.col(DATE_COL).isNull())
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"known_{k}"))
    new = fresh.join(stored.select(*[F.col(k).alias(f"known_{k}") for k in keys]), same, "left_anti").checkpoint()
    moved = new.count()
    if moved:
        history.append(new, [DATE_COL])
    late.replace(fresh.limit(0), [DATE_COL])
    return moved


def classify_log_stream(lines: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Error-log typing and severity on a stream; the batch operator is stateless and used as it is."""
    return rows.classify_log(lines, as_of, days)
