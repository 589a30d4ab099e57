"""History tables on shared storage: parquet partitioned by capture date."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetspan.functions.expr import at

DATE_COL = "capture_date"


def append_history(df: DataFrame, path: str, time_col: str = "capture_time") -> None:
    """Append rows under ``capture_date=...`` folders.

    The rebalance hint groups rows by date and lets the adaptive planner split a
    busy day over many tasks and merge quiet ones, so files come out at the advisory size.
    """
    dated = df.withColumn(DATE_COL, F.to_date(time_col))
    dated.hint("rebalance", F.col(DATE_COL)).write.mode("append").partitionBy(DATE_COL).parquet(path)


def append_new(spark: SparkSession, df: DataFrame, path: str, keys: Sequence[str], time_col: str = "capture_time") -> None:
    """Append the rows whose natural key (``keys``) is not stored yet, one per key; a repeated append changes nothing.

    Only the date folders that the rows fall into are read for the comparison, so late rows are stored
    like any others. Rows that share a key are expected to be the same row delivered twice.
    """
    fresh = df.withColumn(DATE_COL, F.to_date(time_col)).dropDuplicates(list(keys)).checkpoint()
    days = [r[DATE_COL] for r in fresh.select(DATE_COL).distinct().collect()]  # the days of one batch
    try:
        known = spark.read.parquet(path).where(F.col(DATE_COL).isin([d for d in days if d is not None]) | F.col(DATE_COL).isNull())
        known = known.select(*[F.col(k).alias(f"known_{k}") for k in keys])
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"known_{k}"))
        fresh = fresh.join(known, same, "left_anti")
    except AnalysisException:
        pass  # nothing is stored yet
    fresh.hint("rebalance", F.col(DATE_COL)).write.mode("append").partitionBy(DATE_COL).parquet(path)


def read_history(
    spark: SparkSession,
    path: str,
    schema: StructType | None = None,
    time_col: str = "capture_time",
    since: datetime | None = None,
    until: datetime | None = None,
) -> DataFrame:
    """Read a history. A time range prunes date folders first, then rows inside them."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(path)
    if since is not None:
        df = df.where((F.col(DATE_COL) >= F.lit(since.date())) & (F.col(time_col) >= at(since)))
    if until is not None:
        df = df.where((F.col(DATE_COL) <= F.lit(until.date())) & (F.col(time_col) < at(until)))
    return df


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text log files as one ``line`` column."""
    return spark.read.text(path).withColumnRenamed("value", "line")


def write_report(report: DataFrame, path: str, server: str, as_of: datetime) -> None:
    """Append a generated report, stamped with its server and time."""
    report.withColumns({"report_server": F.lit(server), "report_time": at(as_of)}).write.mode("append").parquet(path)


def purge_history(
    spark: SparkSession, path: str, as_of: datetime, retention_days: int = 30, time_col: str = "capture_time"
) -> int:
    """Apply retention to a stored history and return the number of rows removed.

    Whole expired date folders are dropped without reading them for the rewrite;
    only the one day the cutoff falls in is rewritten.
    """
    cutoff = as_of - timedelta(days=retention_days)
    history = spark.read.parquet(path)
    removed = history.where((F.col(DATE_COL) <= F.lit(cutoff.date())) & (F.col(time_col) < at(cutoff))).count()

    edge = history.where(F.col(DATE_COL) == F.lit(cutoff.date()))
    kept = edge.where(F.col(time_col) >= at(cutoff))
    edge_is_gone = kept.isEmpty()
    if not edge_is_gone:
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(DATE_COL).parquet(path)

    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        if not name.startswith(f"{DATE_COL}=") or name.endswith("__HIVE_DEFAULT_PARTITION__"):
            continue  # rows without a time have no age: they stay
        day = datetime.strptime(name.split("=", 1)[1], "%Y-%m-%d").date()
        if day < cutoff.date() or (day == cutoff.date() and edge_is_gone):
            fs.delete(status.getPath(), True)
    spark.catalog.refreshByPath(path)
    return removed
