"""The newest capture of every server from a history in date folders, without reading the history.

Folders are probed from the newest backwards, twice as many each time, until every server of the
inventory has been met; the rows are then read from the folders in which newest captures lie. A server
that never reported makes the search go to the end, over two columns.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.operators.grouping import join_groups
from fleetspan.session import ensure_checkpoint_dir
from fleetspan.sources.landing import DATE_COL

PROBE = 1  # folders in the first step


def history_days(spark: SparkSession, path: str) -> list[date]:
    """The dated folders of a history, newest first."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    names = [s.getPath().getName() for s in root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)]
    dated = [n.split("=", 1)[1] for n in names if n.startswith(f"{DATE_COL}=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")]
    return sorted((datetime.strptime(d, "%Y-%m-%d").date() for d in dated), reverse=True)


def _folders(spark: SparkSession, path: str, days: Sequence[date]) -> DataFrame:
    return spark.read.option("basePath", path).parquet(*[f"{path}/{DATE_COL}={d.isoformat()}" for d in days])


def newest_captures(
    spark: SparkSession, path: str, inventory: DataFrame, by: Sequence[str] = ("server_name",), time_col: str = "capture_time"
) -> tuple[DataFrame, list[date]]:
    """(``by``, ``time_col`` of the newest capture, its day) of each key in ``inventory``, and the folders probed.

    A folder holds the rows of its date, so the newest folder in which a key occurs holds its newest
    capture. Keys that never occur are not returned; rows without a time are no capture.
    """
    ensure_checkpoint_dir(spark)
    wanted = inventory.select(*by).dropna().distinct().checkpoint()
    days, probed, step = history_days(spark, path), [], PROBE
    found, missing = None, wanted.count()
    while missing and len(probed) < len(days):
        part = days[len(probed) : len(probed) + step]
        here = _folders(spark, path, part).groupBy(*by).agg(F.max(time_col).alias(time_col))
        here = here.join(wanted, list(by), "left_semi").withColumn(DATE_COL, F.to_date(time_col)).checkpoint()
        found = here if found is None else found.unionByName(here)
        wanted = wanted.join(here, list(by), "left_anti").checkpoint()
        missing = wanted.count()
        probed += part
        step *= 2
    if found is None:
        found = wanted.limit(0).withColumns({time_col: F.lit(None).cast("timestamp_ntz"), DATE_COL: F.lit(None).cast("date")})
    return found, probed


def latest_rows(
    spark: SparkSession, path: str, inventory: DataFrame, by: Sequence[str] = ("server_name",), time_col: str = "capture_time"
) -> DataFrame:
    """All rows of the newest capture of each key in ``inventory``; ties are kept. The history must not be empty."""
    found, _ = newest_captures(spark, path, inventory, by, time_col)
    days = [r[0] for r in found.select(DATE_COL).distinct().collect()]  # folders, not rows
    if not days:
        return spark.read.parquet(path).limit(0)
    return join_groups(_folders(spark, path, days), found.drop(DATE_COL), [*by, time_col], "left_semi")
