"""Server log files as records: a message, its continuation lines and what the server adds to it.

A line without the prefix continues the line before it in the file. A prefixed line whose severity is
DETAIL, HINT, CONTEXT, QUERY or STATEMENT belongs to the last message of the same process; other
processes may have written in between. Files are read in splits, so both rules are applied within each
split first, and lines whose start lies in an earlier split are linked through one row per split. No
task holds more than a split, however large the file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fleetspan.operators.ingest import LOG_PREFIX

# Severities that add to a message.
ADDED = ["DETAIL", "HINT", "CONTEXT", "QUERY", "STATEMENT"]
SEVERITY = LOG_PREFIX + r"([A-Z0-9]+):\s+"


def read_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """file, block (where the split starts), place (order in the split), line."""
    text = spark.read.text(list(path) if not isinstance(path, str) else path)
    return text.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        F.col("value").alias("line"),
    )


def link_to_start(lines: DataFrame, scope: Sequence[str], starts: Column) -> DataFrame:
    """``lines`` with start_block and start_place: the last line before, or itself, in ``scope`` for which ``starts`` holds.

    ``lines`` has block and place. Both are null where no line of the scope starts anything before.
    """
    marked = lines.withColumn("start", F.when(starts, F.col("place")))
    so_far = W.partitionBy(*scope, "block").orderBy("place").rowsBetween(W.unboundedPreceding, W.currentRow)
    marked = marked.withColumn("start_place", F.last("start", ignorenulls=True).over(so_far))
    splits = marked.groupBy(*scope, "block").agg(F.max("start").alias("tail"))
    earlier = W.partitionBy(*scope).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    mark = F.when(F.col("tail").isNotNull(), F.struct(F.col("block").alias("b"), F.col("tail").alias("p")))
    splits = splits.select(*scope, "block", F.last(mark, ignorenulls=True).over(earlier).alias("before"))
    open_ = splits.where("before IS NOT NULL")
    joined = marked.join(open_, [*scope, "block"], "left")
    inside = F.col("start_place").isNotNull()
    return joined.withColumns(
        {"start_block": F.when(inside, F.col("block")).otherwise(F.col("before.b")), "start_place": F.coalesce("start_place", "before.p")}
    ).drop("start", "before")


def _in_order(text: Column) -> Column:
    """The texts of a record, one per line, in file order."""
    parts = F.array_sort(F.collect_list(F.struct("block", "place", text.alias("text"))))
    return F.array_join(F.transform(parts, lambda p: p["text"]), "\n")


def log_records(lines: DataFrame) -> DataFrame:
    """One row per message: file, block, place, pid, severity, line (with its continuation), added (what the server added, by line).

    Lines before the first prefix of a file and additions without a message before them are records of their own.
    """
    linked = link_to_start(lines, ["file"], F.col("line").rlike(LOG_PREFIX))
    own = F.col("start_place").isNull()
    linked = linked.withColumns({"at_block": F.when(own, F.col("block")).otherwise(F.col("start_block")), "at_place": F.when(own, F.col("place")).otherwise(F.col("start_place"))})
    whole = linked.groupBy("file", F.col("at_block").alias("b"), F.col("at_place").alias("p")).agg(_in_order(F.col("line")).alias("line"))
    part = lambda i: F.regexp_extract("line", SEVERITY, i)
    messages = whole.select("file", F.col("b").alias("block"), F.col("p").alias("place"), "line", F.nullif(part(2), F.lit("")).alias("pid"), F.nullif(part(5), F.lit("")).alias("severity"))
    adds = F.coalesce(F.col("severity").isin(ADDED), F.lit(False))
    linked = link_to_start(messages.where("pid IS NOT NULL"), ["file", "pid"], ~adds)
    alone = F.col("start_place").isNull()
    text = F.regexp_replace("line", SEVERITY, F.concat(F.col("severity"), F.lit(": ")))
    added = linked.where(adds & ~alone).select(
        "file", F.col("start_block").alias("b"), F.col("start_place").alias("p"), "block", "place", text.alias("text")
    )
    added = added.groupBy("file", F.col("b").alias("block"), F.col("p").alias("place")).agg(_in_order(F.col("text")).alias("added"))
    kept = linked.where(~adds | alone).select("file", "block", "place", "pid", "severity", "line")
    kept = kept.unionByName(messages.where("pid IS NULL"))
    return kept.join(added, ["file", "block", "place"], "left")
