"""Joining rows back to an aggregate of their own group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def join_groups(
    rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner", null_safe: bool = False
) -> DataFrame:
    """Join every row with the single row of its group; safe when one group holds a large share of the rows.

    ``groups`` is an aggregate over ``keys``. Joined on just those keys it would need
    no shuffle of its own, and the adaptive planner only splits a skewed side when
    both sides come straight out of a shuffle. A hash of the keys as an extra
    join key makes the (small) aggregate shuffle once more, so a hot group's rows
    are spread over as many tasks as their size asks for. Where the aggregate
    turns out below the broadcast threshold at run time, nothing is shuffled at all.

    ``null_safe`` treats NULL keys as a group, as a window would.
    """
    token = "group_token"
    marked = rows.withColumn(token, F.xxhash64(*keys))
    if not null_safe:
        return marked.join(groups.withColumn(token, F.xxhash64(*keys)), [token, *keys], how).drop(token)
    renamed = groups.withColumnsRenamed({k: f"group_{k}" for k in keys})
    renamed = renamed.withColumn("group_hash", F.xxhash64(*[f"group_{k}" for k in keys]))
    same = F.col(token) == F.col("group_hash")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"group_{k}"))
    return marked.join(renamed, same, how).drop(token, "group_hash", *[f"group_{k}" for k in keys])


def latest_snapshot(history: DataFrame, by: Sequence[str] = ("server_name",), time_col: str = "capture_time") -> DataFrame:
    """Rows of the newest capture per key (``by=()``: newest of all); ties are kept."""
    if not by:
        return history.where(F.col(time_col) == history.select(F.max(time_col)).scalar())
    newest = history.groupBy(*by).agg(F.max(time_col).alias(time_col))
    return join_groups(history, newest, [*by, time_col], "left_semi")


def newest_per_key(df: DataFrame, keys: Sequence[str], time_col: str) -> DataFrame:
    """The newest row of every key; of several the largest by the other columns.

    Spark keeps one row per key in every task before the shuffle, so a key with very many rows is no large group.
    """
    rest = [c for c in df.columns if c not in keys and c != time_col]
    order = W.partitionBy(*keys).orderBy(F.desc(time_col), *[F.desc(c) for c in rest])
    return df.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place").select(*keys, time_col, *rest)
