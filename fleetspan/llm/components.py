"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Each step is one min per node and one join back to it. The links of a node with very many
neighbours are combined on the map side for the min, and the join is a plain shuffled one that
the adaptive skew join can split, so a hub is no single task. Every round is cut with
``checkpoint()`` in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import narrow
from fleetspan.session import ensure_checkpoint_dir

MAX_ROUNDS = 200


def connected_components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """``edges`` has columns a, b of one orderable type, and at most ``rows`` rows if given. Returns node, component (smallest node).

    Edges with a null end and self-links are ignored; nodes without other links are not returned.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    now = edges.select("a", "b").where("a <> b")
    now = now.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = (now if rows is None else narrow(now, rows)).checkpoint()
    mark = _mark(now)
    if mark[0] == 0:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    most = 2 * mark[0]  # a step makes no more links than there are, and one per node
    now = narrow(now, most)
    for _ in range(MAX_ROUNDS):
        now = narrow(_small_star(_large_star(now, most), most), most).checkpoint()
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.withColumn("component", F.col("node"))
    )


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Link every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("low"))
    least = least.select("u", F.least("u", "low").alias("m"))
    moved = both.where("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return narrow(narrow(moved, most).distinct(), most)


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    moved = edges.join(least, F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return narrow(moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))), most).distinct()
