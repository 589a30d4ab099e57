"""One key holds a third of all rows: the join is split, results stay whole, and nothing depends on partition count."""

import pytest
from pyspark.sql import functions as F

from fleetspan.operators import joins, rankings
from fleetspan.registry import all_entries

SMALL_SPLITS = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
}


@pytest.fixture
def split_small(spark):
    before = {k: spark.conf.get(k, None) for k in SMALL_SPLITS}
    for k, v in SMALL_SPLITS.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture
def hot_history(split_small, tmp_path):
    spark = split_small
    n = F.col("id")
    rows = spark.range(0, 300000, 1, 8).select(
        F.when(n % 3 == 0, "srv0").otherwise(F.concat(F.lit("srv"), (n % 500).cast("string"))).alias("server_name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("capture_time"),
        n.cast("string").alias("wait_type"),
        (n + 1).alias("wait_time_ms"),
    )
    rows.write.parquet(str(tmp_path / "h"))
    return spark.read.parquet(str(tmp_path / "h"))


def final_plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("build", [rankings.share_per_snapshot, rankings.latest_snapshot])
def test_hot_group_is_split_and_whole(hot_history, build):
    df = build(hot_history)
    assert len(df.select("wait_type").collect()) == 300000
    df.collect()
    assert "skew=true" in final_plan(df)


def test_hot_blocker_is_split(split_small, tmp_path):
    spark = split_small
    n = F.col("id")
    spark.range(1, 200001, 1, 8).select(
        F.lit("srv0").alias("server_name"),
        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("capture_time"),
        n.alias("session_id"),
        F.when(n == 1, 0).when(n % 3 == 0, 1).otherwise(n - 1).cast("bigint").alias("blocking_session_id"),
        F.lit("l").alias("login_name"), F.lit("p").alias("program_name"), F.lit("running").alias("status"),
        F.lit("w").alias("wait_type"), n.alias("wait_time_ms"), F.repeat(F.lit("q"), 40).alias("query_text"),
    ).write.parquet(str(tmp_path / "s"))
    pairs = joins.blocking_pairs(spark.read.parquet(str(tmp_path / "s")))
    assert len(pairs.collect()) == 199999
    assert "skew=true" in final_plan(pairs)


@pytest.mark.parametrize("name", ["w04_current_waits", "a09_growth_projection", "j08_duplicate_indexes", "p38_setting_changes", "t01_top_queries"])
def test_partition_count_does_not_matter(spark, name):
    entry = all_entries()[name]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for width in ("1", "200"):
        spark.conf.set("spark.sql.shuffle.partitions", width)
        found.append(sorted(str(r) for r in entry.run(spark, "/root/testdata/sf0.001").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    assert found[0] == found[1]


def test_no_plan_needs_a_nested_loop(spark):
    """With broadcasts off, no registered batch query falls back to a product of its inputs or to Python."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    bad = []
    for name, entry in all_entries().items():
        if name.startswith(("r0", "j03")):
            continue
        plan = final_plan(entry.run(spark, "/root/testdata/sf0.001"))
        if any(node in plan for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython")):
            bad.append(name)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert bad == []
