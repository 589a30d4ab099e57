from datetime import datetime

import pytest

from fleetspan.operators import aggregates
from fleetspan.sources import schemas


def test_platform_names_map_into_one_schema(spark):
    landed = spark.createDataFrame(
        [(datetime(2024, 1, 30), "Lock:tuple", 3, 40, 5)],
        "sample_time timestamp_ntz, event_name string, wait_count int, time_waited_ms int, extra int",
    )
    out = schemas.to_canonical(landed, "waits", "oracle", server="ora1")
    assert dict(out.dtypes) == schemas.SCHEMAS["waits"]
    assert out.first().asDict() == {
        "server_name": "ora1", "capture_time": datetime(2024, 1, 30), "wait_type": "Lock:tuple", "wait_time_ms": 40,
        "signal_wait_ms": None, "waiting_tasks": 3,
    }


@pytest.mark.parametrize("key", sorted(schemas.COLUMN_NAMES))
def test_every_mapping_targets_its_schema(key):
    family, _ = key
    assert set(schemas.COLUMN_NAMES[key].values()) <= set(schemas.SCHEMAS[family])


def test_units_are_converted(spark):
    landed = spark.createDataFrame([(datetime(2024, 1, 30), "q1", 2500000, 3)], "sample_time timestamp_ntz, sql_id string, elapsed_time_ns long, executions long")
    row = schemas.to_canonical(landed, "queries", "oracle", server="ora1").first()
    assert (row.query_hash, row.total_elapsed_ms, row.exec_count) == ("q1", 2, 3)


def test_landed_families_feed_the_operators(spark, tmp_path):
    rows = [("s", "db", "D", datetime(2024, 1, 30, 1), datetime(2024, 1, 30, 2), 10, "Success")]
    spark.createDataFrame(rows, schemas.ddl("backups")).write.parquet(str(tmp_path / "b"))
    backups = schemas.read_landed(spark, str(tmp_path / "b"), "backups")
    assert backups.first().duration_s == 3600
    assert aggregates.backup_status(backups, datetime(2024, 1, 31)).first().backup_status == "WARNING"
    sizes = spark.createDataFrame([("s", "db", datetime(2024, 1, 30), 10, None, 4, 6)], schemas.ddl("sizes"))
    assert schemas.with_derived(sizes, "sizes").first().total_mb == 10
