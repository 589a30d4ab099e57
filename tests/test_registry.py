"""Every registered query against its SQL on the smallest test tables."""

import os
import re
import subprocess
import sys

import pytest

from fleetspan.registry import all_entries
from tests.compare import compare, duck

SF_DIR = "/root/testdata/sf0.001"
ENTRIES = all_entries()


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ENTRIES))
def test_query_matches_sql(spark, con, name):
    result = compare(spark, con, SF_DIR, ENTRIES[name])
    assert result["problem"] is None, result["problem"]


def test_every_query_has_sql():
    assert [n for n, e in ENTRIES.items() if e.sql is None] == []


def test_names_follow_the_inventory():
    pattern = re.compile(r"^([sapjwturc]\d\d|fx)_[a-z0-9_]+$")
    assert [n for n in ENTRIES if not pattern.match(n)] == []


def test_entry_point(spark):
    import __spark_entry__ as driver

    out = driver.entry(spark)
    assert out.count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("missing", ["corpus_pipeline", "fleetspan.llm", "xxhash"])
def test_other_queries_work_without_the_training_data_operators(missing):
    code = f"""
import sys
sys.modules[{missing!r}] = None  # as if it were not installed
import __spark_entry__ as driver
names = set(driver.queries())
assert "w04_current_waits" in names and not [n for n in names if n.startswith("op")], sorted(names)[:5]
"""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=repo, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr[-1500:]
