"""Versioned tables: whole or unseen, two writers, repeated batches, compaction and cleaning."""

import os
import time
from datetime import datetime

import pytest

from fleetspan.sources.versioned import Conflict, VersionedTable

SCHEMA = "k long, capture_time timestamp_ntz, n long"
DAY = [datetime(2024, 1, d) for d in range(1, 29)]


def rows(spark, data):
    return spark.createDataFrame([(k, DAY[d], n) for k, d, n in data], SCHEMA)


def content(table, **kw):
    return sorted((r.k, r.n) for r in table.read(**kw).collect())


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"))


def test_append_replace_compact(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.append(rows(spark, [(1, 1, 1)])) == 1
    assert table.append(rows(spark, [(2, 1, 2)]), job=("q", 0)) == 2
    assert table.append(rows(spark, [(2, 1, 2)]), job=("q", 0)) == 2  # the batch is stored
    assert content(table) == [(1, 1), (2, 2)] and content(table, version=1) == [(1, 1)]
    assert table.compact() == 3 and len(table.manifest()["parts"]) == 1 and content(table) == [(1, 1), (2, 2)]
    assert table.compact() == 3
    assert table.replace(rows(spark, [(5, 1, 5)])) == 4
    assert content(table) == [(5, 5)]
    assert table.replace(rows(spark, [])) == 5
    assert content(table) == [] and table.read().schema == rows(spark, []).schema


def test_upsert_writes_touched_buckets_only(spark, table):
    table.upsert(rows(spark, [(i, 1, i) for i in range(40)]), ["k"], 8, "capture_time")
    before = table.manifest()["parts"]
    changed = rows(spark, [(3, 2, 300), (3, 0, 7), (99, 1, 9), (3, 2, 299)])
    for _ in range(2):
        table.upsert(changed, ["k"], 8, "capture_time")
        assert content(table) == sorted({**{i: i for i in range(40)}, 3: 300, 99: 9}.items())
    after = table.manifest()["parts"]
    assert sum(before[p] != after.get(p) for p in before) <= 2 and before.keys() <= after.keys()
    table.upsert(rows(spark, [(3, 1, -1)]), ["k"], 8, "capture_time")  # older than what is stored
    assert (3, 300) in content(table)
    with pytest.raises(ValueError):
        table.upsert(changed, ["k"], 16, "capture_time")


def test_a_key_with_most_rows_and_missing_keys(spark, table):
    data = [(7, d % 28, d) for d in range(2000)] + [(None, 1, 1), (None, 2, 2)]
    table.upsert(rows(spark, data).repartition(8), ["k"], 4, "capture_time")
    assert {(r.k, r.n) for r in table.read().collect()} == {(7, max(d for d in range(2000) if d % 28 == 27)), (None, 2)}


def test_a_writer_that_dies_leaves_the_old_version(spark, table, monkeypatch):
    table.upsert(rows(spark, [(i, 1, i) for i in range(10)]), ["k"], 4, "capture_time")
    want = content(table)
    for dies_at in ("_segment", "_put"):
        with monkeypatch.context() as m:
            real = getattr(VersionedTable, dies_at)

            def broken(self, *args, real=real, dies_at=dies_at):
                if dies_at == "_segment":
                    real(self, *args)  # files are written, the version is not
                raise RuntimeError("killed")

            m.setattr(VersionedTable, dies_at, broken)
            with pytest.raises(RuntimeError):
                table.upsert(rows(spark, [(1, 5, 100)]), ["k"], 4, "capture_time")
        assert content(table) == want and table.versions() == [1]
    table.upsert(rows(spark, [(1, 5, 100)]), ["k"], 4, "capture_time")
    assert (1, 100) in content(table)


def test_two_writers(spark, table, monkeypatch):
    """The second commits while the first has written its files and not yet its version."""
    table.upsert(rows(spark, [(i, 1, i) for i in range(20)]), ["k"], 8, "capture_time")
    other = VersionedTable(spark, table.path)
    real = VersionedTable._commit

    def between(work):
        def commit(self, *args):
            monkeypatch.setattr(VersionedTable, "_commit", real)
            work()
            return real(self, *args)

        monkeypatch.setattr(VersionedTable, "_commit", commit)

    bucket = lambda k: {r.b for r in rows(spark, [(k, 1, 1)]).selectExpr("pmod(xxhash64(k), 8) AS b").collect()}.pop()
    apart = next(k for k in range(1, 20) if bucket(k) != bucket(0))
    between(lambda: other.upsert(rows(spark, [(apart, 3, 111)]), ["k"], 8, "capture_time"))
    table.upsert(rows(spark, [(0, 3, 222)]), ["k"], 8, "capture_time")
    assert {(0, 222), (apart, 111)} <= set(content(table)) and len(content(table)) == 20

    between(lambda: other.upsert(rows(spark, [(0, 4, 333)]), ["k"], 8, "capture_time"))
    with pytest.raises(Conflict):
        table.upsert(rows(spark, [(0, 5, 444)]), ["k"], 8, "capture_time")
    assert (0, 333) in content(table)

    between(lambda: other.upsert(rows(spark, [(0, 6, 555)]), ["k"], 8, "capture_time"))
    with pytest.raises(Conflict):
        table.replace(rows(spark, [(1, 1, 1)]))


def test_appends_meanwhile_are_kept(spark, table, monkeypatch):
    table.append(rows(spark, [(1, 1, 1)]))
    table.append(rows(spark, [(2, 1, 2)]))
    real = VersionedTable._commit

    def commit(self, *args):
        monkeypatch.setattr(VersionedTable, "_commit", real)
        VersionedTable(spark, table.path).append(rows(spark, [(3, 1, 3)]))
        return real(self, *args)

    monkeypatch.setattr(VersionedTable, "_commit", commit)
    table.compact()
    assert content(table) == [(1, 1), (2, 2), (3, 3)] and len(table.manifest()["parts"]) == 2


def test_a_version_is_created_once(spark, table):
    table.append(rows(spark, [(1, 1, 1)]))
    assert table._put("{}", table._manifest_path(1)) is False
    assert table.manifest()["version"] == 1
    assert not [f for f in os.listdir(f"{table.path}/versions") if f.endswith("draft")]


def test_replace_parts(spark, table):
    table.replace_parts(rows(spark, [(1, 1, 1), (2, 1, 2), (3, 2, 3)]).selectExpr("*", "to_date(capture_time) AS day"), "day")
    table.replace_parts(rows(spark, [(4, 1, 4), (5, 3, 5)]).selectExpr("*", "to_date(capture_time) AS day"), "day")
    assert content(table) == [(3, 3), (4, 4), (5, 5)]
    assert dict(table.read().dtypes)["day"] == "date"


def test_clean_removes_what_no_kept_version_names(spark, table):
    table.upsert(rows(spark, [(i, 1, i) for i in range(20)]), ["k"], 4, "capture_time")
    for n in range(3):
        table.upsert(rows(spark, [(0, n + 2, n)]), ["k"], 4, "capture_time")
    table._segment(rows(spark, [(9, 9, 9)]))  # left over by a writer that died
    time.sleep(0.01)
    files = lambda: sum(len(f) for _, _, f in os.walk(f"{table.path}/data"))
    before, want = files(), content(table)
    young = int(time.time() * 1000) + 60_000
    assert table.clean(keep=2, changed_before_ms=0) == 0
    assert table.clean(keep=2, changed_before_ms=young) > 0
    assert table.versions() == [3, 4] and files() < before
    assert content(table) == want and len(content(table, version=3)) == 20
    assert table.clean(keep=2, changed_before_ms=young) == 0
