"""Membership changes with keyed state: what a server's snapshot adds and removes against its last one.

Rows (server_name, principal, snapshot_time) of full snapshots arrive in any number of files. State is kept
per server and slot, a slot being a share of the principals by hash, so that a server with very many
principals is many groups. Each holds the members of the last snapshot and those of the snapshots
still open. An event-time timer closes a snapshot when the watermark passes it; a further one drops the state of a
server that has been silent for ``retire_after``. The state is in RocksDB; it is as large as the live
principals plus the open snapshots.

Every slot must hear of every snapshot, also of one in which it has no principal: the distinct snapshot
times go to all slots as rows without a principal. Rows behind the watermark are left out, as by any
windowed stream; ``jobs.membership_batches`` is the form that keeps them aside.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Python workers get the processor by value: they need not be able to import the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SLOTS = 16
CHANGES = "server_name string, principal string, change_ms long, action_type string"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """State stores of queries started inside are RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


class SnapshotDiff(StatefulProcessor):
    """State of one (server, slot)."""

    def __init__(self, retire_ms: int):
        self.retire_ms = retire_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "snapshot_ms long", "principals array<string>")
        self.last = handle.getValueState("last", "snapshot_ms long, principals array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived: dict[int, set[str]] = {}
        for frame in rows:
            for at, names in frame.groupby("snapshot_ms")["principal"]:
                arrived.setdefault(int(at), set()).update(names.dropna())
        for at, names in arrived.items():
            if self.open.containsKey((at,)):
                names |= set(self.open.getValue((at,))[0])
            else:
                self.handle.registerTimer(at)
            self.open.updateValue((at,), (sorted(names),))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        done, before = self.last.get() if self.last.exists() else (None, [])
        due = sorted(at for (at,) in self.open.keys() if at <= now)
        members = set(before)
        for at in due:
            current = set(self.open.getValue((at,))[0])
            self.open.removeKey((at,))
            changes = [(p, "ADDED") for p in sorted(current - members)] + [(p, "REMOVED") for p in sorted(members - current)]
            if changes:
                yield pd.DataFrame({
                    "server_name": key[0], "principal": [p for p, _ in changes], "change_ms": at, "action_type": [a for _, a in changes]
                })
            members, done = current, at
        if due:
            self.last.update((done, sorted(members)))
            self.handle.registerTimer(done + self.retire_ms)
        elif done is not None and done + self.retire_ms <= now and not any(True for _ in self.open.keys()):
            self.last.clear()

    def close(self) -> None:
        pass


def membership_changes(snapshots: DataFrame, delay: str, retire_after_days: int = 90, slots: int = SLOTS) -> DataFrame:
    """ADDED / REMOVED per (server_name, principal) of a stream of full snapshots: also change_time, the snapshot that shows it.

    A snapshot is compared once the watermark, the newest snapshot time less ``delay``, has passed it,
    with the last one of its own server; a server's first snapshot adds all its principals. Rows without a
    server, principal or time are left out. Start the query within ``rocksdb_state``.
    """
    timed = snapshots.select(
        "server_name", "principal", F.col("snapshot_time").cast("timestamp").alias("event_time")
    ).dropna().withWatermark("event_time", delay)
    rows = timed.withColumn("slot", F.pmod(F.xxhash64("principal"), F.lit(slots)).cast("int"))
    heard = timed.select("server_name", "event_time").dropDuplicatesWithinWatermark(["server_name", "event_time"])
    heard = heard.select("server_name", F.lit(None).cast("string").alias("principal"), "event_time", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"))
    both = rows.unionByName(heard).withColumn("snapshot_ms", F.unix_millis("event_time"))
    changes = both.groupBy("server_name", "slot").transformWithStateInPandas(
        statefulProcessor=SnapshotDiff(retire_after_days * 86_400_000), outputStructType=CHANGES, outputMode="Append", timeMode="EventTime"
    )
    change_time = F.timestamp_millis("change_ms").cast("timestamp_ntz").alias("change_time")
    return changes.select("server_name", "principal", change_time, "action_type")
