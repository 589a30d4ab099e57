"""Importance resampling of a corpus towards a target text distribution.

Word runs fall into a fixed number of buckets. A bucket's gain is the log ratio of its smoothed
shares in target and corpus; a document's weight is the mean gain of its runs, and its score adds
seeded Gumbel noise, so that the highest scores are a draw without replacement. Bucket counts are
arrays of fixed length: one per task, summed by Spark.

The draw is ranked by parallel sorting by regular sampling. Runs of the scored table are sorted
where they lie and give samples at regular distances; the sorted samples give splitters; every run
is cut at the splitters; the sizes of all segments up to one give the rank of its first row; and
the segments that hold drawn rows are exchanged and merged. A row's place in its run is the last
part of the order, so rows that agree in everything else can be parted too and no value is too
frequent for a segment.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.session import scratch_path

BUCKETS = 10_000
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024
PIECE_BYTES = 1 << 21  # of a text, split at once
RUN_ROWS = 1 << 19  # rows of a locally sorted run
SAMPLES = 1 << 16  # regular samples the splitters are chosen from, over all runs
SEGMENT_ROWS = 1 << 14
MOST_SEGMENTS = 4096
SPLITTERS = "run long, place long, score long, unknown long, id long, features long, words long"

# Bytes of words stay (A-Z as a-z), all others become blanks; bytes of non-ASCII letters are above 0x7F.
_WORD_BYTES = bytes(
    ord(ascii_lowercase[ascii_uppercase.index(chr(b))]) if chr(b) in ascii_uppercase else b if b > 0x7F or chr(b) in ascii_lowercase or 0x30 <= b <= 0x39 else 0x20
    for b in range(256)
)


def features(text: bytes | None, longest: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every run of 1 to ``longest`` words."""
    data = (text or b"").translate(_WORD_BYTES)
    found, before, n, at = [], [], 0, 0
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        words = data[at:end].split()
        found.append(np.fromiter(map(zlib.crc32, words), np.uint32, len(words)))
        if longest > 1:
            row = before + words  # the words before are in runs that end here
            for k in range(2, longest + 1):
                runs = [b" ".join(row[i - k + 1 : i + 1]) for i in range(max(len(before), k - 1), len(row))]
                found.append(np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)))
            before = row[-(longest - 1) :]
        n, at = n + len(words), end
    return n, np.concatenate(found) % np.uint32(buckets) if found else np.empty(0, np.uint32)


def bucket_counts(texts: DataFrame, longest: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of each bucket in the column ``text`` of all rows; null texts have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts += np.bincount(features(text, longest, buckets)[1], minlength=buckets)
        there = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(counts[there])], names=["bucket", "n"])

    rows = texts.select(F.col("text").cast("binary")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of target share over source share), both with one occurrence more in every bucket."""
    all_source, all_target, n = float(source.sum()), float(target.sum()), len(source)
    shares = zip(source.tolist(), target.tolist(), strict=True)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n)))) for s, t in shares], np.int64)


def noise(seed: int, doc_id: int | None) -> int:
    """Thousandths of a Gumbel variate from a hash of the id; a missing id is an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: np.ndarray, longest: int = 1, seed: int = SEED) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_features, weight, score."""
    schema = "doc_id long, n_words long, n_features long, weight long, score long"
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((4, batch.num_rows), np.int64)
            for i, (doc_id, text) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n, found = features(text, longest, len(gains))
                weight = int(gains[found].sum()) // len(found) if len(found) else 0
                out[:, i] = n, len(found), weight, weight + noise(seed, doc_id)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, schema)


def _sorted_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Runs of at most ``RUN_ROWS`` rows with their order: a row per part of the key, a column per row.

    Key: run, place in it, -score, whether the id is missing, id, n_features, n_words. All but the first two decide first.
    """
    number = TaskContext.get().partitionId() << 32
    waiting, size = [], 0

    def close() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(waiting)
        ids = table.column("doc_id").combine_chunks()
        key = np.empty((7, table.num_rows), np.int64)
        key[0], key[1] = number, np.arange(table.num_rows)
        key[2], key[3] = -table.column("score").to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
        key[4], key[5], key[6] = ids.fill_null(0).to_numpy(), table.column("n_features").to_numpy(), table.column("n_words").to_numpy()
        return table, key

    for batch in batches:
        for at in range(0, batch.num_rows, RUN_ROWS):
            part = batch.slice(at, RUN_ROWS)
            if size + part.num_rows > RUN_ROWS:
                yield close()
                waiting, size, number = [], 0, number + 1
            waiting.append(part)
            size += part.num_rows
    if size:
        yield close()


def _order(key: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
    parts = key[[1, 0, 6, 5, 4, 3, 2]]
    return np.lexsort(parts if last is None else np.vstack([last[None], parts]))


def splitters(rows: DataFrame, n: int, segments: int) -> np.ndarray:
    """Keys that part the ``n`` rows into about equal segments, from regular samples of the sorted runs."""
    step = max(1, n // SAMPLES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, key in _sorted_runs(batches):
            # The first sample stands at another place in every run, so short runs count as long ones do.
            at = np.arange(int(key[0, 0] * 2654435761 % step), key.shape[1], step)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in key[:, _order(key)[at]]], names=[f.split()[0] for f in SPLITTERS.split(", ")])

    found = rows.mapInArrow(run, SPLITTERS).toArrow()  # about SAMPLES rows
    key = np.array([c.to_numpy() for c in found.columns], np.int64).reshape(7, -1)
    key = key[:, _order(key)]
    at = np.arange(1, segments) * key.shape[1] // segments
    return key[:, np.unique(at)] if key.shape[1] else key


def with_segments(rows: DataFrame, cuts: np.ndarray) -> DataFrame:
    """``rows`` with the column segment: how many splitters come before the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, key in _sorted_runs(batches):
            both, n = np.hstack([key, cuts]), key.shape[1]
            is_cut = (np.arange(both.shape[1]) >= n).astype(np.int64)
            order = _order(both, is_cut)  # a splitter stands behind the row it was taken from
            segment = np.empty(both.shape[1], np.int64)
            segment[order] = np.cumsum(is_cut[order])
            yield from table.append_column("segment", pa.array(segment[:n])).combine_chunks().to_batches()

    schema = ", ".join(f"{c} long" for c in [*rows.columns, "segment"])
    return rows.mapInArrow(run, schema)


def ranked(rows: DataFrame, drawn: int, n: int, folder: str) -> DataFrame:
    """The ``n`` rows with rank 1 to ``drawn`` by score, highest first, ties to the smaller id; others have none."""
    cuts = splitters(rows, n, min(MOST_SEGMENTS, max(1, -(-n // SEGMENT_ROWS))))
    path = f"{folder}/segments"
    with_segments(rows, cuts).write.parquet(path)
    parted = rows.sparkSession.read.parquet(path)
    sizes = {r["segment"]: r["count"] for r in parted.groupBy("segment").count().collect()}  # at most MOST_SEGMENTS
    before, firsts = 0, []
    for segment in sorted(sizes):
        if before < drawn:
            firsts.append((segment, before))
        before += sizes[segment]
    bases = F.broadcast(rows.sparkSession.createDataFrame(firsts, "segment long, base long"))
    order = Window.partitionBy("segment").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "n_features", "n_words")
    merged = parted.join(bases, "segment").withColumn("rank", (F.col("base") + F.row_number().over(order)).cast("long"))
    merged = merged.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank"))).select(*rows.columns, "rank")
    rest = parted.join(bases, "segment", "left_anti").select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return merged.unionByName(rest)


def resample(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED
) -> DataFrame:
    """Per row of ``docs``: doc_id, n_features, weight, score, rank.

    ``target`` is any table with a text column. Of the N rows with at least ``least_words`` words,
    floor(percent * N / 100) are drawn and have a rank. Null and empty texts have no features, weight
    0, and a score by their noise alone. A null id counts as an empty one in the noise and comes last
    among ties; rows that share an id are drawn each for itself. An empty target or corpus has shares
    that are all alike. Only doc_id and text are read. The scored rows are written to the shared folder.
    """
    spark = docs.sparkSession
    folder = scratch_path(spark, "resampling")
    gains = bucket_gains(bucket_counts(docs, longest, buckets), bucket_counts(target, longest, buckets))
    scored(docs, gains, longest, seed).write.parquet(f"{folder}/scored")
    rows = spark.read.parquet(f"{folder}/scored")
    able = F.col("n_words") >= least_words
    n = rows.where(able).count()
    drawn = n * percent // 100
    none = F.lit(None).cast("long").alias("rank")
    done = ranked(rows.where(able), drawn, n, folder) if drawn else rows.where(able).select("*", none)
    return done.unionByName(rows.where(~able).select("*", none)).select("doc_id", "n_features", "weight", "score", "rank")
