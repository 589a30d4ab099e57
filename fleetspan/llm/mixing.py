"""Mixing sources to target weights, block by block.

The words of a source, its documents one after the other, are cut into blocks of fixed length.
Output shards draw how many of their slots each source fills, from a multinomial distribution
seeded by the shard number. Counted over all shards, the k-th slot of a source stands for block
perm(k mod blocks) of pass k div blocks, where perm is a pseudorandom permutation of the source's
block numbers. Slots and blocks meet in a join on the block number. A lost task draws the same
numbers again, and no task sees more than one shard or one slice of a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import WHITE
from fleetspan.session import ensure_checkpoint_dir

BLOCK_WORDS = 64
SHARD_SLOTS = 32_768
SHARDS_PER_TASK = 64
WEIGHTS = (1.0, 2.0, 3.0)
MOST_PASSES = 3
MOST_SOURCES = 1_000_000  # the table of sources is held by the driver and by each task


@dataclass(frozen=True)
class Plan:
    """What each source gives, in code point order of its name, null last."""

    sources: list
    sizes: np.ndarray
    targets: np.ndarray
    blocks: np.ndarray
    quotas: np.ndarray


def share_targets(sizes: np.ndarray, weights: np.ndarray, total: float, most: float) -> np.ndarray:
    """``total`` by weight, no target above ``most`` times its size, the excess shared out again."""
    targets = np.zeros(len(sizes))
    limits = most * sizes.astype(float)
    free = np.ones(len(sizes), bool)
    while free.any():
        rest = max(0.0, total - limits[~free].sum())
        share = rest * weights / weights[free].sum()
        over = free & (share > limits)
        if not over.any():
            targets[free] = share[free]
            break
        free &= ~over
    targets[~free] = limits[~free]
    return targets


def make_plan(sources: list, sizes: list[int], block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES) -> Plan:
    order = sorted(range(len(sources)), key=lambda i: (sources[i] is None, sources[i] or ""))
    names = [sources[i] for i in order]
    size = np.array([sizes[i] for i in order], np.int64)
    cycle = np.array([weights[i % len(weights)] for i in range(len(names))])
    targets = share_targets(size, cycle, share * float(size.sum()), most)
    blocks = -(-size // block_words)
    # In words a block holds size / blocks on average: the quota of blocks that comes nearest.
    quotas = np.minimum(np.rint(targets * blocks / np.maximum(size, 1)).astype(np.int64), most * blocks)
    return Plan(names, size, targets, blocks, quotas)


def _seed(*parts) -> int:
    return int.from_bytes(hashlib.sha256(repr(parts).encode()).digest()[:8], "little")


def permuted(index: np.ndarray, n: int, seed: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 at ``index``: a four-round Feistel network, cycle-walked."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = [np.uint64(_seed(seed, r)) for r in range(4)]
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    with np.errstate(over="ignore"):
        while todo.size:
            left, right = out[todo] >> np.uint64(half), out[todo] & mask
            for key in keys:
                x = (right + key) * np.uint64(0x9E3779B97F4A7C15)
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                left, right = right, left ^ ((x >> np.uint64(32)) & mask)
            out[todo] = (left << np.uint64(half)) | right
            todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: the number of runs of anything but white space; null text has none."""
    size = F.coalesce(F.regexp_count("text", F.lit(WHITE.replace("[", "[^", 1))), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", size.alias("size"))


def pack(sizes: DataFrame) -> DataFrame:
    """doc_id, source, size, slice, row (number in the slice), offset of the first word in the source.

    Rows of a source follow each other by (slice, doc_id, size), where a slice is a hash of the id:
    running sums within slices, and over the slices' totals, so that a large source is many tasks. There
    are as many slices as a slice has rows, about the root of the table's, so neither list grows long.
    Rows equal in all three take neighbouring places and are interchangeable.
    """
    slices = max(1, isqrt(sizes.count()))
    rows = sizes.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    totals = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(F.col("source").alias("s"), F.col("slice").alias("c"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "slice").orderBy("doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"upto": F.sum("size").over(inside), "row": F.row_number().over(inside)})
    rows = rows.join(bases, F.col("source").eqNullSafe(F.col("s")) & (F.col("slice") == F.col("c")))
    return rows.select("doc_id", "source", "size", "slice", "row", (F.col("base") + F.col("upto") - F.col("size")).alias("offset"))


def _batch(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def slots(spark: SparkSession, plan: Plan, seed: int = 0) -> DataFrame:
    """One row per output slot: shard, source_no (place in the plan), pass_no, block."""
    total = int(plan.quotas.sum())
    names = "shard long, source_no int, pass_no int, block long"
    if not total:
        return spark.createDataFrame([], names)
    shards = -(-total // SHARD_SLOTS)
    odds = plan.quotas / total
    quotas, blocks = plan.quotas, plan.blocks

    def draw(shard: int) -> np.ndarray:
        wanted = min(SHARD_SLOTS, total - shard * SHARD_SLOTS)
        return np.random.Generator(np.random.PCG64(_seed(seed, "shard", shard))).multinomial(wanted, odds)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.column("id").to_pylist():
                drawn = draw(shard)
                at = np.flatnonzero(drawn)
                yield _batch(shard=np.full(at.size, shard, np.int64), source_no=at.astype(np.int32), n=drawn[at].astype(np.int64))

    drawn = spark.range(shards).mapInArrow(counts, "shard long, source_no int, n long")
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    drawn = drawn.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    got = np.zeros(len(quotas), np.int64)
    for r in drawn.groupBy("source_no").agg(F.sum("n").alias("n")).collect():  # one row per source
        got[r["source_no"]] = r["n"]
    # Slots drawn beyond a source's quota go, in order, to the sources that fell short of theirs.
    spare, lack = np.maximum(got - quotas, 0), np.maximum(quotas - got, 0)
    spare_from, lack_upto = np.cumsum(spare) - spare, np.cumsum(lack)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, no, n, first in zip(*(batch.column(c).to_pylist() for c in ("shard", "source_no", "n", "first")), strict=True):
                k = np.arange(first, first + n)
                own = k[k < quotas[no]]
                moved = spare_from[no] + k[k >= quotas[no]] - quotas[no]
                to = np.searchsorted(lack_upto, moved, side="right")
                parts = [(int(no), own)] + [
                    (int(t), got[t] + moved[to == t] - (lack_upto[t] - lack[t])) for t in np.unique(to)
                ]
                for source, at in parts:
                    if not len(at):
                        continue
                    turn, index = at // blocks[source], at % blocks[source]
                    block = np.empty_like(index)
                    for p in np.unique(turn):
                        here = turn == p
                        block[here] = permuted(index[here], int(blocks[source]), _seed(seed, "pass", source, int(p)))
                    yield _batch(shard=np.full(len(at), shard, np.int64), source_no=np.full(len(at), source, np.int32), pass_no=turn.astype(np.int32), block=block.astype(np.int64))

    tasks = max(-(-shards // SHARDS_PER_TASK), min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return drawn.repartition(tasks, "shard").mapInArrow(place, names)


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 0) -> tuple[DataFrame, DataFrame, Plan]:
    """The mixture as (slots, spans, plan).

    ``slots``: shard, source_no, pass_no, block. ``spans``: what the blocks hold, one row per
    document and block: source_no, block, slice, row, doc_id, size, first_word, n_words.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    sizes = sized(docs).checkpoint()
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    found = per_source.limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    plan = make_plan([r["source"] for r in found], [r["size"] for r in found], block_words, weights, share, most)
    numbers = docs.sparkSession.createDataFrame([(s, i) for i, s in enumerate(plan.sources)], "s string, source_no int")
    packed = pack(sizes).join(F.broadcast(numbers), F.col("source").eqNullSafe(F.col("s"))).drop("s", "source")
    length = F.lit(block_words)
    last = F.floor((F.col("offset") + F.greatest("size", F.lit(1)) - 1) / length)
    spans = packed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / length), last)))
    start = F.greatest("offset", F.col("block") * length)
    end = F.least(F.col("offset") + F.col("size"), (F.col("block") + 1) * length)
    spans = spans.withColumns({"first_word": start - F.col("offset"), "n_words": end - start})
    return slots(docs.sparkSession, plan, seed), spans, plan


def mixture(docs: DataFrame, block_words: int = BLOCK_WORDS, weights: tuple = WEIGHTS, share: float = 1.0, most: int = MOST_PASSES, seed: int = 0) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken (words in the mix, repeats counted).

    Sources weigh ``weights`` in turn, by code point, a null source last, and share ``share`` of
    all words. No target is above ``most`` times its source; no block, and so no document, is taken
    more often. A null or empty text has size 0 and gives nothing. Rows that repeat an id stay rows
    of their own and share out what the id's blocks give. An empty table gives no rows. Only doc_id,
    text and source are read.
    """
    drawn, spans, plan = mix(docs, block_words, weights, share, most, seed)
    times = drawn.groupBy("source_no", "block").agg(F.count("*").alias("times"))
    # The slots come out of a few shard numbers, so Spark would take them for a small table and broadcast them.
    taken = spans.join(times.hint("merge"), ["source_no", "block"], "left").groupBy("source_no", "slice", "row", "doc_id", "size").agg(
        F.sum(F.col("n_words") * F.coalesce("times", F.lit(0))).cast("long").alias("taken")
    )
    rows = [(i, int(size), float(target)) for i, (size, target) in enumerate(zip(plan.sizes, plan.targets, strict=True))]
    facts = docs.sparkSession.createDataFrame(rows, "source_no int, source_size long, target double")
    return taken.join(F.broadcast(facts), "source_no").select("doc_id", "size", "source_size", "target", "taken")
