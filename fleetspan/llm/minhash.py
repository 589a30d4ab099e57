"""MinHash near-duplicate detection: one-permutation hashing, bands, star edges, exact confirmation.

1. Every text becomes a set of word-shingle hashes. Each hash falls into one of ``bands * rows``
   bins and the smallest per bin is the signature; empty bins borrow from a full one found by a
   universal hash (optimal densification, Shrivastava 2017). Texts with the same set have the same
   set key and only the one with the smallest id goes on.
2. Bands of the signature are buckets. The smallest id of a bucket is its centre, and every other
   member gets one candidate edge to it: a bucket of n texts makes n - 1 pairs, not n * n / 2.
3. A pair is confirmed on the full shingle sets. Centres are dealt to blocks of about ``BLOCK``, and the
   text of a member travels once to each block in which it has centres, in bounded, salted portions, and
   is compared there with all of them. So a member that is near to many centres is few rows.
4. A star can miss a link between two members that are both too far from the centre, or reach one
   of them only. So after components are formed, each bucket that still holds more than one
   component gets further stars, around members outside its largest component, until each of those
   has been a centre or the bucket is one component. The centres of a group are dealt to blocks, and a
   member travels once to each block that has centres of its buckets, first as a signature, in salted portions.
   Only pairs that share a bucket and whose estimated similarity comes within five standard deviations of the
   threshold become candidates for step 3, in the same block.
   The first rounds try few centres, as each star joins components and leaves fewer members to try. Nothing is
   capped: members that do not fit one round's number of centres are centres of the next.
   The members of open buckets are one table that carries its components along and shrinks from round to
   round; a round's tables have as many partitions as their rows ask for, not as the session sets for large ones.

With 40 bands of 6 rows two texts of similarity 0.85 share no bucket with probability
(1 - 0.85^6)^40 < 1e-8, of similarity 0.8 with 6e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import narrow, packed, small_enough
from fleetspan.llm.components import connected_components
from fleetspan.session import ensure_checkpoint_dir

BANDS = 40
ROWS = 6
BLOCK = 256  # centres whose texts are together in a task
PORTION = 1024  # members compared with one copy of a block's centres
CENTRES = (4, 64, 4096)  # further centres per bucket, by round; the last number for all later ones
SIGNED_PORTION = 4096  # signatures compared with one copy of a block's centres
DEVIATIONS = 5.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words; fewer words: of the whole sequence."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        run = one[: len(words) - width + 1].copy()
        for i in range(1, width):
            run = _mixed(run * _MIX + one[i : len(words) - width + 1 + i])
    return np.unique(run)


def signature(found: np.ndarray, bins: int) -> np.ndarray:
    """Smallest hash per bin by one permutation, empty bins filled by optimal densification."""
    out = np.zeros(bins, np.uint64)
    full = np.zeros(bins, bool)
    with np.errstate(over="ignore"):
        hashes = _mixed(found * _MIX)
        at = ((hashes >> np.uint64(20)) % np.uint64(bins)).astype(np.int64)
        full[at] = True
        out[full] = np.iinfo(np.uint64).max
        np.minimum.at(out, at, hashes)
        empty = np.flatnonzero(~full)
        step = np.uint64(0)
        while empty.size:
            step += np.uint64(1)
            probe = (_mixed((empty.astype(np.uint64) + np.uint64(1)) * _MIX + step * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(bins)).astype(np.int64)
            hit = full[probe]
            out[empty[hit]] = _mixed(out[probe[hit]] + empty[hit].astype(np.uint64))
            empty = empty[~hit]
    return out


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key = np.arange(1, bands + 1, dtype=np.uint64) * _MIX
        for column in sig.reshape(bands, rows).T:
            key = _mixed(key + column)
    return key.view(np.int64)


def sign(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for texts without words), keys (one per band), marks (a byte per bin)."""
    schema = "doc_id long, n_shingles long, set_key string, keys array<long>, marks binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, set_keys, keys, marks = [], [], [], []
            for text in batch.column(1):
                found = shingle_set(text.as_py(), width)
                sizes.append(found.size)
                set_keys.append(xxhash.xxh128_hexdigest(found.tobytes()) if found.size else None)
                sig = signature(found, bands * rows) if found.size else None
                keys.append([] if sig is None else band_keys(sig, bands, rows))
                marks.append(None if sig is None else (sig & np.uint64(0xFF)).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(set_keys, pa.string()), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "keys", "marks"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def in_blocks(centres: DataFrame, n: int) -> DataFrame:
    """``centres`` (id), at most ``n``, as distinct (id, block): dealt by hash to blocks of about ``BLOCK``."""
    ids = narrow(centres.distinct(), n).checkpoint()
    return ids.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(-(-ids.count() // BLOCK) or 1)))


def in_blocks_by_home(centres: DataFrame, n: int) -> DataFrame:
    """``centres`` (id, home), at most ``n``, as distinct (id, block): the centres of each home, dealt by hash to blocks of about ``BLOCK``.

    A home is the largest component of a bucket, which the buckets of one group of near copies have in common. So the
    centres that a member meets are in few blocks, however many centres other groups have.
    """
    homes = narrow(centres.groupBy("id").agg(F.min("home").alias("home")), n).checkpoint()
    sizes = narrow(homes.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("parts")), n)
    # Two homes of one hash would be one larger block, and nothing else.
    return homes.join(_light(sizes), "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def by_block(pairs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """``pairs`` (centre, member) as ``confirm`` takes them, each end a component of its own."""
    pairs, n = packed(pairs)
    centres = in_blocks(pairs.select(F.col("centre").alias("id")), n)
    blocked = pairs.join(centres.withColumnRenamed("id", "centre"), "centre")
    # A member's centres in one block: about BLOCK at most.
    lists = blocked.groupBy("block", F.col("member").alias("id")).agg(F.collect_list("centre").alias("centres"))
    return narrow(lists.select("block", "id", F.col("id").alias("id_in"), "centres", F.col("centres").alias("centres_in")), n), centres, n


def confirm(lists: DataFrame, centres: DataFrame, n: int, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The components (a, b) that links join, of a member and its candidate centres.

    ``lists``, at most ``n`` rows: block, id, id_in (its component), centres, centres_in (theirs). ``centres``:
    block, id of all centres in the lists. A link is
    100 * common >= percent * all of the shingle sets. A member that is linked with one centre of a component
    is not compared with others of it.
    """
    members = lists.checkpoint()
    sizes = members.groupBy("block").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    if small_enough(sizes, F.lit(0)):
        sizes = F.broadcast(sizes)
    none = F.array().cast("array<bigint>")
    centres = centres.join(sizes, "block").select(
        "id", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("role"),
        F.col("id").alias("id_in"), none.alias("centres"), none.alias("centres_in"),
    )
    members = members.join(sizes, "block").select(
        "id", "block", F.pmod(F.xxhash64("id"), F.col("portions")).alias("portion"), F.lit(1).alias("role"), "id_in", "centres", "centres_in"
    )
    wanted = narrow(members.unionByName(centres), 2 * n).checkpoint()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    ids = narrow(wanted.select("id").distinct(), 2 * n)
    if small_enough(ids, F.lit(0)):  # then only the texts that are needed are shuffled
        texts = texts.join(F.broadcast(ids), "id", "left_semi")
    there = wanted.join(texts, "id")
    there = there.repartition("block", "portion").sortWithinPartitions("block", "portion", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, sets = None, {}
        for batch in batches:
            out_a, out_b = [], []
            for i, block, portion, role, id_in, centres, centres_in, text in zip(*(batch.column(c).to_pylist() for c in range(8)), strict=True):
                if place != (block, portion):
                    place, sets = (block, portion), {}
                ours = shingle_set(text, width)
                if role == 0:  # an id on several rows may have several texts; any of them may link
                    sets.setdefault(i, []).append(ours)
                    continue
                done = set()
                for centre, centre_in in zip(centres, centres_in, strict=True):
                    if centre_in not in done and any(_linked(ours, theirs, percent) for theirs in sets.get(centre, ())):
                        done.add(centre_in)
                        out_a.append(centre_in)
                        out_b.append(id_in)
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    return there.select("id", "block", "portion", "role", "id_in", "centres", "centres_in", "text").mapInArrow(run, "a long, b long")


def _linked(ours: np.ndarray, theirs: np.ndarray, percent: int) -> bool:
    small, large = sorted((ours.size, theirs.size))
    if 100 * small < percent * large:
        return False
    common = np.intersect1d(ours, theirs, assume_unique=True).size
    return bool(common) and 100 * common >= percent * (ours.size + theirs.size - common)


def near_duplicates(docs: DataFrame, width: int, percent: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Words are runs of anything but white space, A-Z lower-cased. component_id is the smallest
    doc_id reachable over links, its own included. Null, empty and white texts have no shingles and
    no links. A null doc_id cannot be linked to: component_id is null and the row is kept. Rows that
    share an id are one node, linked by any of their texts; each row returns. Other columns are
    not read.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    signed = sign(docs, width, bands, rows).checkpoint()
    able = signed.where("doc_id IS NOT NULL AND set_key IS NOT NULL")
    # Texts with the same set: the one with the smallest id stands for all.
    sets = able.groupBy("set_key").agg(F.min("doc_id").alias("rep")).checkpoint()
    reps = able.join(sets, "set_key").where("doc_id = rep").select("doc_id", "n_shingles", "keys", "marks")
    members = reps.select("doc_id", F.explode("keys").alias("key"))  # the band is mixed into its keys
    shared = members.groupBy("key").agg(F.min("doc_id").alias("centre"), F.count("*").alias("n")).where("n > 1").checkpoint()
    if small_enough(shared, F.lit(0)):
        shared = F.broadcast(shared)
    members = members.join(shared, "key").select("key", "doc_id", "centre").checkpoint()
    pairs = members.where("doc_id <> centre").select("centre", F.col("doc_id").alias("member")).distinct()
    edges = confirm(*by_block(pairs), docs, width, percent)
    # An id on several rows is one node, whatever sets its texts have.
    several = able.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    edges = edges.unionByName(able.join(several, "doc_id").join(sets, "set_key").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    groups = connected_components(edges)
    groups = _further_stars(members, reps.select("doc_id", "n_shingles", "marks", "keys"), groups, docs, width, percent)
    named = sets.join(groups, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
    out = signed.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    out = out.join(named, "set_key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _further_stars(members: DataFrame, signatures: DataFrame, groups: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """``groups`` after stars from members outside a bucket's largest component, until no bucket has one to try."""
    names = groups.withColumnsRenamed({"node": "doc_id"})
    open_, n = packed(
        members.join(names, "doc_id", "left").select(
            "key", "doc_id", F.coalesce("component", "doc_id").alias("component"), (F.col("doc_id") == F.col("centre")).alias("tried")
        )
    )
    signatures, _ = packed(signatures.join(_light(open_.select("doc_id").distinct()), "doc_id", "left_semi"))
    moves: list[DataFrame] = []  # component -> into, one table per round
    turn = 0
    while n:
        # Buckets that hold several components, the largest of each, and its members that have not been centres yet.
        parts = narrow(open_.groupBy("key", "component").agg(F.count("*").alias("n")), n)
        buckets = parts.groupBy("key").agg(F.max(F.struct("n", "component")).alias("top"), F.count("*").alias("components"))
        buckets = buckets.where("components > 1").select("key", F.col("top.component").alias("main"))
        left = narrow(open_.join(_light(narrow(buckets, n)), "key"), n).checkpoint()
        # Up to CENTRES per bucket and round, one per hash slot, found by aggregation and not by sorting the bucket.
        slot = F.pmod(F.xxhash64("doc_id", F.lit(turn)), F.lit(CENTRES[min(turn, len(CENTRES) - 1)]))
        fresh = left.where("component <> main AND NOT tried")
        picked = narrow(fresh.groupBy("key", "main", slot.alias("slot")).agg(F.min("doc_id").alias("id")), n).checkpoint()
        if picked.isEmpty():
            break
        blocks = in_blocks_by_home(picked.select("id", F.col("main").alias("home")), n).checkpoint()
        # CENTRES at most, of one bucket.
        here = picked.join(_light(blocks), "id").groupBy("key").agg(F.collect_list("id").alias("centres"), F.collect_set("block").alias("blocks"))
        # Buckets without a member to try are done: two components that further stars would join are joined elsewhere or not at all.
        here = narrow(here, n).checkpoint()
        light = F.broadcast if small_enough(here, 8 * (F.size("centres") + F.size("blocks"))) else lambda df: df
        tried = F.col("tried") | F.array_contains("centres", F.col("doc_id"))  # the list itself stays behind
        open_, n = packed(left.join(light(here), "key").select("key", "doc_id", "component", tried.alias("tried"), "blocks"))
        # A member of many buckets goes to each block once; they are no more than its buckets have centres.
        goes = open_.groupBy("doc_id").agg(F.min("component").alias("component"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
        goes = narrow(goes, n).select("doc_id", "component", F.explode("blocks").alias("block"))
        centres = blocks.join(_light(narrow(picked.groupBy("id").agg(F.collect_set("key").alias("now")), n)), "id")
        lists, found = packed(alike(goes, centres, signatures, n, percent))
        open_ = open_.drop("blocks")
        turn += 1
        if not found:
            continue
        # Components that a new link joins become one; the rest of the graph is not touched again.
        more, linked = packed(confirm(lists, blocks, found, docs, width, percent))
        if not linked:
            continue
        into, joined = packed(connected_components(more, linked))
        if joined:
            moves.append(into.select(F.col("node").alias("component"), F.col("component").alias("into")))
            open_ = _moved(open_, moves[-1]).checkpoint()
    named = members.select("doc_id").distinct().join(names, "doc_id", "full").select("doc_id", F.coalesce("component", "doc_id").alias("component"))
    if moves:
        all_moves = moves[0]  # a component is in a later round only if it was not moved into another before
        for into in moves[1:]:
            later = into.select(F.col("component").alias("into"), F.col("into").alias("last"))
            all_moves = all_moves.join(later, "into", "left").select("component", F.coalesce("last", "into").alias("into")).unionByName(into).distinct()
        named = _moved(named, all_moves)
    return named.select(F.col("doc_id").alias("node"), "component")


def _light(df: DataFrame) -> DataFrame:
    """``df`` for a join: broadcast if its measured size allows, else as it is."""
    return F.broadcast(df) if small_enough(df, F.lit(64)) else df


def _moved(rows: DataFrame, into: DataFrame) -> DataFrame:
    """``rows`` with the component that theirs became a part of."""
    columns = rows.columns
    return rows.join(_light(into), "component", "left").withColumn("component", F.coalesce("into", "component")).select(columns)


def alike(goes: DataFrame, centres: DataFrame, signatures: DataFrame, n: int, percent: int) -> DataFrame:
    """The members and their centres of the same block, in different components, that share a band and whose signatures may belong to a link.

    One row per member and block, as ``confirm`` takes them: block, id, id_in, centres, centres_in. ``goes``: doc_id,
    component, block. ``centres``: id, block, now (the buckets it is a centre of). ``signatures``: doc_id, n_shingles, marks, keys.
    A bin agrees by chance with probability 1/256, which only adds candidates, as marks do not tell which buckets
    are shared. Signatures of small sets have fewer independent bins; the margin widens with it. A pair counts
    in the first band whose whole keys agree, when that bucket has the centre: if it holds one component only, so are
    the two in one.
    """
    goes, several = packed(goes)
    portions = narrow(goes.groupBy("block").agg(F.ceil(F.count("*") / SIGNED_PORTION).alias("portions")), n)
    rows = goes.join(_light(portions), "block").select("doc_id", "component", "block", F.pmod(F.xxhash64("doc_id"), F.col("portions")).alias("portion"), F.lit(1).alias("role"), F.array().cast("array<bigint>").alias("now"))
    names = narrow(goes.select("doc_id", "component").distinct(), several)
    centres = centres.withColumnRenamed("id", "doc_id").join(_light(names), "doc_id").join(_light(portions), "block").select(
        "doc_id", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"), F.lit(0).alias("role"), "now"
    )
    needed = signatures.join(_light(names.select("doc_id")), "doc_id", "left_semi")
    rows = narrow(rows.unionByName(centres).join(needed, "doc_id"), 2 * several)
    rows = rows.select("block", "portion", "role", "doc_id", "component", "n_shingles", "marks", "keys", "now")
    rows = rows.repartition("block", "portion").sortWithinPartitions("block", "portion", "role")

    deviation = percent / 100 * (1 - percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, centres, table = None, [], None
        for batch in batches:
            block, portion, role, doc, comp, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            marks = np.frombuffer(b"".join(batch.column(6).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            keys = batch.column(7).flatten().to_numpy().reshape(batch.num_rows, -1)
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (portion[1:] != portion[:-1]) | (role[1:] != role[:-1])) + 1
            out: list[tuple] = []
            for at, end in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                if (block[at], portion[at]) != place:
                    place, centres, table = (block[at], portion[at]), [], None
                if role[at] == 0:
                    now = np.array([np.isin(keys[i], batch.column(8)[i].values.to_numpy()) for i in range(at, end)])
                    centres.append((doc[at:end].copy(), comp[at:end].copy(), size[at:end].copy(), marks[at:end].copy(), keys[at:end].copy(), now))
                    table = None
                    continue
                if table is None:
                    table = [np.concatenate(c) for c in zip(*centres, strict=True)] if centres else ()
                if not table:
                    continue
                names, comps, sizes, theirs, theirs_keys, now = table
                for i in range(at, end):
                    spread = DEVIATIONS * np.sqrt(deviation / np.minimum(np.minimum(sizes, size[i]), marks.shape[1]))
                    hit = np.flatnonzero((comps != comp[i]) & ((theirs == marks[i]).mean(axis=1) >= percent / 100 - spread))
                    if hit.size:
                        same = theirs_keys[hit] == keys[i]
                        hit = hit[same.any(axis=1) & now[hit, same.argmax(axis=1)]]
                    if hit.size:
                        out.append((int(block[i]), int(doc[i]), int(comp[i]), names[hit], comps[hit]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(),) * 3 + (pa.list_(pa.int64()),) * 2)],
                names=["block", "id", "id_in", "centres", "centres_in"],
            )

    return rows.mapInArrow(run, "block long, id long, id_in long, centres array<long>, centres_in array<long>")


def first_of_each_group(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does, all columns as they were.

    The smallest id of a group stays; of several rows with that id the one with the smallest text.
    Rows without an id all stay.
    """
    ids = near_duplicates(docs, width, percent).where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.bool_or("kept").alias("kept"), F.count("*").alias("n")
    ).where("kept").select("doc_id", "n").checkpoint()
    light = F.broadcast if small_enough(ids, F.lit(0)) else lambda df: df  # if so, no text is shuffled
    d = docs.alias("d")
    same = F.col("d.doc_id") == F.col("k.doc_id")
    single = d.join(light(ids.where("n = 1")).alias("k"), same, "left_semi")
    order = Window.partitionBy("d.doc_id").orderBy(F.col("d.text").asc_nulls_last(), F.hash(*[F.col(f"d.`{c}`") for c in docs.columns]))
    repeated = d.join(light(ids.where("n > 1")).alias("k"), same, "left_semi")
    repeated = repeated.select(F.struct("d.*").alias("row"), F.row_number().over(order).alias("place")).where("place = 1").select("row.*")
    return single.unionByName(repeated).unionByName(docs.where("doc_id IS NULL"))
