"""Document fingerprints from prefix polynomial hashes.

For a run of code points c the prefix arrays hold sum(c[j] * base^j) modulo two primes. The
difference of two entries, divided by the power of the base at the first, is the hash of the span
between them, so any two spans compare in constant time and the longest common extension of two
places is found by binary search. Long texts are hashed in runs of bounded length.

A fingerprint is the text's length, its hash, and a sketch: the smallest hash of all spans of
``SPAN`` code points in each of ``BINS`` classes. Equal texts have equal fingerprints; the share of
agreeing classes estimates the share of common spans.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import isqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Two primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629)
BASES = (1103515245, 1566083941)
SPAN = 16
BINS = 64
RUN = 1 << 17  # code points hashed at once
OVERSAMPLE = 8

_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(which: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0..base^RUN and the inverse powers, modulo the prime; built once by doubling."""
    if which not in _powers:
        prime, tables = PRIMES[which], []
        for base in (BASES[which], pow(BASES[which], -1, PRIMES[which])):
            table = np.ones(1, np.uint64)
            while len(table) <= RUN:
                step = np.uint64(pow(base, len(table), prime))
                table = np.concatenate([table, table * step % np.uint64(prime)])
            tables.append(table)
        _powers[which] = (tables[0], tables[1])
    return _powers[which]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class PrefixHash:
    """Prefix arrays of at most ``RUN`` code points."""

    def __init__(self, points: np.ndarray):
        self.n = len(points)
        self.prefix = []
        for which, prime in enumerate(PRIMES):
            powers = _power_tables(which)[0][: self.n]
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((points + np.uint64(1)) * powers % np.uint64(prime), out=sums[1:])
            self.prefix.append(sums % np.uint64(prime))

    def span(self, first: int, end: int) -> tuple[int, int]:
        """The hash of code points first..end-1; spans with the same content have the same hash."""
        return tuple(
            (int(s[end]) - int(s[first])) * int(_power_tables(w)[1][first]) % PRIMES[w] for w, s in enumerate(self.prefix)
        )

    def spans(self, width: int) -> np.ndarray:
        """The first hash of all spans of ``width``."""
        prime, sums = np.uint64(PRIMES[0]), self.prefix[0]
        inverse = _power_tables(0)[1][: self.n - width + 1]
        return (sums[width:] + prime - sums[: self.n - width + 1]) % prime * inverse % prime

    def common_extension(self, first: int, other: PrefixHash, other_first: int) -> int:
        """How many code points agree from ``first`` here and ``other_first`` there."""
        low, high = 0, min(self.n - first, other.n - other_first)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(first, first + mid) == other.span(other_first, other_first + mid):
                low = mid
            else:
                high = mid - 1
        return low


class TextHash:
    """Prefix arrays of a whole text, run by run; each run repeats the last SPAN-1 code points."""

    def __init__(self, text: str):
        points = code_points(text)
        self.n = len(points)
        self.runs = [PrefixHash(points[i : i + RUN]) for i in range(0, max(self.n - SPAN + 1, 1), RUN - SPAN + 1)]

    def fingerprint(self) -> str:
        digest = hashlib.blake2b(digest_size=12)
        sketch = np.full(BINS, 0xFFFFFFFFFFFFFFFF, np.uint64)
        for run in self.runs:
            digest.update(repr(run.span(0, run.n)).encode())
            if not run.n:
                continue
            with np.errstate(over="ignore"):
                found = (run.spans(min(SPAN, run.n)) + np.uint64(run.n if run.n < SPAN else 0)) * np.uint64(0x9E3779B97F4A7C15)
                found = (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
                found ^= found >> np.uint64(32)
            np.minimum.at(sketch, (found % np.uint64(BINS)).astype(np.int64), found >> np.uint64(8))
        marks = np.where(sketch == 0xFFFFFFFFFFFFFFFF, 0, sketch % np.uint64(0xFFFF) + np.uint64(1))
        return f"{self.n:x}.{digest.hexdigest()}." + marks.astype(">u2").tobytes().hex()

    def common_prefix(self, other: TextHash) -> int:
        for i, (a, b) in enumerate(zip(self.runs, other.runs, strict=False)):
            same = a.common_extension(0, b, 0)
            if same < a.n or same < b.n:
                return i * (RUN - SPAN + 1) + same
        return min(self.n, other.n)


def likeness(one: str, other: str) -> float:
    """0 to 1: agreeing classes of two fingerprints among those that either text has."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(f.rpartition(".")[2]), ">u2") for f in (one, other))
    there = int(((a != 0) | (b != 0)).sum())
    return float(((a == b) & (a != 0)).sum()) / there if there else 0.0


def edited(text: str, following: str) -> str:
    """The last third of ``text`` replaced by as many code points from the start of ``following``."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def ordered_slices(docs: DataFrame) -> DataFrame:
    """slice, tail, doc_id, text: rows in slices of the id range, largest id first.

    The row that follows a slice's last one is the next slice's first; it comes along as ``tail``.
    About sqrt(rows) slices are cut at a sample of the ids, OVERSAMPLE per slice, so neither the
    list of cuts nor a slice grows as fast as the table. The last slice is followed by the first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = rows.count()
    wanted = max(1, isqrt(n))
    some = rows.where("doc_id IS NOT NULL").where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n // (OVERSAMPLE * wanted)))) == 0)
    ids = np.array(sorted(r["doc_id"] for r in some.select("doc_id").distinct().collect()), np.int64)
    cuts = ids[OVERSAMPLE::OVERSAMPLE]

    def number(values: pd.Series) -> np.ndarray:
        known = values.notna().to_numpy()
        out = np.full(len(values), -1, np.int64)  # rows without id stand last, in a slice of their own
        out[known] = np.searchsorted(cuts, values[known].astype("int64").to_numpy(), side="right")
        return out

    def first_ids(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"slice": number(frame["doc_id"]), "doc_id": frame["doc_id"]}).groupby("slice", as_index=False)["doc_id"].max()

    tops = rows.select("doc_id").mapInPandas(first_ids, "slice long, doc_id long").groupBy("slice").agg(F.max("doc_id").alias("top")).collect()
    tops = sorted(((r["slice"], r["top"]) for r in tops), reverse=True)
    before = {tops[i][0]: tops[i - 1][0] for i in range(len(tops))}  # the slice that ends with this one's first row
    top_of = dict(tops)

    @F.pandas_udf("array<struct<slice:long,tail:int>>")
    def places(ids: pd.Series) -> pd.Series:
        out = []
        for value, at in zip(ids, number(ids), strict=True):
            here = [{"slice": int(at), "tail": 0}]
            if at < 0 or value == top_of[at]:
                here.append({"slice": before[at], "tail": 1})
            out.append(here)
        return pd.Series(out)

    return rows.withColumn("place", F.explode(places("doc_id"))).select("place.slice", "place.tail", "doc_id", "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``, its text's fingerprint and that of the edited text (see ``edited``).

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next,
    common_prefix (code points on which text and edited text agree from the start). The following
    document is the next by descending doc_id; rows without an id come after all others, rows with
    the same id follow each other by text, after the last comes the first. Null texts are empty. A
    table of one row is its own successor. Only doc_id and text are read.
    """
    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
        "near_edited double, near_next double, common_prefix long"
    )
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
    names = [f.split()[0] for f in schema.split(", ")]
    slices = ordered_slices(docs)
    rows = slices.repartition("slice").sortWithinPartitions("slice", "tail", F.desc_nulls_last("doc_id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting = None  # (slice, doc_id, text, its hash, its fingerprint), until its successor comes
        for batch in batches:
            out = []
            for at, tail, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                here = waiting is not None and waiting[0] == at
                if tail and not here:
                    continue  # a further row with the id of the next slice's first
                hashed = TextHash(text)
                mark = hashed.fingerprint()
                if here:
                    _, own_id, own, own_hash, own_mark = waiting
                    changed = edited(own, text)
                    changed_hash = TextHash(changed)
                    changed_mark = changed_hash.fingerprint()
                    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((
                        own_id, own_hash.n, digest, own_mark, changed_mark,
                        likeness(own_mark, changed_mark), likeness(own_mark, mark), own_hash.common_prefix(changed_hash),
                    ))
                waiting = None if tail else (at, doc_id, text, hashed, mark)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    return rows.select("slice", "tail", "doc_id", "text").mapInArrow(run, schema)
