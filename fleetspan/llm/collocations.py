"""Phrase collocations by stripes: every prefix holds a counter of the words that follow it.

Stripes are built level by level. A task counts the next words of each prefix in its texts and sends
one row (prefix, next words, counts); stripes of the same prefix are merged entry by entry. A prefix
that holds a thousandth of all words or more, of which there are a thousand at most, has its stripe
cut into slots by a hash of the next word, so no stripe is a large group. Everything that is asked for comes from the merged
entries: an entry is a phrase and its count; the empty prefix's total is the number of words; the
greatest entry of a prefix, and of the phrases that end in it, tells whether a longer phrase takes
its place.

A phrase is frequent only if the phrases without its last and without its first word are. Those are
known from the level before and go to the tasks as a bitmap of their hashes, at most ``MOST_BITS``
long: a foreign phrase that meets a set bit is counted for nothing and dropped after merging, so
the bitmap's size decides about work only, never about results. Counts are of the words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.common import small_enough
from fleetspan.session import scratch_path

LONGEST = 5
LEAST = 100
COVERED_PERCENT = 100
TOP = 2000
NO_LANG = "und"
MOST_BITS = 1 << 28
BITS_PER_PHRASE = 16
PIECE_BYTES = 1 << 23  # text counted at once
KNOWN_WORDS = 1_000_000  # words a task keeps numbers for; beyond, it starts over

_BREAK = b"A"  # texts are in lower case, so this letter is free to mark the end of a piece
_BYTES = bytes(
    ord(ascii_lowercase[ascii_uppercase.index(chr(b))]) if chr(b) in ascii_uppercase else ord(_BREAK) if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 0x09 else b
    for b in range(256)
)
_MIX = np.uint64(0x9E3779B97F4A7C15)
HOT_SHARE = 1000  # a prefix is cut into slots if it holds one in so many words
STRIPES = "lang string, prefix binary, slot int, next binary, n array<int>"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def joined(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of a phrase from the hash of all but its last word, and that word's."""
    with np.errstate(over="ignore"):
        return _mixed(first * _MIX + word)


def word_hash(lang: str, word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word, seed=xxhash.xxh32_intdigest(lang.encode("utf-8", "surrogatepass")))


class Counter:
    """Stripes of one language in one task."""

    def __init__(self, lang: str, length: int, bits: np.ndarray | None, hot: frozenset[bytes], slots: int):
        self.lang, self.length, self.bits, self.hot, self.slots = lang, length, bits, hot, slots
        self.numbers, self.hashes = defaultdict(count().__next__), []
        self.numbers[_BREAK]

    def _number(self, words: list[bytes]) -> np.ndarray:
        if len(self.numbers) > KNOWN_WORDS:
            self.numbers, self.hashes = defaultdict(count().__next__), []
            self.numbers[_BREAK]
        out = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if self.bits is not None and len(self.hashes) < len(self.numbers):
            new = list(self.numbers)[len(self.hashes) :]
            more = np.fromiter((word_hash(self.lang, w) for w in new), np.uint64, len(new))
            self.hashes = np.concatenate([np.array(self.hashes, np.uint64), more])
        return out

    def _hopeful(self, codes: np.ndarray) -> np.ndarray:
        """Places where a phrase starts whose two shorter parts may both be frequent."""
        k = self.length
        inside = codes != 0
        if self.bits is None:
            return np.flatnonzero(inside)
        n = len(codes) - k + 2  # phrases of k - 1 words
        if n < 2:
            return np.empty(0, np.int64)
        words = self.hashes[codes]
        whole, there = words[:n], inside[:n].copy()
        for i in range(1, k - 1):
            whole = joined(whole, words[i : n + i])
            there &= inside[i : n + i]
        place = whole & np.uint64(len(self.bits) * 64 - 1)
        there &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
        return np.flatnonzero(there[:-1] & there[1:])

    def stripes(self, words: list[bytes]) -> pa.RecordBatch | None:
        """Stripes of all phrases among ``words``; breaks are in no phrase."""
        codes = self._number(words)
        at = self._hopeful(codes)
        if not len(at):
            return None
        k, base = self.length, len(self.numbers)
        prefix = np.zeros(len(at), np.int64)
        for i in range(k - 1):
            prefix = np.unique(prefix * base + codes[at + i], return_inverse=True)[1]
        entry, first, n = np.unique(prefix * base + codes[at + k - 1], return_index=True, return_counts=True)
        starts = np.flatnonzero(np.diff(entry // base, prepend=-1)).tolist()
        places = at[first]
        prefixes = [b" ".join(words[p : p + k - 1]) for p in places[starts].tolist()]
        nexts = [words[p] for p in (places + k - 1).tolist()]
        ends = [*starts[1:], len(entry)]
        rows, slots, joined_, order, offsets = [], [], [], [], [0]
        for phrase, a, b in zip(prefixes, starts, ends, strict=True):
            parts = {0: range(a, b)}
            if phrase in self.hot:
                parts = defaultdict(list)
                for i in range(a, b):
                    parts[xxhash.xxh3_64_intdigest(nexts[i]) % self.slots].append(i)
            for slot, entries in parts.items():
                rows.append(phrase)
                slots.append(slot)
                joined_.append(b" ".join([nexts[i] for i in entries]))
                order.extend(entries)
                offsets.append(len(order))
        counts = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(n[order].astype(np.int32)))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.lang] * len(rows)), pa.array(rows, pa.binary()), pa.array(slots, pa.int32()), pa.array(joined_, pa.binary()), counts],
            names=["lang", "prefix", "slot", "next", "n"],
        )


def words_of(texts: list[bytes], carried: int) -> Iterator[list[bytes]]:
    """Words and breaks of the texts in bounded lists; each begins with the last ``carried`` of the one before."""
    data = b"\n".join([b"", *texts, b""]).translate(_BYTES)
    at, before = 0, []
    while at < len(data):
        end = data.find(b" ", at + PIECE_BYTES)
        end = len(data) if end < 0 else end
        words = before + data[at:end].replace(_BREAK, b" A ").split()
        yield words
        before, at = words[len(words) - carried :] if carried else [], end


def count_level(docs: DataFrame, length: int, bits: np.ndarray | None, hot: dict[str | None, frozenset[bytes]]) -> DataFrame:
    """Merged entries of the stripes of prefixes of ``length`` - 1 words: lang, prefix, next, a.

    ``hot`` names, by language (None: any), the prefixes whose stripes are cut into slots.
    """
    shared = docs.sparkSession.sparkContext.broadcast((bits, hot))
    slots = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters: dict[str, Counter] = {}
        for batch in batches:
            texts = defaultdict(list)
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts[lang].append(text)
            for lang, some in texts.items():
                if lang not in counters:
                    if len(counters) >= 64:  # languages that a task keeps words of
                        counters.clear()
                    bits, hot = shared.value
                    counters[lang] = Counter(lang, length, bits, hot.get(lang, hot.get(None, frozenset())), slots)
                for words in words_of(some, length - 1):
                    found = counters[lang].stripes(words)
                    if found is not None:
                        yield found

    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"), F.col("text").cast("binary").alias("text")).where("text IS NOT NULL")
    # Stripes travel as rows; their entries are counted where they arrive, without a further shuffle.
    stripes = rows.mapInArrow(run, STRIPES).withColumns({"prefix": F.col("prefix").cast("string"), "next": F.col("next").cast("string")})
    stripes = stripes.repartition("lang", "prefix", "slot")
    entries = stripes.select("lang", "prefix", "slot", F.inline(F.arrays_zip(F.split("next", " ").alias("next"), "n")))
    return entries.groupBy("lang", "prefix", "slot", "next").agg(F.sum("n").alias("a")).drop("slot")


def phrase_bits(phrases: DataFrame, n: int) -> np.ndarray:
    """Bitmap of the hashes of ``phrases`` (lang, phrase), of a size after their number ``n``."""
    size = min(MOST_BITS, 1 << max(12, (BITS_PER_PHRASE * n - 1).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.empty(batch.num_rows, np.uint64)
            for i, (lang, phrase) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                hashes = np.array([word_hash(lang, w) for w in phrase.split(b" ")], np.uint64)
                whole = hashes[:1]
                for i_word in range(1, len(hashes)):
                    whole = joined(whole, hashes[i_word : i_word + 1])
                found[i] = whole[0]
            place = found & np.uint64(size - 1)
            blocks, back = np.unique(place >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(blocks), np.uint64)
            np.bitwise_or.at(bits, back, np.uint64(1) << (place & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(blocks.astype(np.int64)), pa.array(bits.view(np.int64))], names=["block", "bits"])

    rows = phrases.select("lang", F.col("phrase").cast("binary")).mapInArrow(run, "block long, bits long")
    table = rows.groupBy("block").agg(F.bit_or("bits").alias("bits")).toArrow()  # at most MOST_BITS / 64 rows
    out = np.zeros(size // 64, np.uint64)
    out[table.column("block").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return out


def _hot_prefixes(level: DataFrame, all_words: int) -> dict[str | None, frozenset[bytes]]:
    """The phrases of one length that hold a thousandth of all words or more, by language: a thousand at most."""
    found = defaultdict(set)
    for r in level.where(F.col("a") * HOT_SHARE >= all_words).select("lang", "phrase").collect():
        found[r["lang"]].add(r["phrase"].encode("utf-8", "surrogatepass"))
    return {lang: frozenset(some) for lang, some in found.items()}


def frequent_phrases(docs: DataFrame, longest: int, least: int) -> tuple[DataFrame, DataFrame]:
    """(counts, totals): lang, phrase, prefix, suffix, length, a of all frequent phrases; lang, n of all words."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "stripes")
    bits, hot = None, {None: frozenset([b""])}
    for length in range(1, longest + 1):
        entries = count_level(docs, length, bits, hot)
        if length == 1:  # the whole stripe of the empty prefix: its total is the number of words
            entries.write.parquet(f"{folder}/words")
            entries = spark.read.parquet(f"{folder}/words")
            entries.groupBy("lang").agg(F.sum("a").alias("n")).write.parquet(f"{folder}/totals")
            all_words = spark.read.parquet(f"{folder}/totals").agg(F.sum("n")).first()[0] or 0
        phrase = F.col("next") if length == 1 else F.concat_ws(" ", "prefix", "next")
        kept = entries.where(F.col("a") >= least).select("lang", phrase.alias("phrase"), "prefix", "a")
        suffix = F.substring_index("phrase", " ", -(length - 1)) if length > 1 else F.lit("")
        kept.withColumn("suffix", suffix).write.parquet(f"{folder}/counts/length={length}")
        if length < longest:
            level = spark.read.parquet(f"{folder}/counts/length={length}")
            n = level.count()
            if not n:  # then no longer phrase is frequent either
                break
            bits = phrase_bits(level, n)
            hot = _hot_prefixes(level, all_words)
    return spark.read.parquet(f"{folder}/counts"), spark.read.parquet(f"{folder}/totals")


def collocations(
    docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered_percent: int = COVERED_PERCENT, top: int = TOP
) -> DataFrame:
    """Per lang its first ``top`` phrases: lang, rank, phrase, a, l, r, n, score.

    Words are runs of anything but blanks and tabs, A-Z lower-cased, in pieces between ``.,;:!?`` and
    line ends. A phrase of 2 to ``longest`` words that occurs ``least`` times or more has the lowest
    score of its cuts, floor(1000 * a * n / (l * r)), ties to the shortest first part. Phrases inside a longer one that
    has ``covered_percent`` of their occurrences are left out: such a longer phrase exists exactly if one of
    one word more does. Null texts are empty, a null lang is ``und``. Rows with repeated or null
    ids count like any other. An empty table gives no rows. Only lang and text are read. Counts are
    written to the shared folder, level by level.
    """
    counts, totals = frequent_phrases(docs, longest, least)
    longer = counts.where("length > 2").select("lang", F.explode(F.array("prefix", "suffix")).alias("phrase"), "a")
    cover = longer.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    open_ = F.col("cover").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("cover") < F.lit(covered_percent).cast("decimal(20,0)") * F.col("a"))
    left = counts.where("length > 1").join(cover, ["lang", "phrase"], "left").where(open_).select("lang", "phrase", "a", F.split("phrase", " ").alias("w"))
    cuts = left.select("lang", "phrase", "a", "w", F.explode(F.sequence(F.lit(1), F.size("w") - 1)).alias("k"))
    cuts = cuts.select(
        "lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("first"), F.array_join(F.slice("w", F.col("k") + 1, F.size("w")), " ").alias("rest")
    )
    if small_enough(totals, F.octet_length("lang")):
        totals = F.broadcast(totals)
    part = lambda name, size: counts.select("lang", F.col("phrase").alias(name), F.col("a").alias(size))
    cuts = cuts.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"]).join(totals, "lang")
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = cuts.withColumns({"above": F.lit(1000).cast("decimal(38,0)") * exact("a") * exact("n"), "below": exact("l") * exact("r")})
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(F.expr("above div below").cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
