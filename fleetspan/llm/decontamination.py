"""Benchmark decontamination: documents against all windows of benchmark words. [native]

The benchmark's windows of ``width`` consecutive words form a hash set. Every window of every
document is hashed, looked up, and a hit is confirmed on the words themselves. The set is
broadcast when its measured size allows it; the lookup then runs inside the scan and nothing
but hits leaves it. A larger set is joined by shuffle, with the same result.

A text is cut into pieces of a fixed number of words that overlap by a window, so that the words
beside a window's hash are never more than a piece and the work grows with a text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.common import BROADCAST_BYTES, alnum_words, small_enough, windows_of
from fleetspan.session import ensure_checkpoint_dir

WIDTH = 10
_GAP = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # between words of a text in its own case
PIECE_WORDS = 256
_HEAD = 0  # the hash under which each document finds its own head row


def item_windows(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """hash, window (words joined by a space), span (its words), items (sorted ids as strings)."""
    words = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), alnum_words(F.col("text")).alias("words"))
    words = words.where(F.size("words") > 0).withColumn("span", F.least(F.size("words"), F.lit(width)))
    starts = F.sequence(F.lit(1), F.size("words") - F.col("span") + 1)
    windows = words.select(
        "item",
        "span",
        F.explode(F.transform(starts, lambda i: F.array_join(F.slice("words", i, F.col("span")), " "))).alias("window"),
    )
    return windows.groupBy("window", "span").agg(F.array_sort(F.collect_set("item")).alias("items")).select(
        F.xxhash64(F.split("window", " ")).alias("hash"), "window", "span", "items"
    )


def find_hits(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, text_key, n_words, hit_words (0-based positions), hit_items.

    Null and empty texts have no words. Rows that agree in doc_id and text are one document; rows
    that share only the id stay apart (text_key tells them apart). A null doc_id is an id like any
    other. Items without words have no windows, items without an id count as the id "". No items:
    no hits. Only doc_id, text and item_id, text are read, so other columns cannot clash.
    """
    windows = item_windows(items, width)
    spans = sorted(r["span"] for r in windows.select("span").distinct().collect())  # at most ``width`` numbers
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_key"), alnum_words(F.col("text")).alias("words"))
    if not spans:
        return texts.select(
            "doc_id", "text_key", F.size("words").cast("long").alias("n_words"),
            F.array().cast("array<int>").alias("hit_words"), F.array().cast("array<string>").alias("hit_items"),
        ).distinct()
    texts = texts.withColumn("n", F.size("words"))
    starts = F.sequence(F.lit(0), F.greatest(F.col("n") - 1, F.lit(0)), F.lit(PIECE_WORDS))
    pieces = F.transform(starts, lambda i: F.slice("words", i + 1, PIECE_WORDS + max(spans) - 1))
    pieces = texts.select("doc_id", "text_key", "n", F.posexplode(pieces).alias("piece", "words"))
    lead = F.when(F.col("piece") == 0, F.array(F.lit(_HEAD).cast("long"))).otherwise(F.array().cast("array<long>"))
    hashes = F.concat(lead, *[F.slice(windows_of(F.col("words"), s), 1, PIECE_WORDS) for s in spans])
    rows = pieces.select("doc_id", "text_key", "n", "piece", "words", F.posexplode(hashes).alias("at", "hash"))
    first = F.when(F.col("piece") == 0, 1).otherwise(0)
    local = F.col("at") - first - _before(spans)
    start = F.col("piece") * PIECE_WORDS + local
    same = F.array_join(F.slice("words", local + 1, F.greatest("span", F.lit(1))), " ") == F.col("window")
    heads = docs.sparkSession.range(1).select(
        F.lit(_HEAD).cast("long").alias("hash"), F.lit("").alias("window"), F.lit(0).alias("span"), F.array().cast("array<string>").alias("items")
    )
    if small_enough(windows, F.length("window") + F.length(F.concat_ws(",", "items")), broadcast_bytes):
        found = rows.join(F.broadcast(windows.unionByName(heads)), "hash")
        found = found.where(F.when(F.col("span") == 0, (F.col("at") == 0) & (F.col("piece") == 0)).otherwise((F.col("at") >= first) & same))
        found = found.select("doc_id", "text_key", "n", "span", start.alias("start"), "items")
    else:
        near = rows.where(F.col("at") >= first).select("doc_id", "text_key", "piece", "at", "hash").join(windows, "hash")
        back = pieces.distinct().withColumnsRenamed({"doc_id": "d", "text_key": "k", "piece": "p"})
        near = near.join(back, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")) & (F.col("piece") == F.col("p"))).where(same)
        near = near.select("doc_id", "text_key", "n", "span", start.alias("start"), "items")
        found = near.unionByName(
            texts.select("doc_id", "text_key", "n", F.lit(0).alias("span"), F.lit(0).alias("start"), F.array().cast("array<string>").alias("items"))
        )
    hit = F.col("span") > 0
    per_doc = found.groupBy("doc_id", "text_key").agg(
        F.max("n").cast("long").alias("n_words"),
        F.collect_set(F.when(hit, F.struct("start", "span"))).alias("hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("lists"),
    )
    covered = F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["span"] - 1))
    return per_doc.select(
        "doc_id", "text_key", "n_words",
        F.array_sort(F.array_distinct(F.flatten(covered))).alias("hit_words"),
        F.array_sort(F.array_distinct(F.flatten("lists"))).alias("hit_items"),
    )


def _before(spans: list[int]) -> Column:
    """How many hashes of shorter windows stand before those of this span in a piece."""
    count = F.lit(0)
    out = F.lit(0)
    for s in spans:
        out = F.when(F.col("span") == s, count).otherwise(out)
        count = count + F.least(F.greatest(F.size("words") - s + 1, F.lit(0)), F.lit(PIECE_WORDS))
    return out


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Cases: ``find_hits``."""
    found = find_hits(docs, items, width, broadcast_bytes)
    n_hit = F.size("hit_words").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hit_items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of ``docs`` without any hit, all columns as they were; null texts stay."""
    ensure_checkpoint_dir(docs.sparkSession)
    bad = find_hits(docs, items, width).where(F.size("hit_words") > 0).select("doc_id", "text_key").checkpoint()
    if small_enough(bad, F.lit(0)):  # then no text is shuffled
        bad = F.broadcast(bad)
    d, b = docs.alias("d"), bad.alias("b")
    return d.join(b, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.xxhash64("d.text") == F.col("b.text_key")), "left_anti")


def remove_spans(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text of every document, hit words cut out together with what separates them from the next word."""
    found = find_hits(docs, items, width).where(F.size("hit_words") > 0).withColumnsRenamed({"doc_id": "d", "text_key": "k"})
    pieces = F.regexp_extract_all("text", F.lit(f"[^{_GAP}]+[{_GAP}]*"), F.lit(0))
    lead = F.regexp_extract("text", f"^[{_GAP}]*", 0)
    kept = F.filter(pieces, lambda _, i: ~F.array_contains("hit_words", i))
    joined = docs.select("doc_id", "text").join(
        found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.xxhash64("text") == F.col("k")), "left"
    )
    return joined.select("doc_id", F.when(F.col("hit_words").isNull(), F.col("text")).otherwise(F.concat(lead, F.array_join(kept, ""))).alias("text"))
