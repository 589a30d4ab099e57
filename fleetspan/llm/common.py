"""Column helpers and guards shared by the operators of this subpackage."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed patterns: what separates words, as Java regular expressions.
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WHITE = r"[\x20\x09-\x0D]+"

# A side is broadcast only if its measured text and ids stay below this many bytes.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z only; all other letters stay as they are."""
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def alnum_words(text: Column) -> Column:
    """Runs of digits, a-z and non-ASCII characters, A-Z lower-cased first; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_ALNUM), "")


def windows_of(words: Column, width: int) -> Column:
    """64-bit hashes of all runs of ``width`` consecutive words, in order; none if there are fewer."""
    n = F.size(words)
    hashes = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(F.slice(words, i + 1, width)))
    return F.when(n >= width, hashes).otherwise(F.array().cast("array<bigint>"))


def small_enough(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> bool:
    """Measure a candidate for broadcasting: one count over that side alone."""
    total = df.agg(F.sum(size.cast("long") + 64).alias("bytes")).first()["bytes"]
    return (total or 0) <= limit


def literal_rows(spark: SparkSession, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few constant rows as a plan without Python."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))


ROWS_PER_TASK = 100_000  # of narrow rows: ids, keys, counts


def narrow(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of at most ``rows`` rows, in no more partitions than they ask for.

    What comes out of a shuffle has as many partitions as the session sets for large tables. A small
    table that goes on like this makes that many files in every later shuffle and checkpoint.
    """
    return df.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def packed(df: DataFrame) -> tuple[DataFrame, int]:
    """``df`` cut with ``checkpoint()``, in as many partitions as its rows ask for, and their number."""
    done = df.checkpoint()
    n = done.count()
    return narrow(done, n), n
