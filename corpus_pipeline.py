"""Cleaning a corpus in stages; each stage takes the documents its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet in the shared
folder and read again, so a lost executor costs at most the stage it was working on. All stages
but the last return the columns of their documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetspan.llm import decontamination, minhash, mixing, secret_scan, toxicity
from fleetspan.llm.common import table
from fleetspan.llm.queries import QUERIES, Query, prepare
from fleetspan.session import scratch_path

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 80
# Of texts on their way to and from Python. An executor's JVM and Python workers live through all stages, and what
# large batches once took of their memory they keep.
BATCH_BYTES = 4 << 20


def prepared(spark: SparkSession) -> SparkSession:
    prepare(spark).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is learned from the labelled ones among ``docs``."""
    return toxicity.acceptable(docs, table(prepared(spark), sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    prepared(spark)
    return minhash.first_of_each_group(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontamination.clean_documents(docs, table(prepared(spark), sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced by their kind."""
    prepared(spark)
    return secret_scan.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (how many of its words the mix takes)."""
    prepared(spark)
    return mixing.mixture(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
]

#: Learned scores and pseudorandom draws have no SQL form; tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the files of each stage stay in the shared folder."""
    docs = table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


CORPUS_QUERIES = {**QUERIES, "pipeline": Query(run, ORACLE_SQL)}
