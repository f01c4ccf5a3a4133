"""The corpus pipeline: five stages from ``documents`` to shards.

Toxic documents go, one document of each near-duplicate group stays, documents
that contain a benchmark item go, sources are mixed to their target weights (rows
repeat as often as the mix takes them), and what is left is placed in shards.
Near duplicates are documents whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more, or are linked by a chain of such documents.

Every stage handles null, empty and repeated rows, empty tables and extra columns
as its operator's module says; columns of ``documents`` pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfmark.llm import decontaminate, jaccard, mixing, sharding, toxicity
from shelfmark.llm.staging import new_folder, release

SHARDS = 40
#: bytes of rows handed to a Python worker at once: the JVM holds them up to three times
#: beside its heap while a batch grows, and the worker once more
BATCH_BYTES = 4 * 1024 * 1024


def _bound_batches(spark: SparkSession) -> None:
    """Stages are computed after they return, so this setting of the session stays."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, labels, toxicity.fold(5) == 0)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return jaccard.keep_one(docs, shingle=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _bound_batches(spark)
    return mixing.mixed_documents(docs)


def place_in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", place_in_shards),
]

#: SQL can state neither the trained classifier nor the random rounding
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
        release(spark)
    return STAGES[-1][1](spark, docs, sf_dir)
