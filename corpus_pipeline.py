"""From raw documents to a training mix: language, near copies, benchmark passages, secrets, source weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vantage.llm import decontaminate, jaccard, langid, mixing, secrets
from vantage.llm.common import stored, table


def small_rows(spark: SparkSession) -> None:
    """Whole texts make long rows: fewer of them at a time go to the Python side of a task."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def in_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; texts without letters and undecided ones go."""
    small_rows(spark)
    return langid.recognised(docs, langid.fit(docs))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of every class of documents linked by shingle similarity."""
    small_rows(spark)
    return jaccard.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    small_rows(spark)
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts masked."""
    small_rows(spark)
    return secrets.redacted(docs)


def in_target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target weight asks for, in a global random order."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", in_known_language),
    ("jaccard_join", without_near_copies),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("source_mixing", in_target_mix),
]

#: Language scores, latent retrieval and masked texts are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
