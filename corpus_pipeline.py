"""A training-data pipeline: toxic texts, near duplicates and benchmark texts go, personal data is
replaced, and what remains is encoded. Each stage reads what the one before it wrote.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm import toxicity
from punctual.llm.bpe import encoded
from punctual.llm.decontaminate import clean_documents
from punctual.llm.jaccard_join import one_per_group
from punctual.llm.pii import pseudonymised
from punctual.llm.store import stored

#: Columns that the last stage adds; of the same name in the documents, its own count.
CODED = ("n_tokens", "ids_sha256", "decoded_sha256", "token_ids")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.trained(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    return toxicity.harmless(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by similar shingle sets."""
    return one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def with_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with pseudonyms for personal data."""
    return pseudonymised(docs)


def with_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the ids of their tokens and the hashes that prove the way back."""
    return encoded(docs, keep=[name for name in docs.columns if name not in CODED], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("pii", with_pseudonyms),
    ("bpe", with_tokens),
]

#: Byte-pair merges and exact cosines are beyond SQL; the stages are tested against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
