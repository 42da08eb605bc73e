"""The registered queries of this package and the SQL that a few of them can be compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from punctual.llm.bpe import encoded
from punctual.llm.cap_filters import near_duplicates
from punctual.llm import language, pseudo_likelihood
from punctual.llm.decontaminate import contained_items
from punctual.llm.html_text import main_text
from punctual.llm.jaccard_join import similar_documents
from punctual.llm.pii import pseudonymised
from punctual.llm.prefix_trie import prefix_trie
from punctual.llm.quality import quality
from punctual.llm.ranked_search import best_documents
from punctual.llm.secrets import secrets
from punctual.llm.statements import CONVERSATION_TRIE, NEAR_DUPLICATES, RANKED_SEARCH
from punctual.llm.toxicity import held_out, toxicity, trained


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op3_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(documents(spark, sf_dir))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(documents(spark, sf_dir)).select("doc_id", "text")


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(documents(spark, sf_dir))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = trained(docs, labels, ~held_out(F.col("doc_id")))
    found = toxicity(docs, model).withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    return found.select("doc_id", "held_out", "score", "predicted", "evidence")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return found.drop("n_lines")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.trained(docs, ~held_out(F.col("doc_id")))
    found = language.languages(docs, model)
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return pseudo_likelihood.scored(docs, pseudo_likelihood.trained(docs))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_bpe_encoding": op3_bpe_encoding,
    "op4_pii_pseudonyms": op4_pii_pseudonyms,
    "op5_secret_scans": op5_secret_scans,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_toxicity": op7_toxicity,
    "op8_quality_rules": op8_quality_rules,
    "op9_language_id": op9_language_id,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_ranked_search": op11_ranked_search,
    "op12_embedding_near_dedup": op12_embedding_near_dedup,
    "op13_conversation_trie": op13_conversation_trie,
}

STATEMENTS: dict[str, str] = {
    "op11_ranked_search": RANKED_SEARCH,
    "op12_embedding_near_dedup": NEAR_DUPLICATES,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
