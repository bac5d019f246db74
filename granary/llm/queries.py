"""The queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import langid, toxicity
from granary.llm.bpe import encode_decode
from granary.llm.common import table
from granary.llm.lattice import near_duplicates
from granary.llm.hnsw import nearest
from granary.llm.line_dedup import oracle as line_oracle
from granary.llm.line_dedup import remove_boilerplate
from granary.llm.negatives import ORACLE as NEGATIVES_ORACLE
from granary.llm.negatives import hard_negatives
from granary.llm.packing import pack
from granary.llm.prefix_trie import ORACLE as TRIE_ORACLE
from granary.llm.prefix_trie import prefix_trie
from granary.llm.simhash import simhash_groups
from granary.llm.suffix_dedup import remove_repeats
from granary.llm.token_counts import token_counts
from granary.llm.vafile import ORACLE as TOP_K_ORACLE
from granary.llm.vafile import top_k


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))


def op5_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_boilerplate(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", F.md5("kept_text").alias("kept_md5"), "n_lines", "n_removed")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_language_id, op3_toxicity, op4_simhash, op5_lattice, op6_bpe, op7_top_k, op8_line_dedup, op9_packing, op10_token_counts, op11_nearest_neighbours, op12_prefix_trie, op13_hard_negatives)}


def oracle_sql() -> dict[str, str]:
    return {"op7_top_k": TOP_K_ORACLE, "op8_line_dedup": line_oracle(), "op12_prefix_trie": TRIE_ORACLE, "op13_hard_negatives": NEGATIVES_ORACLE}
