"""The corpus pipeline: language ID, line dedup, near-dedup, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm.langid import identify, train
from granary.llm.line_dedup import remove_boilerplate
from granary.llm.packing import pack
from granary.llm.simhash import near_duplicate_groups
from granary.llm.suffix_dedup import remove_repeats

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
REST = ("lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not recognised go: no letters (null and empty texts too), or a score below the calibrated
    threshold. Each row is judged by its own text in the pass that keeps or drops it: null ids, repeated rows and rows of
    one doc_id make no difference. Where no language is labelled nothing can be told, and all rows go."""
    return identify(docs, train(docs), keep=("text", *REST)).where("not rejected").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines spread over many sites go, wherever they stand; no row goes. Null texts stay null, rows with a null doc_id keep
    all lines, repeated rows are treated alike; n_chars follows the text where lines went."""
    kept = remove_boilerplate(docs, keep=REST)
    n = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n.alias("n_chars"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group of near copies: the smallest doc_id's, ties to the smaller hash of its text.

    Rows are known by doc_id and text: of rows that share a doc_id only those whose text is a near copy go, and of rows that
    share both one stays. Texts without words (null, empty) are no copies of each other and stay."""
    docs = docs.select(*COLUMNS)
    kept = near_duplicate_groups(docs).where("kept").select(F.col("doc_id").alias("of"), F.col("text_hash").alias("had")).distinct()
    had = docs.withColumn("th", F.xxhash64("text"))
    found = had.join(kept, had.doc_id.eqNullSafe(kept.of) & (had.th == kept.had), "left_semi")
    return found.dropDuplicates(["doc_id", "th"]).select(*COLUMNS)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has already go; no row goes. A null text comes out empty; rows with a
    null doc_id lose nothing; rows that share a doc_id are judged each against smaller ids."""
    kept = remove_repeats(docs.select(*COLUMNS), with_text=True, keep=("lang", "source", "n_chars"))
    n = F.when(F.col("n_removed") == 0, F.col("n_chars")).otherwise(F.length("kept_text")).cast("long")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", n.alias("n_chars"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences for training: pieces of documents, each id in one piece. A null or empty text is its end id alone;
    null ids and repeated rows are packed like any other; an empty table gives no pieces."""
    return pack(docs.select("doc_id", "text"))


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("passages", passages), ("packing", packing)]
ORACLE_SQL = None  # language ID, SimHash and packing have no SQL form; tests/llm holds brute-force versions


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
