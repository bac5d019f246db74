"""Sequence files as records, and as chunks of sequences of any length.

Records come whole where a sequence fits a row. read_fasta_chunks() reads lines instead and never puts a sequence together:
what a split cannot know, how many records and letters lie before it in the file, is a running sum over its splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.shared import small_side, written
from granary.operators.chromosomes import CHUNK, chunk_pieces
from granary.sources.splits import numbered, split_text

PIECE = 1 << 20
Batches = Iterator[pa.RecordBatch]


def _some(value) -> F.Column:
    """Whether a piece holds more than blanks and signs."""
    return F.trim(F.regexp_replace(value, r"[\s>]", "")) != ""


def read_fasta(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """file, ord, seq_id, name, description, sequence, length. ord counts from 1 within the file. Records split on the line
    separator, so that large files are read, and numbered, in parallel."""
    rows = numbered(split_text(spark, paths, "\n>"), _some("value"))
    return fasta_records(rows, F.col("ord"))


def fasta_records(raw: DataFrame, order) -> DataFrame:
    """Records from text pieces (file, value), each from a header, with or without its sign, to the next."""
    text = F.regexp_replace("value", r"^\s*>", "")
    head = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "\r", ""))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(F.expr("substr(t, instr(t, '\n') + 1)"), r"\s", "")).otherwise("")
    rows = raw.withColumn("t", text).where(_some("value"))
    seq_id = F.substring_index(F.regexp_replace(head, r"\s+", " "), " ", 1)
    rows = rows.select("*", order.cast("long").alias("number"), seq_id.alias("seq_id"), seq_id.alias("name"), head.alias("description"), body.alias("sequence"))
    keep = [c for c in raw.columns if c not in ("value", "ord")]
    return rows.select(*keep, F.col("number").alias("ord"), "seq_id", "name", "description", "sequence", F.length("sequence").cast("long").alias("length"))


def _pieces(batches: Batches) -> Batches:
    """Lines of splits -> (file, block, rec, offset, head, text): rec is the record's number in its split, 0 for one that began
    before it; offset counts letters since the record's header, or the split's start; head is set on a header's row alone."""
    place, rec, at, held, size, out = None, 0, 0, [], 0, []

    def flush():
        nonlocal at, held, size
        if size:
            out.append((*place, rec, at, None, "".join(held)))
        at, held, size = at + size, [], 0

    def batch():
        nonlocal out
        rows, out = out, []
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "block", "rec", "offset", "head", "text"])

    for b in batches:
        for *here, line in zip(*(c.to_pylist() for c in b.columns)):
            if here != place:
                flush()
                place, rec, at = here, 0, 0
            if line.startswith(">"):
                flush()
                rec, at = rec + 1, 0
                out.append((*place, rec, 0, line[1:].strip(), ""))
                continue
            line = re.sub(r"\s", "", line)
            held.append(line)
            size += len(line)
            if size >= PIECE:
                flush()
        if out:
            yield batch()
    flush()
    if out:
        yield batch()


def read_fasta_chunks(spark: SparkSession, paths: list[str] | str, size: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(chunks, records) of sequence files: chunks as in operators.chromosomes, records(seq_id, file, ord, name, description,
    length). seq_id is the file with the record's number, from 1, so that records of one name stay apart. Lines before a
    file's first header belong to no record. No task holds more than a chunk and no sequence is put together."""
    pieces = written(split_text(spark, paths).mapInArrow(_pieces, "file string, block long, rec long, offset long, head string, text string"), "pieces")
    n = F.length("text").cast("long")
    split = pieces.groupBy("file", "block").agg(F.max("rec").alias("heads"), F.max(F.struct("rec", (F.col("offset") + n).alias("n")))["n"].alias("tail"))
    order = W.partitionBy("file").orderBy("block")  # one row a split
    split = split.withColumn("through", F.sum("heads").over(order.rowsBetween(W.unboundedPreceding, 0)))
    since = W.partitionBy("file", "through").orderBy("block").rowsBetween(W.unboundedPreceding, 0)
    split = split.withColumn("letters", F.sum("tail").over(since))
    split = split.select("file", "block", (F.col("through") - F.col("heads")).alias("before"), F.coalesce(F.lag("letters").over(order), F.lit(0)).alias("carried"))
    placed = pieces.join(small_side(split), ["file", "block"])
    placed = placed.select("file", (F.col("before") + F.col("rec")).alias("ord"), (F.col("offset") + F.when(F.col("rec") == 0, F.col("carried")).otherwise(0)).alias("offset"), "head", "text").where("ord > 0")
    placed = placed.withColumn("seq_id", F.concat_ws("#", "file", "ord"))
    heads = placed.groupBy("seq_id", "file", "ord").agg(F.max("head").alias("description"), F.max(F.col("offset") + n).alias("length"))
    name = F.substring_index(F.regexp_replace("description", r"\s+", " "), " ", 1)
    return chunk_pieces(placed.select("seq_id", "offset", "text"), size), heads.select("seq_id", "file", "ord", name.alias("name"), "description", "length")
