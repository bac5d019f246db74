"""Order within files that are read in many splits, without a task that holds a file.

A split of a file is a run of rows of one partition, known by where it starts. Rows are numbered within their split as they go
by, each split tells how many rows it has, and running sums over these, one row a split, give where each split's numbers begin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.shared import small_side

Batches = Iterator[pa.RecordBatch]


def split_text(spark: SparkSession, paths, line_sep: str | None = None) -> DataFrame:
    """file, block (where the row's split starts), value of text files."""
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    return reader.text(paths).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def numbered(raw: DataFrame, keep: Column) -> DataFrame:
    """raw(file, block, value) -> file, ord (from 1 within the file), value of the rows to keep. The files are read twice, the
    second time for counts alone; nothing but these is shuffled."""

    def run(batches: Batches) -> Batches:
        last, n = None, 0
        for b in batches:
            place = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
            number = np.empty(len(place), np.int64)
            for k, p in enumerate(place):
                n = n + 1 if p == last else 1
                last, number[k] = p, n
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number)], names=["file", "block", "value", "number"])

    rows = raw.where(keep)
    counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1))
    begin = small_side(counts.select("file", "block", F.coalesce(before, F.lit(0)).alias("before")))
    own = rows.mapInArrow(run, "file string, block long, value string, number long")
    return own.join(begin, ["file", "block"]).select("file", (F.col("before") + F.col("number")).alias("ord"), "value")
