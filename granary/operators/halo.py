"""The row before, without a window: what lag() over few, large groups would put into few tasks.

Rows are dealt out by ranges of their order, so a group of any size is in as many tasks as its size asks for. Within a task
each row sees the one before as it goes by; only a task's first row needs another's last, which is one row each way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.functions.shared import kept_in_order, small_side

Batches = Iterator[pa.RecordBatch]


def with_previous(df: DataFrame, by: list[str], order: list[str], take: list[str], partitions: int | None = None) -> DataFrame:
    """df with, for each column of take, previous_<column>: its value in the row before in the same group of by, null in a
    group's first row. Rows of equal order follow each other in some order. df must not have columns of these names."""
    spark, fields = df.sparkSession, dict(df.dtypes)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("part_", F.spark_partition_id().cast("long"))
    rows = kept_in_order(rows)
    names = rows.columns
    of = [names.index(c) for c in by]
    taken = [names.index(c) for c in take]

    def run(batches: Batches) -> Batches:
        last, start = None, True
        for b in batches:
            if not b.num_rows:
                continue
            ahead = pa.Table.from_batches([b.slice(0, 1) if last is None else last, b]).slice(0, b.num_rows).combine_chunks()
            same = np.ones(b.num_rows, bool)
            for c in of:
                same &= _equal(ahead.column(c).combine_chunks(), b.column(c))
            if last is None:
                same[0] = False
            pick = pa.array(np.arange(b.num_rows), mask=~same)
            first = np.zeros(b.num_rows, bool)
            first[0], start = start, False
            yield pa.RecordBatch.from_arrays([*b.columns, *(ahead.column(c).combine_chunks().take(pick) for c in taken), pa.array(first)], names=[*names, *(f"previous_{c}" for c in take), "first_"])
            last = b.slice(b.num_rows - 1)

    def ends(batches: Batches) -> Batches:
        last = None
        for b in batches:
            last = b.slice(b.num_rows - 1) if b.num_rows else last
        if last is not None:
            yield last

    schema = ", ".join([*(f"`{c}` {fields.get(c, 'long')}" for c in names), *(f"`previous_{c}` {fields[c]}" for c in take), "first_ boolean"])
    seen = rows.mapInArrow(run, schema)
    edge = rows.mapInArrow(ends, rows.schema)
    next_part = rows.select("part_").distinct().withColumn("next_", F.lead("part_").over(W.orderBy("part_")))  # a number a task
    edge = edge.join(small_side(next_part), "part_").where("next_ is not null")
    edge = edge.select(F.col("next_").alias("to_"), *(F.col(c).alias(f"by_{k}_") for k, c in enumerate(by)), *(F.col(c).alias(f"got_{k}_") for k, c in enumerate(take)), F.lit(True).alias("met_"))
    same = F.col("met_")
    for k, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"by_{k}_"))
    begin = seen.where("first_").join(edge, F.col("part_") == F.col("to_"), "left")
    begin = begin.select(*df.columns, *(F.when(same, F.col(f"got_{k}_")).alias(f"previous_{c}") for k, c in enumerate(take)))
    return seen.where("not first_").select(*df.columns, *(f"previous_{c}" for c in take)).union(begin)


def with_number(df: DataFrame, by: list[str], order: list[str], name: str, partitions: int | None = None) -> DataFrame:
    """df with each row's place in its group, from 1, as column name. A group of any size is in as many tasks as its size asks
    for; each task tells how many rows of each group it has, and running sums over these give where its numbers begin."""
    spark, fields = df.sparkSession, dict(df.dtypes)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order).withColumn("part_", F.spark_partition_id().cast("long"))
    rows = kept_in_order(rows)
    names = rows.columns
    of = [names.index(c) for c in by]

    def run(batches: Batches) -> Batches:
        last, at = None, 0
        for b in batches:
            keys = list(zip(*(b.column(c).to_pylist() for c in of)))
            number = np.empty(len(keys), np.int64)
            for k, key in enumerate(keys):
                at = at + 1 if key == last else 1
                last, number[k] = key, at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(number)], names=[*names, "own_"])

    schema = ", ".join([*(f"`{c}` {fields.get(c, 'long')}" for c in rows.columns), "own_ long"])
    counts = rows.groupBy("part_", *by).agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(W.partitionBy(*by).orderBy("part_").rowsBetween(W.unboundedPreceding, -1))  # a number a task
    begin = small_side(counts.select(F.col("part_").alias("of_"), *(F.col(c).alias(f"by_{k}_") for k, c in enumerate(by)), F.coalesce(before, F.lit(0)).alias("before_")))
    numbered = rows.mapInArrow(run, schema)
    same = F.col("part_") == F.col("of_")
    for k, c in enumerate(by):
        same = same & numbered[c].eqNullSafe(F.col(f"by_{k}_"))
    return numbered.join(begin, same).select(*df.columns, (F.col("before_") + F.col("own_")).alias(name))


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    both = pc.and_(pc.is_null(a), pc.is_null(b))
    return np.asarray(pc.or_(pc.fill_null(pc.equal(a, b), False), both))
