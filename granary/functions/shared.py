"""Folders that driver and executors share, and results written to them."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir; under one of this machine only where the master is this machine alone."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = tempfile.mkdtemp(prefix="granary-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Session settings for the time of a block; afterwards each is as it was."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: cuts the lineage, is read by column, and outlives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_order(df: DataFrame) -> DataFrame:
    """A reliable checkpoint: the rows as they stand in their partitions."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        top = spark.conf.get("spark.checkpoint.dir", None)
        spark.sparkContext.setCheckpointDir(top or shared_folder(spark, "kept"))
    return df.checkpoint(eager=True)


SMALL_ROWS = 1 << 17


def small_side(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """The table with the wish to be broadcast where a count finds no more than so many narrow rows; as it is beyond that."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
