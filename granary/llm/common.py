"""Shared pieces: durable intermediate results, connected components, Arrow helpers."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


Batches = Iterator[pa.RecordBatch]


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the session's checkpoint folder; make one only for a master on this machine alone (tests), else raise."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="granary-"))


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 16 << 20


@contextmanager
def settings(spark: SparkSession, **wanted: str):
    """Session settings for the time of a block; afterwards each is as it was, unset if it was not set."""
    wanted = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.getAll.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def durable(df: DataFrame, partitioned: bool = False) -> DataFrame:
    """Reliable checkpoint: cuts the lineage and survives lost executors; the shuffle files behind it are let go.

    Arrow batches hold BATCH_BYTES at most, as texts of ten thousand rows would take many times that beside the heap.

    partitioned: plan without adaptive execution, so that later joins know the result's hash partitioning and leave it.
    """
    ensure_checkpoint_dir(df.sparkSession)
    wanted = {_CLEANUP: "true", _ARROW_BYTES: str(BATCH_BYTES)} | ({"spark.sql.adaptive.enabled": "false"} if partitioned else {})
    with settings(df.sparkSession, **wanted):
        return df.checkpoint(eager=True)


def release(*spent: DataFrame) -> None:
    """Delete the files of durable() results that nothing reads any more."""
    for df in spent:
        jvm = df.sparkSession.sparkContext._jvm
        file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
        if file.isDefined():
            path = jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FINISH = 1 << 18


def _settle(batches: Batches) -> Batches:
    """(node, smallest node of its component) of all edges given."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = y
        return x

    for rows in batches:
        for a, b in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["k", "p"])


def connected_components(edges: DataFrame, finish: int = FINISH) -> DataFrame:
    """Components of an undirected graph given as (src, dst) rows -> (node, component = smallest node reachable).

    Contraction: every node takes the first of itself and its neighbours as parent, edges are rewritten to parents and
    made distinct, labels follow. First is the smallest id in round one, which settles stars round their smallest node,
    then the smallest of a hash drawn anew each round, which leaves a constant share of the nodes on average whatever
    the shape: some log(nodes) rounds, and no limit on them, as each round merges every component further. Minima
    are combined map-side and all joins are plain equi-joins that adaptive execution may split, so a star with millions
    of leaves is no single task. Each round is checkpointed and the one before deleted; only the number of edges left reaches
    the driver. Once no more than FINISH are left, rounds would cost more than they do: one task settles them, whatever the
    size of the input, with the same result.
    Self-loops give a component of one; null ends are ignored; an empty input gives an empty result.
    """
    e = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).where("a is not null and b is not null")
    e = durable(e.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("comp", F.col("node"))
    spent, e, turn = [e], e.where("a <> b"), 0
    while (left := e.count()) > finish:
        order = (lambda c: F.col(c)) if not turn else (lambda c, t=turn: F.xxhash64(c, F.lit(t)))
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(order("b").alias("o"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(order("a").alias("o"), F.col("a").alias("n"))
        parent = least.select(F.col("a").alias("k"), F.least(own, "m")["n"].alias("p"))
        labels = durable(labels.join(parent, labels.comp == parent.k, "left").select("node", F.coalesce("p", "comp").alias("comp")))
        pa_, pb_ = parent.select(F.col("k").alias("ka"), F.col("p").alias("x")), parent.select(F.col("k").alias("kb"), F.col("p").alias("y"))
        e = e.join(pa_, e.a == pa_.ka).join(pb_, F.col("b") == pb_.kb).where("x <> y")
        e = durable(e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        release(*spent)
        spent, turn = [e, labels], turn + 1
    if left:
        root = e.coalesce(1).mapInArrow(_settle, "k long, p long")
        labels = durable(labels.join(root, labels.comp == root.k, "left").select("node", F.coalesce("p", "comp").alias("comp")))
        release(*spent)
    low = labels.groupBy(F.col("comp").alias("of")).agg(F.min("node").alias("component"))
    return labels.join(low, labels.comp == low.of).select("node", "component")


def batches_of(rows: pa.RecordBatch, columns: list[str]) -> list[pa.Array]:
    return [rows.column(rows.schema.get_field_index(c)) for c in columns]


def texts(column: pa.Array) -> list[str]:
    """Whole texts; null counts as empty."""
    return [x or "" for x in column.to_pylist()]


def runs_of(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    n = len(sorted_values)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
    return starts, np.diff(np.r_[starts, n])


PART_BYTES = 8 << 20


def _trim() -> None:
    """Give freed memory back to the system (glibc only), so that idle workers stay small."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def in_parts(batches: Batches, limit: int = PART_BYTES) -> Batches:
    """The same rows in batches of bounded size, so that a worker's memory does not follow the session's batch size."""
    for rows in batches:
        each = max(1, int(rows.num_rows * limit / max(1, rows.nbytes)))
        for at in range(0, max(1, rows.num_rows), each):
            yield rows.slice(at, each)
        pa.default_memory_pool().release_unused()
        _trim()
