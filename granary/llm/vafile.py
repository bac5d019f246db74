"""Exact top-k by inner product with vector-approximation files.

Every vector has an approximation, a byte per component: its cell when the components are cut to the vector's own scale. A
cell bounds the score with a query from both sides. The cells are scanned first: blocks of queries meet blocks of cells,
and what cannot be among a query's k best by the bounds goes. Exact vectors are then read for the rest alone, in two
steps: the k of the highest upper bounds, whose kth score then rules out all others that cannot reach it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable
from granary.llm.suffix_dedup import _keyed_runs

QUERY_BLOCK = 2048
BLOCK = 8192


def matrix(column: pa.Array | pa.ChunkedArray, dtype) -> np.ndarray:
    """Rows of a list column, padded with zeros to the longest."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy())
    width = int(sizes.max()) if len(sizes) else 0
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


FINE = "vec_id is not null and embedding is not null and not exists(embedding, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
LOWEST, HIGHEST = -(2**63), 2**63 - 1  # stand for scores beyond 64 bits
UNBOUND = 2046  # shift of a vector whose scaled components leave the doubles: its cells tell nothing


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as doubles, which hold such numbers exactly; infinite where a double cannot."""
    with np.errstate(over="ignore"):
        return np.floor(vectors * float(scale))


def _whole_ints(row: np.ndarray, scale: int) -> list[int]:
    """The same as integers of any size: from 2**53 on a double is a whole number, so nothing is left to cut off."""
    return [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in row.tolist()]


def _dot(a: list[int], b: list[int]) -> int:
    return min(max(sum(x * y for x, y in zip(a, b)), LOWEST), HIGHEST)


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both with zeros up to the wider one's width."""
    d = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, d - x.shape[1]))) for x in (a, b))


def exact_scores(queries: np.ndarray, vectors: np.ndarray, scale: int) -> np.ndarray:
    """Inner products of floor(scale * x) as 64-bit integers, query by vector; LOWEST and HIGHEST for what lies beyond.

    Sums below 2**53 are exact as doubles. Rows too large for that are multiplied as integers of any size."""
    queries, vectors = same_width(queries, vectors)
    a, b = whole(queries, scale), whole(vectors, scale)
    small = np.sqrt(2.0**53 / max(1, a.shape[1]))
    big_a, big_b = np.abs(a).max(1, initial=0) >= small, np.abs(b).max(1, initial=0) >= small
    out = (np.where(big_a[:, None], 0, a) @ np.where(big_b[:, None], 0, b).T).astype(np.int64)
    if big_a.any() or big_b.any():
        left, right = [_whole_ints(r, scale) for r in queries], [_whole_ints(r, scale) for r in vectors]
        for i, j in zip(*np.nonzero(big_a[:, None] | big_b[None, :])):
            out[i, j] = _dot(left[i], right[j])
    return out


def exact_pairs(queries: np.ndarray, vectors: np.ndarray, scale: int) -> np.ndarray:
    """The same for pairs of rows."""
    queries, vectors = same_width(queries, vectors)
    a, b = whole(queries, scale), whole(vectors, scale)
    with np.errstate(over="ignore"):
        fits = np.abs(a).max(1, initial=0) * np.abs(b).max(1, initial=0) * max(1, a.shape[1]) < 2.0**53
    out = np.einsum("pd,pd->p", np.where(fits[:, None], a, 0), np.where(fits[:, None], b, 0)).astype(np.int64)
    for i in np.flatnonzero(~fits):
        out[i] = _dot(_whole_ints(queries[i], scale), _whole_ints(vectors[i], scale))
    return out


def within(score) -> Column:
    """The score, or an error where it left 64 bits."""
    return F.when(score.isin(LOWEST, HIGHEST), F.raise_error(F.lit("a score is beyond 64 bits")).cast("long")).otherwise(score)


def cells(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a byte per component, shift of each vector) of whole numbers: a component v lies in [c * 2**shift, (c + 1) * 2**shift - 1]."""
    most = np.maximum(vectors, -vectors - 1).max(1, initial=0)
    endless = ~np.isfinite(most)
    shift = np.where(endless, UNBOUND, np.maximum(0, np.ceil(np.log2(np.where(endless, 0, most) + 1.0)) - 7)).astype(np.int64)
    cell = np.floor(np.ldexp(np.where(endless[:, None], 0, vectors), -shift[:, None]))
    over = (cell > 127).any(1) | (cell < -128).any(1)  # the logarithm was rounded down
    shift[over & ~endless] += 1
    return np.floor(np.ldexp(np.where(endless[:, None], 0, vectors), -shift[:, None])).astype(np.int8), shift


def bounds(queries: np.ndarray, cell: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the scores, query by candidate, in whole numbers as doubles, each moved out by the rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        unit = np.ldexp(1.0, np.minimum(shift, 1023))
        low = queries @ cell.T.astype(float) * unit
        slack = unit - 1
        down, up = np.minimum(queries, 0).sum(1), np.maximum(queries, 0).sum(1)
        eps = np.abs(queries).sum(1)[:, None] * unit * 2.0**-33
        lower, upper = low + down[:, None] * slack - eps, low + up[:, None] * slack + eps
    unknown = (shift == UNBOUND)[None, :] | ~np.isfinite(lower) | ~np.isfinite(upper)
    return np.where(unknown, -np.inf, lower), np.where(unknown, np.inf, upper)


def scan_block(queries: np.ndarray, query_ids: np.ndarray, cell: np.ndarray, shift: np.ndarray, ids: np.ndarray, k: int):
    """(query, candidate, lower, upper) of those whose upper bound reaches the kth lower bound of the block."""
    out = []
    for at in range(0, len(queries), 256):
        own = query_ids[at : at + 256, None] == ids
        lower, upper = bounds(queries[at : at + 256], cell, shift)
        lower[own], upper[own] = -np.inf, -np.inf
        kth = np.partition(lower, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
        i, j = np.nonzero((upper >= kth[:, None]) & ~own)
        out.append((query_ids[at + i], ids[j], lower[i, j], upper[i, j]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 2


def top_k(vectors: DataFrame, is_query, k: int = 10, scale: int = 1024, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: the k highest inner products of floor(scale * x).

    is_query: condition naming the query rows; candidates are all other rows, rows with the query's own vec_id left out,
    ties to the smaller vec_id. Vectors that are null or hold null or non-finite components, and rows with a null vec_id,
    take no part. Shorter vectors count as padded with zeros. Repeated rows are candidates each, and one query. Of equal
    candidates those of the k + 1 smallest ids alone can be among the k best and go on. Fewer than k candidates: all of
    them. Other columns are ignored. Components may be of any size: scores are exact, and only a score among the k best that
    leaves 64 bits is an error. Counts and the scan of the cells run at once.
    """
    if k < 1:
        raise ValueError("k must be positive")
    ints = vectors.where(FINE).select("vec_id", is_query.alias("asks"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"))
    same = W.partitionBy("same").orderBy("vec_id")
    ints = durable(ints.groupBy("vec_id", "v").agg(F.count("*").alias("rows"), F.max("asks").alias("asks")).withColumn("same", F.xxhash64("v", F.size("v"))))
    cand = ints.withColumn("n", F.row_number().over(same)).where(F.col("n") <= k + 1).select("vec_id", "v", F.least("rows", F.lit(k)).cast("int").alias("rows"))
    asked = ints.where("asks").select("vec_id", "v")

    def approximate(batches: Batches) -> Batches:
        for b in batches:
            lists = b.column(1)
            sizes = np.diff(lists.offsets.to_numpy())
            out = [None] * len(sizes)
            for d in np.unique(sizes):
                which = np.flatnonzero(sizes == d)
                cell, shift = cells(whole(matrix(lists.take(pa.array(which)), float), scale))
                for i, c, s in zip(which, cell, shift):
                    out[i] = int(s).to_bytes(2, "little") + c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=["vec_id", "cell"])

    n, nq = cand.count(), asked.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-nq // query_block))
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    scanned = cand.select("vec_id", "v").mapInArrow(approximate, "vec_id long, cell binary").select(numbers(query_blocks).alias("qb"), part(blocks).alias("cb"), "vec_id", "cell", F.lit(None).cast("array<double>").alias("v"))
    asking = asked.select(part(query_blocks).alias("qb"), numbers(blocks).alias("cb"), "vec_id", F.lit(None).cast("binary").alias("cell"), "v")
    met = scanned.union(asking).select((F.col("qb").cast("long") * blocks + F.col("cb")).alias("pair"), "vec_id", "cell", "v")

    def scan(batches: Batches) -> Batches:
        for t in _keyed_runs(batches, "pair", 0):
            pair, ids, cell, v = (t.column(c).combine_chunks() for c in ("pair", "vec_id", "cell", "v"))
            pair, ids, query = pair.to_numpy(), ids.to_numpy(), np.asarray(v.is_valid())
            cuts = np.r_[0, np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                q, x = np.flatnonzero(query[a:b]) + a, np.flatnonzero(~query[a:b]) + a
                if not len(q) or not len(x):
                    continue
                raw = cell.take(pa.array(x)).to_pylist()
                width = max(1, max(map(len, raw)) - 2)
                asks = whole(matrix(v.take(pa.array(q)), float), scale)
                width = max(width, asks.shape[1])
                table = np.frombuffer(b"".join([r[2:].ljust(width, b"\0") for r in raw]), np.int8).reshape(-1, width)
                asks = np.pad(asks, ((0, 0), (0, width - asks.shape[1])))
                got = scan_block(asks, ids[q], table, np.array([int.from_bytes(r[:2], "little") for r in raw]), ids[x], k)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["query_id", "vec_id", "lower", "upper"])

    left = durable(met.repartition("pair").sortWithinPartitions("pair").mapInArrow(scan, "query_id long, vec_id long, lower double, upper double"))
    order = lambda *by: W.partitionBy("query_id").orderBy(*by)
    sure = left.withColumn("n", F.row_number().over(order(F.desc("lower"), "vec_id"))).where(F.col("n") == k).select("query_id", F.col("lower").alias("bar"))
    live = durable(left.join(sure, "query_id", "left").where("bar is null or upper >= bar").select("query_id", "vec_id", "upper"))

    def dots(batches: Batches) -> Batches:
        for b in batches:
            score = exact_pairs(matrix(b.column(3), float), matrix(b.column(4), float), scale)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(score)], names=["query_id", "vec_id", "rows", "score"])

    def exact(pairs: DataFrame) -> DataFrame:
        both = pairs.join(asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id").join(cand, "vec_id")
        scored = both.select("query_id", "vec_id", "rows", "q", "v").mapInArrow(dots, "query_id long, vec_id long, rows int, score long")
        return scored.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1), "rows"))).drop("col")

    near = live.withColumn("n", F.row_number().over(order(F.desc("upper"), "vec_id"))).where(F.col("n") <= k).select("query_id", "vec_id").distinct()
    read = durable(exact(near))
    kth = read.withColumn("n", F.row_number().over(order(F.desc("score"), "vec_id"))).where(F.col("n") == k).select("query_id", F.col("score").alias("bar"))
    rest = live.join(kth, "query_id", "left").where("bar is null or upper >= bar").select("query_id", "vec_id").distinct()
    rest = rest.join(read.select("query_id", "vec_id").distinct(), ["query_id", "vec_id"], "left_anti")
    best = read.union(exact(rest))
    rank = F.row_number().over(order(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", within(F.col("score")).alias("score"))


ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 1024) as bigint)) v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id query_id, c.vec_id, cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) score
  from v q join v c on q.vec_id % 100 = 0 and q.vec_id <> c.vec_id),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10"""
