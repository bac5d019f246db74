"""Hard negatives for contrastive training, by slots between the positives' upper limits.

An anchor's positives bound the scores of their negatives from above and below. The upper limits, in descending order, cut
the scores into disjoint slots. Blocks of anchors meet blocks of rows; each meeting keeps the first few negatives of each slot,
and these are combined slot by slot. A positive's window is its own slot and those below it, so one merge in descending order
answers all windows, though they overlap: of what is left of a suffix of slots the first few within the lower limit are it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable
from granary.llm.suffix_dedup import _keyed_runs
from granary.llm.vafile import FINE, LOWEST, exact_scores, matrix, within

ANCHORS = 512
BLOCK = 4096


def _first(group: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each group's k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -score, group))
    g = group[order]
    at = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return order[np.arange(len(g)) - np.repeat(at, np.diff(np.r_[at, len(g)])) < k]


def _top(scores: np.ndarray, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of all wanted scores that reach their row's kth wanted one."""
    if scores.shape[1] <= k:
        return np.nonzero(wanted)
    s = np.where(wanted, scores, LOWEST)
    kth = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
    return np.nonzero(wanted & (s >= kth[:, None]))


def _meet(rows: DataFrame, anchors: DataFrame, block: int, n_blocks: int, n_anchor_blocks: int, work, schema: str) -> DataFrame:
    """work(anchor columns, row columns) for each meeting of a block of anchors with a block of rows."""
    numbers = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    part = lambda c, m: F.pmod(F.xxhash64(*c), F.lit(m)).cast("int")
    limits = F.col("uppers") if "uppers" in anchors.columns else F.lit(None).cast("array<long>")
    asks = anchors.select(part(["vec_id"], n_anchor_blocks).alias("ab"), numbers(n_blocks).alias("rb"), F.lit(True).alias("asks"), "vec_id", "label", "v", limits.alias("uppers"))
    cand = rows.select(numbers(n_anchor_blocks).alias("ab"), part(["vec_id", "label", "v"], n_blocks).alias("rb"), F.lit(False).alias("asks"), "vec_id", "label", "v", F.lit(None).cast("array<long>").alias("uppers"))
    met = cand.union(asks).withColumn("pair", F.col("ab").cast("long") * n_blocks + F.col("rb")).drop("ab", "rb")

    def run(batches: Batches) -> Batches:
        for t in _keyed_runs(batches, "pair", 0):
            pair, asks = t.column("pair").to_numpy(), t.column("asks").to_numpy()
            cuts = np.r_[0, np.flatnonzero(pair[1:] != pair[:-1]) + 1, len(pair)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                q, x = t.slice(a, b - a).filter(pa.array(asks[a:b])), t.slice(a, b - a).filter(pa.array(~asks[a:b]))
                if q.num_rows and x.num_rows:
                    yield work(q, x)

    return durable(met.repartition(max(1, n_blocks * n_anchor_blocks), "pair").sortWithinPartitions("pair").mapInArrow(run, schema))


def hard_negatives(vectors: DataFrame, is_anchor, label="label", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, block: int = BLOCK, anchor_block: int = ANCHORS) -> DataFrame:
    """vectors(vec_id, embedding, label) -> anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of floor(scale * x) with the anchor, higher first, ties to the smaller vec_id. is_anchor names
    the anchors, label is a column or its name. An anchor's positives are its first rows of the same label, its own vec_id
    left out; for each of them the first rows of another label with low * p <= 100 * s <= high * p are returned, p being the
    positive's score: none where p is negative. Rows with a null vec_id, label or vector and rows that hold a null or
    non-finite component take no part. Shorter vectors count as padded with zeros; an empty vector scores 0. Equal rows are
    one row; of unequal rows of one vec_id each is a candidate, and the least (by label, then vector) is the anchor. Scores
    are exact at any size; an error says so where one leaves 64 bits. Other columns are ignored. Blocks are made by a hash
    of the row, so a label of a third of all rows is in all of them. Counts run at once.
    """
    if min(positives, negatives) < 1 or not 0 <= low <= high:
        raise ValueError("positives and negatives must be positive, and 0 <= low <= high")
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.where(FINE).select("vec_id", label.cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"), is_anchor.alias("asks"))
    rows = durable(rows.where("label is not null").distinct())
    anchors = durable(rows.where("asks").groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"))
    n_blocks, n_anchor_blocks = max(1, -(-rows.count() // block)), max(1, -(-anchors.count() // anchor_block))
    meet = lambda a, work, schema: _meet(rows, a, block, n_blocks, n_anchor_blocks, work, schema)
    columns = lambda t: (t.column("vec_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("v"), float))

    def near(q: pa.Table, x: pa.Table) -> pa.RecordBatch:
        (qi, ql, qv), (xi, xl, xv) = columns(q), columns(x)
        score = exact_scores(qv, xv, scale)
        i, j = _top(score, (ql[:, None] == xl) & (qi[:, None] != xi), positives)
        pick = _first(i, score[i, j], xi[j], positives)
        i, j = i[pick], j[pick]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (qi[i], xi[j], score[i, j])], names=["anchor_id", "positive_id", "positive_score"])

    found = meet(anchors, near, "anchor_id long, positive_id long, positive_score long")
    order = W.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    pos = durable(found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).withColumn("positive_score", within(F.col("positive_score"))))
    limit = F.floor(F.col("positive_score").cast("decimal(25,0)") * high / 100).cast("long")
    limits = pos.groupBy("anchor_id").agg(F.sort_array(F.collect_set(limit), asc=False).alias("uppers"))  # at most `positives` of them
    asking = anchors.join(limits, anchors.vec_id == limits.anchor_id).select("vec_id", "label", "v", "uppers")

    def slots(q: pa.Table, x: pa.Table) -> pa.RecordBatch:
        (qi, ql, qv), (xi, xl, xv) = columns(q), columns(x)
        score = exact_scores(qv, xv, scale)
        uppers = q.column("uppers").to_pylist()
        most = max(map(len, uppers))
        bound = np.array([[*u, *[LOWEST] * (most + 1 - len(u))] for u in uppers])  # slot s: bound[s + 1] < score <= bound[s]
        other, out = ql[:, None] != xl, []
        for s in range(most):
            wanted = other & (score <= bound[:, s, None]) & (score > bound[:, s + 1, None])
            i, j = _top(score, wanted, negatives)
            pick = _first(i, score[i, j], xi[j], negatives)
            i, j = i[pick], j[pick]
            out.append((qi[i], np.full(len(i), s), xi[j], score[i, j]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "slot", "negative_id", "negative_score"])

    found = meet(asking, slots, "anchor_id long, slot long, negative_id long, negative_score long")
    order = W.partitionBy("anchor_id", "slot").orderBy(F.desc("negative_score"), "negative_id")
    best = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= negatives)
    best = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("slot")).alias("slot"), F.col("negative_score").alias("score"), (-F.col("negative_id")).alias("id"))), asc=False).alias("merged"))
    upper = F.array_position("uppers", limit) - 1
    p = pos.join(limits, "anchor_id").select("anchor_id", "positive_id", "positive_score", upper.alias("slot")).join(best, "anchor_id")
    suffix = F.slice(F.filter("merged", lambda m: -m["slot"] >= F.col("slot")), 1, negatives)
    p = p.select("anchor_id", "positive_id", "positive_score", F.posexplode(suffix).alias("rank", "m"))
    fits = F.col("m.score").cast("decimal(25,0)") * 100 >= F.col("positive_score").cast("decimal(25,0)") * low
    out = p.where(fits & (F.col("positive_score") >= 0))
    return out.select("anchor_id", "positive_id", (F.col("rank") + 1).cast("int").alias("rank"), (-F.col("m.id")).alias("negative_id"), "positive_score", F.col("m.score").alias("negative_score"))


ORACLE = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end label, list_transform(embedding, lambda x: cast(floor(cast(x as double) * 256) as bigint)) v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select a.vec_id anchor_id, c.vec_id, a.label = c.label same, cast(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * c.v[i])) as bigint) score
  from v a join v c on a.vec_id % 50 = 0 and a.vec_id <> c.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
n as (select p.*, s.vec_id negative_id, s.score negative_score from p join s on p.anchor_id = s.anchor_id and not s.same and 50 * positive_score <= 100 * s.score and 100 * s.score <= 95 * positive_score),
r as (select *, cast(row_number() over (partition by anchor_id, positive_id order by negative_score desc, negative_id) as integer) rank from n)
select anchor_id, positive_id, rank, negative_id, positive_score, negative_score from r where rank <= 3"""
