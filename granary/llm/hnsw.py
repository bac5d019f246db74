"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph for each shard.

Distinct vectors are dealt to shards of similar length (norms within a factor of two), a shard's vectors get one further
component that brings all to the same norm, so that the largest inner product is the nearest point. A shard's nodes stand in
order of their layers, so layer l is the first n / 16**l of them, and its graph is one flat array: a row of neighbours for
each node, padded with the number of nodes. Queries go to every shard and the shards' best are merged.

Nodes are inserted and queries walked in blocks: a step of the walk expands the best nodes of all queries of a block at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable
from granary.llm.vafile import matrix, same_width

SHARD = 32_768  # most vectors of a shard
SHARDS = 16  # as many shards at least, where each has LEAST vectors
LEAST = 1024
LINKS = 16  # links a new node makes; on the lowest layer a node keeps twice as many
BUILD = 64  # width of the walk that finds them
WIDTH = 128  # width of a query's walk
FAN = 16  # a layer has this many times the nodes of the one above
BLOCK = 256
EXPAND = 4

FINE = "vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"


def _walk(points: np.ndarray, links: np.ndarray, asks: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (query, width) found from the entries, best first, and their similarities; number of nodes and -inf where fewer."""
    n, m = links.shape
    q = len(asks)
    ids, sims, done = np.full((q, width), n), np.full((q, width), -np.inf, np.float32), np.zeros((q, width), bool)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    each = np.arange(q)
    ids[:, 0], seen[each, entry] = entry, True
    sims[:, 0] = np.einsum("qd,qd->q", points[entry], asks)
    live = each
    while len(live):
        left = np.where(done[live] | (ids[live] == n), -np.inf, sims[live])
        at = np.argpartition(-left, min(EXPAND, width) - 1, axis=1)[:, :EXPAND]
        some = np.take_along_axis(left, at, 1) > -np.inf
        go = some.any(1)
        live, at, some = live[go], at[go], some[go]
        if not len(live):
            break
        done[live[:, None], at] |= some
        node = np.where(some, ids[live[:, None], at], n)
        near = np.full((len(live), at.shape[1], m), n)
        near[node < n] = links[node[node < n]]
        near = np.sort(near.reshape(len(live), -1), axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        near[seen[live[:, None], near]] = n
        seen[live[:, None], near] = True
        fresh = near < n
        new = np.full(near.shape, -np.inf, np.float32)
        row, col = np.nonzero(fresh)
        new[row, col] = np.einsum("pd,pd->p", points[near[row, col]], asks[live[row]])
        all_sims, all_ids = np.hstack([sims[live], new]), np.hstack([ids[live], near])
        all_done = np.hstack([done[live], np.zeros(near.shape, bool)])
        best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        sims[live], ids[live], done[live] = (np.take_along_axis(x, best, 1) for x in (all_sims, all_ids, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _choose(points: np.ndarray, cand: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
    """At most keep of each row's candidates: nearest first, those nearer to one kept than to the row's own come last."""
    n, (rows, width) = len(points), cand.shape
    order = np.argsort(-sims, axis=1, kind="stable")
    cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
    valid = cand < n
    g = points[np.minimum(cand, n - 1)]
    between = g @ g.transpose(0, 2, 1)
    kept = np.zeros((rows, width), bool)
    for c in range(width):
        hidden = (kept & (between[:, c] > sims[:, c, None])).any(1)
        kept[:, c] = valid[:, c] & ~hidden & (kept.sum(1) < keep)
    order = np.argsort(np.where(kept, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
    out = np.take_along_axis(cand, order, 1)
    return np.pad(out, ((0, 0), (0, keep - out.shape[1])), constant_values=n)


def _link_back(points: np.ndarray, links: np.ndarray, degree: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """The chosen nodes link to the new ones too; a node with too many chooses anew."""
    n, most = links.shape
    to, frm = chosen.ravel(), np.repeat(new, chosen.shape[1])
    to, frm = to[to < n], frm[to < n]
    near = np.einsum("pd,pd->p", points[to], points[frm])
    order = np.lexsort((-near, to))
    to, frm = to[order], frm[order]
    at = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(to) else np.zeros(0, np.int64)
    count = np.diff(np.r_[at, len(to)])
    rank = np.arange(len(to)) - np.repeat(at, count)
    heads = to[at]
    room = degree[heads] + count <= most
    easy = np.repeat(room, count)
    links[to[easy], degree[to[easy]] + rank[easy]] = frm[easy]
    degree[heads[room]] += count[room]
    full = heads[~room]
    if not len(full):
        return
    extra = np.full((len(full), most), n)
    place = np.full(n + 1, -1)
    place[full] = np.arange(len(full))
    pick = ~easy & (rank < most)
    extra[place[to[pick]], rank[pick]] = frm[pick]
    width = int(min(most, count[~room].max()))
    for s in range(0, len(full), BLOCK):
        own = full[s : s + BLOCK]
        cand = np.hstack([links[own], extra[s : s + BLOCK, :width]])
        sims = np.where(cand < n, np.einsum("rcd,rd->rc", points[np.minimum(cand, n - 1)], points[own]), -np.inf)
        links[own] = _choose(points, cand, sims, most)
        degree[own] = (links[own] < n).sum(1)


def layer_sizes(n: int) -> list[int]:
    """Nodes of each layer, the lowest first."""
    out = [n]
    while out[-1] > 2 * FAN:
        out.append(-(-out[-1] // FAN))
    return out


def build(points: np.ndarray, links: int = LINKS, width: int = BUILD) -> list[np.ndarray]:
    """Flat neighbour arrays, the lowest layer first, of unit points in random order; a layer's nodes are the first ones."""
    sizes, upper = layer_sizes(len(points)), []
    for level in range(len(sizes) - 1, -1, -1):
        n, most = sizes[level], links * (2 if level == 0 else 1)
        own = points[:n]
        table, degree = np.full((n, most), n), np.zeros(n, np.int64)
        at = 0
        while at < n:
            end = min(n, at + min(BLOCK, max(32, at)))
            new = np.arange(at, end)
            among = own[new] @ own[new].T
            among[np.tril_indices(len(new))] = -np.inf  # of two new nodes the later links to the earlier
            among = among.T
            few = min(len(new), LINKS)
            best = np.argpartition(-among, few - 1, axis=1)[:, :few]
            sims = np.take_along_axis(among, best, 1)
            cand = np.where(sims > -np.inf, best + at, n)
            if at:
                entry = _descend(points, upper, own[new], np.zeros(len(new), np.int64)) if upper else np.zeros(len(new), np.int64)
                found, near = _walk(own, table, own[new], entry, width)
                cand, sims = np.hstack([cand, found]), np.hstack([sims, near])
            chosen = _choose(own, cand, sims.astype(np.float32), links)
            table[new, :links] = chosen
            degree[new] = (chosen < n).sum(1)
            _link_back(own, table, degree, new, chosen)
            at = end
        alone = np.flatnonzero(np.bincount(table[table < n], minlength=n) == 0)
        for i in alone[table[alone, 0] < n]:  # no node leads here: its nearest one does
            s = table[i, 0]
            table[s, min(degree[s], most - 1)] = i
            degree[s] = min(degree[s] + 1, most)
        upper.append(table)
    return upper[::-1]


def _descend(points: np.ndarray, upper: list[np.ndarray], asks: np.ndarray, entry: np.ndarray) -> np.ndarray:
    """Entries for the next layer below: upper holds the layers above it, the highest first."""
    for table in upper:
        entry = _walk(points[: len(table)], table, asks, entry, EXPAND)[0][:, 0]
    return entry


def search(points: np.ndarray, layers: list[np.ndarray], asks: np.ndarray, width: int) -> np.ndarray:
    """Nodes nearest to each query, number of nodes where fewer. A walk as wide as the shard is all of it."""
    if width >= len(points):
        return np.tile(np.arange(len(points)), (len(asks), 1))
    out = []
    for s in range(0, len(asks), BLOCK):
        part = asks[s : s + BLOCK]
        entry = _descend(points, layers[:0:-1], part, np.zeros(len(part), np.int64))
        out.append(_walk(points, layers[0], part, entry, width)[0])
    return np.concatenate(out)


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Unit points whose nearness to a query without the further component goes by inner product."""
    x = vectors / np.abs(vectors).max()
    norms = np.linalg.norm(x, axis=1)
    x, norms = x / norms.max(), norms / norms.max()
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - norms**2))[:, None]]).astype(np.float32)


INDEX = "shard long, n long, vectors binary, vec_ids binary, times binary, of binary, links binary"


def hnsw_index(vectors: DataFrame, k: int = 20, shard: int = SHARD) -> DataFrame:
    """vectors(vec_id, embedding) -> one row per shard: its vectors, their ids and the flat neighbour arrays of its layers.

    Every vector that is not null, empty or zero and holds no null or non-finite component is indexed; rows with a null
    vec_id are left out. Of equal vectors, which are one node, the k + 1 smallest ids are kept: no other can be among the k
    best of a query. Repeated rows count each.
    """
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v")).where(FINE)
    rows = rows.groupBy("vec_id", "v").agg(F.count("*").alias("times"))
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("v").orderBy("vec_id"))).where(F.col("place") <= k + 1)
    item = F.struct("vec_id", F.least("times", F.lit(k)).alias("times"))
    most = F.array_max(F.transform("v", F.abs))
    band = F.floor(F.log2(most) + F.log2(F.aggregate("v", F.lit(0.0), lambda s, x: s + x / F.col("most") * (x / F.col("most")))) / 2)
    nodes = durable(first.groupBy("v").agg(F.sort_array(F.collect_list(item)).alias("ids")).withColumn("most", most).withColumn("band", band).drop("most"))
    counts = nodes.groupBy("band").agg(F.count("*").alias("n")).collect()  # a few thousand bands at most: the exponents of a double
    size = min(shard, max(LEAST, -(-sum(r.n for r in counts) // SHARDS)))
    bands, start = [], 0
    for r in sorted(counts, key=lambda r: r.band):
        bands.append((r.band, start, -(-r.n // size)))
        start += bands[-1][2]
    plan = vectors.sparkSession.createDataFrame(bands, "band long, start long, parts long")
    dealt = nodes.join(F.broadcast(plan), "band").select((F.col("start") + F.pmod(F.xxhash64("v"), "parts")).alias("shard"), F.xxhash64("v", F.lit(1)).alias("place"), "v", "ids")

    def run(batches: Batches) -> Batches:
        for key, t in _shards(batches):
            v = matrix(t.column("v"), float)
            ids = t.column("ids").combine_chunks()
            sizes = np.diff(ids.offsets.to_numpy())
            flat = ids.flatten()
            order = np.random.default_rng(key).permutation(len(v))
            place = np.empty(len(v), np.int64)
            place[order] = np.arange(len(v))
            layers = build(lifted(v[order]))
            numbers, times = (flat.field(c).to_numpy(zero_copy_only=False).astype("<i8") for c in ("vec_id", "times"))
            links = np.concatenate([x.ravel() for x in layers]).astype("<i4")
            blobs = [v[order].astype("<f8"), numbers, times, np.repeat(place, sizes).astype("<i4"), links]
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([len(v)]), *(pa.array([x.tobytes()], pa.binary()) for x in blobs)], names=["shard", "n", "vectors", "vec_ids", "times", "of", "links"])

    return durable(dealt.repartition(max(1, start), "shard").sortWithinPartitions("shard", "place").mapInArrow(run, INDEX))


def _shards(batches: Batches):
    """(shard, its rows) of batches in order of shard."""
    held, key = [], None
    for rows in batches:
        keys = rows.column(rows.schema.get_field_index("shard")).to_numpy()
        cuts = np.r_[0, np.flatnonzero(keys[1:] != keys[:-1]) + 1, len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                if held and keys[a] != key:
                    yield int(key), pa.Table.from_batches(held)
                    held = []
                key = keys[a]
                held.append(rows.slice(a, b - a))
    if held:
        yield int(key), pa.Table.from_batches(held)


class Shard:
    """One row of the index, ready for queries."""

    def __init__(self, n: int, vectors: bytes, vec_ids: bytes, times: bytes, of: bytes, links: bytes):
        self.vectors = np.frombuffer(vectors, "<f8").reshape(n, -1)
        self.points = lifted(self.vectors)
        self.layers, flat, at = [], np.frombuffer(links, "<i4"), 0
        for level, size in enumerate(layer_sizes(n)):
            m = LINKS * (2 if level == 0 else 1)
            self.layers.append(flat[at : at + size * m].reshape(size, m).astype(np.int64))
            at += size * m
        self.ids, self.times, of = (np.frombuffer(x, t) for x, t in ((vec_ids, "<i8"), (times, "<i8"), (of, "<i4")))
        order = np.argsort(of, kind="stable")
        self.ids, self.times = self.ids[order], self.times[order]
        self.start = np.r_[0, np.cumsum(np.bincount(of, minlength=n))]

    def best(self, query_ids: np.ndarray, asks: np.ndarray, k: int, width: int):
        """(query_id, vec_id, score, times) of the k best found in the shard, the query's own id left out."""
        vectors, asks = same_width(self.vectors, asks)
        n, out = len(vectors), []
        unit = asks / np.abs(asks).max(1, keepdims=True)
        unit = (unit / np.linalg.norm(unit, axis=1, keepdims=True)).astype(np.float32)
        points = self.points
        if vectors.shape[1] > points.shape[1] - 1:
            unit = unit[:, : points.shape[1] - 1]
        unit = np.pad(unit, ((0, 0), (0, points.shape[1] - unit.shape[1])))
        for s in range(0, len(asks), BLOCK):
            node = search(points, self.layers, unit[s : s + BLOCK], width)
            row, col = np.nonzero(node < n)
            node, row = node[row, col], row + s
            with np.errstate(over="ignore", invalid="ignore"):
                score = np.einsum("pd,pd->p", vectors[node], asks[row])
            each = self.start[node + 1] - self.start[node]
            at = np.repeat(self.start[node] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
            row, score, vec, times = np.repeat(row, each), np.repeat(score, each), self.ids[at], self.times[at]
            own = vec == query_ids[row]
            row, score, vec, times = (x[~own] for x in (row, score, vec, times))
            order = np.lexsort((vec, -score, row))
            row, score, vec, times = (x[order] for x in (row, score, vec, times))
            first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            rank = np.arange(len(row)) - np.repeat(first, np.diff(np.r_[first, len(row)]))
            pick = rank < k
            out.append((query_ids[row[pick]], vec[pick], score[pick], times[pick]))
        return [np.concatenate(c) for c in zip(*out)]


def nearest(vectors: DataFrame, is_query, k: int = 20, width: int = WIDTH, shard: int = SHARD, index: DataFrame | None = None) -> DataFrame:
    """vectors(vec_id, embedding) -> query_id, rank, vec_id, score: each query's k nearest found, nearest first.

    Nearness is the inner product in double precision, ties go to the smaller vec_id. is_query: condition naming the query
    rows; candidates are all rows but those of the query's own vec_id, and all of them come back where they are k or fewer.
    Rows that are null, empty or zero or hold null or non-finite components, and rows with a null vec_id, take no part.
    Shorter vectors count as padded with zeros. Of several vectors under one queried vec_id the least in order of components
    asks; as candidates they count each, repeated rows too. Scores beyond a double are infinite. Other columns are ignored;
    no queries or an empty table give no rows. The index is made at once, unless one of hnsw_index() over the same vectors,
    with the same k or more, is given. Shards hold whole graphs: a lost executor costs its own shards' walks only.
    """
    if k < 1:
        raise ValueError("k must be positive")
    index = hnsw_index(vectors, k, shard) if index is None else index
    rows = vectors.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("v"), is_query.alias("asks")).where(FINE)
    asked = rows.where("asks").groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    shards = index.agg(F.max("shard")).first()[0]
    null = lambda kind: F.lit(None).cast(kind)
    blobs = ["n", "vectors", "vec_ids", "times", "of", "links"]
    graphs = index.select("shard", F.lit(0).alias("k"), null("long").alias("query_id"), null("array<double>").alias("v"), *blobs)
    everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shards if shards is not None else 0).cast("long"))).alias("shard")
    asking = asked.select(everywhere, F.lit(1).alias("k"), "query_id", "v", null("long").alias("n"), *(null("binary").alias(c) for c in blobs[1:]))

    def run(batches: Batches) -> Batches:
        graph, of = None, None
        for rows in batches:
            t = pa.Table.from_batches([rows])
            keys, kinds = t.column("shard").to_numpy(), t.column("k").to_numpy()
            cuts = np.r_[0, np.flatnonzero((keys[1:] != keys[:-1]) | (kinds[1:] != kinds[:-1])) + 1, len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if kinds[a] == 0:
                    graph, of = Shard(*(t.column(c)[int(a)].as_py() for c in blobs)), keys[a]
                elif graph is not None and of == keys[a]:
                    ask = t.slice(a, b - a)
                    found = graph.best(ask.column("query_id").to_numpy(), matrix(ask.column("v"), float), k, max(width, k + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score", "times"])

    met = graphs.union(asking).repartition(max(1, (shards or 0) + 1), "shard").sortWithinPartitions("shard", "k")
    found = met.mapInArrow(run, "query_id long, vec_id long, score double, times long")
    found = found.select("query_id", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), "times"))).drop("col")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
