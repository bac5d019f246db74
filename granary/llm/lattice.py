"""Near-duplicate vectors by lattice hashing.

A random rotation cuts a vector into blocks of eight numbers; each block is decoded to the nearest point of the E8
lattice. Some blocks' points together name a cell of a table. A vector lies in its own cell and also probes the
neighbouring ones nearest to it; whatever meets in a cell is verified by cosine in double precision. Each found pair is
counted in one meeting place only, by a rule both sides can compute, so counts add up without writing pairs out. Equal
vectors are one, with a weight, so that a vector of many copies is hashed and met once.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Batches, connected_components, durable
from granary.llm.suffix_dedup import _batch, _keyed_runs, runs_of
from granary.llm.vafile import matrix

TABLES = 8
BLOCKS = 2
PROBES = 4
SCALE = 1.3
GROUP = 1024


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of +-1, or all +-1/2 with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out, float)


def _nearest_d8(y: np.ndarray) -> np.ndarray:
    """Nearest integer points with an even sum: where the sum is odd, the worst-rounded entry goes the other way."""
    r = np.rint(y)
    off = y - r
    odd = np.flatnonzero(r.sum(1).astype(np.int64) & 1)
    worst = np.abs(off[odd]).argmax(1)
    r[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
    return r


def nearest_e8(y: np.ndarray) -> np.ndarray:
    """Nearest points of E8, the union of D8 and D8 shifted by 1/2."""
    a, b = _nearest_d8(y), _nearest_d8(y - 0.5) + 0.5
    closer = ((y - b) ** 2).sum(1) < ((y - a) ** 2).sum(1)
    return np.where(closer[:, None], b, a)


def _hash_points(p: np.ndarray, salt: int) -> np.ndarray:
    h = np.full(len(p), salt * 0x9E3779B97F4A7C15 & (2**64 - 1), np.uint64)
    for c in range(p.shape[1]):
        h ^= (2 * p[:, c]).astype(np.int64).view(np.uint64)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def cells(unit: np.ndarray, tables: int, blocks: int, probes: int, scale: float, seed: int = 7) -> np.ndarray:
    """Cell hashes (vector, table, 1 + probes); the first is the vector's own cell."""
    n, d = unit.shape
    out = np.zeros((n, tables, 1 + probes), np.int64)
    shortest = minimal_vectors()
    rng = np.random.default_rng(seed)
    for t in range(tables):
        base = rng.standard_normal((max(d, 8 * blocks), max(d, 8 * blocks)))
        q = np.linalg.qr(base)[0][:d, : 8 * blocks]
        y = unit @ q * (scale * np.sqrt(d / 8))
        points = [nearest_e8(y[:, 8 * b : 8 * b + 8]) for b in range(blocks)]
        out[:, t, 0] = _hash_points(np.hstack(points), t)
        if not probes:
            continue
        gains = np.hstack([(y[:, 8 * b : 8 * b + 8] - points[b]) @ shortest.T for b in range(blocks)])
        best = np.argsort(-gains, axis=1, kind="stable")[:, :probes]
        for k in range(probes):
            b, m = best[:, k] // 240, best[:, k] % 240
            moved = [points[i] + np.where((b == i)[:, None], shortest[m], 0) for i in range(blocks)]
            out[:, t, 1 + k] = _hash_points(np.hstack(moved), t)
    return out


def _meet(cell: np.ndarray, t: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether i reaches j's own cell in table t, and j reaches i's."""
    return (cell[i, t] == cell[j, t, :1]).any(1), (cell[j, t] == cell[i, t, :1]).any(1)


def link_group(unit: np.ndarray, cell: np.ndarray, t: int, here: int, side: np.ndarray, cross: bool, threshold: float):
    """Links first met in this cell of this table: (index pairs). side: which half a row came from, for split groups."""
    home = cell[:, t, 0] == here
    cos = unit @ unit.T
    ok = np.triu(cos >= threshold, 1) & (home[:, None] | home[None, :])
    if cross:
        ok &= side[:, None] != side[None, :]
    i, j = np.nonzero(ok)
    if not len(i):
        return i, j
    fresh = np.ones(len(i), bool)
    for earlier in range(t):
        a, b = _meet(cell, earlier, i, j)
        fresh &= ~(a | b)
    a, b = _meet(cell, t, i, j)
    hj, hi = cell[j, t, 0], cell[i, t, 0]
    place = np.where(a & b, np.minimum(hi, hj), np.where(a, hj, hi))
    fresh &= place == here
    return i[fresh], j[fresh]


def _labels(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each one's component inside a group."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, tables: int = TABLES, blocks: int = BLOCKS, probes: int = PROBES, scale: float = SCALE, group: int = GROUP) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept (vec_id = component_id).

    Links have a cosine of threshold or more; recall is that of the tables. Equal vectors of different vec_ids are links.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing and are components of their
    own. Rows of one vec_id are one vector if equal; of unequal ones each may link, also with each other, and counts add up.
    A null vec_id gets no links and a null component. Vectors of different lengths never link. Other columns are ignored; an
    empty table gives an empty result. blocks should grow by one for each 64-fold growth of the distinct vectors.
    """
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)"
    live = rows.where(fine).distinct()
    classes = durable(live.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w")).withColumn("cid", F.monotonically_increasing_id()))

    def hashed(batches: Batches) -> Batches:
        for b in batches:
            lists = b.column(3)
            sizes = np.diff(lists.offsets.to_numpy())
            out = np.zeros((len(sizes), tables * (1 + probes)), np.int64)
            for d in np.unique(sizes):
                which = np.flatnonzero(sizes == d)
                x = matrix(lists.take(pa.array(which)), float)
                x = x / np.abs(x).max(1, keepdims=True)
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                out[which] = cells(unit, tables, blocks, probes, scale).reshape(len(which), -1) ^ (int(d) << 1)
            flat = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), tables * (1 + probes)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns, flat], names=["vec_id", "rep", "w", "v", "cells"])

    hashes = classes.select(F.col("cid").alias("vec_id"), "rep", "w", "v")
    hashes = durable(hashes.mapInArrow(hashed, "vec_id long, rep long, w long, v array<double>, cells array<long>"))
    places = hashes.select("vec_id", F.posexplode("cells").alias("k", "cell")).select("vec_id", F.floor(F.col("k") / (1 + probes)).cast("int").alias("t"), (F.col("k") % (1 + probes) == 0).alias("home"), "cell").distinct()
    sizes = places.groupBy("t", "cell").agg(F.count("*").alias("n"), F.count_if("home").alias("homes")).where("n > 1 and homes > 0")
    parts = F.ceil(F.col("n") / group).cast("int")
    dealt = places.join(sizes, ["t", "cell"]).select("vec_id", "t", "cell", parts.alias("m"), F.pmod(F.xxhash64("vec_id"), parts).cast("int").alias("s"))
    dealt = dealt.select("vec_id", "t", "cell", "s", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("x"))
    dealt = dealt.select("vec_id", "t", "cell", "s", F.least("s", "x").alias("a"), F.greatest("s", "x").alias("b"))
    full = dealt.join(hashes, "vec_id").select(F.xxhash64("t", "cell", "a", "b").alias("g"), "t", "cell", "s", (F.col("a") != F.col("b")).alias("cross"), "vec_id", "rep", "w", "v", "cells")

    def verify(batches: Batches) -> Batches:
        for tab in _keyed_runs(batches, "g", 0):
            g, t, here, s, cross, ids, rep, weight = (tab.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("g", "t", "cell", "s", "cross", "vec_id", "rep", "w"))
            cell = matrix(tab.column("cells"), np.int64).reshape(len(g), tables, 1 + probes)
            x = matrix(tab.column("v"), float)
            unit = x / np.abs(x).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            out = []
            for at, n in zip(*runs_of(g)):
                if n < 2:
                    continue
                w = slice(at, at + n)
                i, j = link_group(unit[w], cell[w], int(t[at]), int(here[at]), s[w], bool(cross[at]), threshold)
                if len(i):
                    i, j = i + at, j + at
                    used, back = np.unique(np.r_[i, j], return_inverse=True)
                    order = np.argsort(rep[used], kind="stable")
                    place = np.empty(len(used), np.int64)
                    place[order] = np.arange(len(used))
                    label = _labels(len(used), place[back[: len(i)]], place[back[len(i) :]])
                    links = np.bincount(place[back], np.r_[weight[j], weight[i]], len(used)).astype(np.int64)
                    out.append((ids[used][order], links, rep[used][order], rep[used][order][label]))
            if out:
                yield _batch([np.concatenate(c) for c in zip(*out)], ["cid", "links", "rep", "low"])

    found = durable(full.repartition("g").sortWithinPartitions("g").mapInArrow(verify, "cid long, links long, rep long, low long"))
    count = found.groupBy(F.col("cid").alias("of")).agg(F.sum("links").alias("n"))
    sized = classes.join(count, classes.cid == count.of, "left").select("v", "rep", (F.coalesce("n", F.lit(0)) + F.col("w") - 1).alias("n"))
    members = durable(live.join(sized, "v").where("n > 0").select("vec_id", "rep", "n"))
    comp = connected_components(found.select(F.col("low").alias("src"), F.col("rep").alias("dst")).union(members.select("rep", "vec_id")))
    total = members.groupBy(F.col("vec_id").alias("of")).agg(F.sum("n").alias("n"))
    known = comp.join(total, comp.node == total.of).select("node", "component", "n")
    out = rows.select("vec_id").join(known, rows.vec_id == known.node, "left")
    comp_id = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), comp_id.alias("component_id"), (F.col("vec_id") == comp_id).alias("kept"))
