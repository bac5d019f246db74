"""Nearest neighbours, prefix trie, hard negatives, large components and long runs, each against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from granary.llm import hnsw, negatives, packing, prefix_trie, toxicity, vafile
from granary.llm import queries as Q
from granary.llm.suffix_dedup import _keyed_runs

VEC = "vec_id long, embedding array<float>, label int, v string, k int, n long, score double, shard long, place int, rank int"


def vec_frame(spark, rows):
    """Vectors with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, v, label, "x", 1, 2, 0.5, 3, 4, 5) for i, v, label in rows], VEC)


NAN, INF = float("nan"), float("inf")
ODD_VECTORS = [(0, None, 1), (1, [], 1), (20, [0.0, 0.0], 1), (3, [NAN, 1.0], 1), (40, [INF, 1.0], 1), (5, [None, 1.0], 2), (None, [1.0, 1.0], 2), (60, [1.0, 2.0], 1), (60, [1.0, 2.0], 1), (7, [1.0, 2.0], 2), (8, [1.0, 2.0, 3.0], 2), (9, [-1.0], 1), (80, [0.5, 0.5], None)]


# --- nearest neighbours


def brute_nearest(rows, asks, k):
    fine = [(i, np.array(v, np.float32).astype(float)) for i, v, _ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    dot = lambda a, b: float(np.dot(a[: len(b)], b[: len(a)]))
    out = {}
    for q, a in {i: v for i, v in sorted(fine, key=lambda x: (x[0], list(x[1])), reverse=True) if asks(i)}.items():
        out[q] = sorted(((-dot(a, b), i) for i, b in fine if i != q))[:k]
    return out


def test_few_vectors_are_searched_whole(spark):
    got = hnsw.nearest(vec_frame(spark, ODD_VECTORS), F.col("vec_id") % 20 == 0, k=4)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    want = brute_nearest(ODD_VECTORS, lambda i: i % 20 == 0, 4)
    assert sorted(map(tuple, got.collect())) == sorted((q, k + 1, i, -s) for q, best in want.items() for k, (s, i) in enumerate(best))
    assert hnsw.nearest(vec_frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert hnsw.nearest(vec_frame(spark, ODD_VECTORS), F.lit(False)).count() == 0


@pytest.mark.parametrize("kind", ["unit", "norms", "copies"])
def test_recall_of_graphs(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((6000, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if kind == "norms":
        x *= np.exp(rng.uniform(-6, 6, (len(x), 1)))
        x[17] *= 1e6
    if kind == "copies":
        x[rng.permutation(6000)[:2500]] = x[5]
    rows = [(i, v, 0) for i, v in enumerate(x.astype(np.float32).tolist())]
    got = defaultdict(list)
    for r in hnsw.nearest(vec_frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q in range(0, 6000, 20):
        s = x @ x[q]
        best = sorted((-s[i], i) for i in np.argpartition(-s, 2600 if kind == "copies" else 40)[:2600] if i != q)
        near = got[q]
        assert len(near) == 20 and near == sorted(near, key=lambda y: (-y[1], y[0])) and q not in dict(near)
        assert np.allclose([v for _, v in near], s[[i for i, _ in near]], rtol=1e-12, atol=0)
        hits += sum(v >= -best[19][0] * (1 - 1e-12 * np.sign(-best[19][0])) for _, v in near)
    assert hits / (300 * 20) >= 0.95


def test_index_has_every_vector_once(spark, sf_dir):
    rows = Q.table(spark, sf_dir, "embeddings")
    index = hnsw.hnsw_index(rows).collect()
    ids = np.concatenate([np.frombuffer(r.vec_ids, "<i8") for r in index])
    assert sorted(ids.tolist()) == sorted(r.vec_id for r in rows.select("vec_id").collect())
    graph = hnsw.Shard(*(getattr(index[0], c) for c in ("n", "vectors", "vec_ids", "times", "of", "links")))
    assert [len(x) for x in graph.layers] == hnsw.layer_sizes(index[0].n) and graph.layers[0].shape[1] == 2 * hnsw.LINKS


def test_layers_reach_all_nodes():
    x = np.random.default_rng(1).standard_normal((3000, 8))
    points = hnsw.lifted(x)
    for table in hnsw.build(points):
        n = len(table)
        seen, todo = {0}, [0]
        while todo:
            new = {int(j) for i in todo for j in table[i] if j < n} - seen
            seen |= new
            todo = list(new)
        assert len(seen) >= 0.995 * n


# --- prefix trie


def brute_trie(rows, family=5, heads=9):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    whole = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = c - int(np.fmod(c, family))
        whole[c] = tuple(own.get(base, [])[:h] + v[h:])
    members = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1].encode()) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if whole[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


TURNS = "conv_id long, turn long, role string, text string, key string, sizes int, block long, prefix string, own int"


def turn_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, "y", 3) for r in rows], TURNS)


@pytest.mark.parametrize("seed", range(4))
def test_trie_of_random_conversations(spark, seed):
    rng = random.Random(seed)
    rows = []
    for c in range(-6, 160):
        n = rng.choice([0, 1, 2, 3, 5, 9, 12, 30])
        rows += [(c, t if rng.random() < 0.95 else None, rng.choice(["user", "assistant", None]) if rng.random() < 0.2 else "user", rng.choice(["a", "bé", "", None, "ccc", f"q{rng.randrange(30)}"]) if rng.random() < 0.25 else "same") for t in range(n)]
    rows += [(c, t, "user", "common") for c in range(200, 260) for t in range(12)]  # equal conversations over many blocks
    rows += [(300, t, "user", "long") for t in range(700)] + [(305, t, "user", "long") for t in range(650)] + [(301, 1, "user", "x"), (301, 1, "user", "x"), (None, 1, "user", "y")]
    rng.shuffle(rows)
    want = brute_trie(rows)
    for parts, turns in (("1", 1 << 17), ("4", 1 << 17), ("2", 90)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = prefix_trie.prefix_trie(turn_frame(spark, rows), block_turns=turns).collect()
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
        assert sorted(map(tuple, got), key=str) == want, (parts, turns)
    assert len(want) > 1000


def test_trie_of_little(spark):
    empty = hashlib.sha256(b"").hexdigest()
    assert prefix_trie.prefix_trie(turn_frame(spark, [])).count() == 0
    assert prefix_trie.prefix_trie(turn_frame(spark, [(None, 1, "a", "b")])).count() == 0
    short = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9)
    alone = prefix_trie.prefix_trie(turn_frame(spark, [(short, 1, "a", "b")])).collect()  # its first turns go, and there is no base
    assert [tuple(r) for r in alone] == [(short, 0, None, 1, 0, 1, 0, hashlib.sha256(str(short).encode()).hexdigest())]
    both = prefix_trie.prefix_trie(turn_frame(spark, [(0, 1, None, None), (5, 1, "", "")])).orderBy("depth").collect()
    assert [tuple(r)[:7] for r in both] == [(0, 0, None, 2, 1, 1, 0), (0, 1, 0, 2, 0, 1, 0)] and both[0].ends_sha256 == empty and both[1].ends_sha256 == hashlib.sha256(b"0,5").hexdigest()


def test_sparse_table():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 9, 200)
    t = prefix_trie.SparseMinimum(v)
    a = rng.integers(0, 200, 500)
    b = np.minimum(199, a + rng.integers(0, 60, 500))
    assert t.least(a, b).tolist() == [v[x : y + 1].min() for x, y in zip(a, b)]
    for right in (False, True):
        for i, d, got in zip(a, b % 9, t.reach(a, b % 9, right)):
            j = int(i)
            while (j + 1 < 200 and v[j + 1] >= d) if right else (j > 0 and v[j] >= d):
                j += 1 if right else -1
            assert got == j


# --- hard negatives


def brute_negatives(rows, asks, scale=256, positives=5, n=3):
    fine = {}
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine[i] = (label, [int(np.floor(float(np.float32(x)) * scale)) for x in v])
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in fine.items():
        if asks(a):
            s = sorted((-dot(v, w), i, other) for i, (other, w) in fine.items() if i != a)
            for p, i, _ in [x for x in s if x[2] == label][:positives]:
                fits = [x for x in s if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:n]
                out += [(a, i, k + 1, x[1], -p, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


@pytest.mark.parametrize("seed,blocks", [(0, (4096, 512)), (1, (40, 3)), (2, (7, 2))])
def test_hard_negatives_random(spark, seed, blocks):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 12))
    rows = [(int(i), (centres[i % 6] + rng.standard_normal(12) * rng.choice([0.2, 1.5])).round(1).tolist(), None if i % 31 == 0 else 9 if i % 3 == 0 else int(i % 4)) for i in range(400)]
    rows += [(400 + k, rows[3][1], 9) for k in range(60)] + [(500, [-1.0] * 12, 1), (550, [0.0] * 12, 1), (551, [0.0] * 12, 2)]
    got = negatives.hard_negatives(vec_frame(spark, rows), F.col("vec_id") % 50 == 0, block=blocks[0], anchor_block=blocks[1])
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows, lambda i: i % 50 == 0)


def test_hard_negatives_odd_rows(spark):
    ask = F.col("vec_id") % 20 == 0
    rows = ODD_VECTORS + [(100, [1.0, 1.0], 1), (101, [1.0, 1.0], 1), (102, [0.8, 0.8], 2)]
    assert sorted(map(tuple, negatives.hard_negatives(vec_frame(spark, rows), ask).collect())) == brute_negatives(rows, lambda i: i % 20 == 0)
    assert negatives.hard_negatives(vec_frame(spark, []), ask).count() == 0
    big = spark.createDataFrame([(0, [2.0**20, 1.0], 1), (1, [2.0**20, 3.0], 1), (2, [0.7 * 2**20, 1.0], 2), (3, [1e300, 0.0], 2), (4, [-1e300, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = negatives.hard_negatives(big, F.col("vec_id") == 0, positives=1).collect()
    p, s = 2**28 * 2**28 + 256 * 768, 2**28 * int(np.floor(0.7 * 2**20 * 256)) + 256 * 256
    assert [tuple(r) for r in got] == [(0, 1, 1, 2, p, s)]


# --- exact top-k with large components


def test_top_k_of_any_size(spark):
    rng = random.Random(2)
    rows = [(i, [float(np.float64(rng.choice([1, -1]) * rng.random() * 2.0 ** rng.choice([-3, 0, 10, 21, 22]))) for _ in range(3)]) for i in range(120)]
    rows += [(200, [2.0**50, 0.0, 0.0]), (203, [1e-9, 0.0, 0.0]), (300, [2.0**-10, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ints = {i: [int(np.floor(x * 1024)) for x in v] for i, v in rows}
    for ask in (100, 300):
        want = sorted((-sum(a * b for a, b in zip(ints[ask], v)), i) for i, v in ints.items() if i != ask)[:10]
        got = vafile.top_k(df, F.col("vec_id") == ask, block=16).orderBy("rank").collect()
        assert [(-r.score, r.vec_id) for r in got] == want
    far = spark.createDataFrame([(0, [1e300]), (1, [1e300]), (2, [-1e300]), (3, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        vafile.top_k(far, F.col("vec_id") == 0, k=1).collect()
    assert [r.vec_id for r in vafile.top_k(spark.createDataFrame([(0, [2.0]), (1, [-1e300]), (2, [1.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=1).collect()] == [2]


# --- runs of a sorted key


def batch(keys):
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(range(len(keys)), pa.int64())], names=["key", "x"])


def test_keyed_runs_are_whole_and_linear():
    rng = random.Random(1)
    for _ in range(200):
        keys = sorted(rng.randrange(12) for _ in range(rng.randrange(60)))
        cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(rng.randrange(9)))
        parts = [batch(keys[a:b]) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        tables = [t.column("key").to_pylist() for t in _keyed_runs(iter(parts), "key", 0)]
        assert sum(tables, []) == keys
        seen = set()
        for t in tables:
            assert not seen & set(t)
            seen |= set(t)
    took = []
    for n in (100, 400):
        began = time.process_time()
        assert sum(t.num_rows for t in _keyed_runs((batch([7] * 20_000) for _ in range(n)), "key", 0)) == n * 20_000
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0]


# --- packing and the toxicity sample


@pytest.mark.parametrize("limits", [{}, {"max_segments": 7}, {"max_loss": 100}])
def test_short_texts_are_packed_without_padding(spark, limits):
    rows = [(i, [None, "a", "b c"][i % 3]) for i in range(3000)]
    pieces = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").coalesce(2), max_tokens=256, **limits).toPandas()
    room = pieces.groupby("sequence_id")["length"].agg(["sum", "size"])
    assert room["sum"].max() <= 256 and room["size"].max() <= limits.get("max_segments", 256)
    assert all(n == 256 or n & (n - 1) == 0 for n in room["sum"])
    for _, p in pieces.groupby("sequence_id"):
        p = p.sort_values("offset")
        assert p["offset"].tolist() == [0, *p["length"].cumsum().tolist()[:-1]]
    whole = pieces.groupby("doc_id").agg(n=("length", "sum"), of=("doc_tokens", "max"))
    assert len(whole) == 3000 and (whole["n"] == whole["of"]).all()


def test_toxicity_sample_is_bounded(spark, monkeypatch):
    """One toxic id with very many texts does not bring them all to the driver."""
    toxic = next(i for i in range(1, 99) if zlib.crc32(str(i).encode()) % 4 != 2)
    docs = spark.createDataFrame([(toxic, f"bad words number {k}") for k in range(4000)] + [(1000 + k, f"good text {k} here") for k in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(toxic, 0, 1)] + [(1000 + k, 1, 0) for k in range(300)], "doc_id long, quality int, toxic int")
    seen = {}
    monkeypatch.setattr(toxicity, "fit", lambda pos, unl, prior, **_: seen.update(pos=len(pos), unl=len(unl)))
    arrived = []
    frame = type(docs)
    whole = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: arrived.append(t := whole(self)) or t)
    toxicity.train(docs, labels, positives=3, unlabelled=20)
    assert seen["pos"] <= 3 and seen["unl"] <= 20 and arrived[0].num_rows <= 23
