"""Near copies: the similarity decides, and pairs that have it are found."""

import random
from collections import defaultdict
from itertools import combinations

import pyarrow as pa
import pytest

from granary.llm import simhash
from granary.llm.common import connected_components


def jaccard(a: str, b: str, k: int = 5) -> float:
    x, y = ({tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_recall_and_wrong_links(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, like = [], {}
    for g in range(400):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in rng.sample(range(5, 295, 6), (6, 5, 8, 9)[g % 4]):  # 0.82, 0.84, 0.76, 0.74
            copy[at] = word()
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(copy))]
        like[g] = jaccard(rows[-2][1], rows[-1][1])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    linked = {g: got[2 * g + 1] == 2 * g for g in like}
    near, far = [g for g, x in like.items() if 0.8 <= x < 0.85], [g for g, x in like.items() if 0.7 <= x < 0.8]
    print("recall", sum(linked[g] for g in near), len(near), "wrong", sum(linked[g] for g in far), len(far))
    assert len(near) == len(far) == 200
    assert sum(linked[g] for g in near) >= 194 and not any(linked[g] for g in far)


def test_recall_at_every_length(spark):
    """Pairs just at or over 0.8: some words at the end of one are missing in the other, or some within it differ."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, like = [], defaultdict(list)
    for words in (6, 8, 9, 12, 16, 19, 25, 40, 70, 130, 257, 264, 300, 330, 700, 2000):
        for g in range(100 if words < 500 else 30):
            base = [word() for _ in range(words)]
            n = words - 4
            if g % 2:
                copy = base[: words - int(0.2 * n)]
            else:
                copy = list(base)
                for at in rng.sample(range(0, words, 6), int(0.11 * n / 5)):
                    copy[at] = word()
            if jaccard(" ".join(base), " ".join(copy)) >= 0.8:
                like[words].append(len(rows))
                rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(copy))]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for words, firsts in like.items():
        found = sum(got[i + 1] == i for i in firsts)
        assert len(firsts) >= 10 and found >= (1.0 if words <= 260 else 0.95) * len(firsts), words
        assert all(got[i] == i for i in firsts)


def test_all_true_pairs_of_the_given_documents(spark):
    """Groups as brute force has them, by postings over all shingles, on the documents of sf0.01."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = {r.doc_id: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for r in rows if (w := "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or "").encode().split())}
    held = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    both = defaultdict(int)
    for ids in held.values():
        if len(ids) < 200:
            for a, b in combinations(sorted(ids), 2):
                both[a, b] += 1
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    pairs = [(a, b) for (a, b), n in both.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]
    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs).collect()}
    assert len(pairs) > 50 and {i: root(i) for i in sets} == {i: c for i, c in got.items() if i in sets}


def test_one_shingle_of_very_many_texts(spark):
    """A passage that all texts hold is no reason to meet, and copies among them are found all the same."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    rows = [(i, passage + " " + " ".join(word() for _ in range(40))) for i in range(1500)]
    rows += [(5000 + i, rows[3][1] + " " + word()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (simhash.BLOCK_BYTES, 1 << 15):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs, block_bytes=block).collect()}
        assert got == {i: 3 if i >= 5000 else i for i, _ in rows}


def test_keys_that_two_rows_share():
    rng = random.Random(1)
    for _ in range(100):
        keys = sorted(rng.randrange(30) for _ in range(rng.randrange(50)))
        cuts = sorted(rng.randrange(len(keys) + 1) for _ in range(5))
        parts = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(keys[a:b], pa.int64())], names=["id", "key"]) for a, b in zip([0, *cuts], [*cuts, len(keys)])]
        got = [tuple(r.values()) for t in simhash._shared_keys(iter(parts)) for r in t.to_pylist()]
        assert got == [(i, k) for i, k in enumerate(keys) if keys.count(k) > 1]


@pytest.mark.parametrize("finish", [0, 3, 1 << 18])
def test_components_finish_alike(spark, finish):
    rng = random.Random(7)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(200)] + [(5, 5), (None, 3)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a is not None:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    got = connected_components(spark.createDataFrame(edges, "src long, dst long"), finish=finish).collect()
    assert {r.node: r.component for r in got} == {x: root(x) for x in up} and len(got) == len(up)
