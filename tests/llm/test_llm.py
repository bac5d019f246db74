"""Each operator against a brute-force version, the library it must equal, or held-out accuracy; and its edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from granary.llm import bpe, langid, lattice, line_dedup, packing, simhash, suffix_dedup, token_counts, toxicity, vafile
from granary.llm import queries as Q
from granary.llm.common import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, of string, h long, th long, fp long, id string, n int"


def docs_frame(spark, rows):
    """Documents with further columns whose names clash with those used inside."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 9}", len(t or ""), 1, "x", 2, 3, 4, "y", 5) for i, t in rows], DOCS)


ODD = [(0, None), (1, ""), (2, "  \n \n"), (3, "a"), (3, "a"), (4, "One two three four five six seven eight nine ten eleven."), (5, "One two three four five six seven eight nine ten eleven."), (None, "no id, but a text that is long enough for fifty bytes to be met"), (7, "xy" * 30000), (8, "é" * 40 + "\n" + "日本語テキスト" * 9), (4, "another text of the same id that is long enough for fifty bytes")]


@pytest.fixture(scope="module")
def odd(spark):
    return docs_frame(spark, ODD)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without_repeats(rows, width=50):
    out = []
    for d, t in rows:
        b = (t or "").encode()
        smaller = {x[i : i + width] for e, u in rows if e is not None and d is not None and e < d for x in [(u or "").encode()] for i in range(len(x) - width + 1)}
        cut = [False] * len(b)
        for i in range(len(b) - width + 1):
            if b[i : i + width] in smaller:
                cut[i : i + width] = [True] * width
        kept = bytes(x for x, c in zip(b, cut) if not c)
        out.append((d, len(b), sum(cut), sum(c and not (i and cut[i - 1]) for i, c in enumerate(cut)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_suffix_dedup_random(spark, monkeypatch):
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delé", "x", "yy"]
    base = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(6)]
    rows = []
    for i in range(80):
        t = " ".join(rng.choice([f"q{rng.randrange(1000)}", *words]) for _ in range(rng.randrange(40)))
        if rng.random() < 0.7:
            s = rng.randrange(100)
            t = t[:30] + rng.choice(base)[s : s + rng.randrange(40, 160)] + t[30:]
        rows.append((i * 3, "ab" * 100 if i % 17 == 0 else t if i % 13 else None))
    rows += [(500, rows[5][1]), (501, rows[5][1]), (502, "".join(rng.choice("ab") for _ in range(300)))]
    want = without_repeats(rows)
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == want
    assert sum(r[2] > 0 for r in want) > 20


def test_suffix_dedup_cuts_long_texts_anywhere():
    rng = random.Random(2)
    text = "".join(rng.choice("abc") for _ in range(3000)).encode()
    whole = next(suffix_dedup._slices([text], 50, 28))
    windows = set()
    old, suffix_dedup.SLICE = suffix_dedup.SLICE, 400
    try:
        for s in suffix_dedup._slices([text], 50, 28):
            for a, n, p in zip(s.at, s.n, s.piece):
                windows |= {int(a - s.starts[p] + s.base[p] + k) for k in range(n)}
    finally:
        suffix_dedup.SLICE = old
    assert windows == set(range(len(text) - 49)) == {int(a + k) for a, n in zip(whole.at, whole.n) for k in range(n)}


def test_radix_groups():
    rng = np.random.default_rng(0)
    rows = rng.integers(0, 2, (400, 9)).astype(np.uint8)
    live, group = suffix_dedup.radix_groups(rows)
    want = defaultdict(list)
    for i, r in enumerate(rows):
        want[r.tobytes()].append(i)
    got = defaultdict(list)
    for i, g in zip(live, group):
        got[g].append(i)
    assert sorted(map(sorted, got.values())) == sorted(v for v in want.values() if len(v) > 1)


def test_suffix_dedup_odd(odd, spark):
    rows = [(i, t) for i, t in ODD]
    got = sorted((tuple(r) for r in suffix_dedup.remove_repeats(odd).collect()), key=str)
    small = [(i, t) for i, t in rows if len(t or "") < 1000]
    want = without_repeats(small)
    assert [r for r in got if r[1] < 1000] == want
    assert suffix_dedup.remove_repeats(odd.limit(0)).count() == 0


def test_language_id(docs, odd):
    model = langid.train(docs)
    p = langid.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    held = p[p.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.97
    assert ((p.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)) == p.held_out).all()
    assert p.score.between(0, 1).all()
    o = {r.doc_id: r for r in langid.identify(odd, model).collect()}
    assert [o[k].lang_pred for k in (0, 1, 2)] == ["und"] * 3 and o[0].rejected and o[4].lang_pred in model.langs
    none = langid.train(odd.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    assert np.abs(model.logits("the of and " * 50000) - model.logits("the of and " * 100)).max() < 0.1


def test_toxicity(spark, odd):
    """A planted vocabulary, so that the small table suffices."""
    rng = random.Random(0)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 8 == 0
        words = [rng.choice("abcdefghij") + rng.choice("klmnopqr") * rng.randrange(1, 4) for _ in range(60)]
        if bad:
            words[5:8] = [rng.choice(["grub", "grubber", "wretch", "wretched"]) for _ in range(3)]
        rows.append((i, " ".join(words)))
        if i % 2 == 0 or bad and i % 3:
            labels.append((i, int(bad)))
    docs = docs_frame(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.train(docs, lab)
    p = toxicity.toxicity(docs, model).toPandas()
    held = p[p.held_out]
    truth = held.doc_id % 8 == 0
    assert ((held.predicted == 1) == truth).mean() > 0.97
    assert toxicity.toxicity(odd, model).count() == len(ODD)
    empty = toxicity.train(docs.limit(0), lab.limit(0))
    assert {r.predicted for r in toxicity.toxicity(odd, empty).collect()} == {0}


def plain_fingerprint(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hs = [xxhash.xxh64(s.encode(), 42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def components(nodes, linked):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    nodes = sorted(nodes)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in nodes}


@pytest.mark.parametrize("cap", [64, 1])
def test_simhash(spark, docs, cap):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(5000, None), (5001, "  "), (5002, "A b")]
    fps = {d: plain_fingerprint(t) for d, t in rows}
    c = components(set(fps.values()), lambda a, b: bin(a ^ b).count("1") <= 2)
    low = {}
    for d, f in fps.items():
        low[c[f]] = min(low.get(c[f], d), d)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash_groups(docs_frame(spark, rows), cap=cap).collect()}
    assert got == {d: (f"{f:016x}", low[c[f]]) for d, f in fps.items()}


@pytest.mark.parametrize("radius,segments,cap", [(2, 2, 64), (2, 2, 8), (3, 2, 8), (3, 4, 8), (5, 4, 2000)])
def test_similar_fingerprints(spark, radius, segments, cap):
    rng = random.Random(2)
    fps = set()
    for _ in range(5):
        base = rng.getrandbits(64)
        for _ in range(100):
            x = base
            for _ in range(rng.randrange(5)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    signed = spark.createDataFrame([(simhash._signed(x),) for x in fps], "fp long")
    links = simhash.similar_fingerprints(signed, radius, segments, cap)
    label = {r.node & (2**64 - 1): r.component for r in connected_components(links).collect()}
    got, want = defaultdict(set), defaultdict(set)
    truth = components(fps, lambda a, b: bin(a ^ b).count("1") <= radius)
    for x in fps:
        got[label.get(x, x)].add(x)
        want[truth[x]].add(x)
    assert set(map(frozenset, got.values())) == set(map(frozenset, want.values()))


def test_simhash_odd(odd):
    rows = simhash.simhash_groups(odd).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == 0 and by[2] == 0 and by[5] == 4 and by[3] == 3
    assert simhash.simhash_groups(odd.limit(0)).count() == 0


def test_near_duplicate_groups(spark, odd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows = []
    for g in range(6):
        base = [word() for _ in range(300)]
        for k in range(8):
            t = list(base)
            for _ in range(k and 3):
                t[rng.randrange(300)] = word()
            rows.append((10 * g + k, " ".join(t)))
    rows += [(100 + k, " ".join(word() for _ in range(200))) for k in range(20)]
    for size in (512, 2):
        got = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(docs_frame(spark, rows), group=size).collect()}
        assert got == {d: 10 * (d // 10) if d < 100 else d for d, _ in rows}
    o = {r.doc_id: r.component_id for r in simhash.near_duplicate_groups(odd).collect() if r.doc_id != 4}
    assert o[0] == 0 and o[1] == 1 and o[2] == 2 and o[None] is None and o[5] == 4


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200 + k) for k in range(50)] + [(300, 300), (None, 4)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[200 + k] == 100 for k in range(50)) and got[300] == 300
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for g in range(60):
        c = rng.standard_normal(64)
        rows += [c + rng.standard_normal(64) * 0.25 * (k > 0) for k in range(1 + g % 6)]
    rows += [rows[1].copy(), rng.standard_normal(64)]
    data = [(i, [float(x) for x in r]) for i, r in enumerate(rows)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] + [1.0] * 63), (903, [None] + [1.0] * 63), (904, []), (None, [1.0] * 64)]
    return np.array(rows), spark.createDataFrame(data, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("group", [1024, 3])
def test_lattice(spark, group):
    x, df = vectors(spark)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    close = (u @ u.T >= 0.9) & ~np.eye(len(u), dtype=bool)
    c = components(range(len(u)), lambda a, b: close[a, b])
    got = lattice.near_duplicates(df, group=group).toPandas().set_index("vec_id")
    assert got.n_links[range(len(u))].sum() >= 0.97 * close.sum() and (got.n_links[range(len(u))].values <= close.sum(1)).all()
    assert np.mean([got.component_id[i] == c[i] for i in range(len(u))]) > 0.97
    assert all(got.n_links[k] == 0 and got.component_id[k] == k and got.kept[k] for k in range(900, 905))
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_e8_points_are_nearest():
    rng = np.random.default_rng(0)
    y = rng.standard_normal((200, 8)) * 2
    p = lattice.nearest_e8(y)
    twice = np.rint(2 * p).astype(int)
    assert ((twice % 2 == twice[:, :1] % 2).all(1)).all() and (np.rint(p.sum(1)).astype(int) % 2 == 0).all()
    d = ((y - p) ** 2).sum(1)
    assert (((y[:, None] - (p[:, None] + lattice.minimal_vectors())) ** 2).sum(2).min(1) >= d - 1e-9).all()


def test_top_k(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 16)) / 4
    x[50:60] = x[40]
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1100, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    q = np.floor(x * 1024).astype(np.int64)
    for block in (4096, 64):
        got = vafile.top_k(df, F.col("vec_id") % 100 == 0, block=block, query_block=2).toPandas()
        for i in range(0, 500, 100):
            s = q @ q[i]
            best = sorted((j for j in range(500) if j != i), key=lambda j: (-s[j], j))[:10]
            mine = got[got.query_id == i].sort_values("rank")
            assert mine.vec_id.tolist() == best and mine.score.tolist() == [int(s[j]) for j in best]
    few = vafile.top_k(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).toPandas()
    assert len(few) == 2
    assert vafile.top_k(df.limit(0), F.col("vec_id") == 0).count() == 0


@pytest.fixture(scope="module")
def word_file():
    return bpe.default_vocabulary("word_bpe_49k.json")


SAMPLES = ["", "  ", "Hello <|endoftext|> World<|startoftext|>x", "don't we'll I'M O'Re", "²³ ½ Ⅷ ١٢ 12", "ΑΣ ΣΟΦΟΣ Σ", "İstanbul ß ǅ", "éà", "\x00a \x1c b \x85 c\xa0d", "日本語 テスト 한국어 😀👍🏽", "a_b__c-d", "ab" * 900, "\x00<|endoftext|>"]


def test_bpe_equals_the_library(spark, docs, word_file):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(word_file)
    t.no_truncation()
    t.no_padding()
    rng = random.Random(0)
    letters = [chr(rng.randrange(32, 0x3000)) for _ in range(400)] + list(" \n\t'sSabcABC") * 30
    rows = list(enumerate(SAMPLES + ["".join(rng.choice(letters) for _ in range(80)) for _ in range(500)] + [r.text for r in docs.limit(100).collect()]))
    got = {r.doc_id: r for r in bpe.encode_decode(docs_frame(spark, rows)).collect()}
    for i, text in rows:
        ids = t.encode(text, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, text
    b = bpe.load(word_file)
    long = "".join(rng.choice("abcdefgh") for _ in range(700))
    assert b.merge(long) == t.encode(long, add_special_tokens=False).ids


def test_bpe_round_trip(spark, odd):
    path = bpe.default_vocabulary("byte_bpe_50k.json")
    short = odd.where("doc_id is not null and doc_id <> 7 and doc_id <> 4").distinct()
    back = {r.doc_id: r.text for r in bpe.decode(bpe.encode(short, path), path).collect()}
    assert back == {r.doc_id: r.text or "" for r in short.collect()}
    assert bpe.encode_decode(odd).count() == len(ODD) and bpe.encode_decode(odd.limit(0)).count() == 0


def check_packing(pieces: pd.DataFrame, totals: dict, limit: int):
    for d, g in pieces.sort_values("start").groupby("doc_id"):
        assert (g.start.values == g.length.cumsum().values - g.length.values).all() and g.length.sum() == totals[d] and (g.doc_tokens == totals[d]).all()
    s = pieces.sort_values("offset").groupby("sequence_id")
    assert all((g.offset.values == g.length.cumsum().values - g.length.values).all() for _, g in s)
    size = s.length.sum()
    assert (size <= limit).all() and size[size < limit].map(lambda n: n & (n - 1) == 0).all()


def test_packing(spark, docs, word_file):
    pieces = packing.pack(docs).toPandas()
    ids = {r.doc_id: np.frombuffer(bpe.encode_raw(word_file, r.text) + b"\1\0\0\0", "<u4") for r in docs.collect()}
    check_packing(pieces, {d: len(x) for d, x in ids.items()}, 2048)
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces.itertuples())


def test_packing_limits(spark, docs):
    pieces = packing.pack(docs.withColumn("loss_tokens", F.col("doc_id") % 50 * 3), max_tokens=256, max_segments=3, max_loss=100).toPandas()
    total = pieces.groupby("doc_id").length.sum()
    assert (pieces.groupby("doc_id").doc_tokens.first() == total).all()
    bearing = np.minimum(pieces.doc_id % 50 * 3, pieces.doc_tokens)
    pieces["loss"] = np.maximum(0, pieces.start + pieces.length - np.maximum(pieces.start, pieces.doc_tokens - bearing))
    s = pieces.groupby("sequence_id")
    assert (s.length.sum() <= 256).all() and (s.size() <= 3).all() and (s.loss.sum() <= 100).all()


def test_packing_odd(odd):
    p = packing.pack(odd).toPandas()
    whole = p.sort_values("start").groupby(["doc_id", "doc_tokens"], dropna=False)
    per_row = {(d, n): (g.length.sum(), n) for (d, n), g in whole}
    assert all(total % n == 0 for total, n in per_row.values())  # repeated rows are packed each
    assert p[p.start == 0].shape[0] == len(ODD) and (p[p.doc_id.isin([0, 1, 2])].doc_tokens == 1).all()
    assert packing.pack(odd.limit(0)).count() == 0


def test_token_counts(spark, docs, odd):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_vocabulary("byte_bpe_50k.json"))
    got = token_counts.token_counts(docs).toPandas()
    for r in docs.limit(60).collect():
        e = t.encode(r.text, add_special_tokens=False)
        mine = got[got.doc_id == r.doc_id].sort_values("section")
        assert mine.n_tokens.sum() == len(e.ids) == mine.doc_tokens.iloc[0]
        lines = np.cumsum([len(x) + 1 for x in r.text.split("\n")])
        assert mine.end.tolist() == [min(int(x), len(r.text)) for x in lines][: len(mine)]
        want = np.bincount(np.searchsorted(mine.end.values, [a for a, _ in e.offsets], "right"), minlength=len(mine))
        assert mine.n_tokens.tolist() == want.tolist()
    assert token_counts.token_counts(odd).where("section is null").count() == 2
    assert token_counts.token_counts(odd.limit(0)).count() == 0


def test_token_counts_rules(spark):
    d = spark.createDataFrame([(1, "abc defgh", [(0, 5), (5, 9)])], "doc_id long, text string, sections array<struct<start:long,end:long>>")
    n = {rule: [r.n_tokens for r in token_counts.token_counts(d, rule).orderBy("section").collect()] for rule in token_counts.RULES}
    starts, ends = token_counts.token_spans(bpe.default_vocabulary("byte_bpe_50k.json"), "abc defgh")
    assert sum(n["first"]) == sum(n["most"]) == len(starts)
    assert n["first"][0] == int((starts < 5).sum())
    lo, hi = np.array([0, 5]), np.array([5, 9])
    assert token_counts.attribute(np.array([3]), np.array([9]), lo, hi, "first")[0].tolist() == [1, 0]
    assert token_counts.attribute(np.array([3]), np.array([9]), lo, hi, "most")[0].tolist() == [0, 1]


def test_oracles(spark, sf_dir, duck):
    from conftest import same_rows

    for name, sql in Q.oracle_sql().items():
        same_rows(Q.queries()[name](spark, sf_dir), duck.sql(sql))


def test_line_dedup(spark, odd):
    rows = [(i, f"Shared line here\nown {i} " + "z" * 60 + "\n\nlast") for i in range(8)] + [(20, "Shared line here\nx"), (21, None)]
    got = {r.doc_id: r for r in line_dedup.remove_boilerplate(docs_frame(spark, rows), min_sites=6).collect()}
    assert got[0].kept_text == "own 0 " + "z" * 60 + "\n" and got[0].n_removed == 2
    assert got[20].kept_text == "x" and got[20].n_removed == 1 and got[21].kept_text is None and got[21].n_lines == 0
    assert line_dedup.remove_boilerplate(odd).count() == len(ODD) and line_dedup.remove_boilerplate(odd.limit(0)).count() == 0


def test_pipeline(spark, sf_dir, tmp_path, odd):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    total = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS and 0.5 * total < docs.count() <= total
    assert docs.agg(F.max("offset")).first()[0] < 2048
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, sf_dir).count() >= 0
        assert stage(spark, odd.limit(0), sf_dir).count() == 0
