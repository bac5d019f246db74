"""Whole-library comparisons, limits and repeated rows of the training-data operators."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm import bpe, lattice, packing, simhash, suffix_dedup, token_counts, toxicity, vafile
from granary.llm import queries as Q
from granary.llm.common import connected_components, durable, settings

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_character_as_the_library_has_it(name):
    path = bpe.default_vocabulary(name)
    library = Tokenizer.from_file(path)
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 50_000):
        part = [f"x{c}y {c}{c} e\u0301{c}\u0323\u0301" for c in letters[at : at + 50_000]]
        want = library.encode_batch(part, add_special_tokens=False)
        got = bpe.encode_rows(path, part)
        assert [t for t, g, w in zip(part, got, want) if np.frombuffer(g, "<u4").tolist() != w.ids] == []


def test_rows_of_words_merge_like_single_words():
    rng = random.Random(5)
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        b = bpe.load(bpe.default_vocabulary(name))
        words = ["".join(rng.choice("abcdetionrs\u00e9\u00df\u65e5") for _ in range(rng.randrange(1, n))) for n in (3, 9, 20, 60, 130) for _ in range(300)]
        got = {words[i]: parts[k, : n[k]].tolist() for which, n, parts, _ in b.merged(words) for k, i in enumerate(which)}
        assert got == {w: b.merge(w) for w in words}


def test_long_texts_are_cut_where_no_word_goes_across(monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 50)
    rng = random.Random(6)
    text = "".join(rng.choice(["ab", "C", " ", "  ", "\n", "\t ", ".", "'s", "7", "\u00e9", "<|endoftext|>"]) for _ in range(2000))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        path = bpe.default_vocabulary(name)
        parts = list(bpe.chunks(text, 50))
        assert len(parts) > 20 and "".join(parts) == text
        assert [w for p in parts for w in bpe.all_words(bpe.load(path), p)] == bpe.all_words(bpe.load(path), text)


def test_token_spans_with_added_tokens():
    path = bpe.default_vocabulary("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for text in ("hello<|endoftext|>world", "<|endoftext|>", "a <|endoftext|> \u65e5\u672c <|endoftext|>\u00e9", "x<|endo"):
        starts, ends = token_counts.token_spans(path, text)
        assert list(zip(starts.tolist(), ends.tolist())) == library.encode(text, add_special_tokens=False).offsets


def test_packing_has_the_library_ids_and_little_padding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    library = Tokenizer.from_file(bpe.default_vocabulary("word_bpe_49k.json"))
    ids = {r.doc_id: np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4") for r in docs.collect()}
    p = packing.pack(docs).toPandas()
    assert all(zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in p.itertuples())
    assert p.groupby("doc_id").length.sum().to_dict() == {d: len(x) for d, x in ids.items()}
    size = p.groupby("sequence_id").length.sum()
    short = size[size < 2048]
    assert (short & (short - 1) == 0).all() and len(short) <= 11 * docs.rdd.getNumPartitions()


def test_extra_columns_change_nothing(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).withColumn("loss_tokens", F.lit(3)).withColumn("sections", F.lit("x"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for q in (Q.op9_packing, Q.op10_token_counts):
        got = q(spark, str(tmp_path))
        assert got.agg(F.countDistinct("doc_id")).first()[0] == 40
    assert sorted(map(tuple, Q.op9_packing(spark, str(tmp_path)).collect())) == sorted(map(tuple, packing.pack(docs.select("doc_id", "text")).collect()))


def test_toxicity_on_the_given_labels(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    got = Q.op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").where("held_out and toxic is not null").toPandas()
    assert ((got.predicted == 1) == (got.toxic == 1)).mean() > 0.9
    assert got.score[got.toxic == 1].median() > got.score[got.toxic == 0].quantile(0.9)


def test_settings_are_as_they_were(spark):
    key, other = "spark.sql.adaptive.enabled", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.getAll.get(key), spark.conf.getAll.get(other), spark.conf.get(key)
    suffix_dedup.remove_repeats(docs_of(spark, [(1, "a" * 80), (2, "a" * 80)])).collect()
    durable(spark.range(3), partitioned=True)
    assert (spark.conf.getAll.get(key), spark.conf.getAll.get(other), spark.conf.get(key)) == before
    with pytest.raises(ZeroDivisionError), settings(spark, **{key: "false"}):
        1 / 0
    assert spark.conf.get(key) == before[2]


def test_components_of_a_long_chain(spark):
    chain = spark.range(9_999).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = connected_components(chain)
    assert got.count() == 10_000 and got.agg(F.max("component")).first()[0] == 0


def test_near_copies_know_rows_by_id_and_text(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    base = [word() for _ in range(300)]
    near, own = " ".join([*base[:299], word()]), " ".join(word() for _ in range(200))
    rows = [(1, " ".join(base)), (2, near), (2, own), (3, own + " end"), (1, " ".join(base)), (7, None), (8, ""), (None, " ".join(base)), (9, "a a a a a a a b"), (10, "a a a a a a a c")]
    left = corpus_pipeline.near_copies(spark, docs_of(spark, rows), "").collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in left) == sorted([(1, rows[0][1]), (2, own), (7, ""), (8, ""), (0, rows[0][1]), (9, rows[8][1]), (10, rows[9][1])])


def test_language_stage_judges_each_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs_of(spark, [(1, "12 34 \u00b2"), (1, ""), (None, "%%%"), (None, None)]).withColumn("lang", F.lit(None).cast("string"))
    kept = corpus_pipeline.language(spark, docs.unionByName(extra), sf_dir)
    assert kept.where("doc_id is null or text in ('', '12 34 \u00b2')").count() == 0 and kept.count() >= 0.97 * docs.count()


def test_many_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    one, two = rng.standard_normal(64), rng.standard_normal(64)
    near = one + 0.02 * rng.standard_normal(64)
    rows = [(i, one.tolist()) for i in range(300)] + [(i, two.tolist()) for i in range(300, 310)] + [(400, near.tolist()), (401, (3 * one).tolist()), (5, one.tolist())]
    got = {r.vec_id: (r.n_links, r.component_id) for r in lattice.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[0] == got[299] == got[5] == (301, 0) and got[300] == (9, 300) and got[400] == (301, 0) and got[401] == (301, 0)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0]), (3, []), (4, [-3000.0, 0.5]), (5, [0.0, 0.0]), (6, [float("nan"), 1.0])] + [(20 + i, [1.0, 2.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    pairs = {}
    for i, v in rows:
        if i not in (0, 6):
            s = sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, [1.0, 2.0]))
            pairs.setdefault((-s, i), []).append(s)
    want = [(i, -s) for (s, i), n in sorted(pairs.items()) for _ in n][:12]
    got = vafile.top_k(df, F.col("vec_id") == 0, k=12).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == want
    large = [(0, [1e9]), (1, [1e9])]  # a component of any size is fine; their score leaves 64 bits
    assert vafile.top_k(spark.createDataFrame(large[:1], "vec_id long, embedding array<double>"), F.col("vec_id") == 0).count() == 0
    with pytest.raises(Exception, match="beyond"):
        vafile.top_k(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") == 0).collect()


def test_bounds_hold():
    rng = np.random.default_rng(4)
    v, q = rng.integers(-(2**20), 2**20, (300, 16)) >> rng.integers(0, 20, (300, 1)), rng.integers(-5000, 5000, (20, 16))
    cell, shift = vafile.cells(v)
    low, high = vafile.bounds(q, cell, shift)
    assert ((low <= q @ v.T) & (q @ v.T <= high)).all()


def test_wide_fingerprints_are_bitwise_majorities():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64)) for n in (0, 1, 2, 3, 10, 500, 40_000)]
    got = simhash.wide_fingerprints(sets)
    for s, fp in zip(sets, got):
        h = s[:, None]
        more = (h ^ (h >> np.uint64(31))) * simhash._MIX
        more = (more ^ (more >> np.uint64(29))) * simhash._MIX[0]
        bits = np.unpackbits(np.hstack([h, more ^ (more >> np.uint64(32))]).view(np.uint8), axis=1, bitorder="little")
        assert (np.packbits(bits.sum(0) * 2 > len(s), bitorder="little").view(np.uint64) == fp).all()


def test_toxicity_keeps_its_bounds(spark):
    docs = docs_of(spark, [(1, "same text")] * 500 + [(i, f"text {i}") for i in range(2, 400)])
    model = toxicity.train(docs, spark.createDataFrame([(1, 1)] * 50 + [(i, 0) for i in range(2, 300)], "doc_id long, toxic int"), positives=3, unlabelled=20)
    assert np.isfinite(model.bias)
