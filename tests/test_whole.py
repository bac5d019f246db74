"""Queries read whole texts: late parts count as early ones do."""

import hashlib
import re

import pytest

from conftest import plain, same_rows
from granary.constants import FLEXIBILITY, FLEXIBILITY_WEIGHTS, HYDROPATHY
from granary.operators import documents
from granary.plans import ingest, media, sequences
from granary.plans.views import DUCK, v_prot

md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
CUT = DUCK["v_prot"]
WHOLE = CUT.replace("substr(", "", 1).replace(",1,400)", "")


@pytest.fixture(scope="module")
def proteins(duck):
    rows = duck.sql(WHOLE).fetchall()
    assert max(len(s) for _, s in rows) > 10_000
    return rows


def test_proteins_are_whole(spark, sf_dir, proteins):
    assert sorted(tuple(r) for r in v_prot(spark, sf_dir).collect()) == sorted(proteins)


@pytest.mark.parametrize("name", ["e01_detect_type", "f01_protein_weight", "f02_aromaticity", "f03_instability_index", "f04_isoelectric_point", "f05_residue_percent", "f06_secondary_structure", "f07_gravy", "f09_stability_class", "f10_charge_at_ph", "f11_residue_classes"])
def test_whole_proteins(name, spark, sf_dir, duck):
    """The query's SQL over a view without the cut."""
    same_rows(sequences.QUERIES[name](spark, sf_dir), duck.sql(sequences.ORACLES[name].replace(CUT, WHOLE)))


def test_whole_instability(spark, sf_dir, proteins):
    got = {r.seq_id: r.instability_index for r in sequences.QUERIES["f03_instability_index"](spark, sf_dir).collect()}
    for i, s in proteins:
        total = sum((HYDROPATHY[a] + HYDROPATHY[b]) / 2 for a, b in zip(s, s[1:]))
        assert got[i] == (pytest.approx(10 * total / len(s), abs=2e-6) if s else None)


def test_whole_flexibility(spark, sf_dir, proteins):
    got = {r.seq_id: r.flexibility_mean for r in sequences.QUERIES["f08_flexibility_mean"](spark, sf_dir).collect()}
    half = len(FLEXIBILITY_WEIGHTS) - 1
    w = [FLEXIBILITY_WEIGHTS[half - abs(k)] for k in range(-half, half + 1)]
    for i, s in proteins:
        v = [FLEXIBILITY.get(c, 0.0) for c in s]
        sums = [sum(x * y for x, y in zip(w, v[a : a + len(w)])) / sum(w) for a in range(len(v) - len(w) + 1)]
        assert got[i] == pytest.approx(sum(sums) / len(sums) if sums else 0.0, abs=2e-6)


def test_whole_ptm_sites(spark, sf_dir, proteins):
    want = []
    for i, s in proteins:
        n = dict.fromkeys(("phosphorylation", "glycosylation", "acetylation"), 0)
        for p, c in enumerate(s):
            kind = "phosphorylation" if c in "STY" else "acetylation" if c == "K" else "glycosylation" if c == "N" and s[p + 1 : p + 2] != "P" and s[p + 2 : p + 3] in ("S", "T") else None
            if kind and n[kind] < 15:
                n[kind] += 1
                want.append((i, kind, p + 1, c, s[max(0, p - 2) : p + 3], s[p : p + 3] if kind == "glycosylation" else None, (2.0 if s[p + 1 : p + 2] == "P" else 1.0) if kind == "phosphorylation" else None))
    got = [tuple(r) for r in sequences.QUERIES["f12_ptm_sites"](spark, sf_dir).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.fixture(scope="module")
def long_texts(duck):
    texts = dict(duck.sql("select doc_id, text from documents").fetchall())
    assert max(len(t.split("\n")) for t in texts.values()) > 5 and max(map(len, texts.values())) > 10_000
    return texts


def test_whole_ocr_pages(spark, sf_dir, long_texts):
    got = {(r.doc_id, r.page_no): (r.page_md5, r.total_pages) for r in ingest.QUERIES["a05_ocr_pages"](spark, sf_dir).collect()}
    lines = {i: t.split("\n") for i, t in long_texts.items()}
    assert got == {(i, k): (md5(x), len(own)) for i, own in lines.items() for k, x in enumerate(own)}


def test_whole_base64(spark, sf_dir, long_texts):
    got = {r.doc_id: (r.payload_md5, r.error) for r in ingest.QUERIES["a08_decode_base64"](spark, sf_dir).collect()}
    assert got == {i: (md5(t), None) if i % 4 else (None, "invalid base64") for i, t in long_texts.items()}


def test_whole_image_texts(spark, sf_dir, long_texts):
    got = {r.doc_id: r.text for r in media.QUERIES["k05_rewrite_images"](spark, sf_dir).collect()}
    assert all(t in got[i] for i, t in long_texts.items())
    late = {r.doc_id: r.text for r in media._images(spark, sf_dir).collect()}
    refs = {(r.doc_id, r.pos): r.path for r in media.QUERIES["k05_image_refs"](spark, sf_dir).collect()}
    assert refs == {(i, k): x for i, t in late.items() for k, x in enumerate(re.findall(r"!\[[^\]]*\]\(([^)]+)\)", t))}


def test_whole_formula_texts(spark, sf_dir, long_texts):
    got = {r.doc_id: r.text for r in media._math(spark, sf_dir).collect()}
    assert all(got[i].endswith(re.sub(r"[$\\]", "", t)) for i, t in long_texts.items())
    far = spark.createDataFrame([(1, "word " * 5000 + "$$a$$ and $b$")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in documents.formulas(far).collect()] == [("block", 0, "$$a$$"), ("inline", 0, "$b$")]
