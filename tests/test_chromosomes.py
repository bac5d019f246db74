"""Chunked sequences give what whole ones do, wherever they are cut."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import plain
from granary.operators import chromosomes as C
from granary.operators import nucleotide as N


def made():
    rng = random.Random(8)
    letters = lambda n, of="ACGT": "".join(rng.choice(of) for _ in range(n))
    long = letters(900) + "ATG" + "GCA" * 700 + "TAA" + letters(500) + letters(13) * 90 + "A" * 1300 + letters(700, "CG") + "CG" * 400 + letters(31) * 3 + letters(2000)
    return [(1, long), (2, ""), (3, None), (4, letters(17) * 2 + "AC"), (5, letters(600)), (6, letters(599) + "ATG"), (7, "ACGT" * 150), (8, letters(27) * 40 + "nnn" + letters(27).lower() * 9), (9, "CG" * 150), (10, letters(901) + "é" + letters(40) * 30), (11, "ATGAAA" * 400), (12, letters(200, "CG")), (13, letters(50) * 12)]


@pytest.fixture(scope="module")
def seqs(spark):
    return spark.createDataFrame(made(), "seq_id long, sequence string").cache()


@pytest.fixture(scope="module", params=[300, 600])
def chunks(request, seqs):
    return C.chunk_sequences(seqs, request.param).cache()


def rows(df, *by):
    return sorted(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.parametrize("name", ["find_orfs", "tandem_runs", "tandem_repeats", "cpg_islands"])
def test_as_whole_sequences(name, seqs, chunks):
    want = rows(getattr(N, name)(seqs))
    assert rows(getattr(C, name)(chunks)) == want and len(want) > 20


def test_profile_as_whole_sequences(seqs, chunks):
    got = C.nucleotide_profile(chunks)
    want = N.nucleotide_profile(seqs).withColumns({"entropy": F.coalesce("entropy", F.lit(0.0)), "length": F.coalesce("length", F.lit(0))})
    assert rows(got) == rows(want.select(got.columns))


def test_pieces_of_any_size_become_chunks(spark, seqs):
    rng = random.Random(9)
    pieces = []
    for i, s in made():
        at = 0
        while s and at < len(s):
            n = rng.choice([1, 60, 700, 2500])
            pieces.append((i, at, s[at : at + n]))
            at += n
        if not s:
            pieces.append((i, 0, ""))
    rng.shuffle(pieces)
    got = C.chunk_pieces(spark.createDataFrame(pieces, "seq_id long, offset long, text string"), 600)
    assert rows(got) == rows(C.chunk_sequences(seqs, 600))


def test_one_sequence_over_many_tasks(spark):
    """3 MB in one row: 60 chunks, dealt to many tasks, with the result of the whole row."""
    rng = random.Random(10)
    text = "".join(rng.choices("ACGT", k=3_000_000)) + "ACGTTGCAAGCT" * 30
    one = spark.createDataFrame([(1, text)], "seq_id long, sequence string")
    chunks = C.chunk_sequences(one, 50_000)
    assert chunks.select(F.spark_partition_id()).distinct().count() > 1 and chunks.agg(F.max(F.length("text"))).first()[0] == 50_000
    for name in ("find_orfs", "tandem_repeats"):
        assert rows(getattr(C, name)(chunks)) == rows(getattr(N, name)(one))
