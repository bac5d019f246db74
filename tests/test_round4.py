"""Findings of round 3: work that grew faster than its input."""

import time

import pytest

from granary.operators import protein as P
from granary.plans import sequences
from granary.plans.views import v_prot
from granary.sources import genbank_source
from granary.sources.genbank import parse_genbank
from granary.sources.genbank_source import FlatFileReader, Range, records_of

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_f05_works_out_a_sequence_once(spark):
    plan = plan_of(sequences.QUERIES["f05_residue_percent"](spark, SMALL))
    assert plan.count("regexp_replace") == 1 and "translate(" not in plan


@pytest.mark.parametrize("f", [P.protein_weight, P.gravy, P.residue_classes, P.secondary_structure])
def test_letters_are_counted_in_one_pass(spark, f):
    plan = f(v_prot(spark, SMALL))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "translate(" not in plan


def test_letter_counts_of_odd_texts(spark):
    rows = [(1, "AéA😀K"), (2, ""), (3, None), (4, "W" * 70_000), (5, "aA1")]
    seqs = spark.createDataFrame(rows, "seq_id int, sequence string").coalesce(1)
    got = {r.seq_id: (r.aromaticity, r.instability_index, r.flexibility_mean) for r in P.instability_index(P.flexibility_mean(P.aromaticity(seqs)), spark.createDataFrame([("AA", 2.0), ("WW", 1.0)], "pair string, weight double")).collect()}
    assert got[1] == (0.0, 0.0, 0.0) and got[2] == (None, None, 0.0) and got[3] == (None, None, 0.0) and got[5][1] == 0.0
    assert got[4][:2] == (1.0, pytest.approx(10 * 69_999 / 70_000)) and got[4][2] > 0


def test_features_are_cut_within_the_row(spark):
    table = "     gene            1..9\n                     /gene=\"a\n                     b\"\n\n     CDS             join(1..2,\n                     4..5)\n                     /product=\"p\""
    rows = [("f", 1, f"LOCUS       L1\nFEATURES             x\n{table}\nORIGIN\n 1 acgt"), ("f", 2, "LOCUS       L2\nFEATURES             x\n                     stray\n     gene            3..4\nORIGIN\n"), ("f", 3, "LOCUS       L3\nORIGIN\n 1 ac"), ("f", 4, None)]
    features = parse_genbank(spark.createDataFrame(rows, "file string, record_no long, value string"))[1]
    got = sorted((r.record_no, r.feature_no, r.type, r.location, r.qualifiers) for r in features.collect())
    assert got == [(1, 1, "gene", "1..9", {"gene": ["a b"]}), (1, 2, "CDS", "join(1..2,4..5)", {"product": ["p"]}), (2, 0, None, "stray", {}), (2, 1, "gene", "3..4", {})]
    assert "Exchange" not in features._jdf.queryExecution().executedPlan().toString()


def test_many_short_records_are_read_in_linear_time(tmp_path, monkeypatch):
    one = b"LOCUS       L 12 bp\nORIGIN\n//\n"
    (tmp_path / "x.gb").write_bytes(one * 150_000)
    began = time.process_time()
    assert sum(1 for _ in records_of(Range(str(tmp_path / "x.gb"), 0, len(one) * 150_000))) == 150_000
    assert time.process_time() - began < 5
    monkeypatch.setattr(genbank_source, "TASKS", 10)
    parts = FlatFileReader({"path": str(tmp_path / "x.gb"), "split": "1000"}).partitions()
    assert len(parts) <= 11 and sum(1 for p in parts for _ in records_of(p)) == 150_000


def test_neighbours_are_walked_without_arrays(spark):
    plan = plan_of(P.instability_index(P.flexibility_mean(v_prot(spark, SMALL)), sequences.pair_weights(spark)))
    assert "transform(" not in plan and "zip_with" not in plan and "split(" not in plan


def test_a_pair_with_two_weights_is_an_error(spark):
    with pytest.raises(ValueError, match="two weights"):
        P.instability_index(v_prot(spark, SMALL), spark.createDataFrame([("AA", 1.0), ("AA", 2.0)], "pair string, weight double"))


def test_kept_letters_are_named_one_by_one(spark):
    """Java walks the ranges of a class one after the other for each character, and looks letters up."""
    plan = plan_of(v_prot(spark, SMALL))
    kept = plan.split("[^")[1].split("]")[0]
    assert "-" not in kept and set(kept.upper()) == set("ACDEFGHIKLMNPQRSTVWY") and len(kept) == 40
