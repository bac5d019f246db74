"""Spread lines go from short pages too; exact copies do not lift their own lines."""

from granary.llm import line_dedup


def test_short_pages_and_copies(spark):
    rows = [(i, f"All rights reserved here\nown {i}", f"s{i}") for i in range(8)]
    rows += [(20 + i, "a copied page\nwith its second line", f"s{i}") for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: (r.kept_text, r.n_removed) for r in line_dedup.remove_boilerplate(docs).collect()}
    assert got == {i: (f"own {i}", 1) if i < 20 else (t, 0) for i, t, _ in rows}
