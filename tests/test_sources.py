"""Readers: order and identity within files of many splits."""

import random

import pytest

from granary.functions.shared import settings
from granary.sources.fasta import read_fasta, read_fasta_chunks
from granary.sources.splits import split_text


@pytest.fixture()
def sequence_files(tmp_path):
    rng = random.Random(1)
    want = {}
    for name in "ab":
        rows, text = [], ""
        for k in range(60):
            n = rng.choice([0, 5, 60, 61, 400, 3000 if k % 20 == 7 else 90])
            s = "".join(rng.choice("ACGT") for _ in range(n))
            head = f"r{k % 50} record {k}"
            text += f">{head}\n" + "".join(s[i : i + 60] + ("\r\n" if k % 7 == 0 else "\n") for i in range(0, n, 60))
            rows.append((k + 1, head, s))
        (tmp_path / f"{name}.fasta").write_bytes(text.encode())
        want[name] = rows
    return str(tmp_path), want


@pytest.mark.parametrize("split", ["300", "100000000"])
def test_order_in_files_of_many_splits(spark, sequence_files, split):
    folder, want = sequence_files
    with settings(spark, {"spark.sql.files.maxPartitionBytes": split, "spark.sql.files.openCostInBytes": "1" if split == "300" else split}):
        splits = split_text(spark, folder).select("file", "block").distinct().count()
        assert splits > 20 if split == "300" else splits == 2
        got = read_fasta(spark, folder).collect()
        chunks, records = read_fasta_chunks(spark, folder, 300)
        parts, heads = chunks.collect(), records.collect()
    for name, rows in want.items():
        mine = sorted((r for r in got if r.file.endswith(f"{name}.fasta")), key=lambda r: r.ord)
        assert [(r.ord, r.description, r.sequence) for r in mine] == rows
        mine = sorted((r for r in heads if r.file.endswith(f"{name}.fasta")), key=lambda r: r.ord)
        assert [(r.ord, r.description, r.length) for r in mine] == [(k, h, len(s)) for k, h, s in rows]
        for r, (_, _, s) in zip(mine, rows):
            own = sorted((p for p in parts if p.seq_id == r.seq_id), key=lambda p: p.chunk)
            assert "".join(p.text for p in own) == s and all(len(p.text) == 300 for p in own[:-1])
            assert all(p.ahead == s[p.start + 300 : p.start + 556] for p in own)
