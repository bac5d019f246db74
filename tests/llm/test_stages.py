"""Each stage of the pipeline on its own input, written and reread as the driver does, against brute force."""

import hashlib
import re
from collections import defaultdict
from itertools import combinations

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from granary.llm.bpe import default_vocabulary
from granary.llm.line_dedup import oracle
from test_llm import without_repeats


@pytest.fixture(scope="module")
def tables(spark, sf_dir, tmp_path_factory):
    """The input of each stage and the result, in order."""
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    top = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], sf_dir).write.parquet(str(top / name))
        out.append(spark.read.parquet(str(top / name)))
    return out


def rows_of(df):
    return {r.doc_id: r for r in df.collect()}


def test_language_keeps_what_it_knows(tables):
    before, after = rows_of(tables[0]), rows_of(tables[1])
    assert tables[1].columns == corpus_pipeline.COLUMNS
    assert all(after[i] == before[i] for i in after)
    labelled = {i for i, r in before.items() if r.lang and r.text and len(r.text.split()) >= 5}
    assert len(labelled & set(after)) >= 0.98 * len(labelled)
    assert not {i for i, r in before.items() if not re.search(r"[^\W\d_]", r.text or "")} & set(after)


def test_lines_are_those_of_the_sql(tables, tmp_path):
    tables[1].write.parquet(str(tmp_path / "in"))
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/in/*.parquet'")
    want = {r[0]: r[1] for r in c.sql(f"select doc_id, kept_md5 from ({oracle()})").fetchall()}
    got = {i: hashlib.md5((r.text or "").encode()).hexdigest() for i, r in rows_of(tables[2]).items()}
    assert got == {i: want[i] or hashlib.md5(b"").hexdigest() for i in got} and len(got) == tables[1].count()


def test_near_copies_are_those_of_all_pairs(tables):
    before, after = rows_of(tables[2]), rows_of(tables[3])
    words = {i: re.sub("[A-Z]", lambda m: m[0].lower(), r.text or "").encode().split() for i, r in before.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, w in words.items() if w}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
    stay = {i for i in before if i not in sets or root(i) == i}
    assert set(after) == stay and len(stay) < len(before)
    assert all(after[i] == before[i] for i in stay)


def test_passages_are_those_of_every_window(tables):
    before, after = rows_of(tables[3]), rows_of(tables[4])
    want = {r[0]: r[4] for r in without_repeats([(i, r.text) for i, r in before.items()])}
    assert {i: hashlib.sha256(r.text.encode()).hexdigest() for i, r in after.items()} == want
    assert any(len(after[i].text) < len(before[i].text or "") for i in after)


def test_packing_holds_every_id_once(tables):
    docs, pieces = rows_of(tables[4]), defaultdict(list)
    for r in tables[5].collect():
        pieces[r.doc_id].append(r)
    library = Tokenizer.from_file(default_vocabulary("word_bpe_49k.json"))
    assert set(pieces) == set(docs)
    for i, own in pieces.items():
        own.sort(key=lambda r: r.start)
        n = len(library.encode(docs[i].text, add_special_tokens=False).ids) + 1
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) == n == own[0].doc_tokens
    room = defaultdict(int)
    for own in pieces.values():
        for r in own:
            room[r.sequence_id] += r.length
    assert all(n == 2048 or n < 2048 and n & (n - 1) == 0 for n in room.values())
