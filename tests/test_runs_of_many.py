"""Short texts are compared together, and what several readers take is worked out once."""

import random
import time

import pytest

from granary.operators import nucleotide as N
from granary.operators import reports as R
from granary.plans import sequences
from granary.plans.views import v_seq

SMALL = "/root/testdata/sf0.001"


def plain_runs(text, own, period, edges):
    out, at = [], 0
    same = [i < own and i + period < len(text) and text[i] == text[i + period] for i in range(len(text))]
    while at < len(text):
        if not same[at]:
            at += 1
            continue
        end = at
        while end < len(text) and same[end]:
            end += 1
        if end - at >= period or edges and (at == 0 or end == own):
            out.append((at, end - at))
        at = end
    return out


@pytest.mark.parametrize("edges", [False, True])
def test_runs_equal_a_plain_walk(edges, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_LETTERS", 90)
    rng = random.Random(8)
    for letters in ("AC", "A\x00", "Aé\xff", "A😀"):
        texts = [rng.choice(["", "".join(rng.choice(letters) for _ in range(rng.randrange(60)))]) for _ in range(60)] + [letters[0] * 70]
        own = [rng.randrange(len(t) + 1) for t in texts]
        got = {}
        for a, b in N.blocks_of([len(t) for t in texts]):
            for period, row, start, size in N.matching_runs(texts[a:b], own[a:b], 2, 7, edges):
                for k, s, n in zip(row.tolist(), start.tolist(), size.tolist()):
                    got.setdefault((a + k, period), []).append((s, n))
        want = {(k, p): x for k, t in enumerate(texts) for p in range(2, 8) if (x := plain_runs(t, own[k], p, edges))}
        assert got == want and len(want) > 20


def test_many_short_texts_take_the_time_of_their_letters():
    rng = random.Random(9)
    texts = ["".join(rng.choice("ACGT") for _ in range(160)) for _ in range(10_000)]
    began = time.process_time()
    assert len(N.repeat_units(texts, 10, 50, 15)) == len(texts)
    assert time.process_time() - began < 4


def test_chunks_are_made_once(spark):
    plan = sequences.QUERIES["e15_profile_of_chunks"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan


def test_a_profile_is_worked_out_before_it_is_numbered(spark, monkeypatch):
    seen = []
    number = R.with_number
    monkeypatch.setattr(R, "with_number", lambda df, *a: seen.append(df._jdf.queryExecution().optimizedPlan().toString()) or number(df, *a))
    R.sequence_markdown(N.nucleotide_profile(v_seq(spark, SMALL)))
    assert len(seen) == 1 and "MapInArrow" not in seen[0] and "sequence#" not in seen[0]
