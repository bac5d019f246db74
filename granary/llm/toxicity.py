"""Toxicity scores by non-negative positive-unlabelled learning.

Only confirmed toxic documents are labels. The unlabelled sample is drawn from all texts, whatever their label, so that it
holds the class prior's share of toxic ones. With prior pi the risk is pi * E_pos[loss(+)] + max(0, E_unl[loss(-)] - pi * E_pos[loss(-)]); where the second
term goes negative the model has begun to fit the unlabelled sample, and the step goes back along it.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Batches, durable, in_parts, release
from granary.llm.langid import chance, fold

BUCKETS = 1 << 18
POSITIVES = 2000  # confirmed toxic documents that training sees at most
UNLABELLED = 8000  # unlabelled documents that training sees at most
PREFIXES = (4, 5, 6)  # a word counts with its beginnings, which inflected and compounded forms share
SIGNIFICANT = 5.0
THRESHOLD = 0.3
REMEMBERED = 300_000  # words a task keeps at most
_WORD = re.compile(r"[^\W_]+")


def buckets(word: str) -> tuple[int, ...]:
    """Of a word and of its beginnings."""
    forms = [word] + ["^" + word[:n] for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(f.encode("utf-8", "surrogatepass")) & (BUCKETS - 1) for f in forms)


def words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class Remembered(dict):
    """word -> what ``make`` gives for it, each short word once; emptied when full."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        got = self.make(word)
        if len(word) < 64:
            self[word] = got
        return got


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float

    def memo(self) -> Remembered:
        """word -> its buckets that carry weight"""
        return Remembered(lambda w: tuple(b for b in buckets(w) if self.weights[b]))

    def score(self, memo: Remembered, text: str | None) -> float:
        used = {b for bs in map(memo.__getitem__, words(text)) for b in bs}
        z = self.bias + float(self.weights[sorted(used)].sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(pos: list[np.ndarray], unl: list[np.ndarray], prior: float, seed: int = 0, epochs: int = 20, batch: int = 256, rate: float = 0.2, decay: float = 1e-4) -> ToxicityModel:
    """nnPU with logistic loss and a linear model over bucket presence, by minibatch AdaGrad.

    Only buckets whose rates in the two samples differ by SIGNIFICANT standard errors get a weight.
    """
    weights, bias = np.zeros(BUCKETS, np.float64), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6)))
    if not pos or not unl:
        return ToxicityModel(weights.astype(np.float32), bias)
    rng = np.random.default_rng(seed)
    rates = [np.bincount(np.concatenate(part).astype(np.int64), minlength=BUCKETS) / len(part) for part in (pos, unl)]
    spread = np.sqrt(sum(np.maximum(r * (1 - r), 1 / n) / n for r, n in zip(rates, (len(pos), len(unl)))))
    chosen = np.abs(rates[0] - rates[1]) >= SIGNIFICANT * spread
    pos, unl = [[x[chosen[x]] for x in part] for part in (pos, unl)]
    past, past_b = np.full(BUCKETS, 1e-3), 1e-3
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for _ in range(epochs):
        up = rng.permutation(len(unl))
        parts = max(1, len(unl) // batch)
        for u in np.array_split(up, parts):
            p = rng.choice(len(pos), min(len(pos), max(16, batch // 2)), replace=False)
            docs = [pos[i] for i in p] + [unl[i] for i in u]
            row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
            col = np.concatenate(docs).astype(np.int64)
            z = np.bincount(row, weights[col], minlength=len(docs)) + bias
            zp, zu = z[: len(p)], z[len(p) :]
            soft = lambda x: np.logaddexp(0, x)
            negative = soft(zu).mean() - prior * soft(zp).mean()
            # derivatives of the loss by each document's score
            dp, du = -prior * sig(-zp) / len(p), np.zeros(len(u))
            back_p, back_u = -prior * sig(zp) / len(p), sig(zu) / len(u)
            if negative >= 0:
                dp, du = dp + back_p, du + back_u
            else:
                dp, du = -back_p, -back_u
            d = np.concatenate([dp, du])
            used, back = np.unique(col, return_inverse=True)
            g = np.bincount(back, d[row], minlength=len(used)) + decay * weights[used]
            past[used] += g * g
            weights[used] -= rate * g / np.sqrt(past[used])
            past_b += d.sum() ** 2
            bias -= 0.1 * rate * d.sum() / np.sqrt(past_b)
    return ToxicityModel(weights.astype(np.float32), bias)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, prior: float | None = None) -> ToxicityModel:
    """Fit on bounded samples, by hash of doc_id and text, of rows outside the held-out fold.

    prior: share of toxic texts; by default that among all labelled rows of the learning folds. Runs at once: counts, one
    scan of the documents that keeps ``positives`` toxic and ``unlabelled`` other rows on average, and a fit on the driver.
    Of what the scan keeps, which is more where ids have many texts, only the first ``positives`` and ``unlabelled`` rows by
    a hash reach the driver. Repeated rows count once.
    """
    known = labels.where(fold(F.col("doc_id")) != 2)
    n_yes, mean = known.agg(F.count_if(F.col("toxic") == 1), F.avg(F.col("toxic").cast("double"))).first()
    prior = (mean or 0.0) if prior is None else prior
    text = docs.where((fold(F.col("doc_id")) != 2)).select("doc_id", "text")
    n = text.count()
    yes = known.where("toxic = 1").select(F.col("doc_id").alias("of")).distinct()
    few = yes.where(F.pmod(F.xxhash64("of"), F.lit(1 << 40)) < min(1.0, positives / max(1, n_yes)) * (1 << 40)).limit(2 * positives)
    either = F.array_compact(F.array(F.when(chance(F.lit(min(1.0, unlabelled / max(1, n)))), 0), F.when(F.col("of").isNotNull(), 1)))
    rows = text.where("text is not null").join(F.broadcast(few), F.col("doc_id") == F.col("of"), "left").select("doc_id", "text", F.explode(either).alias("kind"))
    rows = rows.dropDuplicates(["kind", "doc_id", "text"]).select("kind", F.xxhash64("doc_id", "text", F.lit(3)).alias("h"), "text")

    def features(batches: Batches) -> Batches:
        for b in in_parts(batches):
            got = [np.unique(np.array([x for w in words(t) for x in buckets(w)], np.int32)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(got, pa.list_(pa.int32()))], names=["kind", "h", "buckets"])

    kept = durable(rows.mapInArrow(features, "kind int, h long, buckets array<int>"))
    first = lambda kind, n: kept.where(F.col("kind") == kind).orderBy("h", "buckets").limit(n)
    got = first(1, positives).union(first(0, unlabelled)).select("kind", "buckets").toArrow()
    release(kept)
    order = sorted(range(got.num_rows), key=lambda i: (got["kind"][i].as_py(), got["buckets"][i].values.to_numpy().tobytes()))
    kinds, feats = got["kind"].to_pylist(), got["buckets"]
    # copies of one text are one example
    pos, unl = [list({x.tobytes(): x for i in order if kinds[i] == kind for x in [feats[i].values.to_numpy()]}.values()) for kind in (1, 0)]
    return fit(pos[:positives], unl[:unlabelled], prior)


def toxicity(docs: DataFrame, model: ToxicityModel, threshold: float = THRESHOLD) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, score (0 to 1), predicted (1 from threshold up).

    Null and empty texts score what the bias alone gives. A null doc_id has held_out null. Repeated rows and other
    columns make no difference; whole texts are read.
    """

    def run(batches: Batches) -> Batches:
        memo = model.memo()
        for b in in_parts(batches):
            if len(memo) > REMEMBERED:
                memo.clear()
            s = [model.score(memo, t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", "text", (fold(F.col("doc_id")) == 2).alias("held_out")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
