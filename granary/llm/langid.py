"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the byte n-grams of a lower-cased text, hashed to buckets. A document is the mean of its buckets'
embeddings; a softmax layer names the language. Both layers are trained by stochastic gradient descent in numpy on a
bounded, documented sample; a temperature fitted on held-back rows calibrates the scores, and a score below a threshold
taken from those rows is a rejection.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import Batches, in_parts

BUCKETS = 1 << 16
SIZES = (2, 3, 4)
DIM = 16
PER_LANG = 400  # labelled documents of each language that training sees at most
MAX_LANGS = 200  # languages that training tells apart at most
REJECTED = 0.002  # share of right answers on held-back rows that rejection may cost at most
UND = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACE = re.compile(r"\s+")
_CHUNK = 1 << 18


def fold(doc_id):
    """Held-out rows are those where it is 2; they are never learned from."""
    return F.crc32(doc_id.cast("string")) % 4


def subwords(text: str) -> np.ndarray:
    """Bucket numbers of all n-grams of a text, in chunks joined end to end; white space runs count as one space."""
    raw = np.frombuffer((" " + _SPACE.sub(" ", text.lower()).strip() + " ").encode("utf-8", "surrogatepass") + b"\0" * 4, np.uint8)
    w = raw.astype(np.uint32)
    four = w[:-3] | w[1:-2] << 8 | w[2:-1] << 16 | w[3:] << 24
    out = []
    for n in SIZES:
        part = four[: len(raw) - 4 - n + 1]
        if n < 4:
            part = part & np.uint32((1 << 8 * n) - 1)
        h = (part ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)
        out.append(h >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(out).astype(np.int32)


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # bucket -> contribution to each language's logit
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: str) -> np.ndarray:
        grams = subwords(text)
        total = np.zeros(self.table.shape[1])
        for at in range(0, len(grams), _CHUNK):
            total += np.bincount(grams[at : at + _CHUNK], minlength=BUCKETS) @ self.table if len(grams) > BUCKETS else self.table[grams[at : at + _CHUNK]].sum(0)
        return total / max(1, len(grams)) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.langs or not _LETTER.search(text):
            return UND, 0.0
        z = self.logits(text) / self.temperature
        p = np.exp(z - z.max())
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def fit(grams: list[np.ndarray], counts: list[np.ndarray], labels: list[str], seed: int = 0, epochs: int = 8, rate: float = 8.0) -> LanguageModel:
    """Train on (distinct buckets, their counts, language) rows; one row in five is held back for calibration."""
    langs = sorted(set(labels))
    if not langs:
        return LanguageModel([], np.zeros((BUCKETS, 1), np.float32), np.zeros(1), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    order = rng.permutation(len(y))
    held, own = order[::5], np.setdiff1d(order, order[::5])
    own = own if len(own) else order
    emb = rng.normal(0, 0.3, (BUCKETS, DIM)).astype(np.float32)
    top, bias = np.zeros((DIM, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    share = [(c / max(1, c.sum())).astype(np.float32) for c in counts]
    steps, done = epochs * len(own), 0
    for _ in range(epochs):
        for i in rng.permutation(own):
            lr = rate * (1 - done / steps)
            g, x = grams[i], share[i]
            hidden = x @ emb[g]
            z = hidden @ top + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = top @ p
            top -= lr * np.outer(hidden, p)
            bias -= 0.01 * lr * p
            emb[g] -= lr * x[:, None] * back
            done += 1
    table = (emb @ top).astype(np.float32)
    z = np.array([share[i] @ table[grams[i]] + bias for i in held])
    temperature, threshold = 1.0, 0.0
    if len(held):
        def scores(t):
            p = np.exp(z / t - (z / t).max(1, keepdims=True))
            return p / p.sum(1, keepdims=True)

        loss = {t: -np.log(np.maximum(scores(t)[np.arange(len(held)), y[held]], 1e-9)).mean() for t in np.geomspace(0.25, 16, 40)}
        temperature = float(min(loss, key=loss.get))
        p = scores(temperature)
        right = p[np.arange(len(held)), y[held]][p.argmax(1) == y[held]]
        threshold = float(min(0.5, np.quantile(right, REJECTED))) if len(right) else 0.0
    return LanguageModel(langs, table, bias.astype(float), temperature, threshold)


def chance(share):
    """Whether a row is in a sample of that share of all rows, by a hash of doc_id and text."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) < share * (1 << 40)


def train(docs: DataFrame, per_lang: int = PER_LANG, langs: int = MAX_LANGS) -> LanguageModel:
    """Fit on at most per_lang labelled rows of each of the langs most frequent languages, outside the held-out fold.

    Runs at once: a count by language, a scan that keeps some 1.5 times per_lang rows a language by a hash of doc_id and text,
    and a fit on the driver of the first per_lang of these; repeated rows count once. The driver's input is bounded by
    the two parameters.
    """
    known = docs.where(F.col("lang").isNotNull() & (fold(F.col("doc_id")) != 2)).select("doc_id", "lang", "text")
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(langs).collect()
    share = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, min(1.0, 1.5 * per_lang / r.n))])[F.col("lang")] if counts else F.lit(0.0)
    some = known.where(F.col("text").isNotNull() & chance(share))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id"))
    rows = some.dropDuplicates(["lang", "doc_id", "text"]).withColumn("n", rank).where(F.col("n") <= per_lang).select("lang", "text")

    def features(batches: Batches) -> Batches:
        for b in in_parts(batches):
            got = [np.unique(subwords(t), return_counts=True) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g for g, _ in got], pa.list_(pa.int32())), pa.array([c for _, c in got], pa.list_(pa.int32()))], names=["lang", "grams", "counts"])

    got = rows.mapInArrow(features, "lang string, grams array<int>, counts array<int>").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (got["lang"][i].as_py(), got["grams"][i].values.to_numpy().tobytes()))
    return fit([got["grams"][i].values.to_numpy() for i in order], [got["counts"][i].values.to_numpy() for i in order], [got["lang"][i].as_py() for i in order])


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text) -> doc_id, held_out, lang_pred, score, rejected, and the columns named in ``keep``.

    lang_pred is a learned language; und with score 0 where the text is null, empty or without a letter, or nothing was
    learned. rejected: und, or a score under the model's threshold. A null doc_id has held_out null. Repeated rows and
    other columns make no difference; whole texts are read. An empty table gives none.
    """
    kept = {f"kept_{k}": (k, kind) for k, kind in docs.dtypes if k in keep and k != "text"}
    whole = ["text"] if "text" in keep else []
    names = ["doc_id", "held_out", "lang_pred", "score", "rejected", *whole, *kept]

    def run(batches: Batches) -> Batches:
        for b in in_parts(batches):
            got = [model.predict(t) for t in b.column(1).to_pylist()]
            bad = [lang == UND or score < model.threshold for lang, score in got]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array(bad, pa.bool_()), *[b.column(1) for _ in whole], *b.columns[3:]], names=names)

    schema = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean" + ", text string" * len(whole) + "".join(f", `{name}` {kind}" for name, (_, kind) in kept.items())
    rows = docs.select("doc_id", "text", (fold(F.col("doc_id")) == 2).alias("held_out"), *[F.col(k).alias(name) for name, (k, _) in kept.items()])
    return rows.mapInArrow(run, schema).withColumnsRenamed({name: k for name, (k, _) in kept.items()})
