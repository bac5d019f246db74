"""Analysis of nucleotide sequences. Input: seqs(seq_id, sequence); other columns are kept.

Scalar metrics are native column arithmetic in one narrow pass. Searches whose result depends on order along the
sequence (reading frames, translation, tandem runs) run as Arrow functions inside the partition, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from granary.constants import CODE_LETTERS, CODE_RESIDUES, DNA_MASS, NUCLEOTIDE_TEXT, WATER
from granary.functions.text import letter_count, sentence, substring_count, weighted_sum


def detect_type(seqs: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Nucleotide if more than threshold of the upper-case letters are among ATCGUN; empty: protein."""
    share = F.try_divide(letter_count(F.upper("sequence"), "ATCGUN"), F.length("sequence"))
    return seqs.withColumn("sequence_type", F.when(share > threshold, "nucleotide").otherwise("protein"))


def _letters(seq: Column) -> Column:
    letters = F.array_sort(F.array_distinct(F.filter(F.split(seq, ""), lambda c: c != "")))
    return F.transform(letters, lambda c: F.struct(c.alias("letter"), (F.length(seq) - F.length(F.replace(seq, c, F.lit("")))).cast("long").alias("n")))


def composition(seqs: DataFrame) -> DataFrame:
    """(letter, n) items of the upper-case sequence, as an array; counted per row without a shuffle."""
    return seqs.withColumn("composition", _letters(F.upper("sequence")))


def gc_content(seqs: DataFrame) -> DataFrame:
    """GC share of the unambiguous letters; null if there are none."""
    s = F.upper("sequence")
    return seqs.withColumn("gc_content", F.try_divide(letter_count(s, "GC"), letter_count(s, "GCATU")))


def _skew(a: str, b: str) -> Column:
    x, y = letter_count(F.upper("sequence"), a), letter_count(F.upper("sequence"), b)
    return F.try_divide(x - y, x + y)


def gc_skew(seqs: DataFrame) -> DataFrame:
    """(G-C)/(G+C), null without either."""
    return seqs.withColumn("gc_skew", _skew("G", "C"))


def at_skew(seqs: DataFrame) -> DataFrame:
    """(A-T)/(A+T), null without either."""
    return seqs.withColumn("at_skew", _skew("A", "T"))


def _positions(codes: np.ndarray, words: tuple[str, ...]) -> np.ndarray:
    hit = np.zeros(max(0, len(codes) - 2), bool)
    for w in words:
        a, b, c = w.encode()
        hit |= (codes[:-2] == a) & (codes[1:-1] == b) & (codes[2:] == c)
    return np.flatnonzero(hit)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' characters as one byte each, with one between that is in no word, and where each text begins and how long it is."""
    size = np.array([len(x) for x in texts], np.int64)
    return np.frombuffer("\0".join(texts).encode("latin-1", "replace"), np.uint8), np.cumsum(size + 1) - size - 1, size


def _by_block(texts: list[str], work, kinds: tuple) -> list[np.ndarray]:
    """work(texts of a block) -> row within the block and further arrays, for all blocks together."""
    parts = [(first, work(texts[first:last])) for first, last in blocks_of([len(x) for x in texts])]
    rows = np.concatenate([np.empty(0, np.int64), *(first + found[0] for first, found in parts)])
    return [rows, *(np.concatenate([np.empty(0, kind), *(found[k] for _, found in parts)]) for k, kind in enumerate(kinds, 1))]


def orfs_of_texts(texts: list[str], min_length: int) -> list[np.ndarray]:
    """row, start, end, frame of every start codon with the next stop in its frame, in order of row, frame and start; a block of
    texts is searched as one array, so a short text costs its letters, not calls."""

    def work(block: list[str]) -> tuple[np.ndarray, ...]:
        codes, base, size = _joined(block)
        span = int(size.max()) + 1

        def found(words: tuple[str, ...]) -> np.ndarray:
            at = _positions(codes, words)
            row = np.searchsorted(base, at, "right") - 1
            place = at - base[row]
            return np.sort((row * 3 + place % 3) * span + place)

        starts, stops = found(("ATG",)), found(("TAA", "TAG", "TGA"))
        at = np.searchsorted(stops, starts, "right")
        starts, at = starts[at < len(stops)], at[at < len(stops)]
        stops = stops[at]
        fine = (starts // span == stops // span) & (stops + 3 - starts >= min_length)
        starts, stops = starts[fine], stops[fine]
        return starts // span // 3, starts % span, stops % span + 3, starts // span % 3

    return _by_block(texts, work, (np.int64,) * 3)


def find_orfs(seqs: DataFrame, min_length: int = 100) -> DataFrame:
    """seq_id, start, end, length, frame, strand of the forward reading frames, nested ones included; case matters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, end, frame = orfs_of_texts([x or "" for x in b.column(1).to_pylist()], min_length)
            columns = [b.column(0).take(pa.array(row)), *map(pa.array, (start, end, end - start, frame)), pa.array(["+"] * len(row), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["seq_id", "start", "end", "length", "frame", "strand"])

    kind = dict(seqs.dtypes)["seq_id"]
    return seqs.select("seq_id", "sequence").mapInArrow(run, f"seq_id {kind}, start long, end long, length long, frame long, strand string")


def orf_summary(orfs: DataFrame, top: int = 5) -> DataFrame:
    """Longest, count and the first ``top`` in order of frame and start, for sequences that have any."""
    order = F.row_number().over(W.partitionBy("seq_id").orderBy("frame", "start"))
    ranked = orfs.withColumn("k", order)
    first = F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("frame", "start", "end", "length"))))
    return ranked.groupBy("seq_id").agg(F.max("length").alias("longest"), F.count("*").alias("orfs"), first.alias("top"))


def reverse_complement(col: Column | str) -> Column:
    """With the ambiguity letters; case is kept."""
    return F.translate(F.reverse(col), "ACGTURYKMBVDHacgturykmbvdh", "TGCAAYRMKVBHDtgcaayrmkvbhd")


def _translate(sequence: str) -> str:
    code = np.full(256, -1, np.int64)
    for k, c in enumerate(CODE_LETTERS):
        code[ord(c)] = code[ord(c.lower())] = k
    code[ord("U")] = code[ord("u")] = 0
    d = code[np.frombuffer(sequence.encode("latin-1", "replace"), np.uint8)]
    n = len(d) // 3
    d = d[: 3 * n].reshape(n, 3)
    at = np.where((d < 0).any(1), 64, d @ np.array([16, 4, 1]))
    return np.frombuffer((CODE_RESIDUES + "X").encode(), np.uint8)[at].tobytes().decode()


def _cut(peptide: str) -> str:
    stop = peptide.find("*")
    return peptide[: stop + 10] if stop >= 0 else peptide[:200]


def translate_six_frames(seqs: DataFrame) -> DataFrame:
    """seq_id, direction, frame, peptide; a peptide is cut ten letters after its first stop begins, or at 200."""

    @pandas_udf("array<string>")
    def frames(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else [_cut(_translate(t[f:])) for f in range(3)])

    both = seqs.select("seq_id", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), s.alias("s")) for d, s in (("forward", F.col("sequence")), ("reverse", reverse_complement("sequence")))])).alias("x"))
    return both.select("seq_id", "x.direction", F.posexplode(frames("x.s")).alias("k", "peptide")).select("seq_id", "direction", (F.col("k") + 1).cast("long").alias("frame"), "peptide")


def entropy(seqs: DataFrame) -> DataFrame:
    """Shannon entropy in bits over the characters as they are; 0 for an empty sequence."""
    n = F.length("sequence").cast("double")
    terms = F.transform(_letters(F.col("sequence")), lambda x: x["n"] / n * F.log2(x["n"] / n))
    return seqs.withColumn("entropy", F.when(n == 0, 0.0).otherwise(0.0 - F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def matching_runs(texts: list[str], own: list[int], min_length: int, max_length: int, edges: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each period: (period, rows, starts, sizes) of the maximal runs, among the first own letters of each text, in which each letter
    equals the one a period later, at least a period long; with edges, also shorter ones that touch either end of these letters.

    The texts are compared as one array, so a short text costs its letters, not calls; after each comes what equals no letter."""
    whole, size = "".join(texts), np.array([len(x) for x in texts], np.int64)
    data = np.frombuffer(whole.encode("ascii"), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    place = np.arange(len(data)) - np.repeat(np.cumsum(size) - size, size)
    base = np.cumsum(size + max_length) - size - max_length
    at = place + np.repeat(base, size)
    codes = np.full(len(data) + len(texts) * max_length, np.iinfo(data.dtype).max, data.dtype)
    codes[at] = data
    count = np.asarray(own, np.int64)
    inside, touched = np.zeros(len(codes), bool), np.zeros(len(codes), np.int8)
    inside[at[place < np.repeat(count, size)]] = True
    begin, last = base[count > 0], (base + count - 1)[count > 0]
    touched[begin] |= 1
    touched[last] |= 2
    for period in range(min_length, max_length + 1):
        m = len(codes) - period
        if m <= 0:
            return
        same = np.zeros(m + 2, bool)
        np.logical_and(codes[:m] == codes[period:], inside[:m], out=same[1:-1])
        edge = np.flatnonzero(same[1:] != same[:-1])
        start, length = edge[::2], edge[1::2] - edge[::2]
        keep = length >= period
        if edges:
            keep |= ((touched[start] & 1) | (touched[start + length - 1] & 2)) > 0
        start, length = start[keep], length[keep]
        row = np.searchsorted(base, start, "right") - 1
        yield period, row, start - base[row], length


BLOCK_LETTERS = 1 << 18


def blocks_of(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Where to cut rows of these sizes, so that a block has so many letters at most, or is one row."""
    first, total = 0, 0
    for k, n in enumerate(sizes):
        if k > first and total + n > BLOCK_LETTERS:
            yield first, k
            first, total = k, 0
        total += n
    if first < len(sizes):
        yield first, len(sizes)


def runs_of_texts(texts: list[str], min_length: int, max_length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """matching_runs() over whole texts, in blocks, for periods up to a third of each text."""
    sizes = [len(x) for x in texts]
    third = np.array(sizes, np.int64) // 3
    for a, b in blocks_of(sizes):
        for period, row, start, length in matching_runs(texts[a:b], sizes[a:b], min_length, max_length):
            fine = third[a + row] >= period
            yield period, a + row[fine], start[fine], length[fine]


def tandem_runs(seqs: DataFrame, min_length: int = 10, max_length: int = 50) -> DataFrame:
    """E11, the runs: seq_id, period, start, matches, for every period from min_length to a third of the sequence."""
    kind = dict(seqs.dtypes)["seq_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for period, row, start, size in runs_of_texts([x or "" for x in b.column(1).to_pylist()], min_length, max_length):
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(np.full(len(row), period)), pa.array(start), pa.array(size)], names=["seq_id", "period", "start", "matches"])

    return seqs.select("seq_id", "sequence").mapInArrow(run, f"seq_id {kind}, period long, start long, matches long")


def repeat_units(texts: list[str], min_length: int, max_length: int, cap: int) -> list[list[tuple]]:
    """(rank, position, length, repeat_count, pattern) of each sequence, as tandem_repeats gives them."""
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for period, row, start, size in runs_of_texts(texts, min_length, max_length):
        for k, a, n in zip(row.tolist(), start.tolist(), size.tolist()):
            runs[k].append((-period, a, n))
    return [_units(text, sorted(found), cap) if found else [] for text, found in zip(texts, runs)]


def _units(text: str, runs: list[tuple[int, int, int]], cap: int) -> list[tuple]:
    found: dict[str, tuple[int, int, int]] = {}
    for period, start, size in ((-p, a, n) for p, a, n in runs):
        for at in range(start, min(start + size - period, start + period) + 1):
            found.setdefault(text[at : at + period], (at, period, (start + size - at) // period + 1))
            if len(found) == cap:
                break
        if len(found) == cap:
            break
    ranked = sorted(found.items(), key=lambda x: -x[1][1] * x[1][2])
    return [(k + 1, at, n, c, u[:30] + "..." if len(u) > 30 else u) for k, (u, (at, n, c)) in enumerate(ranked)]


def tandem_repeats(seqs: DataFrame, min_length: int = 10, max_length: int = 50, cap: int = 15) -> DataFrame:
    """seq_id, rank, position, length, repeat_count, pattern: each distinct unit once, at most cap of them.

    Within a run of matches every start with a whole period of matches left begins a repeat, of one more unit than whole
    periods are left; further starts than a period's worth only rotate units already seen. The cap is taken in the order
    of discovery (period down, start up); rank is by length x repeat_count, ties by discovery. Patterns show 30 letters.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            units = repeat_units([x or "" for x in b["sequence"]], min_length, max_length, cap)
            rows = [(i, *x) for i, found in zip(b["seq_id"], units) for x in found]
            yield pd.DataFrame(rows, columns=["seq_id", "rank", "position", "length", "repeat_count", "pattern"])

    kind = dict(seqs.dtypes)["seq_id"]
    return seqs.select("seq_id", "sequence").mapInPandas(run, f"seq_id {kind}, rank long, position long, length long, repeat_count long, pattern string")


def islands_of_texts(texts: list[str], window: int = 200, step: int = 50, gc: float = 0.6, ratio: float = 0.6) -> list[np.ndarray]:
    """row, start, gc_content and cpg_ratio of the windows that cpg_islands lists, in order of row and start; a block of texts at a time."""

    def work(block: list[str]) -> tuple[np.ndarray, ...]:
        codes, base, size = _joined(block)
        many = np.maximum(0, -((window - size) // step))  # a window that ends with the sequence is no candidate
        row = np.repeat(np.arange(len(block)), many)
        place = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * step
        at = base[row] + place
        sums = lambda hit: np.r_[0, np.cumsum(hit)]
        c, g, cg = sums(codes == ord("C")), sums(codes == ord("G")), sums((codes[:-1] == ord("C")) & (codes[1:] == ord("G")))
        n_c, n_g, n = c[at + window] - c[at], g[at + window] - g[at], cg[at + window - 1] - cg[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            share, odds = (n_c + n_g) / window, n / (n_c * n_g / window)
        hit = (share >= gc) & (n > 0) & (odds >= ratio)
        return row[hit], place[hit], share[hit], odds[hit]

    return _by_block(texts, work, (np.int64, np.float64, np.float64))


def cpg_islands(seqs: DataFrame, window: int = 200, step: int = 50, gc: float = 0.6, ratio: float = 0.6) -> DataFrame:
    """seq_id, start, end, gc_content, cpg_ratio of the windows that are CpG islands; a window that ends with the sequence is no candidate."""
    at = seqs.where(F.length("sequence") > window).select("seq_id", "sequence", F.explode(F.sequence(F.lit(0), F.length("sequence") - window - 1, F.lit(step))).alias("start"))
    w = at.select("seq_id", F.col("start").cast("long").alias("start"), F.expr(f"substr(sequence, start + 1, {window})").alias("w"))
    c, g, cg = letter_count("w", "C"), letter_count("w", "G"), substring_count(F.col("w"), "CG")
    w = w.select("seq_id", "start", (F.col("start") + window).alias("end"), ((c + g) / window).alias("gc_content"), cg.alias("cg"), F.try_divide(cg, c * g / window).alias("cpg_ratio"))
    return w.where((F.col("gc_content") >= gc) & (F.col("cg") > 0) & (F.col("cpg_ratio") >= ratio)).drop("cg")


def dna_weight(seqs: DataFrame) -> DataFrame:
    """Molecular weight of the single strand; null if empty or if letters other than ACGT occur."""
    s = F.upper("sequence")
    fine = (F.length(s) > 0) & (letter_count(s, "ACGT") == F.length(s))
    return seqs.withColumn("dna_weight", F.when(fine, weighted_sum(s, DNA_MASS) - (F.length(s) - 1) * F.lit(WATER)))


def nucleotide_profile(seqs: DataFrame) -> DataFrame:
    """All scalar metrics with counts of frames, islands and repeats, in one pass; each metric is null on its own where undefined."""
    base = entropy(dna_weight(at_skew(gc_skew(gc_content(seqs)))))
    base = base.withColumn("length", F.length("sequence").cast("long"))
    at, names = base.columns.index("sequence"), ("longest_orf", "orf_count", "cpg_count", "repeat_count")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [x or "" for x in b.column(at).to_pylist()]
            row, start, end, _ = orfs_of_texts(texts, 100)
            longest = np.zeros(len(texts), np.int64)
            np.maximum.at(longest, row, end - start)
            many = lambda rows: np.bincount(rows, minlength=len(texts))
            found = (longest, many(row), many(islands_of_texts(texts)[0]), [len(x) for x in repeat_units(texts, 10, 50, 15)])
            counts = [pa.array(c, pa.int64()) for c in found]
            yield pa.RecordBatch.from_arrays([*b.columns, *counts], names=[*b.schema.names, *names])

    schema = T.StructType([*base.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])
    return base.mapInArrow(run, schema)


def describe_nucleotide(profile: DataFrame, lang: str = "en") -> DataFrame:
    """A description from thresholds on the profile, in English or Chinese."""
    t = NUCLEOTIDE_TEXT[lang]
    say = lambda key, *cols: F.format_string(t[key], *cols)
    gc = F.round(F.coalesce("gc_content", F.lit(0.0)) * 100 + 1e-9, 6)
    gc_text = F.when(gc < 30, say("gc_lowest", F.round(gc, 1))).when(gc < 40, say("gc_low", F.round(gc, 1))).when(gc > 70, say("gc_highest", F.round(gc, 1))).when(gc > 60, say("gc_high", F.round(gc, 1))).otherwise(say("gc_middle", F.round(gc, 1)))
    sign = F.when(F.col("gc_skew") > 0, t["positive"]).otherwise(t["negative"])
    skew = F.when(F.abs("gc_skew") > 0.15, say("skew", F.signum("gc_skew") * F.round(F.abs("gc_skew") + 1e-9, 2), sign))
    n = F.col("longest_orf")
    orf = F.when(n >= 1000, say("orf_longest", n)).when(n >= 300, say("orf_long", n)).when(n >= 100, say("orf_middle", n))
    many = F.when((n >= 300) & (n < 1000) & (F.col("orf_count") > 1), say("orf_many", F.col("orf_count")))
    cpg = F.when(F.col("cpg_count") > 3, say("cpg_many", F.col("cpg_count"))).when(F.col("cpg_count") >= 1, say("cpg", F.col("cpg_count")))
    rep = F.when(F.col("repeat_count") > 5, say("repeats_many", F.col("repeat_count"))).when(F.col("repeat_count") >= 1, say("repeats", F.col("repeat_count")))
    e = F.coalesce("entropy", F.lit(0.0))
    complexity = F.when(e < 1.0, t["complexity_lowest"]).when(e < 1.5, t["complexity_low"]).when(e > 1.9, t["complexity_high"])
    return profile.withColumn("description", sentence([gc_text, skew, orf, many, cpg, rep, complexity], t["separator"], t["end"]))
