"""E06, E11, E12, E15 for sequences too long for one task: chunks that are worked on alone, and what crosses them put together.

Chunks: (seq_id, chunk, start, text, ahead): text is a stretch of CHUNK letters, ahead the next HALO letters of the sequence.
A chunk decides what lies within it. Of what may go on, it tells a few numbers: reading frames that have not met their stop
and its first stop of each frame, runs of matches that touch its edges. These are joined by sequence. No task holds more of a
sequence than one chunk, and no window more than a few numbers for each of its chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.constants import DNA_MASS, WATER
from granary.functions.shared import written
from granary.operators.nucleotide import _positions, blocks_of, matching_runs

CHUNK = 1_000_000
HALO = 256
Batches = Iterator[pa.RecordBatch]


def _codes(text: str) -> np.ndarray:
    """A letter each, those beyond a byte as question marks."""
    return np.frombuffer(text.encode("latin-1", "replace"), np.uint8)


def chunk_sequences(seqs: DataFrame, size: int = CHUNK) -> DataFrame:
    """seqs(seq_id, sequence) -> chunks, dealt out anew. A null or empty sequence is one empty chunk. size: a multiple of 50."""
    if size % 50 or size < HALO:
        raise ValueError(f"size must be a multiple of 50 and {HALO} at least")

    def run(batches: Batches) -> Batches:
        for b in batches:
            for k in range(b.num_rows):
                s = b.column(1)[k].as_py() or ""
                for at in range(0, max(1, len(s)), size):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(k, 1), *(pa.array([x]) for x in (at // size, at, s[at : at + size], s[at + size : at + size + HALO]))], names=["seq_id", "chunk", "start", "text", "ahead"])

    kind = dict(seqs.dtypes)["seq_id"]
    cut = seqs.select("seq_id", "sequence").mapInArrow(run, f"seq_id {kind}, chunk long, start long, text string, ahead string")
    # by number, as what costs time here is work, not bytes, and adaptive execution would put small chunks together
    return cut.repartition(int(seqs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "seq_id", "chunk")


def chunk_pieces(pieces: DataFrame, size: int = CHUNK) -> DataFrame:
    """pieces(seq_id, offset, text), the parts of each sequence in any order and of any length -> chunks."""
    first, last = F.floor(F.col("offset") / size), F.floor((F.col("offset") + F.greatest(F.length("text"), F.lit(1)) - 1) / size)
    cut = pieces.select("seq_id", "offset", "text", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("offset"), F.col("chunk") * size)
    end = F.least(F.col("offset") + F.length("text"), (F.col("chunk") + 1) * size)
    part = F.substr("text", (begin - F.col("offset") + 1).cast("int"), (end - begin).cast("int"))
    cut = cut.select("seq_id", "chunk", begin.alias("begin"), part.alias("part"))
    near = F.col("begin") - F.col("chunk") * size
    own = F.struct(F.col("chunk").alias("to"), F.lit(False).alias("halo"), F.col("part").alias("x"))
    lent = F.when((near < HALO) & (F.col("chunk") > 0), F.struct((F.col("chunk") - 1).alias("to"), F.lit(True).alias("halo"), F.substr("part", F.lit(1), (HALO - near).cast("int")).alias("x")))
    told = cut.select("seq_id", "begin", F.inline(F.array_compact(F.array(own, lent))))
    joined = lambda halo: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("halo") == halo, F.struct("begin", "x")))), lambda p: p["x"]), "")
    whole = told.groupBy("seq_id", F.col("to").alias("chunk")).agg(joined(False).alias("text"), joined(True).alias("ahead"))
    return whole.select("seq_id", "chunk", (F.col("chunk") * size).alias("start"), "text", "ahead")


def _each(chunks: DataFrame, work, schema: str) -> DataFrame:
    """work(chunk number, start, text, ahead) -> columns without the id, one chunk at a time; a block's rows go on together."""
    kind, names = dict(chunks.dtypes)["seq_id"], [x.split()[0] for x in schema.split(", ")]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for x, y in blocks_of(pc.binary_length(b.column(3)).to_pylist()):
                parts = [work(*row) for row in zip(*(c.slice(x, y - x).to_pylist() for c in b.columns[1:]))]
                row = np.repeat(np.arange(x, y), [len(p[0]) for p in parts])
                columns = [pa.concat_arrays(c) if isinstance(c[0], pa.Array) else pa.array(np.concatenate(c)) for c in zip(*parts)]
                if len(row):
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), *columns], names=["seq_id", *names])

    return chunks.select("seq_id", "chunk", "start", "text", "ahead").mapInArrow(run, f"seq_id {kind}, {schema}")


_WHOLE, _OPEN, _STOP = 0, 1, 2


def _frames(chunk: int, start: int, text: str, ahead: str):
    """Whole reading frames, starts without a stop, and the first stop of each frame (or none)."""
    codes = _codes(text + ahead[:2])
    starts, stops = (_positions(codes, w) for w in (("ATG",), ("TAA", "TAG", "TGA")))
    out = []
    for frame in range(3):
        s, e = (x[(x + start) % 3 == frame] + start for x in (starts, stops))
        at = np.searchsorted(e, s, "right")
        done = at < len(e)
        out += [(_WHOLE, frame, s[done], e[at[done]]), (_OPEN, frame, s[~done], s[~done]), (_STOP, frame, e[:1] if len(e) else np.array([-1]), np.array([-1]))]
    many = [len(x[2]) for x in out]
    return np.repeat([x[0] for x in out], many), np.full(sum(many), chunk), np.repeat([x[1] for x in out], many), np.concatenate([x[2] for x in out]), np.concatenate([x[3] for x in out])


def find_orfs(chunks: DataFrame, min_length: int = 100) -> DataFrame:
    """E06 on chunks: the rows of nucleotide.find_orfs."""
    found = written(_each(chunks, _frames, "what long, chunk long, frame long, a long, b long"), "frames")
    stop = found.where(f"what = {_STOP}").select("seq_id", "chunk", "frame", F.when(F.col("a") >= 0, F.col("a")).alias("first"))
    later = W.partitionBy("seq_id", "frame").orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)  # one number a chunk
    coming = stop.withColumn("stop", F.last("first", ignorenulls=True).over(later)).select("seq_id", "chunk", "frame", "stop").where("stop is not null")
    held = found.where(f"what = {_OPEN}").join(coming, ["seq_id", "chunk", "frame"]).select("seq_id", "a", "stop", "frame")
    orfs = found.where(f"what = {_WHOLE}").select("seq_id", "a", "b", "frame").union(held)
    size = F.col("b") + 3 - F.col("a")
    return orfs.where(size >= min_length).select("seq_id", F.col("a").alias("start"), (F.col("b") + 3).alias("end"), size.alias("length"), "frame", F.lit("+").alias("strand"))


def _segments(chunks: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """Stretches in which each letter equals the one a period later; held: whether one touches an edge it may cross.
    head: the letters of a stretch's first two periods and one more."""
    kind, names = dict(chunks.dtypes)["seq_id"], ["seq_id", "period", "start", "matches", "held", "head"]

    def run(batches: Batches) -> Batches:
        for b in batches:
            for x, y in blocks_of(pc.binary_length(b.column(3)).to_pylist()):
                ids, number, begin, text, ahead = (b.column(c).slice(x, y - x) for c in range(5))
                number, begin, text, more = np.asarray(number), np.asarray(begin), text.to_pylist(), ahead.to_pylist()
                own, goes_on, whole = np.array([len(t) for t in text]), np.array([len(t) > 0 for t in more]), [t + m for t, m in zip(text, more)]
                longest = np.where((number > 0) | goes_on, max_length, np.minimum(max_length, own // 3))
                for period, row, at, size in matching_runs(whole, own, min_length, max_length, edges=True):
                    held = ((at == 0) & (number[row] > 0)) | ((at + size == own[row]) & goes_on[row])
                    pick = (held | (size >= period)) & (longest[row] >= period)
                    row, at, size, held = row[pick], at[pick], size[pick], held[pick]
                    if len(row):
                        heads = [whole[k][a : a + 2 * period] for k, a in zip(row.tolist(), at.tolist())]
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(np.full(len(row), period)), pa.array(begin[row] + at), pa.array(size), pa.array(held), pa.array(heads, pa.string())], names=names)

    return chunks.select("seq_id", "chunk", "start", "text", "ahead").mapInArrow(run, f"seq_id {kind}, period long, start long, matches long, held boolean, head string")


def _runs(chunks: DataFrame, min_length: int, max_length: int) -> DataFrame:
    """seq_id, period, start, matches, head of the maximal runs of a period's length and more."""
    if max_length * 2 > HALO:
        raise ValueError(f"max_length must be {HALO // 2} at most")
    found = written(_segments(chunks, min_length, max_length), "runs")
    own = W.partitionBy("seq_id", "period").orderBy("start")  # what touches an edge: two rows a chunk and period at most
    end = F.col("start") + F.col("matches")
    held = found.where("held").withColumn("new", (F.coalesce(F.lag(end).over(own), F.lit(-1)) != F.col("start")).cast("int"))
    held = held.withColumn("run", F.sum("new").over(own)).groupBy("seq_id", "period", "run")
    whole = held.agg(F.min("start").alias("start"), F.sum("matches").alias("matches"), F.min_by("head", "start").alias("head")).where("matches >= period")
    columns = ["seq_id", "period", "start", "matches", "head"]
    return found.where("not held").select(*columns).union(whole.select(*columns))


def tandem_runs(chunks: DataFrame, min_length: int = 10, max_length: int = 50) -> DataFrame:
    """E11 on chunks: the rows of nucleotide.tandem_runs."""
    return _runs(chunks, min_length, max_length).drop("head")


def tandem_repeats(chunks: DataFrame, min_length: int = 10, max_length: int = 50, cap: int = 15) -> DataFrame:
    """E11 on chunks: the rows of nucleotide.tandem_repeats. A run is read from its first two periods: what comes later only
    rotates units already seen."""
    runs = _runs(chunks, min_length, max_length)
    starts = F.least(F.col("matches") - F.col("period"), F.col("period")).cast("int")
    units = runs.select("seq_id", "period", "start", "matches", "head", F.explode(F.sequence(F.lit(0), starts)).alias("k"))
    unit = F.when(F.col("k") < F.col("period"), F.substr("head", F.col("k") + 1, F.col("period").cast("int"))).otherwise(F.substr("head", F.lit(1), F.col("period").cast("int")))
    count = F.floor((F.col("matches") - F.col("k")) / F.col("period")) + 1
    first = units.select("seq_id", "period", (F.col("start") + F.col("k")).alias("position"), count.alias("repeat_count"), unit.alias("unit"))
    first = first.groupBy("seq_id", "unit").agg(F.min(F.struct((-F.col("period")).alias("n"), "position", "repeat_count")).alias("x"))
    found = first.select("seq_id", "unit", (-F.col("x.n")).alias("length"), "x.position", "x.repeat_count")
    found = found.withColumn("k", F.row_number().over(W.partitionBy("seq_id").orderBy(F.desc("length"), "position"))).where(F.col("k") <= cap)
    rank = F.row_number().over(W.partitionBy("seq_id").orderBy(F.desc(F.col("length") * F.col("repeat_count")), "k"))
    shown = F.when(F.length("unit") > 30, F.concat(F.substring("unit", 1, 30), F.lit("..."))).otherwise(F.col("unit"))
    return found.select("seq_id", rank.cast("long").alias("rank"), "position", "length", "repeat_count", shown.alias("pattern"))


def _islands(window: int, step: int, gc: float, ratio: float):
    def work(chunk: int, start: int, text: str, ahead: str):
        codes = _codes(text + ahead)
        at = np.arange(-start % step, min(len(text), max(0, len(codes) - window)), step)
        sums = lambda hit: np.r_[0, np.cumsum(hit)]
        c, g, cg = sums(codes == ord("C")), sums(codes == ord("G")), sums((codes[:-1] == ord("C")) & (codes[1:] == ord("G")))
        n_c, n_g, n = c[at + window] - c[at], g[at + window] - g[at], cg[at + window - 1] - cg[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            share, odds = (n_c + n_g) / window, n / (n_c * n_g / window)
        hit = (share >= gc) & (n > 0) & (odds >= ratio)
        return at[hit] + start, at[hit] + start + window, share[hit], odds[hit]

    return work


def cpg_islands(chunks: DataFrame, window: int = 200, step: int = 50, gc: float = 0.6, ratio: float = 0.6) -> DataFrame:
    """E12 on chunks: the rows of nucleotide.cpg_islands."""
    if window >= HALO:
        raise ValueError(f"window must be below {HALO}")
    return _each(chunks, _islands(window, step, gc, ratio), "start long, end long, gc_content double, cpg_ratio double")


def _letters(chunk: int, start: int, text: str, ahead: str):
    letter, n = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_counts=True)
    return pa.array([chr(x) for x in letter], pa.string()), n


def composition(chunks: DataFrame) -> DataFrame:
    """E02 on chunks: seq_id, letter, n, letters as they are."""
    return _each(chunks, _letters, "letter string, n long").groupBy("seq_id", "letter").agg(F.sum("n").alias("n"))


def nucleotide_profile(chunks: DataFrame) -> DataFrame:
    """E15 on chunks: seq_id and the metrics of nucleotide.nucleotide_profile. The chunks are made once, for five readers."""
    chunks = written(chunks, "chunks")
    many = lambda letters: F.sum(F.when(F.upper("letter").isin(*letters), F.col("n")).otherwise(0))
    counts = {c: many(c) for c in "ACGTU"}
    mass = sum((counts[c] * w for c, w in DNA_MASS.items()), F.lit(0.0))
    items = F.sort_array(F.collect_list(F.struct("letter", "n")))  # as many as there are letters
    seen = composition(chunks).groupBy("seq_id").agg(F.sum("n").alias("length"), many("ACGT").alias("known"), mass.alias("mass"), items.alias("items"), *(v.alias(f"n_{c}") for c, v in counts.items()))
    g, c, a, t, u = (F.col(f"n_{x}") for x in "GCATU")
    share = lambda x: x["n"] / F.col("length") * F.log2(x["n"] / F.col("length"))
    scalar = seen.select(
        "seq_id", "length", F.try_divide(g + c, g + c + a + t + u).alias("gc_content"), F.try_divide(g - c, g + c).alias("gc_skew"), F.try_divide(a - t, a + t).alias("at_skew"),
        (0.0 - F.aggregate(F.transform("items", share), F.lit(0.0), lambda s, x: s + x)).alias("entropy"),
        F.when(F.col("known") == F.col("length"), F.col("mass") - (F.col("length") - 1) * F.lit(WATER)).alias("dna_weight"),
    )
    zero: dict[str, Column] = {x: F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in ("longest_orf", "orf_count", "cpg_count", "repeat_count", "length")}
    out = chunks.select("seq_id").distinct().join(scalar, "seq_id", "left")
    out = out.join(find_orfs(chunks).groupBy("seq_id").agg(F.max("length").alias("longest_orf"), F.count("*").alias("orf_count")), "seq_id", "left")
    out = out.join(cpg_islands(chunks).groupBy("seq_id").agg(F.count("*").alias("cpg_count")), "seq_id", "left")
    out = out.join(tandem_repeats(chunks).groupBy("seq_id").agg(F.count("*").alias("repeat_count")), "seq_id", "left")
    entropy = F.coalesce("entropy", F.lit(0.0)).alias("entropy")
    return out.select("seq_id", zero["length"], "gc_content", "gc_skew", "at_skew", entropy, "dna_weight", *(zero[x] for x in ("longest_orf", "orf_count", "cpg_count", "repeat_count")))
