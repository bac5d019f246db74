"""Analysis of protein sequences. Input: seqs(seq_id, sequence) in upper case; other columns are kept.

Metrics of single residues are native column arithmetic on the letters' counts, which come from one pass over a sequence; those of
neighbours walk a sequence's bytes once, whatever its length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from granary.constants import FLEXIBILITY, FLEXIBILITY_WEIGHTS, HYDROPATHY, PK, PROTEIN_TEXT, RESIDUE_MASS, WATER
from granary.functions.text import each_row, letter_count, sentence, weighted_sum

S = "sequence"


def _share(letters: str) -> Column:
    return F.try_divide(letter_count(S, letters), F.length(S))


def protein_weight(seqs: DataFrame) -> DataFrame:
    """average mass; null if empty or if a letter has no mass."""
    fine = (F.length(S) > 0) & (letter_count(S, "".join(RESIDUE_MASS)) == F.length(S))
    return seqs.withColumn("protein_weight", F.when(fine, weighted_sum(S, RESIDUE_MASS) - (F.length(S) - 1) * F.lit(WATER)))


def aromaticity(seqs: DataFrame) -> DataFrame:
    """share of F, W and Y."""
    return seqs.withColumn("aromaticity", _share("FWY"))


def instability_index(seqs: DataFrame, weights: DataFrame) -> DataFrame:
    """10 / length x the sum of dipeptide weights(pair, weight); null for an empty sequence; unknown pairs weigh nothing.

    The weights of the 26 x 26 pairs of letters, 676 cells at most, are fetched at once, when the query is built; each sequence
    is looked up in them as bytes, so none is cut into rows or shuffled.
    """
    known = weights.where(F.col("pair").rlike("^[A-Z]{2}$")).select("pair", F.coalesce("weight", F.lit(0.0)).cast("double")).limit(677).collect()
    if len({p for p, _ in known}) < len(known):
        raise ValueError("a pair has two weights")
    table, code = np.zeros((27, 27)), np.full(256, 26)
    code[65:91] = np.arange(26)
    for pair, weight in known:
        table[code[ord(pair[0])], code[ord(pair[1])]] = weight

    @arrow_udf(T.DoubleType())
    def total(text: pa.Array) -> pa.Array:
        sums = [table[c[:-1], c[1:]].sum() for c in (code[row] for row in each_row(text))]
        return pa.array(sums, pa.float64(), mask=np.asarray(text.is_null()))

    return seqs.withColumn("instability_index", F.try_divide(10.0 * total(S), F.length(S)))


def isoelectric_point(seqs: DataFrame, pk=PK, step: float = 0.01) -> DataFrame:
    """the pH of a grid at which the net charge is nearest to zero, the lower one of two; null for an empty sequence.

    The charge falls as pH rises, so the last of every 38th grid point with no negative charge starts the stretch to search.
    A batch's rows are searched together, in an Arrow function over their counts; what a residue's charge is divided by at each
    grid point is worked out once, for all rows.
    """
    last, stride = round(14 / step), 38
    signs = np.array([sign for _, _, sign in pk], float)
    below = np.array([[1 + 10.0 ** (sign * (k * step - value)) for k in range(last + 1)] for _, value, sign in pk])

    def net(charged: np.ndarray, k: np.ndarray) -> np.ndarray:
        total = np.zeros(np.broadcast_shapes((len(charged), 1), k.shape))
        for i in range(len(signs)):
            total += charged[:, i : i + 1] / below[i][k]
        return total

    def nearest(counts: np.ndarray) -> np.ndarray:
        charged, coarse = counts * signs, np.arange(0, last + 1, stride)[None]
        start = np.where(net(charged, coarse) >= 0, coarse, 0).max(1)
        stretch = np.minimum(start[:, None] + np.arange(stride + 1), last)
        off = np.floor(np.abs(net(charged, stretch)) * 1e9 + 0.5)
        return np.take_along_axis(stretch, off.argmin(1)[:, None], 1)[:, 0]

    @arrow_udf(T.LongType())
    def best(counts: pa.Array) -> pa.Array:
        table = np.asarray(counts.flatten().fill_null(0.0)).reshape(len(counts), len(signs))
        blocks = [nearest(table[k : k + 4096]) for k in range(0, len(table), 4096)]
        return pa.array(np.concatenate(blocks) if blocks else [], pa.int64())

    counts = F.array(*[F.lit(1.0) if name.endswith("-term") else letter_count(S, name).cast("double") for name, _, _ in pk])
    return seqs.withColumn("isoelectric_point", F.when(F.length(S) > 0, best(counts) * F.lit(step)))


def residue_percent(seqs: DataFrame) -> DataFrame:
    """map of residue to its share, for the twenty residues. Take it apart with explode_outer: the map is never empty, and
    for a plain explode Spark asks for its size first, in a filter that works out the sequence anew for each residue."""
    items = [x for r in RESIDUE_MASS for x in (F.lit(r), _share(r))]
    return seqs.withColumn("residue_percent", F.create_map(*items))


def secondary_structure(seqs: DataFrame) -> DataFrame:
    """shares of helix, turn and sheet formers."""
    return seqs.withColumn("helix", _share("EMALK")).withColumn("turn", _share("NPGS")).withColumn("sheet", _share("VIYFWLT"))


def gravy(seqs: DataFrame, scale: dict[str, float] = HYDROPATHY) -> DataFrame:
    """mean hydropathy."""
    return seqs.withColumn("gravy", F.try_divide(weighted_sum(S, scale), F.length(S)))


def flexibility_mean(seqs: DataFrame, scale: dict[str, float] = FLEXIBILITY, weights: tuple[float, ...] = FLEXIBILITY_WEIGHTS) -> DataFrame:
    """mean over all whole windows of the weighted flexibility, 0 if there is no window.

    Windows are twice the weights less one wide, weighted towards their middle, and normalised by the weights' sum.
    """
    half, table = len(weights) - 1, np.zeros(256)
    for letter, v in scale.items():
        table[ord(letter)] = v
    w = [weights[half - abs(k)] for k in range(-half, half + 1)]

    def mean(row: np.ndarray) -> float:
        x, n = table[row], len(row) - len(w) + 1
        return float(sum(x[k : k + n] * v for k, v in enumerate(w)).sum() / sum(w) / n) if n > 0 else 0.0

    @arrow_udf(T.DoubleType())
    def means(text: pa.Array) -> pa.Array:
        return pa.array([mean(row) for row in each_row(text)], pa.float64())

    return seqs.withColumn("flexibility_mean", means(S))


def stability_class(profile: DataFrame) -> DataFrame:
    """stable below an instability index of 40."""
    return profile.withColumn("stability_class", F.when(F.col("instability_index") < 40, "stable").when(F.col("instability_index") >= 40, "unstable"))


def charge_at_ph(seqs: DataFrame, ph: float = 7.0) -> DataFrame:
    """K + R + H/2 (below pH 7) - D - E."""
    his = letter_count(S, "H") * (0.5 if ph < 7.0 else 0.0)
    return seqs.withColumn("charge", letter_count(S, "KR") + his - letter_count(S, "DE"))


def residue_classes(seqs: DataFrame) -> DataFrame:
    """shares of hydrophobic, polar, positive, negative and, independently, aromatic residues."""
    sets = {"hydrophobic": "AVILMFWP", "polar": "STNQ", "positive": "KRH", "negative": "DE", "aromatic": "FWY"}
    return seqs.withColumns({k: F.coalesce(_share(v), F.lit(0.0)) for k, v in sets.items()})


def ptm_sites(seqs: DataFrame, cap: int = 15) -> DataFrame:
    """seq_id, kind, position (from 1), residue, context (two letters either side), score; the first cap of each kind.

    Phosphorylation: S, T, Y, scored 2 before P and else 1. N-glycosylation: N, not P, then S or T. Acetylation: K.
    """
    letters = F.filter(F.split(S, ""), lambda c: c != "")
    seqs = seqs.select("seq_id", letters.alias("letters")).where(F.size("letters") > 0)
    at = lambda i: F.get("letters", i)
    kinds = {
        "phosphorylation": lambda i: at(i).isin("S", "T", "Y"),
        "acetylation": lambda i: at(i) == "K",
        "glycosylation": lambda i: (at(i) == "N") & (at(i + 1) != "P") & at(i + 2).isin("S", "T"),
    }
    places = F.sequence(F.lit(0), F.size("letters") - 1)

    def site(kind: str):
        def one(i: Column) -> Column:
            first = F.greatest(i - 2, F.lit(0))
            context = F.array_join(F.slice("letters", first + 1, i + 3 - first), "")
            motif = F.array_join(F.slice("letters", i + 1, F.lit(3)), "") if kind == "glycosylation" else F.lit(None).cast("string")
            score = F.when(at(i + 1) == "P", 2.0).otherwise(1.0) if kind == "phosphorylation" else F.lit(None).cast("double")
            return F.struct(F.lit(kind).alias("kind"), (i + 1).cast("long").alias("position"), at(i).alias("residue"), context.alias("context"), motif.alias("motif"), score.alias("score"))

        return one

    found = [F.transform(F.slice(F.filter(places, here), 1, cap), site(kind)) for kind, here in kinds.items()]
    return seqs.select("seq_id", F.inline(F.concat(*found)))  # right above the letters: a projection between would split them anew for each


def ptm_counts(seqs: DataFrame, cap: int = 15) -> DataFrame:
    """Numbers of phosphorylation and N-glycosylation sites, each cap at most, as F12 lists them."""
    glyco = F.regexp_count(S, F.lit("N(?=[^P][ST])"))
    return seqs.withColumns({"phosphorylation_sites": F.least(letter_count(S, "STY"), F.lit(cap)), "glycosylation_sites": F.least(glyco.cast("long"), F.lit(cap))})


def describe_protein(profile: DataFrame, lang: str = "en") -> DataFrame:
    """a description from thresholds on weight, stability, isoelectric point, hydropathy, helix and sheet, aromaticity and
    the numbers of phosphorylation and glycosylation sites; a clause without its value is left out."""
    t = PROTEIN_TEXT[lang]
    say = lambda key, *cols: F.format_string(t[key], *cols)
    one, two = (lambda c, n=n: F.round(c + F.signum(c) * 1e-9, n) for n in (1, 2))
    kda, i, pi, g = F.col("protein_weight") / 1000, F.col("instability_index"), F.col("isoelectric_point"), F.col("gravy")
    helix, sheet, rings, phos, glyco = F.col("helix") * 100, F.col("sheet") * 100, F.col("aromaticity"), F.col("phosphorylation_sites"), F.col("glycosylation_sites")
    mass = F.when(kda > 100, say("mass_large", one(kda))).when(kda < 10, say("mass_small", one(kda))).when(kda > 0, say("mass", one(kda)))
    stable = F.when(i < 25, say("stable_very", one(i))).when(i < 40, say("stable", one(i))).when(i >= 40, say("unstable", one(i)))
    point = F.when(pi < 5, say("pi_lowest", two(pi))).when(pi < 6, say("pi_low", two(pi))).when(pi > 9, say("pi_highest", two(pi))).when(pi > 8, say("pi_high", two(pi))).when(pi.isNotNull(), say("pi_middle", two(pi)))
    water = F.when(g > 0.5, say("gravy_highest", two(g))).when(g > 0, say("gravy_high", two(g))).when(g < -0.5, say("gravy_lowest", two(g))).when(g.isNotNull(), say("gravy_low", two(g)))
    fold = F.when(helix > 40, say("helix_rich", one(helix))).when(sheet > 30, say("sheet_rich", one(sheet))).when(helix.isNotNull(), say("structure", one(helix), one(sheet)))
    aromatic = F.when(rings > 0.15, say("aromatic", one(rings * 100)))
    sites = F.when(phos > 10, say("phospho_many", phos)).when(phos > 0, say("phospho", phos))
    sugar = F.when(glyco > 0, say("glyco", glyco))
    return profile.withColumn("description", sentence([mass, stable, point, water, fold, aromatic, sites, sugar], t["separator"], t["end"]))
