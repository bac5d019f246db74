"""Reports over collections of sequences."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from granary.constants import REPORT_TEXT, SUMMARY_TEXT
from granary.functions.shared import written
from granary.operators.halo import with_number
from granary.operators.nucleotide import islands_of_texts, orfs_of_texts


def collection_stats(seqs: DataFrame, by: str = "file") -> DataFrame:
    """Count, total, average, shortest and longest length of each collection."""
    n = F.coalesce(F.length("sequence"), F.lit(0)).cast("long")
    return seqs.groupBy(by).agg(F.count("*").alias("n"), F.sum(n).alias("total_length"), F.avg(n).alias("avg_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"))


def sequence_preview(seqs: DataFrame, n: int = 100) -> DataFrame:
    """The first n letters, with dots if there are more."""
    return seqs.withColumn("preview", F.when(F.length("sequence") > n, F.concat(F.substring("sequence", 1, n), F.lit("..."))).otherwise(F.col("sequence")))


def collection_summary(stats: DataFrame, lang: str = "en") -> DataFrame:
    """One sentence for each collection."""
    t = SUMMARY_TEXT[lang]
    text = F.format_string(t["some"], F.col("n"), F.format_number("total_length", 0))
    return stats.withColumn("summary", F.when(F.col("n") == 0, t["empty"]).otherwise(text))


def _lists(n: int, row: np.ndarray, fields: dict) -> pa.Array:
    """The values of each of n rows, which come in order of row, as a list of structs; null where there are none."""
    many = np.bincount(row, minlength=n)
    items = pa.StructArray.from_arrays([pa.array(x) for x in fields.values()], list(fields))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(many)], pa.int32()), items, mask=pa.array(many == 0))


def with_details(seqs: DataFrame, top: int = 5) -> DataFrame:
    """seqs with orfs (the first ``top`` reading frames in order of frame and start) and islands (all CpG islands) as arrays,
    null where there are none. Both are found within the row, so no sequence is shuffled."""

    @arrow_udf("struct<orfs:array<struct<frame:long,start:long,end:long,length:long,strand:string>>,islands:array<struct<start:long,end:long,gc_content:double,cpg_ratio:double>>>")
    def details(texts: pa.Array) -> pa.Array:
        whole = [x or "" for x in texts.to_pylist()]
        found = orfs_of_texts(whole, 100)
        row, start, end, frame = (x[np.arange(len(found[0])) - np.searchsorted(found[0], found[0]) < top] for x in found)
        orfs = _lists(len(whole), row, {"frame": frame, "start": start, "end": end, "length": end - start, "strand": np.full(len(row), "+")})
        row, start, share, odds = islands_of_texts(whole)
        islands = _lists(len(whole), row, {"start": start, "end": start + 200, "gc_content": share, "cpg_ratio": odds})
        return pa.StructArray.from_arrays([orfs, islands], ["orfs", "islands"])

    out = seqs.withColumn("details", details("sequence"))
    return out.withColumns({"orfs": F.col("details.orfs"), "islands": F.col("details.islands")}).drop("details")


# What the head of a collection names.
ANALYSIS_VERSION = "1.0"
SEQUENCE_FEATURES = ("sequence_type_detection", "gc_content_analysis", "orf_prediction", "cpg_island_detection", "protein_properties", "secondary_structure", "ptm_site_prediction", "semantic_description")


def sequence_json(profile: DataFrame, include_full: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """seq_id, json: each sequence as an object of its type, with an analysis object; what is null is left out.

    profile: seq_id, length and what there is of name, seq_description, sequence, sequence_type (nucleotide if there is none),
    description (its meaning) and the metrics. A nucleotide has its reading frames and CpG islands, where profile has orfs and
    islands; a protein its secondary structure, residue classes and numbers of modification sites.
    """
    have = set(profile.columns)
    col = lambda name, kind="double": F.col(name) if name in have else F.lit(None).cast(kind)
    count = lambda name: F.coalesce(col(name, "long"), F.lit(0)).cast("long")
    some = lambda name: F.when(F.size(name) > 0, F.col(name)) if name in have else F.lit(None).cast("array<string>")
    group = lambda names: F.when(F.col(names[0]).isNotNull(), F.struct(*names)) if names[0] in have else F.lit(None).cast("string")
    named = F.coalesce(col("name", "string"), F.col("seq_id").cast("string"))
    head = [F.col("seq_id").alias("id"), named.alias("name"), F.coalesce(col("seq_description", "string"), named).alias("description"), F.col("length")]
    kind = F.col("sequence_type") if "sequence_type" in have else F.lit("nucleotide")
    meaning = F.nullif(col("description", "string"), F.lit("")).alias("semantic_description")
    whole = [F.col("sequence")] if include_full and "sequence" in have else []
    bases = F.struct(
        col("gc_content").alias("gc_content"), col("gc_skew").alias("gc_skew"), col("at_skew").alias("at_skew"), col("dna_weight").alias("molecular_weight"), col("entropy").alias("sequence_entropy"),
        count("longest_orf").alias("longest_orf_length"), count("orf_count").alias("orf_count"), count("cpg_count").alias("cpg_island_count"), count("repeat_count").alias("repeat_count"),
    )
    residues = F.struct(
        col("protein_weight").alias("molecular_weight"), col("isoelectric_point").alias("isoelectric_point"), col("aromaticity").alias("aromaticity"), col("instability_index").alias("instability_index"),
        col("stability_class", "string").alias("stability_class"), col("gravy").alias("gravy"), col("charge").alias("charge_at_ph7"),
    )
    sites = F.struct(count("phosphorylation_sites").alias("phosphorylation_count"), count("glycosylation_sites").alias("glycosylation_count"), count("acetylation_sites").alias("acetylation_count"))
    sites = F.when(count("phosphorylation_sites") + count("glycosylation_sites") + count("acetylation_sites") > 0, sites)
    dna = F.to_json(F.struct(*head, kind.alias("sequence_type"), meaning, bases.alias("analysis"), some("orfs").alias("top_orfs"), some("islands").alias("cpg_islands"), *whole))
    protein = F.to_json(F.struct(*head, kind.alias("sequence_type"), meaning, residues.alias("analysis"), group(["helix", "turn", "sheet"]).alias("secondary_structure"), group(["hydrophobic", "polar", "positive", "negative", "aromatic"]).alias("amino_acid_classes"), sites.alias("ptm_sites_summary"), *whole))
    other = F.to_json(F.struct(*head, kind.alias("sequence_type"), meaning, *whole))
    return profile.select("seq_id", *keep, F.when(kind == "nucleotide", dna).when(kind == "protein", protein).otherwise(other).alias("json"))


def collection_json(profile: DataFrame, by: str = "file") -> DataFrame:
    """The head of each collection's JSON: total_count, total_length, the version and features of the analysis. Its
    sequences are the rows of sequence_json(), so that no collection meets in one cell."""
    totals = profile.groupBy(by).agg(F.count("*").alias("total_count"), F.sum("length").alias("total_length"))
    features = F.array(*[F.lit(x) for x in SEQUENCE_FEATURES])
    return totals.select(by, F.to_json(F.struct("total_count", "total_length", F.lit(ANALYSIS_VERSION).alias("analysis_version"), features.alias("bioinformatics_features"))).alias("json"))


def sequence_markdown(profile: DataFrame, by: str = "file", preview: int = 100, number: Column | None = None, lang: str = "en") -> DataFrame:
    """A Markdown report of each collection as rows (by, part, markdown): part 0 is the head with the statistics, each
    further part a sequence's section, so a report in order of part is whole and no collection meets in one cell or task.

    profile: seq_id, length, sequence, and what there is of sequence_type, seq_description, description (its meaning) and
    the metrics; a metric that is null or not there is left out. number: place of a sequence in its collection, by default
    by rank of seq_id.
    """
    t, have = REPORT_TEXT[lang], set(profile.columns)
    profile = sequence_preview(profile, preview).drop("sequence")
    if number is None:  # dealing out by ranges reads its rows twice, so the profile is worked out before
        profile = with_number(written(profile, "profile"), [by], ["seq_id"], "part")
    stats = profile.groupBy(by).agg(F.count("*").alias("n"), F.sum("length").alias("sum"), F.avg("length").alias("avg"), F.min("length").alias("min"), F.max("length").alias("max"))
    whole = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    head = F.concat(
        F.lit(f"# {t['title']}\n\n## 📊 {t['statistics']}\n\n- **{t['count']}**: "), F.col("n").cast("string"), F.lit(f"\n- **{t['total']}**: "), whole(F.col("sum")), F.lit(f" bp\n- **{t['average']}**: "),
        F.format_string("%.0f", F.bround("avg")), F.lit(f" bp\n- **{t['shortest']}**: "), whole(F.col("min")), F.lit(f" bp\n- **{t['longest']}**: "), whole(F.col("max")), F.lit(f" bp\n\n## 🧬 {t['details']}\n"),
    )

    def line(label: str, form: str, *values: Column) -> Column:
        return F.when(values[0].isNotNull(), F.format_string(f"**{t[label]}**: {form}", *values))

    col = lambda name: F.col(name) if name in have else F.lit(None).cast("double")
    word = lambda name: F.col(name).cast("string") if name in have else F.lit(None).cast("string")
    kind = F.col("sequence_type") if "sequence_type" in have else F.lit("nucleotide")
    more_than = lambda name: F.when(col(name) > 0, col(name))
    bases = [line("gc", "%.2f%%", F.round(col("gc_content") * 100 + 1e-9, 2)), line("orf", "%d bp", more_than("longest_orf").cast("long")), line("cpg", "%d", more_than("cpg_count").cast("long")), line("complexity", "%.2f", F.round(more_than("entropy") + 1e-9, 2))]
    residues = [
        line("weight", "%.1f kDa", F.round(col("protein_weight") / 1000 + 1e-9, 1)), line("pi", "%.2f", F.round(col("isoelectric_point") + 1e-9, 2)), line("stability", "%s", word("stability_class")),
        line("gravy", "%.2f", F.round(col("gravy") + F.signum(col("gravy")) * 1e-9, 2)), line("structure", "α-helix %.1f%%, β-sheet %.1f%%", F.round(col("helix") * 100 + 1e-9, 1), F.round(col("sheet") * 100 + 1e-9, 1)),
    ]
    metrics = F.when(kind == "nucleotide", F.concat_ws("\n", *bases, F.lit(""))).when(kind == "protein", F.concat_ws("\n", *residues, F.lit("")))
    p = profile if number is None else profile.withColumn("part", number.cast("long"))
    about = F.col("seq_description") if "seq_description" in have else F.col("seq_id").cast("string")
    meaning = F.when(word("description") != "", F.concat(F.lit(f"**🔬 {t['meaning']}**:\n"), word("description"), F.lit("\n")))
    section = F.concat_ws(
        "\n", F.concat(F.lit("### "), F.col("part").cast("string"), F.lit(". "), F.col("seq_id").cast("string"), F.lit("\n")), F.concat(F.lit("**Description**: "), about, F.lit("\n")),
        F.concat(F.lit("**Length**: "), whole(F.col("length")), F.lit(" bp\n")), F.concat(F.lit(f"**{t['preview']}**:\n```\n"), F.col("preview"), F.lit("\n```\n")), meaning, metrics,
    )
    return stats.select(by, F.lit(0).cast("long").alias("part"), head.alias("markdown")).union(p.select(by, "part", section))
