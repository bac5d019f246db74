"""Annotated sequence records. Features: (record_id, feature_no, type, location, qualifiers map<string,array<string>>).

A record is known by record_id, or, where features have them, by file, record_no and record_id together: accessions repeat.
Results carry the same columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.constants import RECORD_TEXT, RECORD_TITLE, REPORT_TEXT
from granary.functions.text import sentence
from granary.operators.halo import with_number

# Feature types of each group.
REGULATORY = ("regulatory", "promoter", "enhancer", "terminator", "RBS", "TATA_signal", "polyA_signal")
RNA = ("rRNA", "tRNA", "mRNA", "ncRNA", "misc_RNA")


def key_of(*frames: DataFrame) -> list[str]:
    """The columns that know a record in all of these."""
    return [c for c in ("file", "record_no", "record_id") if all(c in f.columns for f in frames)]


def first_of(*names: str) -> Column:
    """The first value of the first qualifier that is there."""
    return F.coalesce(*[F.get(F.col("qualifiers")[n], F.lit(0)) for n in names])


def with_strand(features: DataFrame) -> DataFrame:
    """-1 for complement locations, else 1."""
    return features.withColumn("strand", F.when(F.col("location").startswith("complement"), -1).otherwise(1))


def feature_type_counts(features: DataFrame) -> DataFrame:
    """The record's key, type, n."""
    return features.groupBy(*key_of(features), "type").agg(F.count("*").alias("n"))


def genes(features: DataFrame) -> DataFrame:
    """H03"""
    return with_strand(features.where("type = 'gene'")).select(*key_of(features), "feature_no", "location", "strand", first_of("gene").alias("gene"), first_of("locus_tag").alias("locus_tag"), first_of("note").alias("note"))


def coding_products(features: DataFrame) -> DataFrame:
    """With the length of the translation."""
    names = ("product", "gene", "protein_id", "function", "note")
    return features.where("type = 'CDS'").select(*key_of(features), "feature_no", *[first_of(n).alias(n) for n in names], F.length(first_of("translation")).cast("long").alias("translation_length"))


def regulatory_elements(features: DataFrame) -> DataFrame:
    """H05"""
    return features.where(F.col("type").isin(*REGULATORY)).select(*key_of(features), "feature_no", "type", "location", first_of("regulatory_class").alias("regulatory_class"), first_of("note").alias("note"))


def rna_features(features: DataFrame) -> DataFrame:
    """H06"""
    return features.where(F.col("type").isin(*RNA)).select(*key_of(features), "feature_no", "type", first_of("product").alias("product"), first_of("gene").alias("gene"))


def _firsts(condition: Column, value: Column, n: int) -> Column:
    items = F.array_sort(F.collect_list(F.when(condition & value.isNotNull(), F.struct("feature_no", value.alias("x")))))
    return F.transform(F.slice(items, 1, n), lambda i: i["x"])


def feature_summary(features: DataFrame, n: int = 10) -> DataFrame:
    """Counts by group and the first n gene names and products of each record."""
    t = F.col("type")
    return features.groupBy(*key_of(features)).agg(
        F.count("*").alias("features"), F.count_if(t == "gene").alias("genes"), F.count_if(t == "CDS").alias("cds"), F.count_if(t.isin(*REGULATORY)).alias("regulatory"), F.count_if(t.isin(*RNA)).alias("rna"),
        _firsts(t == "gene", first_of("gene", "locus_tag"), n).alias("gene_names"), _firsts(t == "CDS", first_of("product"), n).alias("products"),
    )


def organisms(features: DataFrame) -> DataFrame:
    """The record's key, sorted distinct organisms of its source features."""
    return features.where("type = 'source'").groupBy(*key_of(features)).agg(F.array_sort(F.collect_set(first_of("organism"))).alias("organisms"))


def scalar_annotations(records: DataFrame) -> DataFrame:
    """records(record_id, annotations map) -> record_id, name, value of the non-empty ones, one line long."""
    return records.select(*key_of(records), F.explode(F.map_filter("annotations", lambda k, v: v.isNotNull() & (v != "") & ~v.contains("\n"))).alias("name", "value"))


def taxonomy_refs(records: DataFrame) -> DataFrame:
    """The first three levels of taxonomy array, and the number of references."""
    return records.withColumns({"taxonomy_text": F.array_join(F.slice("taxonomy", 1, 3), " > "), "reference_count": F.coalesce(F.size("references"), F.lit(0)).cast("long")})


def describe_record(records: DataFrame, features: DataFrame, lang: str = "en") -> DataFrame:
    """A description of records(record_id, organism, length, gc_content, taxonomy array, reference_count) and their
    features: organism, length with GC, genes and coding sequences, products of the first three of these, RNAs by type in
    order of appearance, regulatory elements, taxonomy and references. A clause without its value is left out."""
    t, kind, key = RECORD_TEXT[lang], F.col("type"), key_of(records, features)
    say = lambda key, *cols: F.format_string(t[key], *cols)
    listed = lambda condition, value: F.array_sort(F.collect_list(F.when(condition, F.struct("feature_no", value.alias("x")))))
    found = features.groupBy(*key).agg(
        F.count_if(kind == "gene").alias("genes"), F.count_if(kind == "CDS").alias("cds"), F.count_if(kind.isin(*REGULATORY)).alias("regulatory"),
        listed(kind == "CDS", first_of("product")).alias("coding"), F.transform(listed(kind.isin(*RNA), kind), lambda i: i["x"]).alias("rna"),
    )
    r = records.join(found, key, "left")
    products = F.filter(F.transform(F.slice("coding", 1, 3), lambda i: i["x"]), lambda x: x.isNotNull() & (x != ""))
    by_type = F.transform(F.array_distinct("rna"), lambda name: F.concat(F.size(F.filter("rna", lambda x: x == name)).cast("string"), F.lit(" "), name))
    size, gc = F.format_number("length", 0), F.col("gc_content") * 100
    parts = [
        F.when(F.col("organism") != "", say("organism", F.col("organism"))),
        F.when(gc.isNotNull(), say("length_gc", size, F.round(gc + 1e-9, 1))).otherwise(say("length", size)),
        F.when((F.col("genes") > 0) | (F.col("cds") > 0), say("genes", F.col("genes"), F.col("cds"))),
        F.when(F.size(products) > 0, say("products", F.array_join(products, ", "))),
        F.when(F.size("rna") > 0, say("rna", F.array_join(by_type, ", "))),
        F.when(F.col("regulatory") > 0, say("regulatory", F.col("regulatory"))),
        F.when(F.size("taxonomy") > 0, say("taxonomy", F.array_join(F.slice("taxonomy", 1, 3), " > "))),
        F.when(F.col("reference_count") > 0, say("references", F.col("reference_count"))),
    ]
    return r.withColumn("description", sentence(parts, t["separator"], t["end"])).drop("genes", "cds", "regulatory", "coding", "rna")


def record_totals(records: DataFrame, features: DataFrame, by: str = "file") -> DataFrame:
    """Records, total length and features of each file of records(record_id, file, length)."""
    key = key_of(records, features)
    n = features.groupBy(*key).agg(F.count("*").alias("f"))
    return records.join(n, key, "left").groupBy(by).agg(F.count("*").alias("records"), F.sum("length").alias("total_length"), F.sum(F.coalesce("f", F.lit(0))).alias("features"))


def _types(features: DataFrame, key: list[str]) -> DataFrame:
    """The record's key, n features and types (type, n), the most frequent first, ties by first appearance."""
    each = features.groupBy(*key, "type").agg(F.count("*").alias("n"), F.min("feature_no").alias("first"))
    item = F.struct((-F.col("n")).alias("order"), "first", "type", "n")
    return each.groupBy(*key).agg(F.sum("n").alias("feature_count"), F.transform(F.sort_array(F.collect_list(item)), lambda x: F.struct(x["type"].alias("type"), x["n"].alias("n"))).alias("types"))


# What the head of a collection names.
ANALYSIS_VERSION = "1.0"
RECORD_FEATURES = ("feature_extraction", "gene_annotation", "protein_annotation", "regulatory_elements", "rna_features", "semantic_description")


def record_json(records: DataFrame, features: DataFrame, include_full: bool = True, include_features: bool = True, first: int = 10) -> DataFrame:
    """The record's key, json: id, name, description, length and what there is of annotations, sequence, gc_content and
    meaning (as semantic_description) of records; with features, each of them, their number by type, and a summary with the
    first genes and proteins. What is null is left out; a record without features has none of these."""
    key, have = key_of(records, features), set(records.columns)
    fields = [F.col("record_id").alias("id"), *(F.col(c) for c in ("name", "description", "length", "annotations") if c in have)]
    fields += [F.col("sequence")] if include_full and "sequence" in have else []
    fields += [F.col("gc_content")] if "gc_content" in have else []
    fields += [F.nullif("meaning", F.lit("")).alias("semantic_description")] if "meaning" in have else []
    if not include_features:
        return records.select(*key, F.to_json(F.struct(*fields)).alias("json"))
    f, kind = with_strand(features), F.col("type")
    ordered = lambda condition, *values: F.transform(F.sort_array(F.collect_list(F.when(condition, F.struct("feature_no", F.struct(*values).alias("x"))))), lambda i: i["x"])
    name = lambda x, *of: F.coalesce(*[F.get(x["qualifiers"][n], F.lit(0)) for n in of])
    named = lambda x, *of: [name(x, n).alias(n) for n in of]
    gene = lambda x: F.struct(x["location"].alias("location"), x["strand"].alias("strand"), name(x, "gene").alias("name"), *named(x, "locus_tag", "note"))
    protein = lambda x: F.struct(x["location"].alias("location"), x["strand"].alias("strand"), *named(x, "product", "gene", "protein_id", "function", "note"), F.nullif(F.length(name(x, "translation")), F.lit(0)).alias("translation_length"))
    whole = lambda x: F.struct(x["type"].alias("type"), x["location"].alias("location"), x["strand"].alias("strand"), F.map_from_entries(x["q"]).alias("qualifiers"))
    told = f.groupBy(*key).agg(
        F.transform(ordered(F.lit(True), "location", "type", "strand", F.map_entries("qualifiers").alias("q")), whole).alias("features"),
        F.count_if(kind.isin(*REGULATORY)).alias("regulatory_count"), F.count_if(kind.isin(*RNA)).alias("rna_count"),
    )
    of_type = lambda wanted, item: F.transform(F.filter("features", lambda x: x["type"] == wanted), item)
    told = told.withColumns({"genes": of_type("gene", gene), "proteins": of_type("CDS", protein)})  # a feature is shuffled once, not once a list
    both = records.join(told, key, "left").join(_types(features, key), key, "left")
    by_type = F.map_from_entries("types").alias("feature_types")
    summary = F.struct(F.size("genes").alias("gene_count"), F.size("proteins").alias("cds_count"), "regulatory_count", "rna_count", F.slice("genes", 1, first).alias("genes"), F.slice("proteins", 1, first).alias("proteins"))
    return both.select(*key, F.to_json(F.struct(*fields, "features", by_type, F.when(F.col("features").isNotNull(), summary).alias("feature_summary"))).alias("json"))


def records_json_head(records: DataFrame, by: str = "file") -> DataFrame:
    """The head of each collection's JSON; its records are the rows of record_json()."""
    totals = records.groupBy(by).agg(F.count("*").alias("total_count"), F.sum("length").alias("total_length"))
    return totals.select(by, F.to_json(F.struct("total_count", "total_length", F.lit(ANALYSIS_VERSION).alias("analysis_version"), F.array(*[F.lit(x) for x in RECORD_FEATURES]).alias("genbank_features"))).alias("json"))


def record_markdown(records: DataFrame, features: DataFrame, by: str = "file", preview: int = 100, lang: str = "en") -> DataFrame:
    """A Markdown report of each collection as rows (by, part, markdown): part 0 is the head with the totals, each further
    part a record's section, in order of record_no, or record_id where there is none. A section has the basic information and
    what there is of annotations (map), features with their types, sequence, gc_content and meaning."""
    t, key, have = REPORT_TEXT[lang], key_of(records, features), set(records.columns)
    whole = lambda c: F.format_number(F.coalesce(c, F.lit(0)), 0)
    lit = lambda x: F.lit(x)
    stats = records.groupBy(by).agg(F.count("*").alias("n"), F.sum("length").alias("sum"))
    head = F.concat(lit(f"# {RECORD_TITLE[lang]}\n\n## 📊 {t['statistics']}\n\n- **{t['count']}**: "), F.col("n").cast("string"), lit(f"\n- **{t['total']}**: "), whole(F.col("sum")), lit(f" bp\n\n## 🧬 {t['details']}\n"))
    numbered = with_number(records.join(_types(features, key), key, "left"), [by], ["record_no" if "record_no" in have else "record_id"], "part")
    id = F.col("record_id").cast("string")
    name = F.col("name") if "name" in have else id
    about = F.coalesce(F.col("description"), lit("")) if "description" in have else lit("")
    basic = F.concat(lit("**Basic Information**:\n- ID: `"), id, lit("`\n- Name: `"), F.coalesce(name, lit("")), lit("`\n- Description: "), about, lit("\n- Length: "), whole(F.col("length")), lit(" bp\n"))
    notes = F.lit(None).cast("string")
    if "annotations" in have:
        pairs = F.transform(F.map_entries("annotations"), lambda e: F.concat(lit("- "), e["key"], lit(": "), e["value"]))
        notes = F.when(F.size("annotations") > 0, F.concat(lit("**Annotations**:\n"), F.array_join(F.concat(pairs, F.array(lit(""))), "\n")))
    each = F.transform("types", lambda x: F.concat(lit("- "), x["type"], lit(": "), x["n"].cast("string")))
    counted = F.when(F.col("types").isNotNull(), F.concat(lit("**Feature Count**: "), F.col("feature_count").cast("string"), lit("\n**Feature Types**:\n"), F.array_join(each, "\n"), lit("\n")))
    letters = F.col("sequence") if "sequence" in have else F.lit(None).cast("string")
    shown = F.concat(lit(f"**{t['preview']}**:\n```\n"), F.substring(letters, 1, preview), F.when(F.length(letters) > preview, "...").otherwise(""), lit("\n```\n"))
    gc = F.format_string(f"**{t['gc']}**: %.2f%%\n", F.round(F.col("gc_content") * 100 + 1e-9, 2)) if "gc_content" in have else F.lit(None).cast("string")
    gc = F.when(F.col("gc_content").isNotNull(), gc) if "gc_content" in have else gc
    meaning = F.when(F.col("meaning") != "", F.concat(lit(f"**🔬 {t['meaning']}**:\n"), F.col("meaning"), lit("\n"))) if "meaning" in have else F.lit(None).cast("string")
    title = F.concat(lit("### "), F.col("part").cast("string"), lit(". "), F.coalesce(F.nullif(name, lit("")), id), lit("\n"))
    section = F.concat_ws("\n", title, basic, notes, counted, shown, gc, meaning)
    return stats.select(by, F.lit(0).cast("long").alias("part"), head.alias("markdown")).union(numbered.select(by, "part", section))
