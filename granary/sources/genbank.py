"""Flat-file sequence records with annotations, as a records and a features table.

A record's feature table is cut before each key line, which its continuation lines follow, within the row; nothing is shuffled.
No line is parsed in Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.sources.splits import numbered, split_text

_KEYED = r"[^\n]{5,19}[^ \n]"  # something in columns 6 to 20
KEY_LINE = rf"\n(?={_KEYED})"


def read_genbank(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """(records, features) of .gb files; records are read, and numbered within their file, in parallel, split on their end mark."""
    rows = numbered(split_text(spark, paths, "\n//"), F.trim(F.regexp_replace("value", r"\s", "")) != "")
    return parse_genbank(rows.select("file", F.col("ord").alias("record_no"), "value"))


def _field(key: str):
    """The value of a header field, continuation lines joined by blanks."""
    text = F.regexp_extract("value", rf"(?s)(?:^|\n){key} +(.*?)(?=\n\S|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(text, r"\s*\n\s+", " ")), F.lit(""))


def parse_genbank(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """raw(file, record_no, value), one record each -> records(file, record_no, record_id, name, description, sequence, length,
    organism, taxonomy, references), features(file, record_no, record_id, feature_no, type, location, qualifiers).

    A record is known by its file and its number there, so records of one accession, in several files or one, stay apart. Without
    a record_no in raw, records are numbered as they come.
    """
    raw = raw.withColumn("value", F.replace("value", F.lit("\r"), F.lit("")))
    raw = raw if "record_no" in raw.columns else raw.withColumn("record_no", F.monotonically_increasing_id())
    accession = F.coalesce(F.substring_index(_field("VERSION"), " ", 1), F.substring_index(_field("ACCESSION"), " ", 1), F.substring_index(_field("LOCUS"), " ", 1))
    origin = F.regexp_extract("value", r"(?s)\nORIGIN[^\n]*\n(.*)", 1)
    source = F.regexp_extract("value", r"(?s)\n +ORGANISM +([^\n]*)((?:\n {12}[^\n]*)*)", 2)
    records = raw.select(
        "file", "record_no", accession.alias("record_id"), F.substring_index(_field("LOCUS"), " ", 1).alias("name"), _field("DEFINITION").alias("description"),
        F.upper(F.regexp_replace(origin, "[^A-Za-z]", "")).alias("sequence"),
        F.nullif(F.regexp_extract("value", r"\n +ORGANISM +([^\n]*)", 1), F.lit("")).alias("organism"),
        F.filter(F.split(F.trim(F.regexp_replace(F.regexp_replace(source, r"\.\s*$", ""), r"\s+", " ")), r"\s*;\s*"), lambda x: x != "").alias("taxonomy"),
        F.regexp_count("value", F.lit(r"(?:^|\n)REFERENCE ")).cast("long").alias("references"),
    ).withColumn("length", F.length("sequence").cast("long"))
    table = F.regexp_extract("value", r"(?s)\nFEATURES[^\n]*\n(.*?)(?=\n\S|\z)", 1)
    lines = F.array_join(F.filter(F.split(table, "\n"), lambda x: F.trim(x) != ""), "\n")
    # outer: for a plain explode Spark asks for the array's size first, in a filter that works it out once more
    cut = raw.select("file", "record_no", accession.alias("record_id"), lines.alias("lines")).select("*", F.posexplode_outer(F.split("lines", KEY_LINE)).alias("k", "feature")).where(F.col("feature") != "")
    keyed = F.col("lines").rlike(f"^{_KEYED}").cast("long")  # lines before the first key are feature 0
    text = F.array_join(F.transform(F.split("feature", "\n"), lambda x: F.trim(F.substring(x, 22, 1 << 30))), "\n")
    whole = cut.select("file", "record_no", (F.col("k") + keyed).alias("feature_no"), "record_id", F.nullif(F.trim(F.substring(F.substring_index("feature", "\n", 1), 6, 15)), F.lit("")).alias("type"), text.alias("text"))
    entry = lambda x: F.struct(F.regexp_extract(x, r"^/([^=\n]+)", 1).alias("key"), F.regexp_replace(F.regexp_replace(F.regexp_extract(x, r"(?s)=(.*)$", 1), r'^"|"$', ""), r"\n", " ").alias("value"))
    items = F.transform(F.filter(F.slice("parts", 2, 1000000), lambda x: x.startswith("/")), entry)
    tidy = lambda e: F.when(e["key"] == "translation", F.replace(e["value"], F.lit(" "), F.lit(""))).otherwise(e["value"])
    names = F.array_distinct(F.transform("items", lambda e: e["key"]))
    values = F.transform("names", lambda n: F.transform(F.filter("items", lambda e: e["key"] == n), tidy))
    location = F.replace(F.get("parts", F.lit(0)), F.lit("\n"), F.lit(""))
    features = whole.withColumn("parts", F.split("text", r"\n(?=/)")).withColumn("items", items).withColumn("names", names)  # one after the other, so that each is worked out once
    features = features.select("file", "record_no", "record_id", F.col("feature_no").cast("long").alias("feature_no"), "type", location.alias("location"), F.map_from_arrays("names", values).alias("qualifiers"))
    return records, features
