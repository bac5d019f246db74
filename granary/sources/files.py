"""Reading and writing files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators.transcripts import ITEM
from granary.sources.splits import numbered, split_text


def file_inventory(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Path, length, modified, kind (md, json, other), is_result. File contents are never read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    return classify_files(f)


def classify_files(files: DataFrame) -> DataFrame:
    """Kind and is_result from the path; files in folders named page_... are parts, not results."""
    parts = F.split("path", "/")
    name, parent = F.element_at(parts, -1), F.coalesce(F.try_element_at(parts, F.lit(-2)), F.lit(""))
    kind = F.when(name.endswith(".md"), "md").when(name.endswith(".json"), "json").otherwise("other")
    result = ~parent.startswith("page_") & ((kind == "md") | name.isin("content.json", "result.json") | name.endswith("_content_list.json"))
    return files.withColumns({"kind": kind, "is_result": result})


def read_transcripts(spark: SparkSession, paths) -> DataFrame:
    """file_id, text, text_segments of JSON lists with one object; an empty list is a transcript without segments."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_id"), "value")
    return parse_transcripts(raw)


def parse_transcripts(raw: DataFrame, col: str = "value") -> DataFrame:
    got = F.from_json(F.col(col), f"array<struct<text:string,text_segments:array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in ITEM.split(','))}>>>>")
    first = F.get(got, F.lit(0))
    return raw.select("file_id", F.coalesce(first["text"], F.lit("")).alias("text"), first["text_segments"].alias("text_segments"))


def read_ocr_pages(spark: SparkSession, paths) -> DataFrame:
    """doc_id (file), page_no, page, total_pages of {"pages": [...], "total_pages": n} files."""
    raw = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("doc_id"), "value")
    return parse_ocr_pages(raw)


def parse_ocr_pages(raw: DataFrame, col: str = "value") -> DataFrame:
    got = F.from_json(F.col(col), "pages array<string>, total_pages long")
    return raw.select("doc_id", F.posexplode(got["pages"]).alias("page_no", "page"), got["total_pages"].alias("total_pages"))


def read_delimited(spark: SparkSession, paths, schema: str, sep: str = ",", header: bool = True) -> DataFrame:
    """The schema's columns, with error_type and error, both null for a row that fits the schema. A row with a value of
    another kind, or too few or many values, is kept with what could be read; error is its line. split_errors() parts the two.
    Lines are read in parallel and each is judged whole, whatever columns a query asks for; blank lines and, with a header,
    each file's first line are left out."""
    lines = split_text(spark, paths)
    lines = numbered(lines, F.lit(True)).where("ord > 1") if header else lines
    parsed = F.from_csv("value", f"{schema}, error string", {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "error"})
    rows = lines.where(F.trim("value") != "").select(parsed.alias("row")).select("row.*")
    return rows.withColumn("error_type", F.when(F.col("error").isNotNull(), "MalformedRow"))


def read_plain(spark: SparkSession, paths) -> DataFrame:
    """Path, text of whole files."""
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def decode_base64(df: DataFrame, col: str) -> DataFrame:
    """Payload, and an error where the text is no base64."""
    got = F.try_to_binary(col, F.lit("base64"))
    return df.withColumns({"payload": got, "error": F.when(got.isNull() & F.col(col).isNotNull(), "invalid base64")})


def size_limit(df: DataFrame, limit: int = 524288000, col: str = "length") -> tuple[DataFrame, DataFrame]:
    """(rows within the limit, rejected rows with size_mb)."""
    fits = F.coalesce(F.col(col) <= limit, F.lit(False))
    return df.where(fits), df.where(~fits).withColumn("size_mb", F.round(F.col(col) / (1024 * 1024), 2))


def filename_from_source(df: DataFrame, url: str = "url", disposition: str = "disposition") -> DataFrame:
    """A10: the name a Content-Disposition gives, else the URL's last part, else downloaded_file."""
    named = F.nullif(F.trim(F.regexp_extract(disposition, r"filename[*]?=[\"']?([^\"';\r\n]+)", 1)), F.lit(""))
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", "")
    last = F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))
    return df.withColumn("file_name", F.coalesce(named, last, F.lit("downloaded_file")))
