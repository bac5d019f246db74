"""Cross-site boilerplate lines by distinct-site spread, in DataFrame functions alone.

A HyperLogLog sketch of sites per line hash is built map-side and merged by aggregation. Lines whose estimate is clear of
the threshold are decided by it; those near it get an exact distinct count. Lines spread over enough sites are removed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_SITES = 6
LOG_K = 10
BAND = 0.25


def _line_hash(line):
    return F.xxhash64(F.trim(line))


def boilerplate_lines(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """docs(text, source) -> h: hashes of the lines on min_sites sites or more. Blank lines and null sites do not count.

    Exact copies of a text count as one row at one site, so a group of copies does not lift its own lines.
    """
    hashes = F.array_distinct(F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), _line_hash))
    sited = docs.where("source is not null and text is not null").select(F.xxhash64("text").alias("th"), "source", hashes.alias("hs"))
    lines = sited.groupBy("th").agg(F.min("source").alias("source"), F.first("hs").alias("hs")).select("source", F.explode("hs").alias("h"))
    spread = lines.groupBy("h").agg(F.hll_sketch_estimate(F.hll_sketch_agg("source", F.lit(LOG_K))).alias("sites"))
    spread = spread.where(F.col("sites") >= min_sites * (1 - band))
    clear = spread.where(F.col("sites") > min_sites * (1 + band)).select("h")
    near = spread.where(F.col("sites") <= min_sites * (1 + band)).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= min_sites)
    return clear.union(exact.select("h"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, band: float = BAND, keep: tuple[str, ...] = ()) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, kept_text, n_lines, n_removed, and the columns named in ``keep``.

    A line (trimmed of spaces) on min_sites distinct sources or more goes wherever it stands, exact copies of a text being
    one row. Null text stays null with no lines; an empty text has one blank line and stays. Blank lines stay. Null
    sources are no site; rows with a null doc_id lose nothing. Repeated rows are treated alike, rows of one doc_id with
    different texts each by its lines. Other columns are ignored, whatever their names. An empty table gives none.
    """
    kept_columns = {f"kept_{k}": k for k in keep}
    docs = docs.select("doc_id", "text", "source", *[F.col(k).alias(name) for name, k in kept_columns.items()])
    bad = boilerplate_lines(docs, min_sites, band)
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where("doc_id is not null and trim(line) <> ''")
    hits = lines.select("doc_id", _line_hash("line").alias("h")).join(bad, "h", "left_semi")
    per_doc = hits.groupBy(F.col("doc_id").alias("of")).agg(F.collect_set("h").alias("hs"))
    joined = docs.join(per_doc, docs.doc_id == per_doc.of, "left")
    got = joined.select("doc_id", "text", "hs", F.split("text", "\n").alias("lines"), *kept_columns)
    kept = F.when(F.col("hs").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x: (F.trim(x) == "") | ~F.array_contains("hs", _line_hash(x))))
    got = got.withColumn("kept", kept)
    whole = F.size("lines") == F.size("kept")
    return got.select(
        "doc_id",
        F.when(whole, F.col("text")).otherwise(F.array_join("kept", "\n")).alias("kept_text"),
        F.coalesce(F.when(F.col("text").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("text").isNull() | whole, F.lit(0)).otherwise(F.size("lines") - F.size("kept")).cast("long").alias("n_removed"),
        *[F.col(name).alias(k) for name, k in kept_columns.items()],
    )


def oracle(min_sites: int = MIN_SITES) -> str:
    return f"""
with lines as (select doc_id, pos, line from (select doc_id, unnest(range(0, len(string_split(text, chr(10))))) pos, unnest(string_split(text, chr(10))) line from documents)),
once as (select text, min(source) source from documents where text is not null and source is not null group by text),
sited as (select source, unnest(string_split(text, chr(10))) line from once),
bad as (select trim(line) l from sited where trim(line) <> '' group by 1 having count(distinct source) >= {min_sites}),
per as (select doc_id, count(*) n_lines, count(*) filter (where b.l is not null) n_bad,
  coalesce(string_agg(line, chr(10) order by pos) filter (where b.l is null), '') joined
  from lines left join bad b on trim(line) = b.l group by doc_id)
select d.doc_id, md5(case when n_bad = 0 then text else joined end) kept_md5, cast(n_lines as bigint) n_lines, cast(n_bad as bigint) n_removed
from documents d join per using (doc_id)"""
