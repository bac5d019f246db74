"""Pages, redaction, image references, results, boxes, formulas, JSON structure and display helpers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.constants import BACKEND_LABELS
from granary.functions.shared import written
from granary.functions.text import lookup

PAGE_BREAK = "\n\n---\n\n"


def merge_pages(pages: DataFrame, sep: str = PAGE_BREAK) -> DataFrame:
    """doc_id, markdown: the texts of a document's pages in order."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(rows, lambda x: x["page_text"]), sep).alias("markdown"))


def combine_page_json(pages: DataFrame) -> DataFrame:
    """doc_id, json with pages and total_pages."""
    rows = F.array_sort(F.collect_list(F.struct("page_no", "page_text")))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(rows.alias("pages"), F.count("*").alias("total_pages"))).alias("json"))


def editable_or_scanned(pages: DataFrame, first: int = 5, min_chars: int = 50, ratio: float = 0.1) -> DataFrame:
    """doc_id, kind: editable if ratio or more of the first pages hold more than min_chars of stripped text."""
    has = F.length(F.regexp_replace("page_text", r"^\s+|\s+$", "")) > min_chars
    share = F.avg(F.when(has, 1.0).otherwise(0.0))
    return pages.where(F.col("page_no") < first).groupBy("doc_id").agg(F.when(share >= ratio, "editable").otherwise("scanned").alias("kind"))


def redact_keywords(pages: DataFrame, keywords: list[str], col: str = "page_text") -> DataFrame:
    """The text without the keywords, taken in the order given, and how many occurrences went."""
    text, removed = F.col(col), F.lit(0)
    for k in keywords:
        n = (F.length(text) - F.length(F.replace(text, F.lit(k), F.lit("")))) / len(k)
        text, removed = F.replace(text, F.lit(k), F.lit("")), removed + n
    return pages.withColumns({"redacted": text, "removed": removed.cast("long")})


_IMAGE = r"!\[([^\]]*)\]\(([^)]+)\)"


def image_refs(docs: DataFrame, col: str = "text") -> DataFrame:
    """doc_id, pos, alt, path, basename of the Markdown images of a text."""
    whole = F.posexplode(F.regexp_extract_all(col, F.lit(_IMAGE), F.lit(0))).alias("pos", "ref")
    r = docs.select("doc_id", whole)
    return r.select("doc_id", F.col("pos").cast("long").alias("pos"), F.regexp_extract("ref", _IMAGE, 1).alias("alt"), F.regexp_extract("ref", _IMAGE, 2).alias("path"), F.element_at(F.split(F.regexp_extract("ref", _IMAGE, 2), "/"), -1).alias("basename"))


def rewrite_images(docs: DataFrame, assets: DataFrame, col: str = "text") -> DataFrame:
    """Texts with images found among assets(doc_id, basename, url) as img elements; others stay as they are."""
    refs = image_refs(docs, col).join(assets, ["doc_id", "basename"], "left").where("url is not null")
    found = refs.groupBy("doc_id").agg(F.collect_list(F.struct(F.concat(F.lit("!["), "alt", F.lit("]("), "path", F.lit(")")).alias("old"), F.concat(F.lit('<img src="'), "url", F.lit('" alt="'), "alt", F.lit('">')).alias("new"))).alias("found"))
    out = docs.join(found, "doc_id", "left")
    new = F.aggregate("found", F.col(col), lambda t, x: F.replace(t, x["old"], x["new"]))
    return out.withColumn(col, F.when(F.col("found").isNull(), F.col(col)).otherwise(new)).drop("found")


def select_results(tasks: DataFrame, files: DataFrame, format: str = "markdown") -> DataFrame:
    """tasks(task_id, result_path) with files(task_id, path): the Markdown and JSON chosen, and a message where either is missing."""
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.when(name.endswith(".md"), "md").when(name.isin("content.json", "result.json") | name.endswith("_content_list.json"), "json")
    ranked = files.withColumn("kind", kind).where("kind is not null").withColumn("n", F.row_number().over(W.partitionBy("task_id", "kind").orderBy("path"))).where("n = 1")
    by_kind = ranked.groupBy("task_id").agg(F.max(F.when(F.col("kind") == "md", F.col("path"))).alias("md"), F.max(F.when(F.col("kind") == "json", F.col("path"))).alias("js"))
    t = tasks.select("task_id", "result_path").join(by_kind, "task_id", "left")
    message = F.when(F.col("result_path").isNull(), "result files have been cleaned up")
    if format in ("json", "both"):
        message = message.when(F.col("js").isNull(), "JSON not available for this task")
    return t.select("task_id", (F.col("md") if format in ("markdown", "both") else F.lit(None).cast("string")).alias("markdown_path"), (F.col("js") if format in ("json", "both") else F.lit(None).cast("string")).alias("json_path"), F.col("js").isNotNull().alias("json_available"), message.alias("message"))


def has_images(tasks: DataFrame, files: DataFrame) -> DataFrame:
    """Whether a file of the task lies in a folder named images."""
    held = files.where(F.col("path").contains("/images/")).select("task_id", F.lit(True).alias("found")).distinct()
    return tasks.select("task_id").join(held, "task_id", "left").select("task_id", F.coalesce("found", F.lit(False)).alias("has_images"))


def dilate_boxes(boxes: DataFrame, conf: float = 0.35, dilation: int = 10, w: int | None = None, h: int | None = None) -> DataFrame:
    """Boxes of enough confidence, grown on each side and cut to the page; with their area."""
    clip = lambda c, hi: F.greatest(F.lit(0), c if hi is None else F.least(c, F.lit(hi)))
    g = boxes.where(F.col("conf") >= conf).select("page_id", "box_no", *[clip(F.col(c) + s * dilation, hi).alias(c) for c, s, hi in (("x1", -1, w), ("y1", -1, h), ("x2", 1, w), ("y2", 1, h))])
    return g.withColumn("area", ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).cast("long"))


def sweep(boxes: DataFrame, confidences=(0.25, 0.35, 0.45, 0.55), dilations=(5, 10, 15, 20)) -> DataFrame:
    """Boxes and summed area for each pair of settings; the grid is a literal array, so boxes are read once and combined map-side."""
    grid = F.array(*[F.struct(F.lit(c).alias("min_conf"), F.lit(d).alias("dilation")) for c in confidences for d in dilations])
    b = boxes.select("conf", "x1", "y1", "x2", "y2", F.inline(grid)).where("conf >= min_conf")
    lo = lambda c: F.greatest(F.lit(0), F.col(c) - F.col("dilation"))
    area = (F.col("x2") + F.col("dilation") - lo("x1")) * (F.col("y2") + F.col("dilation") - lo("y1"))
    return b.groupBy("min_conf", "dilation").agg(F.count("*").alias("boxes"), F.sum(area.cast("long")).alias("area"))


_BLOCK = r"(?s)\$\$.+?\$\$|\\\[.+?\\\]"
_INLINE = r"\$[^$\n]+\$|\\\(.+?\\\)"


def formulas(docs: DataFrame, col: str = "text") -> DataFrame:
    """doc_id, kind, pos, formula: blocks first, then inline ones of what is left."""
    found = lambda kind, text, pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x, k: F.struct(F.lit(kind).alias("kind"), k.cast("long").alias("pos"), x.alias("formula")))
    rest = F.regexp_replace(col, _BLOCK, "")
    return docs.select("doc_id", F.inline(F.concat(found("block", F.col(col), _BLOCK), found("inline", rest, _INLINE))))


_NO_VALUE = "cast(null as variant)"
LEVELS, MOST_LEVELS = 4, 32


def _children(v: Column, path: Column, depth: Column) -> Column:
    """The objects and arrays right below one: (path, depth, v)."""
    fields = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
    items = F.transform(F.try_variant_get(v, "$", "array<variant>"), lambda x, k: F.struct(k.cast("string").alias("key"), x.alias("value")))
    under = lambda e: F.struct(F.when(depth == 0, e["key"]).otherwise(F.concat(path, F.lit("."), e["key"])).alias("path"), (depth + 1).alias("depth"), e["value"].alias("v"))
    return F.filter(F.transform(F.coalesce(fields, items), under), lambda x: _is_container(x["v"]))


def _is_container(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "map<string,variant>").isNotNull() | F.try_variant_get(v, "$", "array<variant>").isNotNull(), F.lit(False))


def json_paths(docs: DataFrame, id: str = "id", col: str = "json", max_level: int | None = None) -> DataFrame:
    """Id, path, depth, error of every object and array of a JSON text, dot-joined, down to max_level if given.

    Levels are opened from the outside in, LEVELS at first and twice as many each round up to MOST_LEVELS, until none is left:
    rounds grow with the depth of the deepest text, not with the number of texts. What follows a whole value is not looked at.
    A text that Spark's reader does not take (bad JSON, a key twice in an object, more than
    its thousand levels) is one row with an error and no path. A null text and a scalar have no rows.
    """
    spark = docs.sparkSession
    parsed = docs.select(F.col(id).alias("id"), F.col(col).cast("string").alias("text")).where("text is not null").withColumn("v", F.try_parse_json("text"))
    bad = parsed.where("v is null").select("id", F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("depth"), F.lit("not JSON that can be read").alias("error"))
    open_ = parsed.where(_is_container(F.col("v"))).select("id", F.lit("").alias("path"), F.lit(0).cast("long").alias("depth"), "v")
    none, done, level, many = F.expr(_NO_VALUE), [], 0, LEVELS
    while True:
        rows = open_
        steps = many if max_level is None else min(many, max_level - level)
        for _ in range(steps):
            own = F.array(F.struct("path", "depth", none.alias("v")))
            below = F.when(F.col("v").isNotNull(), _children(F.col("v"), F.col("path"), F.col("depth")))
            rows = rows.select("id", F.inline(F.concat(own, F.coalesce(below, F.slice(own, 1, 0)))))
        level, many = level + steps, min(2 * many, MOST_LEVELS)
        last = max_level is not None and level >= max_level
        rows = rows.withColumn("json", F.to_json("v")).drop("v") if not last else rows.drop("v").withColumn("json", F.lit(None).cast("string"))
        rows = written(rows, "levels")
        done.append(rows.where("json is null").select("id", "path", "depth") if not last else rows.select("id", "path", "depth"))
        left = rows.where("json is not null")
        if last or left.isEmpty():
            break
        open_ = left.select("id", "path", "depth", F.try_parse_json("json").alias("v"))
    found = done[0]
    for more in done[1:]:
        found = found.union(more)
    return found.withColumn("error", F.lit(None).cast("string")).union(bad)


def _value_preview(v: Column, width: int) -> Column:
    """One value as it is shown: strings in quotes, cut at a width, containers by their size."""
    n_fields = F.size(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>")))
    n_items = F.size(F.try_variant_get(v, "$", "array<variant>"))
    text = F.try_variant_get(v, "$", "string")
    number = F.regexp_replace(text, r"(\.[0-9]*?)0+$", "$1")
    shown = F.when(F.length(text) > width, F.concat(F.lit('"'), F.substring(text, 1, width), F.lit('..."'))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    kind = F.schema_of_variant(v)
    return (
        F.when(F.is_variant_null(v), "null").when(kind.startswith("OBJECT"), F.format_string("Object(%d)", n_fields)).when(kind.startswith("ARRAY"), F.format_string("Array(%d)", n_items))
        .when(kind == "STRING", shown).when(kind.startswith("DECIMAL"), F.regexp_replace(number, r"\.$", "")).otherwise(text)
    )


def json_shape(docs: DataFrame, id: str = "id", col: str = "json", width: int = 20, first: int = 3) -> DataFrame:
    """Id, kind (object, array, scalar, invalid), n keys or items, preview: of an object the first keys with their values,
    of an array the first items, in order of the text, with dots if there are more; of a scalar itself."""
    d = docs.select(F.col(id).alias("id"), F.col(col).cast("string").alias("text")).withColumn("v", F.try_parse_json("text"))
    shape = F.schema_of_variant("v")
    kind = F.when(F.col("v").isNull(), "invalid").when(shape.startswith("OBJECT"), "object").when(shape.startswith("ARRAY"), "array").otherwise("scalar")
    d = d.withColumn("kind", kind).withColumn("keys", F.when(F.col("kind") == "object", F.json_object_keys("text")))
    d = d.withColumn("items", F.try_variant_get("v", "$", "array<variant>")).withColumn("fields", F.try_variant_get("v", "$", "map<string,variant>"))
    n = F.when(F.col("kind") == "object", F.size("keys")).when(F.col("kind") == "array", F.size("items")).otherwise(0)
    pairs = F.transform(F.slice("keys", 1, first), lambda k: F.concat(k, F.lit(": "), _value_preview(F.try_element_at("fields", k), width)))
    values = F.transform(F.slice("items", 1, first), lambda x: _value_preview(x, width))
    listed = F.array_join(F.coalesce(pairs, values), ", ")
    preview = F.when(F.col("kind").isin("object", "array"), F.concat(listed, F.when(n > first, ", ...").otherwise(""))).when(F.col("kind") == "scalar", _value_preview(F.col("v"), width))
    return d.select("id", "kind", n.cast("long").alias("n"), preview.alias("preview"))


UNITS = ("B", "KB", "MB", "GB", "TB")


def format_bytes(col: Column | str) -> Column:
    """Base 1024, two decimals at most, no trailing zeros."""
    b = (F.col(col) if isinstance(col, str) else col).cast("double")
    k = F.when(b < 1, F.lit(0)).otherwise(sum((F.when(b >= 1024.0**i, 1).otherwise(0) for i in range(1, len(UNITS))), F.lit(0)))
    n = F.round(b / F.pow(F.lit(1024.0), k), 2)
    number = F.regexp_replace(F.format_string("%.2f", n), r"\.?0+$", "")
    unit = F.element_at(F.array(*[F.lit(u) for u in UNITS]), k + 1)
    return F.when(b == 0, "0 B").otherwise(F.concat(F.when(F.format_string("%.2f", n).endswith(".00"), F.format_string("%.0f", n)).otherwise(number), F.lit(" "), unit))


def format_duration(start: Column | str, end: Column | str) -> Column:
    """Seconds, minutes and seconds, or hours and minutes; - where a time is missing."""
    s = F.timestamp_diff("SECOND", start, end) if not isinstance(start, str) else F.timestamp_diff("SECOND", F.col(start), F.col(end))
    text = F.when(s < 60, F.concat(s.cast("string"), F.lit("s"))).when(s < 3600, F.concat(F.floor(s / 60).cast("string"), F.lit("m"), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.floor(s / 3600).cast("string"), F.lit("h"), F.floor(s % 3600 / 60).cast("string"), F.lit("m")))
    return F.coalesce(text, F.lit("-"))


def display_time(col: Column | str, zone: str = "UTC") -> Column:
    """Local time as text; - for none."""
    return F.coalesce(F.date_format(F.from_utc_timestamp(col, zone), "yyyy-MM-dd HH:mm:ss"), F.lit("-"))


def relative_time(col: Column | str, as_of: dt.datetime) -> Column:
    """How long before as_of, in the largest whole unit."""
    s = F.timestamp_diff("SECOND", F.col(col) if isinstance(col, str) else col, F.lit(as_of))
    ago = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(f" {unit} ago"))
    return F.coalesce(F.when(s < 60, "just now").when(s < 3600, ago(s / 60, "min")).when(s < 86400, ago(s / 3600, "h")).otherwise(ago(s / 86400, "d")), F.lit("-"))


def backend_label(col: Column | str) -> Column:
    """Shown name of a backend, or the name itself."""
    col = F.col(col) if isinstance(col, str) else col
    return lookup(col, BACKEND_LABELS, col)
