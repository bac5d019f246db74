"""Routing of files to engines, catalogues and options."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.constants import ENGINE_INFO, ENGINES, EXPLICIT_BACKENDS


def engine_registrations(spark: SparkSession) -> DataFrame:
    """reg_order, engine, ext: a few dozen rows by construction."""
    rows = [(k, e, x) for k, (e, xs) in enumerate(ENGINES.items()) for x in xs]
    return spark.createDataFrame(rows, "reg_order int, engine string, ext string")


def extension(name: Column | str) -> Column:
    """Lower-cased suffix with its dot, of the last path part; empty if none."""
    return F.lower(F.regexp_extract(name, r"[^/.](\.[^./\\]+)$", 1))


def lookup_engine(files: DataFrame, registrations: DataFrame, name: str = "file_name") -> DataFrame:
    """Ext, engine, supported; the last registration of an extension counts."""
    last = registrations.groupBy(F.col("ext").alias("registered_ext")).agg(F.max_by("engine", "reg_order").alias("engine"))
    out = files.withColumn("ext", extension(name)).join(F.broadcast(last), F.col("ext") == F.col("registered_ext"), "left").drop("registered_ext")
    return out.withColumn("supported", F.col("engine").isNotNull())


def route_engine(tasks: DataFrame, registrations: DataFrame) -> DataFrame:
    """Engine and route_error. A named backend wins; auto goes by extension; another name must be registered."""
    names = registrations.select(F.col("engine").alias("named")).distinct()
    t = lookup_engine(tasks, registrations).withColumnRenamed("engine", "by_ext")
    t = t.join(F.broadcast(names), F.col("backend") == F.col("named"), "left")
    engine = F.when(F.col("backend").isin(*EXPLICIT_BACKENDS), F.col("backend")).when(F.col("backend") == "auto", F.col("by_ext")).otherwise(F.col("named"))
    t = t.withColumn("engine", engine)
    error = F.when(F.col("engine").isNotNull(), F.lit(None).cast("string")).when(F.col("backend") == "auto", F.concat(F.lit("unsupported file type: "), F.col("ext"))).otherwise(F.concat(F.lit("unknown engine: "), F.col("backend")))
    return t.withColumn("route_error", error).drop("by_ext", "named", "ext", "supported")


def engine_catalogue(registrations: DataFrame) -> DataFrame:
    """Category, engine, display_name, description, extensions (sorted), n of each engine. One without a known entry is a
    format of its own name, in capitals, without description."""
    about = registrations.sparkSession.createDataFrame([(e, *x) for e, x in ENGINE_INFO.items()], "named string, category string, display_name string, description string")
    own = registrations.groupBy("engine").agg(F.array_sort(F.collect_set("ext")).alias("extensions"), F.count_distinct("ext").alias("n"))
    both = own.join(F.broadcast(about), F.col("engine") == F.col("named"), "left")
    return both.select(F.coalesce("category", F.lit("format")).alias("category"), "engine", F.coalesce("display_name", F.upper("engine")).alias("display_name"), "description", "extensions", "n")


def catalogue_by_category(catalogue: DataFrame) -> DataFrame:
    """The engines of each category as an array."""
    item = F.struct("engine", "display_name", "description", "extensions")
    return catalogue.groupBy("category").agg(F.array_sort(F.collect_list(item)).alias("engines"))


# Option defaults.
OPTION_DEFAULTS = {"lang": "auto", "method": "auto", "formula_enable": True, "table_enable": True, "keep_audio": False, "enable_keyframe_ocr": False, "ocr_backend": "paddleocr-vl", "keep_keyframes": False, "remove_watermark": False, "watermark_conf_threshold": 0.35, "watermark_dilation": 10}


def _kind(value) -> str:
    return {bool: "boolean", float: "double", int: "int"}.get(type(value), "string")


def apply_option_defaults(tasks: DataFrame, options: str = "options") -> DataFrame:
    """One typed column for each option; the document language auto reads as ch."""
    schema = ", ".join(f"{k} {_kind(v)}" for k, v in OPTION_DEFAULTS.items())
    given = F.from_json(F.col(options), schema)
    out = tasks.withColumns({k: F.coalesce(given[k], F.lit(v)) for k, v in OPTION_DEFAULTS.items()})
    return out.withColumn("document_lang", F.when(F.col("lang") == "auto", "ch").otherwise(F.col("lang")))


def project_options(tasks: DataFrame, allowed: list[str], renames: dict[str, str], options: str = "options") -> DataFrame:
    """An option map cut to the allowed keys, some renamed."""
    given = F.from_json(F.col(options), "map<string,string>")
    kept = F.map_filter(given, lambda k, v: k.isin(*allowed))

    def name(k: Column) -> Column:
        out = k
        for old, new in renames.items():
            out = F.when(k == old, F.lit(new)).otherwise(out)
        return out

    return tasks.withColumn("options_map", F.transform_keys(kept, lambda k, v: name(k)))


def split_errors(df: DataFrame, error_type: str = "error_type", message: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows without an error, rows with status failed and 'Type: message')."""
    bad = F.col(error_type).isNotNull()
    text = F.concat_ws(": ", error_type, message)
    return df.where(~bad).drop(error_type, message), df.where(bad).withColumn("status", F.lit("failed")).withColumn("error_message", text).drop(error_type, message)


def sequence_lang(col: Column | str) -> Column:
    """Zh for the Chinese names, else en."""
    return F.when(F.lower(F.trim(col)).isin("zh", "zh-cn", "zh_cn", "chinese", "中文"), "zh").otherwise("en")


class FormatRegistry:
    """Name -> (extensions, reader(spark, paths, options) -> DataFrame); users add formats."""

    def __init__(self):
        self.readers: dict[str, tuple[tuple[str, ...], Callable]] = {}

    def register(self, name: str, extensions: tuple[str, ...], reader: Callable) -> None:
        self.readers[name] = (tuple(x.lower() for x in extensions), reader)

    def format_of(self, path: str) -> str:
        for name, (extensions, _) in reversed(self.readers.items()):
            if path.lower().endswith(extensions):
                return name
        raise ValueError(f"no reader for {path}")

    def read_any(self, spark: SparkSession, paths: list[str], options: dict | None = None) -> dict[str, DataFrame]:
        groups: dict[str, list[str]] = {}
        for p in paths:
            groups.setdefault(self.format_of(p), []).append(p)
        return {n: self.readers[n][1](spark, ps, options or {}) for n, ps in groups.items()}


def default_registry() -> FormatRegistry:
    """The formats of this library."""
    from granary.sources.fasta import read_fasta
    from granary.sources.files import read_plain
    from granary.sources.genbank_source import records_source

    registry = FormatRegistry()
    registry.register("fasta", ENGINES["fasta"], lambda spark, paths, options: read_fasta(spark, paths))
    registry.register("genbank", ENGINES["genbank"], lambda spark, paths, options: functools.reduce(DataFrame.union, (records_source(spark, p, options) for p in paths)))
    registry.register("text", (".txt", ".md"), lambda spark, paths, options: read_plain(spark, paths))
    return registry
