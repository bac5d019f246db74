"""Speech transcripts. Segments: (file_id, id, text, start_s, end_s, speaker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.constants import EMOTIONS, EVENTS, LANGUAGE_TAGS
from granary.functions.text import lookup

# Shown names of the languages.
LANGUAGE_NAMES = {"zh": "Chinese", "en": "English", "ja": "Japanese", "ko": "Korean", "yue": "Cantonese"}
_TAG = r"<\|({})\|>"
_LANG, _EMOTION, _EVENT = ("|".join(x) for x in (LANGUAGE_TAGS, EMOTIONS, EVENTS))
ITEM = "text string, start double, `end` double, speaker string, emotion string, language string"


def _first(text: Column | str, names: str, default: str) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(text, _TAG.format(names), 1), F.lit("")), F.lit(default))


def normalize_segments(transcripts: DataFrame) -> DataFrame:
    """transcripts(file_id, text, text_segments) -> a row per segment, times in seconds, defaults filled.

    A transcript without segments is one segment of its whole text at 0 s, with what its tags say.
    """
    t = transcripts.withColumn("segs", F.coalesce("text_segments", F.array().cast(f"array<struct<{ITEM.replace(' ', ':').replace(',:', ',')}>>")))
    many = t.select("file_id", F.posexplode("segs").alias("id", "s")).select(
        "file_id", F.col("id").cast("long").alias("id"), "s.text", (F.col("s.start") / 1000).alias("start_s"), (F.col("s.end") / 1000).alias("end_s"),
        F.coalesce("s.speaker", F.lit("SPEAKER_00")).alias("speaker"), F.coalesce("s.emotion", F.lit("NEUTRAL")).alias("emotion"), F.coalesce("s.language", F.lit("zh")).alias("language"),
    )
    one = t.where(F.size("segs") == 0).select(
        "file_id", F.lit(0).cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"),
        F.lit("SPEAKER_00").alias("speaker"), _first("text", _EMOTION, "NEUTRAL").alias("emotion"), _first("text", _LANG, "zh").alias("language"),
    )
    return many.union(one)


def parse_tags(df: DataFrame, col: str = "text") -> DataFrame:
    """The first language, emotion and event tag of a text, or zh, NEUTRAL and Speech."""
    return df.withColumns({"language": _first(col, _LANG, "zh"), "emotion": _first(col, _EMOTION, "NEUTRAL"), "event": _first(col, _EVENT, "Speech")})


def detect_language(df: DataFrame, col: str = "text") -> DataFrame:
    """A language tag, else by script: CJK over 0.2 of the characters, kana or hangul over 0.1; en if all letters and digits are ASCII; else auto."""
    tag = F.nullif(F.regexp_extract(col, _TAG.format(_LANG), 1), F.lit(""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(col, r"<\|[^|]+\|>", ""), r"^\s+|\s+$", ""))
    share = lambda block: (F.length(bare) - F.length(F.regexp_replace(bare, f"[{block}]", ""))) / F.length(bare)
    by_script = F.when(share("一-鿿") > 0.2, "zh").when(share("぀-ヿ") > 0.1, "ja").when(share("가-힯") > 0.1, "ko")
    foreign = bare.rlike(r"[\p{L}\p{N}&&[^\x00-\x7F]]")
    text = by_script.when(~foreign, "en").otherwise("auto")
    return df.withColumn("detected", F.coalesce(tag, F.when(F.length(bare) == 0, "unknown").otherwise(text)))


def clean_tags(df: DataFrame, col: str = "text") -> DataFrame:
    """Language tags go, emotions and events become symbols, other tags go, white space collapses."""
    out = F.regexp_replace(col, _TAG.format(_LANG + "|nospeech"), "")
    for name, symbol in (EMOTIONS | EVENTS).items():
        out = F.replace(out, F.lit(f"<|{name}|>"), F.lit(symbol))
    out = F.regexp_replace(out, r"<\|[^|]+\|>", "")
    return df.withColumn("clean_text", F.trim(F.regexp_replace(out, r"\s+", " ")))


def emotion_symbol(col: Column | str) -> Column:
    """Whatever the case; empty for others."""
    return lookup(F.upper(col), EMOTIONS, F.lit(""))


def event_symbol(col: Column | str) -> Column:
    return lookup(F.col(col) if isinstance(col, str) else col, EVENTS, F.lit(EVENTS["Speech"]))


def language_label(col: Column | str) -> Column:
    col = F.col(col) if isinstance(col, str) else col
    return lookup(col, LANGUAGE_NAMES, col)


def transcript_metadata(segments: DataFrame) -> DataFrame:
    """Duration (end of the last segment), sorted speakers and counts for each file."""
    g = segments.groupBy("file_id").agg(F.max_by("end_s", "id").alias("last"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.count("*").alias("segment_count"))
    return g.select("file_id", F.greatest("last", F.lit(0.0)).alias("duration"), "speakers", F.size("speakers").cast("long").alias("speaker_count"), "segment_count")


def speaker_turns(segments: DataFrame) -> DataFrame:
    """file_id, turn, speaker, segments, start_s, end_s, text; a turn ends where the speaker changes."""
    w = W.partitionBy("file_id").orderBy("id")
    s = segments.withColumn("new", (~F.lag("speaker").over(w).eqNullSafe(F.col("speaker"))).cast("long"))
    s = s.withColumn("turn", F.sum("new").over(w))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "text"))), lambda x: x["text"]), " ")
    return s.groupBy("file_id", "turn").agg(F.min("speaker").alias("speaker"), F.count("*").alias("segments"), F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), text.alias("text"))


def format_timestamp(seconds: Column | str) -> Column:
    """MM:SS, or HH:MM:SS from one hour on; fractions are dropped."""
    s = F.floor(seconds).cast("int")
    part = lambda x: F.lpad(x.cast("int").cast("string"), 2, "0")
    h, rest = F.floor(s / 3600), F.concat(part(F.floor(s % 3600 / 60)), F.lit(":"), part(s % 60))
    return F.when(h > 0, F.concat(F.when(h < 100, part(h)).otherwise(h.cast("string")), F.lit(":"), rest)).otherwise(rest)


def transcript_text(segments: DataFrame) -> DataFrame:
    """All cleaned segments of a file in order."""
    c = clean_tags(segments)
    return c.groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "clean_text"))), lambda x: x["clean_text"]), " ").alias("transcript"))


def transcript_markdown(segments: DataFrame) -> DataFrame:
    """Title, language (of the first segment that names one), speakers, whole text, then a line per segment under its
    speaker's name, given again where the speaker changes; NEUTRAL and Speech carry no symbol."""
    s = clean_tags(parse_tags(segments))
    mark = F.concat(F.when(F.col("emotion") == "NEUTRAL", "").otherwise(emotion_symbol("emotion")), F.when(F.col("event") == "Speech", "").otherwise(event_symbol("event")))
    line = F.trim(F.concat(F.lit("["), format_timestamp("start_s"), F.lit("] "), mark, F.lit(" "), F.col("clean_text")))
    rows = F.array_sort(F.collect_list(F.struct("id", line.alias("line"), F.col("clean_text").alias("text"), F.coalesce("speaker", F.lit("SPEAKER_00")).alias("speaker"))))
    body = s.groupBy("file_id").agg(rows.alias("rows"), F.array_sort(F.collect_set("speaker")).alias("speakers"), F.min_by("language", F.when(F.col("language").isNotNull(), F.col("id"))).alias("language"))
    changed = lambda x, i: (i == 0) | (F.get("rows", i - 1)["speaker"] != x["speaker"])
    named = F.transform("rows", lambda x, i: F.when(changed(x, i), F.concat(F.lit("\n**"), x["speaker"], F.lit("**:\n\n"), x["line"])).otherwise(x["line"]))
    text = F.concat_ws(
        "\n", F.concat(F.lit("# Transcript "), F.col("file_id").cast("string")), F.lit(""), F.concat(F.lit("**Language**: "), F.coalesce(language_label("language"), F.lit("auto"))),
        F.concat(F.lit("**Number of speakers**: "), F.size("speakers").cast("string")), F.when(F.size("speakers") > 0, F.concat(F.lit("**Speakers**: "), F.array_join("speakers", ", "))), F.lit(""),
        F.lit("## Text"), F.lit(""), F.array_join(F.transform("rows", lambda x: x["text"]), " "), F.lit(""), F.lit("## Segments"), F.array_join(named, "\n"),
    )
    return body.select("file_id", text.alias("markdown"))
