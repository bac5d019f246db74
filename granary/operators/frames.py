"""Key frames of videos. Frames: (video_id, frame_number, gray array, ...), already decoded."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from granary.functions.shared import written
from granary.operators.halo import with_previous
from granary.operators.transcripts import format_timestamp


def frame_diff(frames: DataFrame) -> DataFrame:
    """Mean absolute difference to the frame before; null for the first. A video is in as many tasks as its size asks for."""
    both = with_previous(frames.select("video_id", "frame_number", "gray"), ["video_id"], ["frame_number"], ["gray"])
    gaps = F.zip_with("gray", "previous_gray", lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    total = F.aggregate(gaps, F.lit(0.0), lambda acc, x: acc + x) / F.size("gray")
    return both.select("video_id", "frame_number", F.when(F.col("previous_gray").isNotNull(), total).alias("diff"))


def _followed(steps: DataFrame, start: DataFrame) -> DataFrame:
    """steps(video_id, at, next) and start(video_id, at) -> all (video_id, at) that one comes to from the starts.

    Each round knows where twice as many steps lead, so the rounds grow with the logarithm of the longest way."""
    reached, jump = written(start.distinct(), "reached"), steps.where("next is not null")
    n = reached.count()
    while True:
        led = reached.join(jump, ["video_id", "at"]).select("video_id", F.col("next").alias("at"))
        reached = written(reached.union(led).distinct(), "reached")
        m = reached.count()
        if m == n:
            return reached
        n = m
        after = jump.select("video_id", F.col("at").alias("next"), F.col("next").alias("then"))
        jump = written(jump.join(after, ["video_id", "next"]).select("video_id", "at", F.col("then").alias("next")), "jump")


def scene_cuts(diffs: DataFrame, threshold: float = 30.0, min_seconds: float = 1.0, fps: float = 25.0) -> DataFrame:
    """video_id, frame_number, ts of the cuts: a large difference, and far enough from the last cut (at first frame 0).

    Each candidate's next cut, were it one, is the first candidate far enough on; the cuts are those that the first leads to.
    Only numbers of candidates are sorted and joined, never pixels, and no array holds a video.
    """
    gap = int(min_seconds * fps)
    c = diffs.where(F.col("diff") > threshold).select("video_id", F.col("frame_number").cast("long").alias("at")).distinct()
    asks = c.select("video_id", F.col("at").alias("of"), (F.col("at") + gap).alias("at")).union(c.select("video_id").distinct().select("video_id", F.lit(-1).cast("long"), F.lit(gap).cast("long")))
    both = c.select("video_id", F.lit(None).cast("long").alias("of"), "at").union(asks)
    onward = W.partitionBy("video_id").orderBy(F.desc("at"), F.col("of").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    step = both.withColumn("next", F.min(F.when(F.col("of").isNull(), F.col("at"))).over(onward)).where("of is not null and next <> of or of = -1")
    steps = written(step.select("video_id", F.col("of").alias("at"), "next"), "steps")
    found = _followed(steps, steps.where("at = -1").select("video_id", "at")).where("at >= 0")
    return found.select("video_id", F.col("at").alias("frame_number"), (F.col("at") / fps).alias("ts"))


def fixed_interval(videos: DataFrame, cuts: DataFrame, seconds: int = 10) -> DataFrame:
    """Cuts, and for videos(video_id, fps, total_frames) without any, a frame every ``seconds`` from 0."""
    without = videos.join(cuts.select("video_id").distinct(), "video_id", "left_anti").withColumn("length", F.floor(F.col("total_frames") / F.col("fps")).cast("int"))
    steps = without.where("length > 0").select("video_id", "fps", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(seconds))).alias("at"))
    return cuts.select("video_id", "frame_number", "ts").union(steps.select("video_id", F.floor(F.col("at") * F.col("fps")).alias("frame_number"), F.col("at").cast("double").alias("ts")))


@pandas_udf(DoubleType())
def sharpness(gray: pd.Series, width: pd.Series) -> pd.Series:
    """Variance of the 4-neighbour Laplacian, edges mirrored."""

    def one(pixels, w):
        m = np.pad(np.asarray(pixels, float).reshape(-1, int(w)), 1, mode="reflect")
        return float((m[:-2, 1:-1] + m[2:, 1:-1] + m[1:-1, :-2] + m[1:-1, 2:] - 4 * m[1:-1, 1:-1]).var())

    return pd.Series([None if g is None else one(g, w) for g, w in zip(gray, width)], dtype="float64")


def brightness(gray: Column | str = "gray") -> Column:
    return F.aggregate(gray, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(gray)


def quality_filter(frames: DataFrame, width: int, sharp: float = 100.0, lo: float = 30.0, hi: float = 225.0) -> DataFrame:
    """Frames that are sharp and neither dark nor blown, with quality_score. Brightness is tested before pixels leave the JVM."""
    lit = frames.where(brightness().between(lo, hi))
    return lit.withColumn("quality_score", sharpness("gray", F.lit(width))).where(F.col("quality_score") >= sharp)


def mean_hash(gray: Column | str = "gray") -> Column:
    """64-bit hash: bit k says whether pixel k of an 8 x 8 frame is above the mean."""
    bits = F.transform(gray, lambda x, k: F.when(x.cast("double") > F.col("mean"), F.lit(1).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    return F.aggregate(F.transform(bits, lambda b, k: F.call_function("shiftleft", b, k)), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def with_hash(frames: DataFrame) -> DataFrame:
    return frames.withColumn("mean", brightness()).withColumn("phash", mean_hash()).drop("mean")


def phash_dedup(frames: DataFrame, max_bits: int = 5) -> DataFrame:
    """video_id, frame_number of the frames that differ from the last kept one in more than max_bits of their hash.

    What stays depends on what stayed, so a video's hashes, 16 bytes a frame, go by in order in one task, which holds the last
    kept one alone."""
    kind = dict(frames.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, last = object(), 0
        for b in batches:
            keep = []
            for k, (v, h) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist())):
                if h is not None and (v != video or ((last ^ h) & (1 << 64) - 1).bit_count() > max_bits):
                    video, last = v, h
                    keep.append(k)
            yield b.take(pa.array(keep, pa.int64())).select(["video_id", "frame_number"])

    rows = frames.select("video_id", F.col("frame_number").cast("long").alias("frame_number"), F.col("phash").cast("long").alias("phash"))
    return rows.repartition("video_id").sortWithinPartitions("video_id", "frame_number").mapInArrow(run, f"video_id {kind['video_id']}, frame_number long")


def text_near_dup(frames: DataFrame, ratio: float = 0.9) -> DataFrame:
    """frames(video_id, frame_number, ocr_text) whose text is new against the last kept one's.

    Similarity is difflib's ratio, current text first. Blank texts go, but for a first one. Frames of one video, a few
    hundred after the earlier steps, meet in one task.
    """

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, last = [], None
        for k, text in enumerate(pdf.sort_values("frame_number").itertuples(index=False)):
            t = (text.ocr_text or "").strip()
            if last is None or (t and (not last or difflib.SequenceMatcher(None, t, last).ratio() < ratio)):
                kept.append((text.video_id, text.frame_number))
                last = t
        return pd.DataFrame(kept, columns=["video_id", "frame_number"])

    kind = dict(frames.dtypes)
    return frames.select("video_id", "frame_number", "ocr_text").groupBy("video_id").applyInPandas(keep, f"video_id {kind['video_id']}, frame_number {kind['frame_number']}")


def keyframes_report(frames: DataFrame) -> DataFrame:
    """video_id, markdown, json of frames(video_id, frame_number, ts, ocr_text)."""
    text = F.when(F.trim("ocr_text") == "", F.lit(None).cast("string")).otherwise(F.trim("ocr_text"))
    section = F.concat(F.lit("### ["), format_timestamp("ts"), F.format_string("] (%.2fs)\n\n", "ts"), F.coalesce(text, F.lit("*no text*")), F.lit("\n"))
    item = F.struct("frame_number", "ts", "ocr_text")
    rows = F.array_sort(F.collect_list(F.struct("frame_number", section.alias("section"), item.alias("item"))))
    g = frames.groupBy("video_id").agg(rows.alias("rows"))
    return g.select(
        "video_id", F.concat(F.lit("## Key frames\n\n"), F.array_join(F.transform("rows", lambda x: x["section"]), "\n")).alias("markdown"),
        F.to_json(F.transform("rows", lambda x: x["item"])).alias("json"), F.size("rows").cast("long").alias("total_keyframes"),
    )


def merge_video(transcripts: DataFrame, frames: DataFrame) -> DataFrame:
    """transcripts(video_id, markdown[, file_name]) with what is known of the video and its key-frame report.

    -> video_id, type, file_type, video_format, original_filename, markdown, keyframes_enabled, total_keyframes. The video's
    lines go in before the first blank line, or in front where there is none; the report, without its title, follows at
    the end. A null transcript stays null. file_name: by default the video_id.
    """
    f = frames.select("video_id", F.col("markdown").alias("report"), F.col("total_keyframes").alias("total"))
    name = F.col("file_name") if "file_name" in transcripts.columns else F.col("video_id").cast("string")
    t = transcripts.select("video_id", "markdown", name.alias("file_name"))
    ext = F.regexp_extract("file_name", r"\.([^./]*)$", 1)
    seen = F.col("report").isNotNull()
    ocr = F.when(seen, F.format_string("**Key-frame OCR**: enabled (%d frames)\n", "total")).otherwise("**Key-frame OCR**: not enabled\n")
    info = F.concat(F.lit("\n**Source file**: "), "file_name", F.lit(" (video)\n**Video format**: "), F.upper(ext), F.lit("\n"), ocr)
    at = F.instr("markdown", "\n\n")
    body = F.when(at > 0, F.concat(F.expr("substr(markdown, 1, instr(markdown, '\\n\\n') - 1)"), info, F.expr("substr(markdown, instr(markdown, '\\n\\n'))"))).otherwise(F.concat(info, "markdown"))
    untitled = F.regexp_replace("report", r"^[^\n]*\n*", "")
    tail = F.when(seen, F.concat(F.format_string("\n\n---\n\n# Key frames of the video\n\n> %d key frames were taken from the video and read\n\n", "total"), untitled)).otherwise("")
    joined = t.join(f, "video_id", "left")
    return joined.select(
        "video_id", F.lit("video").alias("type"), F.lit("video").alias("file_type"), ext.alias("video_format"), F.col("file_name").alias("original_filename"),
        F.concat(body, tail).alias("markdown"), seen.alias("keyframes_enabled"), F.coalesce("total", F.lit(0)).cast("long").alias("total_keyframes"),
    )


PROBE = "format struct<duration:string,size:string,format_name:string>, streams array<struct<codec_type:string,codec_name:string,width:int,height:int,r_frame_rate:string>>"


def media_fields(probes: DataFrame, col: str = "probe") -> DataFrame:
    """Duration, container and the first video and audio stream of a probe's JSON."""
    p = F.from_json(F.col(col), PROBE)
    first = lambda kind: F.get(F.filter(p["streams"], lambda s: s["codec_type"] == kind), F.lit(0))
    v, a = first("video"), first("audio")
    return probes.withColumns({"duration": p["format"]["duration"].cast("double"), "container": p["format"]["format_name"], "width": v["width"], "height": v["height"], "video_codec": v["codec_name"], "audio_codec": a["codec_name"]})
