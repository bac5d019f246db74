"""All cuts, reports and assets are passed; the branch without a match has fixtures."""

from granary.operators import documents, frames
from granary.plans import media


def test_cuts_of_odd_videos_stay(spark, sf_dir):
    cuts = {(r.video_id, r.frame_number) for r in media.QUERIES["j02_scene_cuts"](spark, sf_dir).collect()}
    got = {(r.video_id, r.frame_number) for r in media.QUERIES["j03_fixed_interval"](spark, sf_dir).collect()}
    assert any(v % 2 for v, _ in cuts) and cuts <= got
    held = {v for v, _ in cuts}
    assert {x for x in got if x[0] in held} == cuts


def test_a_video_without_cuts_gets_a_frame_by_the_clock(spark):
    videos = spark.createDataFrame([(1, 100, 0.5), (3, 100, 0.5)], "video_id long, total_frames long, fps double")
    cuts = spark.createDataFrame([(3, 7, 0.28)], "video_id long, frame_number long, ts double")
    got = [(r.video_id, r.frame_number) for r in frames.fixed_interval(videos, cuts).orderBy("video_id", "frame_number").collect()]
    assert (3, 7) in got and len([x for x in got if x[0] == 3]) == 1 and len([x for x in got if x[0] == 1]) > 1


def test_reports_of_odd_videos_stay(spark, sf_dir):
    reports = {r.video_id for r in frames.keyframes_report(media._ocr(spark, sf_dir)).collect()}
    got = {r.video_id: r.keyframes_enabled for r in media.QUERIES["j08_merge_video"](spark, sf_dir).collect()}
    assert any(v % 2 for v in reports) and {v for v, on in got.items() if on} == reports & set(got)


def test_images_of_odd_documents_are_rewritten(spark, sf_dir):
    got = {r.doc_id: r.text for r in media.QUERIES["k05_rewrite_images"](spark, sf_dir).collect()}
    assert any(i % 2 for i in got) and all(t.startswith(f'<img src="https://assets/{i}" alt="a">') for i, t in got.items())
    one = spark.createDataFrame([(1, "![a](img/0.png)")], "doc_id long, text string")
    assert documents.rewrite_images(one, spark.createDataFrame([(2, "0.png", "u")], "doc_id long, basename string, url string")).first().text == "![a](img/0.png)"
