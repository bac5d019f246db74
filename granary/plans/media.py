"""Queries and oracles of H01-H12, I01-I11, J01-J09 and K01-K16."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from granary.constants import RECORD_TEXT, RECORD_TITLE, REPORT_TEXT
from granary.operators import annotations as H
from granary.operators import documents as K
from granary.operators import frames as J
from granary.operators import transcripts as T
from granary.plans.views import duck, table, v_boxes, v_doc_pages, v_features, v_frames, v_segments, v_tasks

R6 = lambda c: F.round(c, 6).alias(c)
SCENE = 0.15  # the frames of the given tables hold values in -0.53..0.46, not 0..255


def _transcripts(s, d):
    g = v_segments(s, d).groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("id", "text", "start_s", "end_s", "speaker"))).alias("x"))
    seg = F.transform("x", lambda i: F.struct(i["text"].alias("text"), (i["start_s"] * 1000).alias("start"), (i["end_s"] * 1000).alias("end"), F.when(i["id"] % 3 != 0, i["speaker"]).alias("speaker"), F.lit(None).cast("string").alias("emotion"), F.when(i["id"] % 2 == 0, F.lit("en")).alias("language")))
    return g.select("file_id", F.get("x", F.lit(0))["text"].alias("text"), F.when(F.col("file_id") % 7 != 0, seg).alias("text_segments"))


def _cuts(s, d):
    return J.scene_cuts(J.frame_diff(v_frames(s, d)), SCENE, 0.2)


def j03(s, d):
    videos = v_frames(s, d).groupBy("video_id").agg(F.count("*").alias("total_frames")).withColumn("fps", F.lit(0.5))
    return J.fixed_interval(videos, _cuts(s, d))


def _ocr(s, d):
    return table(s, d, "conversations").selectExpr("conv_id video_id", "turn frame_number", "cast(turn * 1.5 as double) ts", "case when turn % 5 = 4 then '' when turn % 3 = 2 then concat(text, ' ') else text end ocr_text")


def j08(s, d):
    t = T.transcript_markdown(v_segments(s, d)).select(F.col("file_id").alias("video_id"), "markdown", F.concat("file_id", F.lit(".mp4")).alias("file_name"))
    return J.merge_video(t, J.keyframes_report(_ocr(s, d)))


def j09(s, d):
    probe = F.expr("""concat('{"format":{"duration":"', l_quantity, '","format_name":"mp4"},"streams":[', case when l_linenumber % 2 = 0 then '{"codec_type":"audio","codec_name":"aac"},' else '' end, '{"codec_type":"video","codec_name":"h264","width":', l_partkey % 1920, ',"height":', l_suppkey, '}]}')""")
    return J.media_fields(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", probe.alias("probe"))).select("l_orderkey", "l_linenumber", "duration", "container", "width", "height", "video_codec", "audio_codec")


def _images(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("![a](img/"), F.col("doc_id") % 5, F.lit(".png) "), F.col("text"), F.when(F.col("doc_id") % 3 == 0, F.lit(" ![b c](x/y/z.jpg)")).otherwise("")).alias("text"))


def _files(s, d):
    t = v_tasks(s, d).select("task_id", "key")
    paths = F.array(F.concat(F.lit("/out/"), "task_id", F.lit("/b.md")), F.concat(F.lit("/out/"), "task_id", F.lit("/a.md")), F.when(F.col("key") % 4 == 0, F.concat(F.lit("/out/"), "task_id", F.lit("/content.json"))), F.when(F.col("key") % 5 == 0, F.concat(F.lit("/out/"), "task_id", F.lit("/images/p1.png"))))
    return t.select("task_id", F.explode(paths).alias("path")).where("path is not null")


_SHAPES = """case event_id % 5 when 0 then props when 1 then concat('[', event_id, ',"', repeat(event_type, 6), '",null,true]')
  when 2 then concat('{"z":"', event_type, '","a":[1,2],"m":{"x":1},"b":', event_id, '}') when 3 then concat('"', event_type, '"') else concat('{', event_type) end"""


def _math(s, d):
    return table(s, d, "documents").select("doc_id", F.concat(F.lit("$$x"), F.col("doc_id") % 7, F.lit("$$ and $y$ or \\(z\\) \\[w"), "doc_id", F.lit("\\] "), F.regexp_replace("text", r"[$\\]", "")).alias("text"))


def _records(s, d):
    return table(s, d, "orders").selectExpr(
        "o_orderkey record_id", "case when o_orderkey % 5 > 0 then concat('organism ', o_orderkey % 9) end organism", "cast(floor(o_totalprice) as bigint) length",
        "case when o_orderkey % 7 > 0 then (o_orderkey % 1000) / 1000.0D end gc_content", "case when o_orderkey % 3 > 0 then array('a', o_orderstatus, o_orderpriority, 'z') end taxonomy", "o_orderkey % 4 reference_count",
    )


def k02(s, d):
    """What the JSON of each document's pages says, read back from it."""
    got = F.from_json("json", "pages array<struct<page_no:long,page_text:string>>, total_pages long")
    return K.combine_page_json(v_doc_pages(s, d)).select(
        "doc_id", F.aggregate(got["pages"], F.lit(0).cast("long"), lambda a, x: a + x["page_no"]).alias("numbers"), F.size(got["pages"]).cast("long").alias("pages"), got["total_pages"].alias("total_pages"),
        F.md5(F.array_join(F.transform(got["pages"], lambda x: x["page_text"]), "|")).alias("texts_md5"),
    )


def _full_records(s, d):
    more = table(s, d, "orders").selectExpr(
        "o_orderkey record_id", "o_orderpriority file", "case when o_orderkey % 4 > 0 then concat('L', o_orderkey) else '' end name", "concat('order ', o_orderkey) description", "repeat('ACGTT', cast(o_orderkey % 30 as int)) sequence",
        "case when o_orderkey % 3 > 0 then map('priority', o_orderpriority, 'status', o_orderstatus) end annotations", "case when o_orderkey % 2 = 0 then concat('says ', o_orderkey) end meaning",
    )
    return _records(s, d).select("record_id", "length", "gc_content").join(more, "record_id")


def h12_json(s, d):
    """What the JSON of each record says, read back from it."""
    j = H.record_json(_full_records(s, d), v_features(s, d))
    at = lambda path, kind="string": F.get_json_object("json", f"$.{path}").cast(kind)
    return j.select(
        "record_id", F.array_join(F.json_object_keys("json"), ",").alias("keys"), at("annotations.status").alias("status"), F.json_array_length(at("features")).cast("long").alias("features"), at("feature_types.gene", "long").alias("gene_type"),
        at("feature_summary.gene_count", "long").alias("genes"), at("feature_summary.cds_count", "long").alias("cds"), at("feature_summary.regulatory_count", "long").alias("regulatory"), at("feature_summary.rna_count", "long").alias("rna"),
        at("feature_summary.genes[0].locus_tag").alias("first_gene"), at("feature_summary.proteins[0].product").alias("first_product"),
    )


QUERIES = {
    "h01_features_strand": lambda s, d: H.with_strand(v_features(s, d)).select("record_id", "feature_no", "type", "location", "strand"),
    "h02_feature_type_counts": lambda s, d: H.feature_type_counts(v_features(s, d)),
    "h03_genes": lambda s, d: H.genes(v_features(s, d)),
    "h04_coding_products": lambda s, d: H.coding_products(v_features(s, d)).select("record_id", "feature_no", "product", "gene", "translation_length"),
    "h05_regulatory_elements": lambda s, d: H.regulatory_elements(v_features(s, d)).select("record_id", "feature_no", "type", "regulatory_class"),
    "h06_rna_features": lambda s, d: H.rna_features(v_features(s, d)),
    "h07_feature_summary": lambda s, d: H.feature_summary(v_features(s, d)).select("record_id", "features", "genes", "cds", "regulatory", "rna", F.array_join("gene_names", ",").alias("gene_names"), F.array_join("products", ",").alias("products")),
    "h08_organisms": lambda s, d: H.organisms(v_features(s, d)).select("record_id", F.array_join("organisms", ",").alias("organisms")),
    "h09_scalar_annotations": lambda s, d: H.scalar_annotations(table(s, d, "orders").selectExpr("o_orderkey record_id", "map('priority', o_orderpriority, 'status', case when o_orderkey % 5 = 0 then '' else o_orderstatus end) annotations")),
    "h10_taxonomy_refs": lambda s, d: H.taxonomy_refs(table(s, d, "orders").selectExpr("o_orderkey record_id", "array('a', o_orderstatus, o_orderpriority, 'z') taxonomy", "sequence(1, cast(1 + o_orderkey % 3 as int)) references")).select("record_id", "taxonomy_text", "reference_count"),
    "h11_describe_record": lambda s, d: H.describe_record(_records(s, d), v_features(s, d)).select("record_id", "description"),
    "h11_describe_record_zh": lambda s, d: H.describe_record(_records(s, d), v_features(s, d), "zh").select("record_id", "description"),
    "h12_record_totals": lambda s, d: H.record_totals(table(s, d, "orders").selectExpr("o_orderkey record_id", "o_orderpriority file", "cast(o_totalprice as bigint) length"), v_features(s, d)),
    "h12_record_json": h12_json,
    "h12_record_markdown": lambda s, d: H.record_markdown(_full_records(s, d), v_features(s, d)).select("file", "part", F.md5("markdown").alias("markdown_md5")),
    "i01_normalize_segments": lambda s, d: T.normalize_segments(_transcripts(s, d)),
    "i03_parse_tags": lambda s, d: T.parse_tags(v_segments(s, d)).select("file_id", "id", "language", "emotion", "event"),
    "i04_detect_language": lambda s, d: T.detect_language(v_segments(s, d)).select("file_id", "id", "detected"),
    "i05_clean_tags": lambda s, d: T.clean_tags(v_segments(s, d)).select("file_id", "id", "clean_text"),
    "i06_symbols": lambda s, d: T.parse_tags(v_segments(s, d)).select("file_id", "id", T.emotion_symbol("emotion").alias("emotion"), T.event_symbol("event").alias("event"), T.language_label("language").alias("lang_name")),
    "i07_transcript_metadata": lambda s, d: T.transcript_metadata(v_segments(s, d)).withColumn("speakers", F.array_join("speakers", ",")),
    "i08_speaker_turns": lambda s, d: T.speaker_turns(v_segments(s, d)),
    "i09_format_timestamp": lambda s, d: v_segments(s, d).select("file_id", "id", T.format_timestamp(F.col("start_s") * 700).alias("at")),
    "i10_transcript_text": lambda s, d: T.transcript_text(v_segments(s, d)),
    "i11_transcript_markdown": lambda s, d: T.transcript_markdown(v_segments(s, d)),
    "j01_frame_diff": lambda s, d: J.frame_diff(v_frames(s, d)).select("video_id", "frame_number", R6("diff")),
    "j02_scene_cuts": _cuts,
    "j03_fixed_interval": j03,
    "j04_quality_filter": lambda s, d: J.quality_filter(v_frames(s, d), 8, 0.1, -0.02, 0.02).select("video_id", "frame_number", R6("quality_score")),
    "j05_phash_dedup": lambda s, d: J.phash_dedup(J.with_hash(v_frames(s, d)), 28),
    "j06_text_near_dup": lambda s, d: J.text_near_dup(_ocr(s, d)),
    "j07_keyframes_report": lambda s, d: J.keyframes_report(_ocr(s, d)).select("video_id", "markdown", "total_keyframes"),
    "j08_merge_video": j08,
    "j09_media_fields": j09,
    "k01_merge_pages": lambda s, d: K.merge_pages(v_doc_pages(s, d)).select("doc_id", F.md5("markdown").alias("markdown_md5")),
    "k02_combine_page_json": k02,
    "k03_editable_or_scanned": lambda s, d: K.editable_or_scanned(v_doc_pages(s, d)),
    "k04_redact_keywords": lambda s, d: K.redact_keywords(v_doc_pages(s, d), ["the", "ou", "en"]).select("doc_id", "page_no", F.md5("redacted").alias("redacted_md5"), "removed"),
    "k05_image_refs": lambda s, d: K.image_refs(_images(s, d)),
    "k05_rewrite_images": lambda s, d: K.rewrite_images(_images(s, d), table(s, d, "documents").selectExpr("doc_id", "concat(doc_id % 5, '.png') basename", "concat('https://assets/', doc_id) url")),
    "k06_select_results": lambda s, d: K.select_results(v_tasks(s, d), _files(s, d), "both"),
    "k07_has_images": lambda s, d: K.has_images(v_tasks(s, d), _files(s, d)),
    "k08_dilate_boxes": lambda s, d: K.dilate_boxes(v_boxes(s, d), w=530, h=500),
    "k09_sweep": lambda s, d: K.sweep(v_boxes(s, d)),
    "k10_formulas": lambda s, d: K.formulas(_math(s, d)),
    "k11_json_paths": lambda s, d: K.json_paths(table(s, d, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"a":{"b":[1,{"c":2}]},"p":'), "props", F.lit("}")).alias("json"))).where("error is null").drop("error"),
    "k12_json_shape": lambda s, d: K.json_shape(table(s, d, "events").select("event_id", F.expr(_SHAPES).alias("json")), "event_id"),
    "k13_format_bytes": lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", K.format_bytes(F.pow(F.lit(7.0), F.col("l_linenumber")).cast("bigint") * F.col("l_partkey")).alias("bytes_text")),
    "k14_format_duration": lambda s, d: v_tasks(s, d).select("task_id", K.format_duration("started_at", "completed_at").alias("duration")),
    "k15_display_times": lambda s, d: v_tasks(s, d).select("task_id", K.display_time("started_at", "Asia/Shanghai").alias("shown"), K.relative_time("created_at", dt.datetime(1998, 8, 2)).alias("ago")),
    "k16_backend_labels": lambda s, d: v_tasks(s, d).select("task_id", K.backend_label("backend").alias("label")),
}

_S = "v_segments"
_CLEAN = "trim(regexp_replace(regexp_replace(replace(replace(replace(regexp_replace(text, '<\\|(zh|en|ja|ko|yue|nospeech)\\|>', '', 'g'), '<|HAPPY|>', '😊'), '<|BGM|>', '🎵'), '<|Speech|>', '💬'), '<\\|[^|]+\\|>', '', 'g'), '\\s+', ' ', 'g'))"
_DIFF = "with p as (select *, lag(gray) over (partition by video_id order by frame_number) prev from v_frames), d as (select video_id, frame_number, case when prev is not null then list_sum(list_transform(range(1, len(gray) + 1), lambda i: abs(gray[i]::double - prev[i]::double))) / len(gray) end diff from p) "
_CUT = _DIFF.replace("with p", "with recursive p", 1) + f", c as (select video_id, frame_number, row_number() over (partition by video_id order by frame_number) k from d where diff > {SCENE}), w as (select video_id, 0::bigint k, 0::bigint last, false cut, 0::bigint f from (select distinct video_id from c) union all select w.video_id, c.k, case when c.frame_number - w.last >= 5 then c.frame_number else w.last end, c.frame_number - w.last >= 5, c.frame_number from w join c on c.video_id = w.video_id and c.k = w.k + 1), cuts as (select video_id, f frame_number, f / 25 ts from w where cut) "
_HASH = "with recursive h as (select video_id, frame_number, row_number() over (partition by video_id order by frame_number) k, list_transform(gray, lambda x: x::double > list_sum(list_transform(gray, lambda y: y::double)) / len(gray)) b from v_frames), w as (select video_id, k, frame_number, b, true keep from h where k = 1 union all select h.video_id, h.k, h.frame_number, case when dist > 28 then h.b else w.b end, dist > 28 from (select w.*, list_sum(list_transform(range(1, 65), lambda i: (w.b[i] <> h.b[i])::int)) dist, h.video_id v2, h.k k2, h.frame_number f2, h.b b2 from w join h on h.video_id = w.video_id and h.k = w.k + 1) w join h on h.video_id = w.v2 and h.k = w.k2) select video_id, frame_number from w where keep"
_F = "v_features"
_REG = "('regulatory', 'promoter', 'enhancer', 'terminator', 'RBS', 'TATA_signal', 'polyA_signal')"
_RNA = "('rRNA', 'tRNA', 'mRNA', 'ncRNA', 'misc_RNA')"
_SUMMARY = f"with u as (select record_id, count(*) features, count(*) filter (where type = 'gene') genes, count(*) filter (where type = 'CDS') cds, count(*) filter (where type in {_REG}) regulatory, count(*) filter (where type in {_RNA}) rna, coalesce(string_agg(coalesce(q_gene, q_locus), ',' order by feature_no, coalesce(q_gene, q_locus)) filter (where type = 'gene'), '') gene_names, coalesce(string_agg(q_product, ',' order by feature_no, q_product) filter (where type = 'CDS'), '') products, list(q_product order by feature_no, q_product) filter (where type = 'CDS') ps from v_features group by 1) "



def _record_sql(lang: str) -> str:
    t = RECORD_TEXT[lang]
    say = lambda key, *values: f"printf('{t[key]}', {', '.join(values)})"
    size, gc = "format('{:,}', length)", "round(100 * gc + 1e-9, 1)"
    return duck(
        f"""with n as (select record_id, type, count(*) n, min(feature_no) k from v_features where type in {_RNA} group by 1, 2),
r as (select record_id, string_agg(n || ' ' || type, ', ' order by k, type) rna from n group by 1),
p as (select record_id, list(q_product order by feature_no, q_product)[1:3] ps from v_features where type = 'CDS' group by 1),
f as (select record_id, count(*) filter (where type = 'gene') genes, count(*) filter (where type = 'CDS') cds, count(*) filter (where type in {_REG}) reg from v_features group by 1),
o as (select o_orderkey record_id, cast(floor(o_totalprice) as bigint) length, case when o_orderkey % 7 > 0 then (o_orderkey % 1000) / 1000::double end gc, o_orderkey, o_orderstatus, o_orderpriority from orders)
select o.record_id, concat_ws('{t['separator']}', case when o_orderkey % 5 > 0 then {say('organism', "'organism ' || (o_orderkey % 9)")} end, case when gc is not null then {say('length_gc', size, gc)} else {say('length', size)} end,
  case when genes > 0 or cds > 0 then {say('genes', 'genes', 'cds')} end, case when ps is not null then {say('products', "array_to_string(ps, ', ')")} end, case when rna is not null then {say('rna', 'rna')} end,
  case when reg > 0 then {say('regulatory', 'reg')} end, case when o_orderkey % 3 > 0 then {say('taxonomy', "concat_ws(' > ', 'a', o_orderstatus, o_orderpriority)")} end,
  case when o_orderkey % 4 > 0 then {say('references', 'o_orderkey % 4')} end) || '{t['end']}' description
from o left join f using (record_id) left join p using (record_id) left join r using (record_id)""",
        _F,
    )


ORACLES = {
    "h01_features_strand": duck("select record_id, feature_no, type, location, case when starts_with(location, 'complement') then -1 else 1 end strand from v_features", _F),
    "h02_feature_type_counts": duck("select record_id, type, count(*) n from v_features group by 1, 2", _F),
    "h03_genes": duck("select record_id, feature_no, location, case when starts_with(location, 'complement') then -1 else 1 end strand, q_gene gene, q_locus locus_tag, cast(null as varchar) note from v_features where type = 'gene'", _F),
    "h04_coding_products": duck("select record_id, feature_no, q_product product, q_gene gene, cast(q_translation as bigint) translation_length from v_features where type = 'CDS'", _F),
    "h05_regulatory_elements": duck(f"select record_id, feature_no, type, case when type = 'regulatory' then 'promoter' end regulatory_class from v_features where type in {_REG}", _F),
    "h06_rna_features": duck(f"select record_id, feature_no, type, q_product product, q_gene gene from v_features where type in {_RNA}", _F),
    "h07_feature_summary": duck(_SUMMARY + "select * exclude (ps) from u", _F),
    "h08_organisms": duck("select record_id, string_agg(distinct q_organism, ',' order by q_organism) organisms from v_features where type = 'source' group by 1", _F),
    "h09_scalar_annotations": "select o_orderkey record_id, 'priority' name, o_orderpriority \"value\" from orders union all select o_orderkey, 'status', o_orderstatus from orders where o_orderkey % 5 <> 0",
    "h10_taxonomy_refs": "select o_orderkey record_id, 'a > ' || o_orderstatus || ' > ' || o_orderpriority taxonomy_text, 1 + o_orderkey % 3 reference_count from orders",
    "h11_describe_record": _record_sql("en"),
    "h11_describe_record_zh": _record_sql("zh"),
    "h12_record_totals": "with f as (select l_orderkey k, count(*) f from lineitem group by 1) select o_orderpriority file, count(*) records, cast(sum(cast(trunc(o_totalprice) as bigint)) as bigint) total_length, cast(sum(coalesce(f, 0)) as bigint) features from orders left join f on k = o_orderkey group by 1",
    "i01_normalize_segments": duck("select file_id, id, text, start_s, end_s, case when id % 3 <> 0 then speaker else 'SPEAKER_00' end speaker, 'NEUTRAL' emotion, case when id % 2 = 0 then 'en' else 'zh' end \"language\" from v_segments where file_id % 7 <> 0 union all select file_id, 0, text, 0, 0, 'SPEAKER_00', case when regexp_matches(text, '<\\|HAPPY\\|>') then 'HAPPY' else 'NEUTRAL' end, case when regexp_matches(text, '<\\|en\\|>') then 'en' else 'zh' end from v_segments where file_id % 7 = 0 qualify row_number() over (partition by file_id order by id) = 1", _S),
    "i03_parse_tags": duck("select file_id, id, case when id % 4 = 0 then 'en' else 'zh' end \"language\", case when id % 4 = 0 then 'HAPPY' else 'NEUTRAL' end emotion, case id % 4 when 1 then 'BGM' else 'Speech' end event from v_segments", _S),
    "i04_detect_language": duck("select file_id, id, case when id % 4 = 0 then 'en' when regexp_matches(regexp_replace(text, '<\\|[^|]+\\|>', '', 'g'), '[À-ÖØ-öø-ɏ]') then 'auto' else 'en' end detected from v_segments", _S),
    "i05_clean_tags": duck(f"select file_id, id, {_CLEAN} clean_text from v_segments", _S),
    "i06_symbols": duck("select file_id, id, case when id % 4 = 0 then '😊' else '😐' end emotion, case id % 4 when 1 then '🎵' else '💬' end event, case when id % 4 = 0 then 'English' else 'Chinese' end lang_name from v_segments", _S),
    "i07_transcript_metadata": duck("select file_id, greatest(arg_max(end_s, id), 0) duration, string_agg(distinct speaker, ',' order by speaker) speakers, count(distinct speaker) speaker_count, count(*) segment_count from v_segments group by 1", _S),
    "i08_speaker_turns": duck("with n as (select *, case when lag(speaker) over (partition by file_id order by id) is not distinct from speaker then 0 else 1 end new from v_segments), t as (select *, sum(new) over (partition by file_id order by id) turn from n) select file_id, cast(turn as bigint) turn, min(speaker) speaker, count(*) segments, min(start_s) start_s, max(end_s) end_s, string_agg(text, ' ' order by id) text from t group by file_id, turn", _S),
    "i09_format_timestamp": duck("with t as (select file_id, id, cast(floor(start_s * 700) as int) s from v_segments) select file_id, id, case when s >= 3600 then printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%02d:%02d', s // 60, s % 60) end \"at\" from t", _S),
    "i10_transcript_text": duck(f"select file_id, string_agg({_CLEAN}, ' ' order by id) transcript from v_segments group by 1", _S),
    "j01_frame_diff": duck(_DIFF + "select video_id, frame_number, round(diff, 6) diff from d", "v_frames"),
    "j02_scene_cuts": duck(_CUT + "select video_id, frame_number, ts from cuts", "v_frames").replace("with v_frames", "with recursive v_frames").replace(", recursive p as", ", p as"),
    "j05_phash_dedup": duck(_HASH, "v_frames").replace("with v_frames", "with recursive v_frames").replace(", recursive h as", ", h as"),
    "j09_media_fields": "select l_orderkey, l_linenumber, cast(l_quantity as double) duration, 'mp4' container, cast(l_partkey % 1920 as int) width, cast(l_suppkey as int) height, 'h264' video_codec, case when l_linenumber % 2 = 0 then 'aac' end audio_codec from lineitem",
    "k01_merge_pages": duck("select doc_id, md5(string_agg(page_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_no)) markdown_md5 from v_doc_pages group by 1", "v_doc_pages"),
    "k03_editable_or_scanned": duck("select doc_id, case when avg(case when length(regexp_replace(page_text, '^\\s+|\\s+$', '', 'g')) > 50 then 1.0 else 0.0 end) >= 0.1 then 'editable' else 'scanned' end kind from v_doc_pages where page_no < 5 group by 1", "v_doc_pages"),
    "k04_redact_keywords": duck("with a as (select *, replace(page_text, 'the', '') t1 from v_doc_pages), b as (select *, replace(t1, 'ou', '') t2 from a), c as (select *, replace(t2, 'en', '') t3 from b) select doc_id, page_no, md5(t3) redacted_md5, (length(page_text) - length(t1)) // 3 + (length(t1) - length(t3)) // 2 removed from c", "v_doc_pages"),
    "k05_image_refs": "select doc_id, 0::bigint pos, 'a' alt, 'img/' || (doc_id % 5) || '.png' path, (doc_id % 5) || '.png' basename from documents union all select doc_id, 1::bigint, 'b c', 'x/y/z.jpg', 'z.jpg' from documents where doc_id % 3 = 0",
    "k05_rewrite_images": "select doc_id, '<img src=\"https://assets/' || doc_id || '\" alt=\"a\"> ' || text || case when doc_id % 3 = 0 then ' ![b c](x/y/z.jpg)' else '' end text from documents",
    "k06_select_results": duck("select task_id, '/out/' || task_id || '/a.md' markdown_path, case when key % 4 = 0 then '/out/' || task_id || '/content.json' end json_path, key % 4 = 0 json_available, case when result_path is null then 'result files have been cleaned up' when key % 4 <> 0 then 'JSON not available for this task' end message from v_tasks", "v_tasks"),
    "k07_has_images": duck("select task_id, key % 5 = 0 has_images from v_tasks", "v_tasks"),
    "k08_dilate_boxes": duck("with b as (select page_id, box_no, greatest(0, least(x1 - 10, 530)) x1, greatest(0, least(y1 - 10, 500)) y1, greatest(0, least(x2 + 10, 530)) x2, greatest(0, least(y2 + 10, 500)) y2 from v_boxes where conf >= 0.35) select *, cast((x2 - x1) * (y2 - y1) as bigint) area from b", "v_boxes"),
    "k09_sweep": duck("select min_conf, dilation, count(*) boxes, cast(sum((x2 + dilation - greatest(0, x1 - dilation)) * (y2 + dilation - greatest(0, y1 - dilation))) as bigint) area from v_boxes, (values (0.25::double), (0.35), (0.45), (0.55)) c(min_conf), (values (5), (10), (15), (20)) e(dilation) where conf >= min_conf group by 1, 2", "v_boxes"),
    "k10_formulas": "select doc_id, unnest(['block', 'block', 'inline', 'inline']) kind, unnest([0, 1, 0, 1]::bigint[]) pos, unnest(['$$x' || (doc_id % 7) || '$$', '\\[w' || doc_id || '\\]', '$y$', '\\(z\\)']) formula from documents",
    "k13_format_bytes": "with b as (select l_orderkey, l_linenumber, cast(pow(7, l_linenumber) as bigint) * l_partkey b from lineitem), k as (select *, case when b >= 1099511627776 then 4 when b >= 1073741824 then 3 when b >= 1048576 then 2 when b >= 1024 then 1 else 0 end k from b) select l_orderkey, l_linenumber, case when b = 0 then '0 B' else regexp_replace(regexp_replace(printf('%.2f', round(b / pow(1024, k), 2)), '0+$', ''), '\\.$', '') || ' ' || ['B', 'KB', 'MB', 'GB', 'TB'][k + 1] end bytes_text from k",
    "k14_format_duration": duck("with t as (select task_id, cast(floor(epoch_us(completed_at) / 1e6 - epoch_us(started_at) / 1e6) as bigint) s from v_tasks) select task_id, coalesce(case when s < 60 then s || 's' when s < 3600 then (s // 60) || 'm' || (s % 60) || 's' else (s // 3600) || 'h' || (s % 3600 // 60) || 'm' end, '-') duration from t", "v_tasks"),
    "k15_display_times": duck("with t as (select task_id, started_at, cast(epoch_us(timestamp '1998-08-02') / 1e6 - epoch_us(created_at) / 1e6 as bigint) s from v_tasks) select task_id, coalesce(strftime(started_at + interval 8 hour, '%Y-%m-%d %H:%M:%S'), '-') shown, case when s < 60 then 'just now' when s < 3600 then (s // 60) || ' min ago' when s < 86400 then (s // 3600) || ' h ago' else (s // 86400) || ' d ago' end ago from t", "v_tasks"),
    "k16_backend_labels": duck("select task_id, case backend when 'pipeline' then 'Document pipeline' else backend end label from v_tasks", "v_tasks"),
    "k11_json_paths": "with e as (select event_id id, props::json p from events), t as (select id, unnest(['', 'a', 'a.b', 'a.b.1', 'p']) path, unnest([0, 1, 2, 3, 1]::bigint[]) depth from e), "
    "k as (select id, p, unnest(json_keys(p)) k from e) select * from t union all select id, 'p.' || k, 2 from k where json_type(p, '$.\"' || k || '\"') in ('OBJECT', 'ARRAY')",
}
_RT, _NL = REPORT_TEXT["en"], "chr(10)"
ORACLES["k12_json_shape"] = """select event_id id, ['object', 'array', 'object', 'scalar', 'invalid'][event_id % 5 + 1] kind, cast([1, 4, 4, 0, 0][event_id % 5 + 1] as bigint) n,
  case event_id % 5 when 0 then replace(replace(replace(props, '{"', ''), '":', ':'), '}', '') when 1 then event_id || ', "' || case when length(repeat(event_type, 6)) > 20 then substr(repeat(event_type, 6), 1, 20) || '...' else repeat(event_type, 6) end || '", null, ...'
  when 2 then 'z: "' || event_type || '", a: Array(2), m: Object(1), ...' when 3 then '"' || event_type || '"' end preview from events"""
_RECORD = """with r as (select o_orderkey record_id, o_orderpriority file, case when o_orderkey % 4 > 0 then 'L' || o_orderkey else '' end as name, 'order ' || o_orderkey description, repeat('ACGTT', cast(o_orderkey % 30 as int)) sequence, o_orderkey % 3 > 0 noted, o_orderstatus,
  case when o_orderkey % 2 = 0 then 'says ' || o_orderkey end meaning, cast(floor(o_totalprice) as bigint) length, case when o_orderkey % 7 > 0 then (o_orderkey % 1000) / 1000::double end gc from orders),
n as (select record_id, type, count(*) n, min(feature_no) k from v_features group by 1, 2), t as (select record_id, cast(sum(n) as bigint) n, string_agg('- ' || type || ': ' || n, chr(10) order by n desc, k, type) types from n group by 1) """
ORACLES["h12_record_json"] = duck(_RECORD + f""", g as (select record_id, count(*) features, count(*) filter (where type = 'gene') genes, count(*) filter (where type = 'CDS') cds, count(*) filter (where type in {_REG}) regulatory, count(*) filter (where type in {_RNA}) rna,
  list(q_locus order by feature_no, location, q_gene, q_locus) filter (where type = 'gene') gs, list(q_product order by feature_no, location, q_product) filter (where type = 'CDS') ps from v_features group by 1)
select r.record_id, concat_ws(',', 'id,name,description,length', case when noted then 'annotations' end, 'sequence', case when gc is not null then 'gc_content' end, case when meaning is not null then 'semantic_description' end, case when g.record_id is not null then 'features,feature_types,feature_summary' end) keys,
  case when noted then o_orderstatus end status, features, nullif(genes, 0) gene_type, genes, cds, regulatory, rna, gs[1] first_gene, ps[1] first_product from r left join g using (record_id)""", "v_features")
ORACLES["h12_record_markdown"] = duck(_RECORD + f"""select file, 0::bigint part, md5('# {RECORD_TITLE["en"]}' || {_NL} || {_NL} || '## 📊 {_RT["statistics"]}' || {_NL} || {_NL} || '- **{_RT["count"]}**: ' || count(*) || {_NL} || '- **{_RT["total"]}**: ' || format('{{:,}}', cast(sum(length) as bigint)) || ' bp' || {_NL} || {_NL} || '## 🧬 {_RT["details"]}' || {_NL}) markdown_md5 from r group by 1
union all select file, row_number() over (partition by file order by record_id) part, md5(concat_ws({_NL}, '### ' || row_number() over (partition by file order by record_id) || '. ' || coalesce(nullif(name, ''), record_id || '') || {_NL},
  '**Basic Information**:' || {_NL} || '- ID: `' || record_id || '`' || {_NL} || '- Name: `' || name || '`' || {_NL} || '- Description: ' || description || {_NL} || '- Length: ' || format('{{:,}}', length) || ' bp' || {_NL},
  case when noted then '**Annotations**:' || {_NL} || '- priority: ' || file || {_NL} || '- status: ' || o_orderstatus || {_NL} end,
  '**Feature Count**: ' || t.n || {_NL} || '**Feature Types**:' || {_NL} || types || {_NL}, '**{_RT["preview"]}**:' || {_NL} || '```' || {_NL} || substr(sequence, 1, 100) || case when length(sequence) > 100 then '...' else '' end || {_NL} || '```' || {_NL},
  case when gc is not null then printf('**{_RT["gc"]}**: %.2f%%', round(gc * 100 + 1e-9, 2)) || {_NL} end, case when meaning is not null then '**🔬 {_RT["meaning"]}**:' || {_NL} || meaning || {_NL} end)) from r left join t using (record_id)""", "v_features")
_MMSS = "lpad((cast(floor({0}) as int) // 60 % 60)::varchar, 2, '0') || ':' || lpad((cast(floor({0}) as int) % 60)::varchar, 2, '0')"
_AT = "case when floor({0}) >= 3600 then lpad((cast(floor({0}) as int) // 3600)::varchar, 2, '0') || ':' else '' end || " + _MMSS
ORACLES["i11_transcript_markdown"] = duck(f"""with s as (select *, {_CLEAN} clean, case turn4 when 0 then '😊' when 1 then '🎵' else '' end mark, case turn4 when 0 then 'en' when 1 then nullif('de', 'de') end lang from (select *, id % 4 turn4 from v_segments)),
l as (select *, trim('[' || {_AT.format("start_s")} || '] ' || mark || ' ' || clean) line, coalesce(speaker, 'SPEAKER_00') who, lag(coalesce(speaker, 'SPEAKER_00')) over (partition by file_id order by id) was from s)
select file_id, concat_ws(chr(10), '# Transcript ' || file_id, '', '**Language**: ' || coalesce(case when arg_min(lang, id) filter (where lang is not null) = 'en' then '{T.LANGUAGE_NAMES["en"]}' end, 'auto'), '**Number of speakers**: ' || count(distinct speaker),
  case when count(speaker) > 0 then '**Speakers**: ' || string_agg(distinct speaker, ', ' order by speaker) end, '', '## Text', '', string_agg(clean, ' ' order by id), '', '## Segments',
  string_agg(case when was is null or was <> who then chr(10) || '**' || who || '**:' || chr(10) || chr(10) || line else line end, chr(10) order by id)) markdown from l group by file_id""", "v_segments")
_FRAMES_OF = "with o as (select conv_id video_id, turn frame_number, cast(turn * 1.5 as double) ts, case when turn % 5 = 4 then '' when turn % 3 = 2 then text || ' ' else text end ocr_text from conversations) "
_KEYFRAMES = f"""select video_id, '## Key frames' || chr(10) || chr(10) || string_agg('### [' || {_AT.format("ts")} || '] (' || printf('%.2f', ts) || 's)' || chr(10) || chr(10) || coalesce(nullif(trim(ocr_text), ''), '*no text*') || chr(10), chr(10) order by frame_number) markdown, count(*) total_keyframes from o group by 1"""
ORACLES["j07_keyframes_report"] = f"{_FRAMES_OF}{_KEYFRAMES}"
ORACLES["j08_merge_video"] = ORACLES["i11_transcript_markdown"].replace("with v_segments", _FRAMES_OF + f", k as ({_KEYFRAMES}), v_segments", 1).replace("select file_id, concat_ws(chr(10), '# Transcript '", ", md as (select file_id, concat_ws(chr(10), '# Transcript '", 1) + """)
select file_id video_id, 'video' as type, 'video' file_type, 'mp4' video_format, file_id || '.mp4' original_filename,
  substr(m.markdown, 1, strpos(m.markdown, chr(10) || chr(10)) - 1) || chr(10) || '**Source file**: ' || file_id || '.mp4 (video)' || chr(10) || '**Video format**: MP4' || chr(10) || case when k.markdown is not null then '**Key-frame OCR**: enabled (' || k.total_keyframes || ' frames)' else '**Key-frame OCR**: not enabled' end || chr(10)
  || substr(m.markdown, strpos(m.markdown, chr(10) || chr(10))) || case when k.markdown is not null then chr(10) || chr(10) || '---' || chr(10) || chr(10) || '# Key frames of the video' || chr(10) || chr(10) || '> ' || k.total_keyframes || ' key frames were taken from the video and read' || chr(10) || chr(10) || substr(k.markdown, length('## Key frames') + 3) else '' end markdown,
  k.markdown is not null keyframes_enabled, coalesce(k.total_keyframes, 0) total_keyframes from md m left join k on k.video_id = m.file_id"""
ORACLES["j03_fixed_interval"] = ORACLES["j02_scene_cuts"].replace("select video_id, frame_number, ts from cuts", "select video_id, frame_number, ts from cuts union all select video_id, cast(floor(step * 0.5) as bigint), step::double from (select video_id, unnest(range(0, total * 2, 10)) step from (select video_id, count(*) total from v_frames group by 1) where video_id not in (select video_id from cuts))")
_SHARP = """with g as (select video_id, frame_number, list_transform(gray, lambda x: x::double) g from v_frames), b as (select *, list_sum(g) / 64 lit from g),
p as (select video_id, frame_number, list_transform(range(0, 64), lambda k: g[(case when k // 8 = 0 then 1 else k // 8 - 1 end) * 8 + k % 8 + 1] + g[(case when k // 8 = 7 then 6 else k // 8 + 1 end) * 8 + k % 8 + 1]
  + g[k // 8 * 8 + (case when k % 8 = 0 then 1 else k % 8 - 1 end) + 1] + g[k // 8 * 8 + (case when k % 8 = 7 then 6 else k % 8 + 1 end) + 1] - 4 * g[k + 1]) l from b where lit between -0.02 and 0.02),
q as (select video_id, frame_number, list_var_pop(l) quality_score from p) select video_id, frame_number, round(quality_score, 6) quality_score from q where quality_score >= 0.1"""
ORACLES["j04_quality_filter"] = duck(_SHARP, "v_frames")
ORACLES["k02_combine_page_json"] = duck("select doc_id, cast(sum(page_no) as bigint) numbers, count(*) pages, count(*) total_pages, md5(string_agg(page_text, '|' order by page_no)) texts_md5 from v_doc_pages group by 1", "v_doc_pages")
