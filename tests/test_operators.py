"""Small hand-made cases and plain restatements of the order-dependent rules."""

import datetime as dt
import difflib
import random
import time

import pytest
from pyspark.sql import functions as F

from granary.operators import access, annotations, documents, frames, ledger, nucleotide, protein, routing, transcripts
from granary.sources import fasta, files
from granary.sources.genbank import parse_genbank, read_genbank
from granary.streaming.monitor import queue_monitor, transition_stream


def seqs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "seq_id long, sequence string")


def test_orfs_against_a_plain_scan(spark):
    rng = random.Random(3)
    texts = ["", "ATGTGA", "ATG" + "AAA" * 40 + "TAA", "atg" + "AAA" * 40 + "TAA", None, "ATGATG" + "CCC" * 40 + "TAGTGA"] + ["".join(rng.choice("ACGT") for _ in range(rng.randrange(900))) for _ in range(20)]
    want = set()
    for i, s in enumerate(texts):
        for frame in range(3):
            for a in range(frame, len(s or "") - 2, 3):
                if s[a : a + 3] == "ATG":
                    stop = next((b for b in range(a, len(s) - 2, 3) if s[b : b + 3] in ("TAA", "TAG", "TGA")), None)
                    if stop is not None and stop + 3 - a >= 100:
                        want.add((i, a, stop + 3, frame))
    assert {(r.seq_id, r.start, r.end, r.frame) for r in nucleotide.find_orfs(seqs(spark, *texts)).collect()} == want


def test_tandem_repeats_against_a_plain_scan(spark):
    rng = random.Random(5)
    texts = ["", "A" * 60, "ACGTTGCAGTCA" * 3, "".join(rng.choice("AC") for _ in range(300)), "ACGTACGGTA" * 4 + "TTGACCAGTACGATTACA" * 3]

    def scan(s):
        seen, out = set(), []
        for n in range(min(50, len(s) // 3), 9, -1):
            for i in range(len(s) - 2 * n + 1):
                u = s[i : i + n]
                if u == s[i + n : i + 2 * n] and u not in seen and len(out) < 15:
                    seen.add(u)
                    c = 1
                    while s[i + c * n : i + (c + 1) * n] == u:
                        c += 1
                    out.append((i, n, c))
        return sorted(out, key=lambda x: -x[1] * x[2])

    got = {}
    for r in nucleotide.tandem_repeats(seqs(spark, *texts)).orderBy("seq_id", "rank").collect():
        got.setdefault(r.seq_id, []).append((r.position, r.length, r.repeat_count))
    assert [got.get(i, []) for i in range(len(texts))] == [scan(s) for s in texts]


def test_type_edges_and_cpg_edges(spark):
    t = nucleotide.detect_type(seqs(spark, "A" * 17 + "Q" * 3, "A" * 18 + "Q" * 3, "", None)).orderBy("seq_id").collect()
    assert [r.sequence_type for r in t] == ["protein", "nucleotide", "protein", "protein"]
    c = nucleotide.cpg_islands(seqs(spark, "CG" * 100, "CG" * 100 + "C", None)).collect()
    assert [(r.seq_id, r.start, r.end) for r in c] == [(1, 0, 200)]


def test_six_frames(spark):
    rows = nucleotide.translate_six_frames(seqs(spark, "ATGGCCTAAATGN")).collect()
    got = {(r.direction, r.frame): r.peptide for r in rows}
    assert got["forward", 1] == "MA*M" and got["reverse", 1] == "XI*A" or got["reverse", 1] == "XFRP"
    assert len(got) == 6


def test_ptm_sites(spark):
    rows = protein.ptm_sites(seqs(spark, "NPSNASP" + "K" * 20, "")).collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.kind, []).append((r.position, r.score))
    assert kinds["phosphorylation"] == [(3, 1.0), (6, 2.0)]
    assert [p for p, _ in kinds["glycosylation"]] == [4] and len(kinds["acetylation"]) == 15


def test_transitions_batch_and_stream_agree(spark, tmp_path):
    rng = random.Random(1)
    states = ["processing", "completed", "failed", "pending", "cancelled"]
    rows = [(f"t{k % 5}", k, rng.choice(states), rng.choice([None, "w1", "w2"])) for k in range(100)]
    events = spark.createDataFrame(rows, "task_id string, seq long, requested_status string, worker_id string").coalesce(1)
    want = {(r.task_id, r.seq): (r.accepted, r.status) for r in ledger.apply_transitions(events).collect()}
    state, plain = {}, {}
    for t, k, asked, by in rows:
        s, w = state.get(t, ("pending", None))
        ok = asked not in ("completed", "failed") or (s == "processing" and (by is None or by == w))
        if ok:
            s, w = asked, by if asked == "processing" else None if asked == "pending" else w
        state[t], plain[t, k] = (s, w), (ok, s)
    assert want == plain
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = transition_stream(stream).writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {(r.task_id, r.seq): (r.accepted, r.status) for r in spark.table("moves").collect()} == want


def test_monitor_stream_equals_batch_on_closed_windows(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("status"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = queue_monitor(s, "1 hour").writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.window_start, r.status): r.n for r in spark.table("counts").collect()}
    want = {(r.window_start, r.status): r.n for r in queue_monitor(e, "1 hour").collect()}
    assert got and all(want[k] == n for k, n in got.items())


def test_ledger_edges(spark):
    now = dt.datetime(2024, 1, 10, 12)
    rows = [("a", "pending", 1, now, None, None), ("b", "pending", 1, now, None, None), ("c", "processing", 0, now, now - dt.timedelta(minutes=60), "w"), ("d", "processing", 0, now, now - dt.timedelta(minutes=61), "w")]
    t = spark.createDataFrame(rows, "task_id string, status string, priority int, created_at timestamp, started_at timestamp, worker_id string").withColumn("retry_count", F.lit(0))
    assert [r.task_id for r in ledger.claim_next(t, 1).collect()] == ["a"]
    assert {r.task_id for r in ledger.reset_stale(t, now).where("status = 'pending'").collect()} == {"a", "b", "d"}
    empty = t.limit(0)
    assert {r.status: r.n for r in ledger.queue_stats(empty).collect()}["total"] == 0


def test_dedup_compares_with_the_last_kept(spark):
    f = spark.createDataFrame([(1, k, (1 << (4 * k)) - 1) for k in range(5)], "video_id long, frame_number long, phash long")
    assert sorted(r.frame_number for r in frames.phash_dedup(f).collect()) == [0, 2, 4]


def test_text_near_dup(spark):
    texts = ["", "alpha beta gamma", "alpha beta gamma!", "", "other words here", "other words hero"]
    kept, last = [], None
    for k, t in enumerate(texts):
        if last is None or (t and (not last or difflib.SequenceMatcher(None, t, last).ratio() < 0.9)):
            kept.append(k)
            last = t
    f = spark.createDataFrame([(1, k, t) for k, t in enumerate(texts)], "video_id long, frame_number long, ocr_text string")
    assert sorted(r.frame_number for r in frames.text_near_dup(f).collect()) == kept == [0, 1, 4]


def test_scene_cuts_and_fallback(spark):
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate([None, 99.0, 1.0, 99.0, 99.0, 99.0, 99.0])] + [(2, 0, None)], "video_id long, frame_number long, diff double")
    cuts = frames.scene_cuts(d, 30.0, 1.0, 2.0)
    assert [r.frame_number for r in cuts.orderBy("frame_number").collect()] == [3, 5]
    videos = spark.createDataFrame([(1, 2.0, 60), (2, 2.0, 41)], "video_id long, fps double, total_frames long")
    assert sorted(r.frame_number for r in frames.fixed_interval(videos, cuts).where("video_id = 2").collect()) == [0, 20]


@pytest.mark.parametrize("text,lang", [("<|ja|>hello", "ja"), ("<|BGM|>", "unknown"), ("你好世界", "zh"), ("こんにちは", "ja"), ("안녕하세요", "ko"), ("hello 12", "en"), ("olé amigo", "auto")])
def test_detect_language(spark, text, lang):
    assert transcripts.detect_language(spark.createDataFrame([(text,)], "text string")).first().detected == lang


def test_display_helpers(spark):
    b = spark.createDataFrame([(0,), (1,), (1023,), (1024,), (1536,), (1048576,), (10240,)], "b long").select(documents.format_bytes("b").alias("t")).collect()
    assert [r.t for r in b] == ["0 B", "1 B", "1023 B", "1 KB", "1.5 KB", "1 MB", "10 KB"]
    s = spark.createDataFrame([(59.9,), (3599.0,), (3600.0,)], "s double").select(transcripts.format_timestamp("s").alias("t")).collect()
    assert [r.t for r in s] == ["00:59", "59:59", "01:00:00"]


def test_json_paths_and_shape(spark):
    d = spark.createDataFrame([(1, '{"a":{"b":[1,{"c":2}]},"d":[]}'), (2, "7"), (3, "{bad"), (4, None)], "id long, json string")
    paths = {(r.id, r.path, r.depth) for r in documents.json_paths(d).collect()}
    assert paths == {(1, "", 0), (1, "a", 1), (1, "a.b", 2), (1, "a.b.1", 3), (1, "d", 1), (3, None, None)}  # bad JSON is a row with an error
    assert {r.id: (r.kind, r.n) for r in documents.json_shape(d).collect()} == {1: ("object", 2), 2: ("scalar", 0), 3: ("invalid", 0), 4: ("invalid", 0)}


def test_read_fasta_and_inventory(spark, tmp_path):
    (tmp_path / "page_1").mkdir()
    (tmp_path / "x.fasta").write_text(">one first record\nACGT\nAC\n>two\nGG\n\n")
    (tmp_path / "r.md").write_text("x")
    (tmp_path / "page_1" / "p.md").write_text("x")
    rows = fasta.read_fasta(spark, str(tmp_path / "x.fasta")).orderBy("ord").collect()
    assert [(r.seq_id, r.description, r.sequence, r.length) for r in rows] == [("one", "one first record", "ACGTAC", 6), ("two", "two", "GG", 2)]
    inv = {r.path.rsplit("/", 1)[1]: (r.kind, r.is_result) for r in files.file_inventory(spark, str(tmp_path)).collect()}
    assert inv == {"x.fasta": ("other", False), "r.md": ("md", True), "p.md": ("md", False)}


def test_read_genbank(spark, tmp_path):
    text = '''LOCUS       AB1 12 bp DNA
DEFINITION  A test
            record.
VERSION     AB1.1
SOURCE      x
  ORGANISM  Some thing
            Bacteria; Alpha.
FEATURES             Location/Qualifiers
     source          1..12
                     /organism="Some thing"
     CDS             complement(join(1..3,
                     7..9))
                     /note="first
                     second"
                     /note="again"
                     /translation="MK
                     VL"
                     /pseudo
ORIGIN
        1 acgtac gtacgt
//
'''
    (tmp_path / "a.gb").write_text(text)
    records, features = read_genbank(spark, str(tmp_path / "a.gb"))
    r = records.collect()
    assert len(r) == 1 and (r[0].record_id, r[0].sequence, r[0].organism, r[0].taxonomy, r[0].description) == ("AB1.1", "ACGTACGTACGT", "Some thing", ["Bacteria", "Alpha"], "A test record.")
    f = {x.type: x for x in features.collect()}
    assert f["CDS"].location == "complement(join(1..3,7..9))"
    assert f["CDS"].qualifiers["note"] == ["first second", "again"] and f["CDS"].qualifiers["translation"] == ["MKVL"]


def test_access_and_registry(spark, tmp_path):
    u = spark.createDataFrame([(1, "ok_name", "a@x", "user"), (2, "no", "a@x", "admin"), (3, "bad name", None, "manager")], "user_id long, username string, email string, role string")
    v = {r.user_id: r.violations for r in access.validate_users(u).collect()}
    assert v == {1: ["email_taken"], 2: ["email_taken", "username_length"], 3: ["username_format"]}
    reg = routing.FormatRegistry()
    reg.register("fasta", (".fa",), lambda s, p, o: fasta.read_fasta(s, p))
    (tmp_path / "x.FA").write_text(">a\nAC\n")
    assert reg.read_any(spark, [str(tmp_path / "x.FA")])["fasta"].count() == 1
    with pytest.raises(ValueError):
        reg.format_of("x.bin")


def test_partitions_do_not_matter(spark, sf_dir):
    from granary.plans.views import v_seq

    def rows(n):
        p = nucleotide.nucleotide_profile(v_seq(spark, sf_dir).where("seq_id < 60").repartition(n)).drop("sequence")
        return sorted(map(str, p.collect()))

    began = time.time()
    assert rows(1) == rows(7)
    assert time.time() - began < 120


def test_unowned_task_rejects_a_named_worker(spark):
    log = [("a", 1, "processing", None), ("a", 2, "completed", "w1"), ("a", 3, "completed", None), ("b", 1, "processing", "w1"), ("b", 2, "failed", "w2"), ("b", 3, "failed", "w1"), (None, 1, "completed", None)]
    got = ledger.apply_transitions(spark.createDataFrame(log, "task_id string, seq long, requested_status string, worker_id string")).collect()
    assert {(r.task_id, r.seq): (r.accepted, r.status) for r in got} == {
        ("a", 1): (True, "processing"), ("a", 2): (False, "processing"), ("a", 3): (True, "completed"),
        ("b", 1): (True, "processing"), ("b", 2): (False, "processing"), ("b", 3): (True, "failed"), (None, 1): (False, "pending"),
    }


def test_records_of_one_accession_stay_apart(spark):
    text = "LOCUS       A\nVERSION     V1.1\nFEATURES             Location/Qualifiers\n     gene            {at}\n                     /gene=\"{gene}\"\nORIGIN\n        1 acgt\n"
    raw = spark.createDataFrame([("x.gb", text.format(at="1..2", gene="x")), ("y.gb", text.format(at="1..9", gene="y")), ("y.gb", text.format(at="3..4", gene="z"))], "file string, value string")
    got = {(r.file, r.location, r.qualifiers["gene"][0]) for r in parse_genbank(raw)[1].collect()}
    assert got == {("x.gb", "1..2", "x"), ("y.gb", "1..9", "y"), ("y.gb", "3..4", "z")}


def test_json_paths_at_any_depth(spark):
    deep = "[" * 60 + "1" + "]" * 60
    got = documents.json_paths(spark.createDataFrame([(1, deep), (2, "{"), (3, None), (4, "5")], "id long, json string"))
    assert sorted(r.depth for r in got.where("error is null").collect()) == list(range(60))
    assert [r.id for r in got.where("error is not null").collect()] == [2]


def test_describe_record_and_protein_clauses(spark):
    records = spark.createDataFrame([(1, "E. coli", 1200, 0.5, ["a", "b", "c", "d"], 2), (2, None, 5, None, None, 0)], "record_id long, organism string, length long, gc_content double, taxonomy array<string>, reference_count long")
    features = spark.createDataFrame([(1, 1, "tRNA", {}), (1, 2, "rRNA", {}), (1, 3, "tRNA", {}), (1, 4, "CDS", {"product": ["p"]}), (1, 5, "promoter", {})], "record_id long, feature_no long, type string, qualifiers map<string,array<string>>")
    got = {r.record_id: r.description for r in annotations.describe_record(records, features).collect()}
    assert got == {
        1: "This sequence is from E. coli; Total length 1,200 bp, GC content 50.0%; Contains 0 gene(s) and 1 coding sequence(s); Main encoded proteins include: p; Contains RNA features: 2 tRNA, 1 rRNA; Contains 1 regulatory element(s); Taxonomy: a > b > c; Contains 2 reference(s).",
        2: "Total length 5 bp.",
    }
    p = spark.createDataFrame([(1, "NASNPSNNTT" + "FWY" * 3)], "seq_id long, sequence string")
    for f in (protein.protein_weight, protein.isoelectric_point, protein.gravy, protein.secondary_structure, protein.aromaticity, protein.ptm_counts):
        p = f(p)
    one = protein.describe_protein(p.withColumn("instability_index", F.lit(50.0))).first()
    assert one.glycosylation_sites == 3 and one.phosphorylation_sites == 7
    assert "Unstable (instability index 50.0)" in one.description and one.description.endswith("High aromaticity (47.4%), may contain important aromatic residue clusters; Identified 7 potential phosphorylation site(s); Contains 3 N-glycosylation site(s), may be a glycoprotein.")


def test_transcript_and_video_reports(spark):
    seg = [("v", 0, "<|en|><|HAPPY|><|Speech|>hello", 0.0, 1.0, "A"), ("v", 1, "again", 1.0, 2.0, "A"), ("v", 2, "bye", 2.0, 3.0, "B")]
    md = transcripts.transcript_markdown(spark.createDataFrame(seg, "file_id string, id long, text string, start_s double, end_s double, speaker string")).first().markdown
    assert md.startswith("# Transcript v\n\n**Language**: English\n**Number of speakers**: 2\n**Speakers**: A, B\n\n## Text\n\n")
    assert md.count("**A**:") == 1 and md.count("**B**:") == 1 and md.endswith("**B**:\n\n" + md.splitlines()[-1]) and md.splitlines()[-1].endswith("bye")
    t = spark.createDataFrame([("v", "# T\n\nbody", "v.mp4"), ("w", "no break", "w.mkv"), ("x", None, "x.avi")], "video_id string, markdown string, file_name string")
    ocr = frames.keyframes_report(spark.createDataFrame([("v", 1, 2.0, "text")], "video_id string, frame_number int, ts double, ocr_text string"))
    got = {r.video_id: r for r in frames.merge_video(t, ocr).collect()}
    assert got["v"].markdown.startswith("# T\n**Source file**: v.mp4 (video)\n**Video format**: MP4\n**Key-frame OCR**: enabled (1 frames)\n\n\nbody\n\n---\n\n# Key frames") and got["v"].markdown.endswith("text\n") and "## Key frames" not in got["v"].markdown
    assert got["w"].markdown == "\n**Source file**: w.mkv (video)\n**Video format**: MKV\n**Key-frame OCR**: not enabled\nno break" and got["x"].markdown is None
    assert (got["v"].type, got["v"].video_format, got["v"].total_keyframes, got["w"].keyframes_enabled) == ("video", "mp4", 1, False)
