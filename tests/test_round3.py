"""Records known by file and number, order without windows, results with retention, exactly-once append, malformed rows, deep JSON."""

import datetime as dt
import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from granary.functions.shared import settings
from granary.operators import annotations as H
from granary.operators import documents as K
from granary.operators import frames as J
from granary.operators.halo import with_number, with_previous
from granary.operators.routing import default_registry, split_errors
from granary.sources.files import read_delimited, read_ocr_pages, read_plain, read_transcripts
from granary.sources.genbank import parse_genbank, read_genbank
from granary.sources.genbank_source import records_source
from granary.sources.results import ResultStore, append_batch, write_results


def record(accession, genes, organism="O"):
    rows = "".join(f'     gene            {10 * k}..{10 * k + 5}\n                     /gene="{g}"\n' for k, g in enumerate(genes, 1))
    return f"LOCUS       L 12 bp DNA\nDEFINITION  d\nVERSION     {accession}\n  ORGANISM  {organism}\n            A; B.\nFEATURES             Location/Qualifiers\n{rows}ORIGIN\n        1 acgtac gtacgt\n//\n"


@pytest.fixture()
def flat_files(tmp_path):
    (tmp_path / "a.gb").write_text(record("V1.1", ["x"]) + record("V2.1", ["u", "v"]) + record("V1.1", ["w", "w", "w"]))
    (tmp_path / "b.gb").write_text(record("V1.1", ["y"]).replace("\n", "\r\n"))
    return str(tmp_path)


def test_records_of_one_accession_stay_apart_down_the_chain(spark, flat_files):
    records, features = read_genbank(spark, flat_files)
    at = lambda r: (Path(r.file).name, r.record_no)
    n = {(*at(r), r.type): r.n for r in H.feature_type_counts(features).collect()}
    assert n == {("a.gb", 1, "gene"): 1, ("a.gb", 2, "gene"): 2, ("a.gb", 3, "gene"): 3, ("b.gb", 1, "gene"): 1}
    names = {at(r): r.gene_names for r in H.feature_summary(features).collect()}
    assert names == {("a.gb", 1): ["x"], ("a.gb", 2): ["u", "v"], ("a.gb", 3): ["w"] * 3, ("b.gb", 1): ["y"]}
    full = records.withColumns({"gc_content": F.lit(0.5), "reference_count": F.lit(0)})
    said = {at(r): r.description for r in H.describe_record(full, features).collect()}
    assert len(said) == 4 and "1" in said["b.gb", 1] and said["a.gb", 3] != said["a.gb", 1]
    totals = {Path(r.file).name: (r.records, r.features) for r in H.record_totals(records, features).collect()}
    assert totals == {"a.gb": (3, 6), "b.gb": (1, 1)}
    parts = {(Path(r.file).name, r.part): r.markdown for r in H.record_markdown(records, features).collect()}
    assert set(parts) == {("a.gb", k) for k in range(4)} | {("b.gb", 0), ("b.gb", 1)} and "- gene: 3" in parts["a.gb", 3] and parts["a.gb", 2].startswith("### 2. L\n")
    said = {at(r): json.loads(r.json) for r in H.record_json(records, features).collect()}
    assert [g["name"] for g in said["a.gb", 2]["feature_summary"]["genes"]] == ["u", "v"] and said["b.gb", 1]["feature_types"] == {"gene": 1} and said["a.gb", 1]["sequence"] == "ACGTACGTACGT"


@pytest.mark.parametrize("split", [40, 333, 1 << 20])
def test_source_reads_each_record_once_whatever_the_ranges(spark, flat_files, split):
    got = records_source(spark, flat_files, {"split": split})
    assert got.rdd.getNumPartitions() == (2 if split > 9999 else sum(-(-Path(flat_files, f).stat().st_size // split) for f in ("a.gb", "b.gb")))
    records, features = parse_genbank(got)
    assert sorted((Path(r.file).name, r.record_id) for r in records.collect()) == [("a.gb", "V1.1"), ("a.gb", "V1.1"), ("a.gb", "V2.1"), ("b.gb", "V1.1")]
    assert features.count() == 7


def test_registry_of_formats(spark, tmp_path, flat_files):
    (tmp_path / "x.fa").write_text(">s one\nAC\nGT\n")
    got = default_registry().read_any(spark, [str(tmp_path / "x.fa"), f"{flat_files}/a.gb", f"{flat_files}/b.gb"])
    assert got["fasta"].first().sequence == "ACGT" and got["genbank"].count() == 4


def test_row_before_and_place_without_a_window(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", "b", None]), k, rng.randrange(9) if rng.random() < 0.9 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, x int")
    want = {}
    for g in ("a", "b", None):
        own = [r for r in rows if r[0] == g]
        want |= {r[1]: (i + 1, own[i - 1][2] if i else None) for i, r in enumerate(own)}
    for parts in (1, 7, 150):
        got = {r.k: r.previous_x for r in with_previous(df, ["g"], ["k"], ["x"], parts).collect()}
        assert got == {k: v[1] for k, v in want.items()}
        assert {r.k: r.place for r in with_number(df, ["g"], ["k"], "place", parts).collect()} == {k: v[0] for k, v in want.items()}
    assert with_previous(df.limit(0), ["g"], ["k"], ["x"]).count() == 0


def test_cuts_follow_each_other(spark):
    rng = random.Random(2)
    rows = [(v, k, float(rng.choice([0, 0, 50]))) for v in range(4) for k in range(0, 900)]
    got = {}
    for r in J.scene_cuts(spark.createDataFrame(rows, "video_id long, frame_number long, diff double"), 30.0, 1.0, 25.0).collect():
        got.setdefault(r.video_id, []).append(r.frame_number)
    for v in range(4):
        last, want = 0, []
        for _, k, d in (r for r in rows if r[0] == v):
            if d > 30 and k - last >= 25:
                want.append(k)
                last = k
        assert sorted(got[v]) == want and len(want) > 20


def test_retention_touches_expired_folders_alone(spark, tmp_path):
    now = dt.datetime(2024, 3, 1, 12)
    day = lambda n, h=0: now - dt.timedelta(days=n, hours=h)
    rows = [(f"t{k}", "md" if k % 2 else "json", s, t, p) for k, (s, t, p) in enumerate([("completed", day(40), "/p"), ("failed", day(30, 1), "/p"), ("completed", day(30, -1), "/p"), ("cancelled", day(40), "/p"), ("completed", day(8), "/p"), ("completed", day(7, -1), "/p"), ("completed", day(1), "/p"), ("pending", None, None), ("completed", day(9), None)])]
    store = ResultStore(spark, str(tmp_path / "results"))
    store.write(spark.createDataFrame(rows, "task_id string, format string, status string, completed_at timestamp, result_path string"))
    files = lambda: {str(p.relative_to(tmp_path)): p.stat().st_mtime_ns for p in (tmp_path / "results").rglob("*.parquet")}
    before = files()
    gone = store.expire_files(now, 7)
    assert {r.task_id for r in gone.collect()} == {"t0", "t1", "t2", "t4"}
    kept = {r.task_id: r.result_path for r in store.read().collect()}
    assert kept == {"t0": None, "t1": None, "t2": None, "t3": "/p", "t4": None, "t5": "/p", "t6": "/p", "t7": None, "t8": None}
    same = {p for p, t in files().items() if before.get(p) == t}
    untouched = ("done_on=2024-02-29", "done_on=2024-02-23", "done_on=2024-02-21", "done_on=__HIVE")
    assert all(any(x in p for p in same) for x in untouched[:3])
    store.expire_records(now, 30)
    assert {r.task_id for r in store.read().collect()} == {"t2", "t3", "t4", "t5", "t6", "t7", "t8"}
    assert {p for p in files() if "2024-02-2" in p} == {p for p in same if "2024-02-2" in p} | {p for p in files() if "2024-02-22" in p}
    write_results(store.read().drop("done_on"), str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {"format=md", "format=json"} and spark.read.parquet(str(tmp_path / "out")).count() == 7


def test_a_batch_that_runs_again_adds_nothing(spark, tmp_path):
    path, at = str(tmp_path / "log"), dt.datetime(2024, 1, 1)
    batch = lambda *names: spark.createDataFrame([(n, f"/in/{n}", at) for n in names], "file_name string, file_path string, submitted_at timestamp")
    append_batch(batch("a", "b", "b"), 0, path)
    append_batch(batch("b", "c"), 1, path)
    once = sorted(map(str, spark.read.parquet(path).collect()))
    append_batch(batch("b", "c"), 1, path)
    append_batch(batch("a", "b", "b"), 0, path)
    assert sorted(map(str, spark.read.parquet(path).collect())) == once and len(once) == 3


def test_malformed_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text('id,n\n1,2\nx,3\n4\n5,6,7\n"8","9"\n')
    rows = read_delimited(spark, str(tmp_path), "id int, n int")
    good, bad = split_errors(rows)
    assert sorted(map(tuple, good.collect())) == [(1, 2), (8, 9)]
    assert sorted((r.status, r.error_message) for r in bad.collect()) == [("failed", "MalformedRow: 4"), ("failed", "MalformedRow: 5,6,7"), ("failed", "MalformedRow: x,3")]
    (tmp_path / "t.txt").write_text("whole\ntext\n")
    assert read_plain(spark, str(tmp_path / "t.txt")).first().text == "whole\ntext\n"


def test_readers_of_transcripts_and_pages(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"text": "hi", "text_segments": [{"text": "hi", "start": 0, "end": 5}]}]))
    (tmp_path / "b.json").write_text("[]")
    got = {Path(r.file_id).name: r for r in read_transcripts(spark, str(tmp_path)).collect()}
    assert got["a.json"].text == "hi" and len(got["a.json"].text_segments) == 1 and got["b.json"].text == ""
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "d.json").write_text(json.dumps({"pages": ["one", "two"], "total_pages": 2}))
    assert [(r.page_no, r.page, r.total_pages) for r in read_ocr_pages(spark, str(tmp_path / "p")).orderBy("page_no").collect()] == [(0, "one", 2), (1, "two", 2)]


def test_json_of_any_depth(spark):
    texts = ['{"a":{"b":[1,{"c":2}]},"p":{}}', "[]", "5", "{bad", None, "[" * 20_000 + "]" * 20_000, '{"a":[[[[[[[{"x":{}}]]]]]]]}', '{"a.b":{"c":[]}}', "[" * 60 + "]" * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, json string")

    def paths(text):
        todo, out = [("", 0, json.loads(text))], []
        while todo:
            path, depth, v = todo.pop()
            if isinstance(v, (dict, list)):
                out.append((path, depth))
                todo += [(f"{path}.{k}" if depth else str(k), depth + 1, x) for k, x in (v.items() if isinstance(v, dict) else enumerate(v))]
        return sorted(out)

    got = K.json_paths(df).collect()
    assert sorted(r.id for r in got if r.error) == [3, 5]
    for i in (0, 1, 2, 6, 7, 8):
        assert sorted((r.path, r.depth) for r in got if r.id == i) == paths(texts[i])
    assert {(r.id, r.path) for r in K.json_paths(df.where("id = 6"), max_level=1).collect()} == {(6, ""), (6, "a")}


def test_shapes_show_the_first_three(spark):
    texts = ['{"z":null,"y":"' + "a" * 29 + '","x":1.50,"w":true}', '[1,2.0,{"a":1},[1,2]]', '{"a":{"b":1},"c":[]}', '"s"', "{}", "nope", "null"]
    got = {r.id: (r.kind, r.n, r.preview) for r in K.json_shape(spark.createDataFrame(list(enumerate(texts)), "id long, json string")).collect()}
    assert got == {0: ("object", 4, 'z: null, y: "' + "a" * 20 + '...", x: 1.5, ...'), 1: ("array", 4, "1, 2, Object(1), ..."), 2: ("object", 2, "a: Object(1), c: Array(0)"), 3: ("scalar", 0, '"s"'), 4: ("object", 0, ""), 5: ("invalid", 0, None), 6: ("scalar", 0, "null")}
