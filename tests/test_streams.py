"""The ledger's streams against their batch twins."""

import datetime as dt
import random

from pyspark.sql import functions as F

from granary.operators import ledger
from granary.streaming.lifecycle import Rules, Task, drain, lifecycle_batch, task_lifecycle

EVENTS = "task_id string, seq long, ts timestamp, requested_status string, worker_id string"
BASE = dt.datetime(2024, 1, 1)


def arrivals(spark, folder, rows, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], EVENTS).coalesce(1).write.parquet(f"{folder}/{k:06d}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_late_events_are_judged_in_their_place(spark, tmp_path):
    rng = random.Random(4)
    ask = lambda: rng.choice(["processing", "processing", "completed", "failed", "pending", "cancelled"])
    rows = [(f"t{rng.randrange(12)}", k, BASE + dt.timedelta(minutes=4 * k), ask(), rng.choice(["w1", "w2", None])) for k in range(500)]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(50)))
    assert late != rows
    stream = task_lifecycle(arrivals(spark, str(tmp_path / "in"), late, 130), "1 hour", 60, 1)
    got = drain(stream).collect()
    passed = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = lifecycle_batch(spark.createDataFrame(rows, EVENTS), passed, 60, 1).collect()
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert {r.event for r in want} >= {"request", "reset"} and len({r.seq for r in want}) > 400


def test_batch_twin_is_the_guard_without_a_clock(spark):
    rng = random.Random(5)
    rows = [(f"t{rng.randrange(9)}", k, BASE + dt.timedelta(minutes=k), rng.choice(["processing", "completed", "failed", "pending", "cancelled"]), rng.choice(["w1", "w2", None])) for k in range(300)]
    events = spark.createDataFrame(rows, EVENTS)
    got = lifecycle_batch(events, BASE + dt.timedelta(days=9), None, None).select("task_id", "seq", "accepted", "status").collect()
    assert sorted(got) == sorted(ledger.apply_transitions(events).collect())


def test_replay_equals_reset_and_retention(spark, tmp_path):
    """The state a stream ends in is that of the batch rules over the ledger's table at the same moment."""
    rng = random.Random(6)
    rows, table = [], []
    for k in range(60):
        start = BASE + dt.timedelta(hours=rng.randrange(1, 2400))
        status = rng.choice(["processing", "completed", "failed", "cancelled"])
        end = None if status == "processing" else start + dt.timedelta(minutes=rng.randrange(1, 59))
        rows.append((f"t{k}", 2 * k, start, "processing", "w"))
        if end:
            rows.append((f"t{k}", 2 * k + 1, end, status, "w"))
        table.append((f"t{k}", status, "w", start, end, 0))
    rows.append(("last", 999, BASE + dt.timedelta(hours=2500), "cancelled", None))
    rows.sort(key=lambda r: r[2])
    now = BASE + dt.timedelta(hours=2499)
    stream = drain(task_lifecycle(arrivals(spark, str(tmp_path / "in"), rows, 60), "1 hour", 60, 30))
    last = stream.groupBy("task_id").agg(F.max_by(F.struct("event", "status", "worker_id", "retry_count"), F.struct("at", F.col("event") != "request")).alias("x"))
    got = {(r.task_id, r.x.status, r.x.worker_id, r.x.retry_count) for r in last.collect() if r.x.event != "dropped"}
    tasks = spark.createDataFrame(table, "task_id string, status string, worker_id string, started_at timestamp, completed_at timestamp, retry_count int")
    kept = ledger.retention_records(ledger.reset_stale(tasks, now), now)
    assert got == {(r.task_id, r.status, r.worker_id, r.retry_count) for r in kept.collect()}
    dropped = {r.task_id for r in stream.where("event = 'dropped'").collect()}
    assert dropped and dropped == {r.task_id for r in tasks.collect()} - {r.task_id for r in kept.collect()}


def test_a_dropped_task_leaves_no_state():
    rules = Rules(1000, 5000)
    task, out = rules.run(Task(), [(1, 0, "processing", "w"), (2, 10, "completed", "w")], 5011)
    assert task == Task() and [x[2] for x in out] == ["request", "request", "dropped"]
    task, out = rules.run(Task(), [(1, 0, "processing", "w"), (2, 1001, "completed", "w")], 1002)
    assert [(x[2], x[3], x[4]) for x in out] == [("request", True, "processing"), ("reset", True, "pending"), ("request", False, "pending")]
    assert rules.run(Task(), [(1, 0, "processing", "w")], 1000)[0].status == "processing" and rules.run(Task(), [(1, 0, "processing", "w")], 1001)[0].status == "pending"
