"""tasks share state by groups, so a stream's work does not go with the calls each task's state and timer would take."""

import datetime as dt
import random

from granary.functions.shared import settings
from granary.streaming import lifecycle
from granary.streaming.lifecycle import drain, lifecycle_batch, task_lifecycle

EVENTS = "task_id string, seq long, ts timestamp, requested_status string, worker_id string"
BASE = dt.datetime(2024, 1, 1)
ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def arrivals(spark, folder, rows, size):
    for k in range(0, len(rows), size):
        spark.createDataFrame(rows[k : k + size], EVENTS).coalesce(1).write.parquet(f"{folder}/{k:06d}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(folder)


def test_many_tasks_in_a_group_equal_the_batch_twin(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lifecycle, "PART_ROWS", 7)
    rng = random.Random(7)
    ask = lambda: rng.choice(["processing", "processing", "completed", "failed", "pending", "cancelled"])
    rows = [(f"t{rng.randrange(60)}", k, BASE + dt.timedelta(minutes=9 * k), ask(), rng.choice(["w1", "w2", None])) for k in range(900)]
    late = sorted(rows, key=lambda r: r[2] + dt.timedelta(minutes=rng.randrange(50)))
    got = drain(task_lifecycle(arrivals(spark, str(tmp_path / "in"), late, 250), "1 hour", 60, 0.5, groups=2)).collect()
    passed = max(r[2] for r in rows) - dt.timedelta(hours=1)
    want = lifecycle_batch(spark.createDataFrame(rows, EVENTS), passed, 60, 0.5).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.event for r in want} == {"request", "reset", "dropped"}


def test_state_is_a_few_rows_a_group(spark, tmp_path):
    rows = [(f"t{k}", k, BASE + dt.timedelta(seconds=k), "processing", "w") for k in range(4000)]
    stream = task_lifecycle(arrivals(spark, str(tmp_path / "in"), rows, 4000), "1 minute", None, None)
    with settings(spark, ROCKS):
        query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4000 - 61
    assert max(op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators) <= 4 * 1024
