"""The task ledger as tables. Clocks are parameters (as_of), ties end in task_id, so results are repeatable."""

from __future__ import annotations

import datetime as dt

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.constants import STATUSES
from granary.operators.halo import with_previous


def append_tasks(requests: DataFrame, submitted_at: dt.datetime | Column) -> DataFrame:
    """Submission events of requests(file_name, file_path[, backend, options, priority, user_id]); ids follow from path and time."""
    have = lambda c, default: F.coalesce(F.col(c), default) if c in requests.columns else default
    at = (submitted_at if isinstance(submitted_at, Column) else F.lit(submitted_at)).cast("timestamp")
    return requests.select(
        F.sha2(F.concat_ws("|", "file_path", at.cast("string")), 256).alias("task_id"), "file_name", "file_path",
        F.lit("pending").alias("status"), have("priority", F.lit(0)).cast("int").alias("priority"), have("backend", F.lit("pipeline")).alias("backend"),
        have("options", F.lit("{}")).alias("options"), have("user_id", F.lit(None).cast("string")).alias("user_id"), at.alias("created_at"), F.lit(0).alias("retry_count"),
    )


def _queue() -> tuple[Column, ...]:
    return F.desc("priority"), F.asc("created_at"), F.asc("task_id")


def claim_next(tasks: DataFrame, k: int, workers: int = 1, as_of: dt.datetime | None = None) -> DataFrame:
    """The next k pending tasks by priority and age, dealt in turn to the workers."""
    top = tasks.where("status = 'pending'").orderBy(*_queue()).limit(k)
    rank = F.row_number().over(W.orderBy(*_queue()))  # over k rows only
    out = top.withColumn("rank", rank.cast("long")).select("task_id", "rank", ((F.col("rank") - 1) % workers).cast("long").alias("worker"))
    return out if as_of is None else out.withColumn("started_at", F.lit(as_of).cast("timestamp"))


def advance(status: str, worker: str | None, requested: str, by: str | None) -> tuple[bool, str, str | None]:
    """C03, the rule: (accepted, status, worker) after a request. Finishing needs a task in process and, where a worker is
    named, that it is the task's own; cancelling and resetting always work."""
    if requested in ("completed", "failed") and not (status == "processing" and (not by or by == worker)):
        return False, status, worker
    return True, requested, by if requested == "processing" else None if requested == "pending" else worker


def apply_transitions(events: DataFrame) -> DataFrame:
    """events(task_id, seq, requested_status, worker_id) -> with accepted and the status after each, in order of seq.

    Each task's events follow each other in one partition and only the last state is held, however many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, status, worker = None, "pending", None
        for b in batches:
            out = []
            for task, _, requested, by in zip(*(c.to_pylist() for c in b.columns)):
                if (task,) != now:
                    now, status, worker = (task,), "pending", None
                ok, status, worker = advance(status, worker, requested, by)
                out.append((ok, status))
            flags = [pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.string())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *flags], names=["task_id", "seq", "accepted", "status"])

    rows = events.select("task_id", F.col("seq").cast("long").alias("seq"), "requested_status", "worker_id")
    kind = dict(rows.dtypes)["task_id"]
    return rows.repartition("task_id").sortWithinPartitions("task_id", "seq").mapInArrow(run, f"task_id {kind}, seq long, accepted boolean, status string")


def latest_state(events: DataFrame) -> DataFrame:
    """The last event of each task."""
    last = F.row_number().over(W.partitionBy("task_id").orderBy(F.desc("ts"), F.desc("seq")))
    return events.withColumn("rn", last).where("rn = 1").drop("rn")


def queue_stats(tasks: DataFrame) -> DataFrame:
    """Count of each status, absent ones as 0, and the total."""
    counts = tasks.groupBy("status").agg(F.count("*").alias("n"))
    names = tasks.sparkSession.createDataFrame([(x,) for x in STATUSES], "status string")
    known = names.join(counts, "status", "full").select("status", F.coalesce("n", F.lit(0)).alias("n"))
    return known.union(known.agg(F.lit("total"), F.coalesce(F.sum("n"), F.lit(0))))


def newest(tasks: DataFrame, limit: int) -> DataFrame:
    return tasks.orderBy(F.desc("created_at"), "task_id").limit(limit)


def tasks_by_status(tasks: DataFrame, status: str, limit: int = 100) -> DataFrame:
    """Newest first."""
    return newest(tasks.where(F.col("status") == status), limit)


def list_tasks(tasks: DataFrame, permissions: DataFrame, user_id, role: str, status: str | None = None, limit: int = 100) -> DataFrame:
    """All tasks for roles that may view all, else the user's own; at most 1000, newest first."""
    allowed = permissions.where((F.col("role") == role) & (F.col("permission") == "task:view:all")).limit(1).select(F.lit(True).alias("all"))
    seen = tasks.join(F.broadcast(allowed), F.lit(True), "left").where(F.coalesce("all", F.lit(False)) | (F.col("user_id") == user_id)).drop("all")
    return newest(seen if status is None else seen.where(F.col("status") == status), min(limit, 1000))


def _old(as_of: dt.datetime, days: int) -> Column:
    return (F.col("completed_at") < F.lit(as_of - dt.timedelta(days=days))) & F.col("status").isin("completed", "failed")


def retention_files(tasks: DataFrame, as_of: dt.datetime, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """(tasks with expired result paths cleared, the expired paths)."""
    gone = F.coalesce(_old(as_of, days), F.lit(False)) & F.col("result_path").isNotNull()
    return tasks.withColumn("result_path", F.when(~gone, F.col("result_path"))), tasks.where(gone).select("task_id", "result_path")


def retention_records(tasks: DataFrame, as_of: dt.datetime, days: int = 30) -> DataFrame:
    """The tasks that stay."""
    return tasks.where(~F.coalesce(_old(as_of, days), F.lit(False)))


def reset_stale(tasks: DataFrame, as_of: dt.datetime, timeout_minutes: int = 60) -> DataFrame:
    """Tasks in process for too long are pending again, without worker, one retry more; started_at stays."""
    stale = F.coalesce((F.col("status") == "processing") & (F.col("started_at") < F.lit(as_of - dt.timedelta(minutes=timeout_minutes))), F.lit(False))
    changed = {"status": F.when(stale, "pending").otherwise(F.col("status")), "worker_id": F.when(~stale, F.col("worker_id")), "retry_count": F.col("retry_count") + stale.cast("int")}
    return tasks.withColumns(changed)


def cancel_pending(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """C11: requests(task_id) -> task_id, cancelled, reason; only pending tasks can be cancelled."""
    seen = requests.join(tasks.select("task_id", "status"), "task_id", "left")
    ok = F.coalesce(F.col("status") == "pending", F.lit(False))
    return seen.select("task_id", ok.alias("cancelled"), F.when(F.col("status").isNull(), "not found").when(~ok, F.concat(F.lit("status is "), F.col("status"))).alias("reason"))


def processing_time(tasks: DataFrame) -> DataFrame:
    """Seconds and its text, N/A where a time is missing."""
    s = F.unix_micros("completed_at") / 1e6 - F.unix_micros("started_at") / 1e6
    return tasks.withColumn("seconds", s).withColumn("seconds_text", F.when(s.isNull(), "N/A").otherwise(F.format_string("%.2f seconds", s)))


def search_tasks(tasks: DataFrame, status: str | None = None, backend: str | None = None, search: str = "", page: int = 1, size: int = 20) -> tuple[DataFrame, DataFrame]:
    """(rows of one page, number of rows and pages). The text is sought in file name or task id, whatever the case."""
    hit = tasks.where(F.col("status") == status) if status else tasks
    hit = hit.where(F.col("backend") == backend) if backend else hit
    if search:
        hit = hit.where(F.lower("file_name").contains(search.lower()) | F.lower("task_id").contains(search.lower()))
    total = hit.agg(F.count("*").alias("rows"), F.ceil(F.count("*") / size).cast("long").alias("pages"))
    return hit.orderBy(F.desc("created_at"), "task_id").offset((page - 1) * size).limit(size), total


def recent_tasks(tasks: DataFrame, n: int = 10) -> DataFrame:
    """C14"""
    return newest(tasks, n)


def status_split(tasks: DataFrame, key: str) -> DataFrame:
    """One count column for each status, in one pass."""
    return tasks.groupBy(key).agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES])


def snapshot_change(snapshots: DataFrame) -> DataFrame:
    """Whether each status' count differs from the snapshot before."""
    both = with_previous(snapshots, ["status"], ["snap_at"], ["n"])
    return both.withColumn("changed", ~F.col("previous_n").eqNullSafe(F.col("n"))).drop("previous_n")


def worker_parts(tasks: DataFrame) -> DataFrame:
    """C17: host, device, pid and the last part of worker ids of the form name-host-device-pid."""
    p = F.split("worker_id", "-")
    return tasks.withColumns({"host": F.get(p, F.lit(1)), "device": F.get(p, F.lit(2)), "pid": F.get(p, F.lit(3)), "tail": F.try_element_at(p, F.lit(-1))})
