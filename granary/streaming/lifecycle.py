"""C03, C10, C18 as one stream: each task's state with timers. An event waits until the watermark has passed it, so what
comes late, but within the watermark, is judged in its place; a task in process for too long is pending again; a finished
task is dropped, with its state, once its retention is over.

The rules are one function over a task's state, its events and a clock. The stream calls it when a timer fires; the batch
twin calls it once with all events and the final clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass
from itertools import groupby
from operator import itemgetter

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from granary.functions.shared import settings, shared_folder
from granary.operators.ledger import advance

OUT = "task_id string, seq long, at timestamp, event string, accepted boolean, status string, worker_id string, retry_count int"
_COLUMNS = [x.split()[0] for x in OUT.split(", ")]
NEVER = 1 << 62


@dataclass
class Task:
    """What is known of a task: times in milliseconds, NEVER where there is none."""

    status: str = "pending"
    worker: str | None = None
    started: int = NEVER
    finished: int = NEVER
    retries: int = 0


class Rules:
    """The life of a task. timeout and keep in milliseconds; None: no reset, no retention."""

    def __init__(self, timeout: int | None, keep: int | None):
        self.timeout, self.keep = timeout, keep

    def due(self, task: Task) -> int:
        """The last moment at which the clock changes nothing."""
        stale = task.started + self.timeout if self.timeout is not None and task.status == "processing" else NEVER
        old = task.finished + self.keep if self.keep is not None and task.status in ("completed", "failed") else NEVER
        return min(stale, old)

    def pass_time(self, task: Task, now: int, out: list[tuple]) -> Task:
        """What the clock alone does to a task before now: a reset, or the end of its retention."""
        if self.due(task) >= now:
            return task
        at = self.due(task)
        if task.status == "processing":
            task = Task("pending", None, task.started, NEVER, task.retries + 1)
            out.append((None, at, "reset", True, *self.told(task)))
            return task
        out.append((None, at, "dropped", True, *self.told(task)))
        return Task()

    def event(self, task: Task, seq: int, at: int, requested: str, by: str | None, out: list[tuple]) -> Task:
        ok, status, worker = advance(task.status, task.worker, requested, by)
        if ok:
            started = at if requested == "processing" else NEVER if requested == "pending" else task.started
            task = Task(status, worker, started, at if status in ("completed", "failed") else NEVER, task.retries)
        out.append((seq, at, "request", ok, *self.told(task)))
        return task

    def run(self, task: Task, events: list[tuple], now: int) -> tuple[Task, list[tuple]]:
        """Events before now, (seq, at, requested, by), in order of seq, then the clock up to now."""
        out: list[tuple] = []
        for seq, at, requested, by in sorted(events):
            task = self.event(self.pass_time(task, at, out), seq, at, requested, by, out)
        return self.pass_time(task, now, out), out

    @staticmethod
    def told(task: Task) -> tuple:
        return task.status, task.worker, task.retries


def _frame(out: list[tuple]) -> pd.DataFrame:
    """Rows of OUT, with at in milliseconds."""
    frame = pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "Int64"})
    return frame.assign(at=pd.to_datetime(frame["at"], unit="ms", utc=True))


def _batch(out: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.timestamp("ms", "UTC"), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.int32()))]
    columns[2] = columns[2].cast(pa.timestamp("us", "UTC"))
    return pa.RecordBatch.from_arrays(columns, names=_COLUMNS)


_WAITING = pa.schema([("task_id", pa.string()), ("seq", pa.int64()), ("at_ms", pa.int64()), ("requested_status", pa.string()), ("worker_id", pa.string())])
_TASKS = pa.schema([("task_id", pa.string()), ("status", pa.string()), ("worker", pa.string()), ("started", pa.int64()), ("finished", pa.int64()), ("retries", pa.int64())])
PART_ROWS = 1 << 16


def _parts(table: pa.Table) -> list[tuple[bytes]]:
    """A table as elements of a list state, each an Arrow stream of so many rows at most: a call for each row of the state would take more time than its events."""
    out = []
    for at in range(0, table.num_rows, PART_ROWS):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as w:
            w.write_table(table.slice(at, PART_ROWS))
        out.append((sink.getvalue().to_pybytes(),))
    return out


def _table(state, schema: pa.Schema) -> pa.Table:
    parts = [pa.ipc.open_stream(bytes(x[0])).read_all() for x in state.get()] if state.exists() else []
    return pa.concat_tables(parts) if parts else schema.empty_table()


def _put(state, table: pa.Table) -> None:
    if table.num_rows:
        state.put(_parts(table))
    elif state.exists():
        state.clear()


class Lifecycle(StatefulProcessor):
    """State of a group of tasks: what is known of each, events the watermark has not passed, and the one timer that is set."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.tasks = handle.getListState("tasks", "part binary")
        self.waiting = handle.getListState("waiting", "part binary")
        self.timer = handle.getValueState("timer", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pa.concat_tables(pa.Table.from_pandas(x, _WAITING, preserve_index=False) for x in rows)
        self.waiting.appendList(_parts(new))
        at = pc.min(new["at_ms"]).as_py() + 1
        set_to = self.timer.get()[0] if self.timer.exists() else NEVER
        if at < set_to:
            self.set_timer(set_to, at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        waiting = _table(self.waiting, _WAITING)
        early = pc.less(waiting["at_ms"], now)
        ready, later = waiting.filter(early), waiting.filter(pc.invert(early))
        if ready.num_rows:
            _put(self.waiting, later)
        known = {row[0]: Task(*row[1:]) for row in _rows(_table(self.tasks, _TASKS))}
        asked = {task_id: [x[1:] for x in events] for task_id, events in groupby(_rows(ready.sort_by([(c, "ascending") for c in _WAITING.names])), itemgetter(0))}
        out: list[tuple] = []
        for task_id in [*asked, *(k for k, task in known.items() if k not in asked and self.rules.due(task) < now)]:
            task, told = self.rules.run(known.pop(task_id, Task()), asked.get(task_id, []), now)
            out += [(task_id, *x) for x in told]
            if task != Task():
                known[task_id] = task
        if out:
            _put(self.tasks, pa.table(list(map(list, zip(*((k, *astuple(v)) for k, v in known.items())))) or [[]] * len(_TASKS), schema=_TASKS))
        self.timer.clear()
        due = min([NEVER, *map(self.rules.due, known.values()), *later["at_ms"].to_pylist()])
        if due < NEVER:
            self.set_timer(NEVER, due + 1)
        return (_frame(out[k : k + PART_ROWS]) for k in range(0, len(out), PART_ROWS))

    def set_timer(self, old: int, at: int) -> None:
        """A timer fires once the watermark has come to it, so one for what must be before the watermark is a moment later."""
        if old < NEVER:
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at)
        self.timer.update((at,))

    def close(self) -> None:
        pass


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[tuple]:
    return zip(*(c.to_pylist() for c in table.columns))


def _minutes(n: float | None) -> int | None:
    return None if n is None else int(n * 60_000)


def task_lifecycle(events: DataFrame, watermark: str = "1 hour", timeout_minutes: float | None = 60, keep_days: float | None = 30, groups: int = 1024) -> DataFrame:
    """A stream of (task_id, seq, ts, requested_status, worker_id) -> what becomes of each task:
    task_id, seq, at, event (request, reset, dropped), accepted, status, worker_id, retry_count.

    A request is judged by C03's guard once the watermark has passed its ts, in order of seq among those that have waited with
    it; seq and ts must agree in order. Requests later than the watermark are lost, as in any event-time stream. A task in
    process for more than timeout_minutes is reset at that moment, its worker taken and its retries counted (C10); keep_days
    after it was completed or failed it is dropped (C09) and its state with it; a later request begins it anew. State holds
    what waits, and tasks that are not dropped. It is kept by groups of tasks, each read and written whole by one task of Spark,
    as state and timers of each ledger task alone cost more than its events do; groups is how many, and stays as it is for a
    stream's checkpoint. Rows with a null task_id, seq, ts or requested_status are left out. Start the stream with drain(), or
    with the RocksDB state store as provider.
    """
    rules = Rules(_minutes(timeout_minutes), None if keep_days is None else _minutes(keep_days * 1440))
    timed = _requests(events).withWatermark("ts", watermark)
    of_group = timed.withColumn("group", F.pmod(F.xxhash64("task_id"), F.lit(groups)).cast("int"))
    return of_group.groupBy("group").transformWithStateInPandas(Lifecycle(rules), OUT, "Append", "EventTime")


def _requests(events: DataFrame) -> DataFrame:
    whole = events.where("task_id is not null and seq is not null and ts is not null and requested_status is not null")
    return whole.select(F.col("task_id").cast("string").alias("task_id"), F.col("seq").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), "requested_status", "worker_id")


def lifecycle_batch(events: DataFrame, now, timeout_minutes: float | None = 60, keep_days: float | None = 30) -> DataFrame:
    """The batch twin: the same rows for the events before now (a timestamp), as if the clock had stopped there.

    A task's events follow each other in one partition, in order of seq; one task's events are held at a time."""
    rules = Rules(_minutes(timeout_minutes), None if keep_days is None else _minutes(keep_days * 1440))
    at = int(pd.Timestamp(now).timestamp() * 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in _rows(b))
        out: list[tuple] = []
        for task_id, events in groupby(rows, itemgetter(0)):
            out += [(task_id, *x) for x in rules.run(Task(), [x[1:] for x in events], at)[1]]
            if len(out) >= PART_ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    rows = _requests(events).where(F.col("at_ms") < at).repartition("task_id").sortWithinPartitions("task_id", "seq")
    return rows.select("task_id", "seq", "at_ms", "requested_status", "worker_id").mapInArrow(run, OUT)


def drain(stream: DataFrame, name: str = "stream") -> DataFrame:
    """Run a stream over all there is now and return what it appended, as a table in the shared folder."""
    spark, top = stream.sparkSession, shared_folder(stream.sparkSession, name)
    with settings(spark, {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}):
        query = stream.writeStream.format("parquet").option("path", f"{top}/rows").option("checkpointLocation", f"{top}/progress").trigger(availableNow=True).start()
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{top}/rows")
