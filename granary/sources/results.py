"""Results as one dataset, retention that touches expired partitions alone, and a task log that is appended to
exactly once."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.shared import written
from granary.operators.ledger import append_tasks


def write_results(df: DataFrame, path: str, format: str = "parquet", by: str | None = "format", mode: str = "error") -> None:
    """One dataset, split by a column; no file per row."""
    writer = df.write.mode(mode).format(format)
    (writer.partitionBy(by) if by and by in df.columns else writer).save(path)


FILE_ROWS = 1 << 19


class ResultStore:
    """Results in folders by the day they were done and their format: done_on=2024-01-31/format=md.

    rows: task_id, format, status, completed_at, result_path and any more. Rows without completed_at lie in a folder of their own.
    unit: day, week, month, quarter or year; done_on is the first day of it. Each folder costs files and calls to the file system
    whatever it holds, so years of few results a day lie better by month; retention then rewrites the unit its moment falls in.
    """

    KEYS = ("done_on", "format")

    def __init__(self, spark: SparkSession, path: str, unit: str = "day"):
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit

    def write(self, rows: DataFrame) -> None:
        """Add results. They are dealt out by folder, and a large folder over as many files as its rows ask for, by a hash of the task."""
        day = F.to_date("completed_at")
        dated = rows.withColumn("done_on", day if self.unit == "day" else F.trunc(day, self.unit))
        large = dated.groupBy(*self.KEYS).agg(F.ceil(F.count("*") / FILE_ROWS).alias("files_")).where("files_ > 1")
        large = large.select(F.col("done_on").alias("on_"), F.col("format").alias("as_"), "files_")
        spread = dated.join(F.broadcast(large), F.col("done_on").eqNullSafe(F.col("on_")) & F.col("format").eqNullSafe(F.col("as_")), "left")  # folders: some per day
        place = F.when(F.col("files_").isNotNull(), F.pmod(F.xxhash64("task_id"), F.col("files_")))
        spread = spread.repartition(*self.KEYS, place).select(*dated.columns)
        spread.write.mode("append").partitionBy(*self.KEYS).parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).withColumn("done_on", F.col("done_on").cast("date"))

    def _replace(self, rows: DataFrame) -> None:
        """Put rows in place of what their folders hold; other folders keep their files."""
        kept = written(rows, "retention")  # read before its folders are written
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*self.KEYS).parquet(self.path)

    def _drop(self, day: dt.date, before: dt.date) -> None:
        """Remove the folders of days from day to before, before left out; only names of folders come to the driver."""
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        top = hadoop.Path(self.path)
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(top):
            name = status.getPath().getName()
            if name.startswith("done_on=2") or name.startswith("done_on=1"):
                if day <= dt.date.fromisoformat(name.removeprefix("done_on=")) < before:
                    fs.delete(status.getPath(), True)

    def expire_records(self, as_of: dt.datetime, days: int = 30) -> None:
        """Results of tasks completed or failed more than days before as_of go. Days before the last one are dropped as
        folders, but for what else they hold; the last day alone is looked at by the clock."""
        cut = as_of - dt.timedelta(days=days)
        old = (F.col("completed_at") < F.lit(cut)) & F.col("status").isin("completed", "failed")
        touched = self.read().where(F.col("done_on") <= F.lit(cut.date()))
        stay = written(touched.where(~F.coalesce(old, F.lit(False))), "stay")
        self._drop(dt.date(1, 1, 1), cut.date() + dt.timedelta(days=1))
        stay.write.mode("append").partitionBy(*self.KEYS).parquet(self.path)

    def expire_files(self, as_of: dt.datetime, days: int = 7) -> DataFrame:
        """Paths of files of tasks completed or failed more than days before as_of are cleared; returns (task_id,
        result_path) of what may be deleted. Folders where nothing is to be cleared keep their files."""
        cut = as_of - dt.timedelta(days=days)
        old = F.coalesce((F.col("completed_at") < F.lit(cut)) & F.col("status").isin("completed", "failed") & F.col("result_path").isNotNull(), F.lit(False))
        rows = self.read().where(F.col("done_on") <= F.lit(cut.date()))
        gone = written(rows.where(old).select("task_id", "result_path", *self.KEYS), "gone")
        folders = gone.select(*self.KEYS).distinct()
        self._replace(rows.join(F.broadcast(folders), list(self.KEYS), "left_semi").withColumn("result_path", F.when(~old, F.col("result_path"))))  # folders: some per day
        return gone.select("task_id", "result_path")


def append_batch(requests: DataFrame, batch_id: int, path: str) -> None:
    """C01, one batch of a stream: its tasks take the place of whatever a first try of the same batch has left, in a folder of the
    batch's own. A task id that an earlier batch has already appended, or that comes twice in the batch, is appended once."""
    spark = requests.sparkSession
    tasks = append_tasks(requests, F.col("submitted_at")).dropDuplicates(["task_id"])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    if top.getFileSystem(spark._jsc.hadoopConfiguration()).exists(top):
        earlier = spark.read.schema("task_id string, batch_id long").parquet(path).where(F.col("batch_id") < batch_id).select("task_id")
        tasks = tasks.join(earlier, "task_id", "left_anti")
    tasks.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def append_stream(requests: DataFrame, path: str, checkpoint: str):
    """C01 on a stream of requests(file_name, file_path, submitted_at[, ...]): the started query, which appends what there is now
    and ends. A batch that is run again, after a failure, adds nothing to what it added before."""
    return requests.writeStream.foreachBatch(lambda df, n: append_batch(df, n, path)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
