"""a folder of results has as many files as its rows ask for."""

import datetime as dt
import glob

from pyspark.sql import functions as F

from granary.sources import results
from granary.sources.results import ResultStore


def rows_of(spark, n, days):
    start = dt.datetime(2024, 1, 1)
    rows = [(f"t{k}", "md" if k % 2 else None, "completed", start + dt.timedelta(days=k % days) if k % days else None, f"/out/{k}") for k in range(n)]
    return spark.createDataFrame(rows, "task_id string, format string, status string, completed_at timestamp, result_path string")


def test_small_folders_have_one_file(spark, tmp_path):
    store = ResultStore(spark, str(tmp_path / "r"))
    store.write(rows_of(spark, 600, 15))
    files = glob.glob(str(tmp_path / "r/done_on=*/format=*/*.parquet"))
    assert store.read().count() == 600 and len(files) == len({f.rsplit("/", 1)[0] for f in files}) == 30


def test_a_large_folder_is_dealt_out(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "FILE_ROWS", 20)
    rows = rows_of(spark, 600, 3)
    store = ResultStore(spark, str(tmp_path / "r"))
    with results_settings(spark):
        store.write(rows)
    found = sorted(map(tuple, store.read().select("task_id", "format", "status", "completed_at", "result_path").collect()), key=str)
    assert found == sorted(map(tuple, rows.collect()), key=str)
    assert len(glob.glob(str(tmp_path / "r/done_on=__HIVE*/format=__HIVE*/*.parquet"))) > 1


def results_settings(spark):
    from granary.functions.shared import settings

    return settings(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false"})


def test_retention_is_the_same_by_month_as_by_day(spark, tmp_path):
    now, told = dt.datetime(2024, 3, 20, 12), {}
    for unit in ("day", "month"):
        store = ResultStore(spark, str(tmp_path / unit), unit)
        store.write(rows_of(spark, 400, 97).withColumn("status", F.expr("case when task_id like '%5' then 'cancelled' else status end")))
        gone = sorted(map(str, store.expire_files(now, 7).collect()))
        store.expire_records(now, 30)
        told[unit] = gone, sorted(map(str, store.read().select("task_id", "format", "status", "completed_at", "result_path").collect()))
    assert told["day"] == told["month"] and told["day"][0] and len(glob.glob(str(tmp_path / "month/done_on=*"))) <= 5
