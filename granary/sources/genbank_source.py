"""Flat-file records as a data source, spark.read.format("genbank").load(path).

The rows are whole records, (file, record_no, value), for parse_genbank(). Files are cut into byte ranges; a record belongs to
the range that holds its first byte, and record_no is where that is in the file. Files are opened by pyarrow's file systems, for
paths and addresses that these know; read_genbank() reads whatever Spark itself can.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT = 64 << 20
READ = 4 << 20
AHEAD = 64 << 10
BATCH = 8 << 20
TASKS = 96
_END = re.compile(rb"\n//\r?\n")
_SCHEMA = "file string, record_no long, value string"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


class Range(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


class FlatFileReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))

    def partitions(self) -> list[Range]:
        fs, inner = _open(self.path)
        info = fs.get_file_info(inner)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(inner, recursive=True))
        scheme = self.path[: len(self.path) - len(inner)] if self.path.endswith(inner) else ""
        named = [f for f in files if f.type == pafs.FileType.File and not f.base_name.startswith(("_", "."))]
        step = max(self.split, min(SPLIT, sum(f.size for f in named) // TASKS))
        return [Range(scheme + f.path, at, min(f.size, at + step)) for f in sorted(named, key=lambda f: f.path) for at in range(0, f.size, step)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for at, text in records_of(partition):
            rows.append((partition.path, at, text.decode("utf-8", "replace")))
            size += len(text)
            if size >= BATCH:
                yield self.batch(rows)
                rows, size = [], 0
        yield self.batch(rows)

    @staticmethod
    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.int64(), pa.string()))], names=["file", "record_no", "value"])


def records_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, text without its end mark) of the records that begin in a range; a last one needs no end mark."""
    fs, inner = _open(part.path)
    back = min(part.start, 5)
    with fs.open_input_file(inner) as f:
        f.seek(part.start - back)
        held, base, begin = b"", part.start - back, 0 if part.start == 0 else None
        looked = 0
        while True:
            more = f.read(min(READ, max(part.end - base - len(held), len(held)) + AHEAD))
            held += more
            while True:
                found = _END.search(held, looked)  # both ends at once: a search for one that never comes goes to the end for each record
                if not found:
                    looked = max(0, len(held) - 5)
                    break
                k = found.start()
                if begin is not None and held[begin:k].strip():
                    yield base + begin, held[begin:k]
                begin = looked = found.end()
                if base + begin < part.start:
                    begin = None
                elif base + begin >= part.end:
                    return
            if not more:
                if begin is not None and (last := held[begin:].strip()) and last != b"//":
                    yield base + begin, held[begin:]
                return
            cut = looked if begin is None else min(begin, looked)
            held, base, looked, begin = held[cut:], base + cut, looked - cut, None if begin is None else begin - cut


class FlatFiles(DataSource):
    """Option split: bytes of a range, at least; ranges are longer, up to 64 MB, where there would be more than 96: each range is a task, which starts a worker."""

    @classmethod
    def name(cls) -> str:
        return "genbank"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema) -> FlatFileReader:
        return FlatFileReader(self.options)


def records_source(spark: SparkSession, path: str, options: dict | None = None) -> DataFrame:
    """Registers the source with the session and reads with it."""
    spark.dataSource.register(FlatFiles)
    return spark.read.format("genbank").options(**(options or {})).load(path)
