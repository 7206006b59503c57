"""Run logs as a source that reads one file by many tasks.

A task takes a range of a file's bytes. An entry belongs to the range in which its first line, one
with a header, begins; its further lines are read beyond the range's end, up to the next header, and a
range skips lines before its first header. So each entry comes once and whole, wherever files are cut.

Rows: log (the file), entry (its place, in bytes), line (the first), continuation (the others). Line ends may
be CR LF; bytes that are no UTF-8 are replaced; a byte-order mark and lines before the first header are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from titerloom.operators import loggrammar as G

#: Bytes that a task takes, that are read at once, and rows that are handed on at once.
SPLIT, BLOCK, ROWS = 32 << 20, 1 << 20, 4096
_HEADER = re.compile(G.HEADER, re.ASCII)


@dataclass
class Part(InputPartition):
    path: str
    lo: int
    hi: int


def lines(read: Any, size: int, at: int) -> Iterator[tuple[int, bytes]]:
    """Places and bytes of the lines that begin at or after at."""
    place = max(0, at - 1)
    skip, rest = at > 0, b""  # what stands before the first line end belongs to the line before
    while place < size or rest:
        block = read(min(BLOCK, size - place), place) if place < size else b""
        begin = place - len(rest)
        place += len(block)
        held = rest + block
        *whole, rest = held.split(b"\n") if place < size else [*held.split(b"\n"), b""]
        for line in whole:
            if not skip:
                yield begin, line
            skip = False
            begin += len(line) + 1
        if place >= size:
            return


def entries(read: Any, size: int, lo: int, hi: int) -> Iterator[tuple[int, str, list[str]]]:
    """Entries that begin in lo to hi: place, first line, further lines."""
    now: tuple[int, str, list[str]] | None = None
    for place, raw in lines(read, size, lo):
        line = raw.decode("utf-8", "replace").removesuffix("\r")
        if place == 0:
            line = line.removeprefix("\ufeff")
        if _HEADER.match(line):
            if now:
                yield now
            if place >= hi:
                return
            now = place, line, []
        elif now:
            now[2].append(line)
        elif place >= hi:
            return
    if now:
        if now[2] and now[2][-1] == "":
            now[2].pop()  # after the last line end there is no line
        yield now


class Reader(DataSourceReader):
    def __init__(self, path: str, split: int) -> None:
        self.path, self.split = path, split

    def partitions(self) -> Sequence[InputPartition]:
        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        found = files.get_file_info(fs.FileSelector(root, recursive=True)) if info.type == fs.FileType.Directory else [info]
        out = [Part(f.path, lo, min(lo + self.split, f.size)) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File for lo in range(0, f.size, self.split)]
        return out or [Part("", 0, 0)]

    def read(self, partition: Any) -> Iterator[pa.RecordBatch]:
        if partition.lo == partition.hi:
            return
        files, _ = fs.FileSystem.from_uri(self.path)
        with files.open_input_file(partition.path) as f:
            rows = []
            for row in entries(f.read_at, f.size(), partition.lo, partition.hi):
                rows.append(row)
                if len(rows) == ROWS:
                    yield self.batch(partition.path, rows)
                    rows = []
            if rows:
                yield self.batch(partition.path, rows)

    @staticmethod
    def batch(path: str, rows: list[tuple[int, str, list[str]]]) -> pa.RecordBatch:
        place, line, more = zip(*rows, strict=True)
        return pa.record_batch([pa.array([path] * len(rows)), pa.array(place, pa.int64()), pa.array(line, pa.string()), pa.array(more, pa.list_(pa.string()))], names=["log", "entry", "line", "continuation"])


class RunLogs(DataSource):
    """Options: path (a file or folder), split (bytes a task takes)."""

    @classmethod
    def name(cls) -> str:
        return "run_logs"

    def schema(self) -> str:
        return "log string, entry long, line string, continuation array<string>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def read_run_logs(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """log, entry, ts, level, logger, message, continuation: what loggrammar.events() takes."""
    spark.dataSource.register(RunLogs)
    rows = spark.read.format("run_logs").option("split", str(split)).load(path)
    return rows.select("log", "entry", "continuation", G.header(F.col("line")).alias("h")).select("log", "entry", "h.*", "continuation")
