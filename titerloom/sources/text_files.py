"""A sink of text files: one for each name, of its lines in order, all or none.

Each task writes the names it has, one after another and line by line, under names of its own attempt; commit gives
them their real ones, abort removes them. Rows: name, place (orderable) and text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "text_files"


@dataclass
class Written(WriterCommitMessage):
    """Files of a task: where each lies, and where it goes."""

    files: list[tuple[str, str]] = field(default_factory=list)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, suffix: str) -> None:
        self.path, self.suffix = path, suffix

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, root = fs.FileSystem.from_uri(self.path)
        files.create_dir(f"{root}/_temporary", recursive=True)
        done, now, out = Written(), None, None
        try:
            for batch in iterator:
                for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if name != now:
                        if out:
                            out.close()
                        at = f"_temporary/{uuid.uuid4().hex}"
                        out, now = files.open_output_stream(f"{root}/{at}", buffer_size=1 << 16), name
                        done.files.append((at, f"{name}{self.suffix}"))
                    else:
                        out.write(b"\n")
                    out.write((text or "").encode())
        finally:
            if out:
                out.close()
        return done

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for at, name in m.files if isinstance(m, Written) else ():
                files.move(f"{root}/{at}", f"{root}/{name}")
        files.delete_dir(f"{root}/_temporary")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, root = fs.FileSystem.from_uri(self.path)
        for m in messages:
            for at, _ in m.files if isinstance(m, Written) else ():
                files.delete_file(f"{root}/{at}")


class TextFiles(DataSource):
    """Options: path, suffix."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return Writer(self.options["path"], self.options.get("suffix", ""))


def write_text_files(lines: DataFrame, path: str, suffix: str = ".md") -> None:
    """lines: name, place, text. Names are dealt out by their hash; a name's lines are sorted and streamed by one task."""
    lines.sparkSession.dataSource.register(TextFiles)
    placed = lines.repartition("name").sortWithinPartitions("name", "place").select("name", "text")
    placed.write.format(FORMAT).option("suffix", suffix).mode("append").save(path)
