"""Numbered lines of listed text files as a data source: each line with the number of its file and its own, and files written with a commit."""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

SCHEMA = "file_id int, file string, line_index long, value string"
LINES = 20_000


def located(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; a path without scheme is one that every executor sees."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


class OneFile(InputPartition):
    def __init__(self, number: int, path: str) -> None:
        super().__init__(number)
        self.path = path


class LineReader(DataSourceReader):
    def __init__(self, paths: list[str], comment: str) -> None:
        self.paths, self.comment = paths, comment

    def partitions(self) -> list[InputPartition]:
        return [OneFile(k, path) for k, path in enumerate(self.paths)]

    def read(self, partition: OneFile) -> Iterator[pa.RecordBatch]:
        system, path = located(partition.path)
        kinds = [pa.int32(), pa.string(), pa.int64(), pa.string()]

        def batch(lines: list[str], first: int) -> pa.RecordBatch:
            columns = [[partition.value] * len(lines), [partition.path] * len(lines), range(first, first + len(lines)), lines]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["file_id", "file", "line_index", "value"])

        held, first = [], 0
        with system.open_input_stream(path, compression=None) as raw:
            text = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else io.BufferedReader(raw)
            for line in io.TextIOWrapper(text, "utf-8", newline="\n"):
                line = line.rstrip("\r\n")
                if not line or line.startswith(self.comment):
                    continue
                held.append(line)
                if len(held) == LINES:
                    yield batch(held, first)
                    held, first = [], first + LINES
        if held:
            yield batch(held, first)


@dataclass
class Written(WriterCommitMessage):
    name: str
    rows: int


class LineWriter(DataSourceArrowWriter):
    """A gzip file for each task, by a name of its own until the job is committed; then all get their places, and a list of them is written."""

    def __init__(self, path: str, header: str | None) -> None:
        self.path, self.header, self.job = path.rstrip("/"), header, uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, at = located(self.path)
        system.create_dir(f"{at}/_tmp-{self.job}")
        task = TaskContext.get()
        name, rows = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.gz", 0
        with system.open_output_stream(f"{at}/_tmp-{self.job}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0) as out:
            if self.header:
                out.write(f"{self.header}\n".encode())
            for batch in iterator:
                for line in batch.column(batch.schema.get_field_index("value")).to_pylist():
                    out.write(f"{line}\n".encode())
                    rows += 1
        return Written(name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        names = []
        for m in messages:
            if m and m.rows:
                final = "-".join(m.name.split("-")[:2]) + ".gz"
                system.move(f"{at}/_tmp-{self.job}/{m.name}", f"{at}/{final}")
                names.append(final)
        system.create_dir(f"{at}/_tmp-{self.job}")
        system.delete_dir(f"{at}/_tmp-{self.job}")
        with system.open_output_stream(f"{at}/_files.json") as out:
            out.write(json.dumps(sorted(names)).encode())

    def abort(self, messages: list[Written | None]) -> None:
        system, at = located(self.path)
        system.create_dir(f"{at}/_tmp-{self.job}")
        system.delete_dir(f"{at}/_tmp-{self.job}")


class NumberedLines(DataSource):
    """Format 'numbered_lines'. Options: paths, a JSON list whose order numbers the files; comment, how lines begin that are left out ('#').

    To write: path, a folder; header, a line each file begins with. The table has a column value.
    """

    @classmethod
    def name(cls) -> str:
        return "numbered_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LineReader:
        return LineReader(json.loads(self.options["paths"]), self.options.get("comment", "#"))

    def writer(self, schema, overwrite: bool) -> LineWriter:
        if overwrite:
            raise ValueError("numbered_lines only adds files: write to a new folder in mode 'append'")
        return LineWriter(self.options["path"], self.options.get("header"))


def numbered_lines(spark: SparkSession, paths: list[str]):
    """file_id, file, line_index and value of the lines of files, one task a file."""
    spark.dataSource.register(NumberedLines)
    return spark.read.format("numbered_lines").option("paths", json.dumps(paths)).load()
