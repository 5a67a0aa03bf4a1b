"""Event sources and a key-value source as Python data sources, over files of JSON lines.

`events` is a stream reader with offsets per file and byte, as a server that sends events by id would
give; `keyed` a batch reader that takes a prefix of the key as a pushed-down filter.
"""

from __future__ import annotations

import io
import json
import re
from collections.abc import Iterator

import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, InputPartition, StringStartsWith

BLOCK = 1 << 16


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    if m := re.match(r"file:/*(/.*)", path):
        path = m[1]
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


class Range(InputPartition):
    """The lines of a file that begin at a byte of [start, end)."""

    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def whole_lines(fs: pafs.FileSystem, path: str, size: int) -> int:
    """The end of the last line that a line feed ends."""
    with fs.open_input_file(path) as f:
        while size:
            start = max(0, size - BLOCK)
            f.seek(start)
            if (at := f.read(size - start).rfind(b"\n")) >= 0:
                return start + at + 1
            size = start
    return 0


class EventsReader(DataSourceStreamReader):
    """Rows (topic, id, data); resumes after the last offset, as Last-Event-ID does.

    An offset is how many bytes of each file are done. The driver lists files and looks for the last
    line feed of those that have grown; ranges of about `splitBytes` are read and parsed by tasks. A line
    counts once its line feed is there. Events without an id get their file and byte.
    """

    def __init__(self, options: dict[str, str]):
        self.path, self.split = options["path"], int(options.get("splitBytes", 32 << 20))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        fs, at = filesystem(self.path)
        for i in fs.get_file_info(pafs.FileSelector(at)):
            if i.path.endswith(".jsonl") and self.known.get(i.base_name, (-1, 0))[0] != i.size:
                self.known[i.base_name] = (i.size, whole_lines(fs, i.path, i.size))
        return {file: end for file, (_, end) in sorted(self.known.items())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, at, min(at + self.split, e)) for f, e in end.items() for at in range(start.get(f, 0), e, self.split)]

    def read(self, partition: Range) -> Iterator[tuple]:
        fs, folder = filesystem(self.path)
        with fs.open_input_file(f"{folder.rstrip('/')}/{partition.file}") as raw:
            at = max(0, partition.start - 1)
            raw.seek(at)
            f = io.BufferedReader(raw, BLOCK)
            # the line that holds the byte before belongs to the range before
            at += len(f.readline()) if partition.start else 0
            while at < partition.end and (line := f.readline()):
                if line.strip():
                    v = json.loads(line)
                    yield str(v.get("topic", "")), str(v.get("id", f"{partition.file}:{at}")), json.dumps(v.get("data"))
                at += len(line)


class EventsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "events"

    def schema(self) -> str:
        return "topic string, id string, data string"

    def streamReader(self, schema) -> EventsReader:
        return EventsReader(self.options)


class KeyedReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.prefix, self.exact = options["path"], "", None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("key",):
                self.prefix = max(self.prefix, f.value, key=len)
                yield f  # several prefixes may be given; Spark checks all
            elif isinstance(f, EqualTo) and f.attribute == ("key",):
                self.exact = f.value
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, at = filesystem(self.path)
        return [InputPartition(i.path) for i in fs.get_file_info(pafs.FileSelector(at)) if i.path.endswith(".jsonl")] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        fs, _ = filesystem(self.path)
        with fs.open_input_file(partition.value) as raw:
            for line in io.BufferedReader(raw, BLOCK):
                if not line.strip():
                    continue
                v = json.loads(line)
                key = str(v["key"])
                if key.startswith(self.prefix) and (self.exact is None or key == self.exact):
                    yield key, json.dumps(v.get("value"))


class KeyedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "keyed"

    def schema(self) -> str:
        return "key string, value string"

    def reader(self, schema) -> KeyedReader:
        return KeyedReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventsSource)
    spark.dataSource.register(KeyedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
