"""Append logs of JSON lines: rows with their place, in the order in which they were appended, read once or followed.

A place is (file, offset), the file's path below the log and the byte at which the line begins; places sort as the rows
were appended. ``append`` adds a folder ``batch=<n>`` whose number only one writer gets, so that appends of several
writers are in some order and none is lost, and takes effect by one rename. Logs that other tools write, a file that
grows, are read the same way.

Files are cut into ranges of bytes, each read by a task. A line belongs to the range that its first byte lies in. What
follows the last line break of a file isn't read yet: a torn last line counts once it is whole. Lines that are no JSON
of the schema, such as one that went on after a crash, are left out.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from stridemark.sources import store

FORMAT, LINES = "stridemark_log", "file string, offset bigint, line string"
RANGE = 32 << 20


def append(rows: DataFrame, path: str) -> None:
    """Add rows to a log. Within an append the rows stay in the order of the frame's partitions."""
    spark = rows.sparkSession
    draft = f"{path}/_append-{uuid.uuid4().hex}"
    rows.write.json(draft)
    store.delete(spark, f"{draft}/_SUCCESS")
    n = max([0, *(int(c) for c in store.names(spark, f"{path}/_claims") if c.isdigit())])
    while not store.put_if_absent(spark, f"{path}/_claims/{(n := n + 1):012d}", draft):
        pass
    store.rename(spark, draft, f"{path}/batch={n:012d}")


def _open(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def _is_data(name: str) -> bool:
    return not any(part[:1] in ("_", ".") for part in name.split("/"))


def _files(root: str) -> dict[str, int]:
    """Path below the log and size of each of its files; the log may be one file, whose path is empty."""
    from pyarrow import fs

    on, base = _open(root)
    info = on.get_file_info(base)
    if info.type == fs.FileType.File:
        return {"": info.size}
    found = on.get_file_info(fs.FileSelector(base, allow_not_found=True, recursive=True))
    listed = {f.path[len(base.rstrip("/")) + 1 :]: f.size for f in found if f.type == fs.FileType.File}
    return {name: size for name, size in sorted(listed.items()) if _is_data(name)}


def _whole(root: str, name: str, start: int, size: int, step: int = 1 << 16) -> int:
    """Where the last line break from start on ends, or start if there is none."""
    on, base = _open(root)
    with on.open_input_file(f"{base}/{name}" if name else base) as f:
        end = size
        while end > start:
            a = max(start, end - step)
            f.seek(a)
            at = f.read(end - a).rfind(b"\n")
            if at >= 0:
                return a + at + 1
            end = a
    return start


def ends(root: str, known: dict[str, int] | None = None) -> dict[str, int]:
    """Of each file the place up to which it has whole lines; files that haven't grown since ``known`` aren't opened."""
    known = known or {}
    return {name: _whole(root, name, known.get(name, 0), size) if size > known.get(name, 0) else known[name] for name, size in _files(root).items() if size}


@dataclass
class Range(InputPartition):
    """Lines of a file that begin from start on and before end."""

    name: str
    start: int
    end: int
    whole: int  # where the file's whole lines end


def _ranges(start: dict[str, int], end: dict[str, int], size: int) -> list[Range]:
    return [Range(name, a, min(a + size, z), z) for name, z in sorted(end.items()) for a in range(start.get(name, 0), z, size)]


def _lines(root: str, part: Range) -> Iterator[tuple[str, int, str]]:
    on, base = _open(root)
    with on.open_input_file(f"{base}/{part.name}" if part.name else base) as f:
        skipping = part.start > 0  # from the byte before: a line that was begun earlier, or what a line break ends
        at = place = max(0, part.start - 1)
        f.seek(at)
        rest = b""
        while at < part.end and (more := f.read(min(1 << 20, part.whole - place))):
            place += len(more)
            *whole, rest = (rest + more).split(b"\n")
            for line in whole:
                if at >= part.end:
                    return
                if not skipping:
                    yield part.name, at, line.decode("utf-8", "replace")
                skipping = False
                at += len(line) + 1


class _Batch(DataSourceReader):
    def __init__(self, root: str, after: dict[str, int], size: int) -> None:
        self.root, self.after, self.size = root, after, size

    def partitions(self) -> list[Range]:
        return _ranges(self.after, ends(self.root, self.after), self.size) or [Range("", 0, 0, 0)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(self.root, partition) if partition.end > partition.start else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, root: str, after: dict[str, int], size: int) -> None:
        self.root, self.after, self.size, self.known = root, after, size, dict(after)

    def initialOffset(self) -> dict:
        return self.after

    def latestOffset(self) -> dict:
        self.known = ends(self.root, self.known)
        return self.known

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return _ranges(start, end, self.size)

    def read(self, partition: Range) -> Iterator[tuple]:
        return _lines(self.root, partition)


class LogSource(DataSource):
    """Lines of a log with their places. Options: path, ``after`` (JSON of file: offset, read from there on), ``range``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return LINES

    def _given(self) -> tuple[str, dict[str, int], int]:
        return self.options["path"], json.loads(self.options.get("after", "{}")), int(self.options.get("range", RANGE))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._given())

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(*self._given())


def _uri(spark: SparkSession, path: str) -> str:
    hadoop, fs = store.at(spark, path)
    whole = fs.makeQualified(hadoop).toString()
    return whole.replace("file:/", "file:///", 1) if whole.startswith("file:/") and not whole.startswith("file://") else whole


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of the schema, and ``seq``, the row's place; lines that aren't of the schema are left out."""
    row = F.from_json("line", f"{schema}, _corrupt_record STRING", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = lines.select(row.alias("r"), F.struct("file", "offset").alias("seq")).filter("r IS NOT NULL AND r._corrupt_record IS NULL")
    return rows.select("r.*", "seq").drop("_corrupt_record")


def read_log(spark: SparkSession, path: str, schema: str, after: dict[str, int] | None = None, size: int = RANGE) -> DataFrame:
    """The rows of a log from a position on, which ``position`` gives, with ``seq``."""
    spark.dataSource.register(LogSource)
    lines = spark.read.format(FORMAT).option("path", _uri(spark, path)).option("after", json.dumps(after or {})).option("range", size).load()
    return _parsed(lines, schema)


def position(spark: SparkSession, path: str, after: dict[str, int] | None = None) -> dict[str, int]:
    """Up to where a log's lines are whole: what a later read goes on from."""
    return ends(_uri(spark, path), after)


def follow_log(spark: SparkSession, path: str, schema: str, size: int = RANGE) -> DataFrame:
    """The rows of a log as a stream; its checkpoint holds the position."""
    spark.dataSource.register(LogSource)
    return _parsed(spark.readStream.format(FORMAT).option("path", _uri(spark, path)).option("range", size).load(), schema)
