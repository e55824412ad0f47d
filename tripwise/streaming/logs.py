"""Camera logs as a streaming source of their own.

    spark.dataSource.register(CameraLogs)
    spark.readStream.format("camera_logs").option("path", folder).load()

A camera appends lines `<t_ms>` or `<t_ms>,<error>` to `<camera_id>.log`. The offset holds, for each file, the bytes
read so far; it ends at a line's end, so a line half written waits for the next batch. A batch is cut into ranges of
bytes, partBytes in a task, and a range that is read again gives the same rows: a stream that goes on from its checkpoint
neither loses nor repeats a line. Short ranges share a task. Rows are (camera_id, t_ms, ts, error); lines that do not begin with a time, and
files that are not named by a number, are passed over. A log that became shorter is read from its new end on.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.files import opened

SCHEMA = "camera_id long, t_ms long, ts timestamp, error string"
ARROW = pa.schema([("camera_id", pa.int64()), ("t_ms", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("error", pa.string())])
BLOCK = 65_536
#: Times that a timestamp holds (years 1 to 9999), in milliseconds.
LEAST_MS, MOST_MS = -62_135_596_800_000, 253_402_300_799_999


@dataclass
class Range:
    """Bytes of a log; a line belongs to the range it begins in."""

    name: str
    start: int
    end: int


@dataclass
class Part(InputPartition):
    """The ranges that a task reads."""

    ranges: list[Range]


def last_line_end(files: arrow_fs.FileSystem, path: str, size: int) -> int:
    """The position after a file's last newline, looked for from its end; 0 if it has none."""
    with files.open_input_file(path) as f:
        end = size
        while end > 0:
            at = max(0, end - BLOCK)
            f.seek(at)
            found = f.read(end - at).rfind(b"\n")
            if found >= 0:
                return at + found + 1
            end = at
    return 0


def parsed(camera: int, line: bytes) -> tuple | None:
    t, _, error = line.decode("utf-8", "replace").rstrip("\r").partition(",")
    digits = t.removeprefix("-")
    if not (digits.isascii() and digits.isdigit() and len(digits) < 16 and LEAST_MS <= int(t) <= MOST_MS):
        return None
    return camera, int(t), int(t) * 1000, error or None


def rows_in(f, r: Range) -> Iterator[tuple]:
    """The rows of the lines that begin in a range of an open log."""
    camera = int(r.name.rpartition(".")[0])
    # From the byte before: a range that begins with a line finds the newline there, any other skips to the next one.
    at, rest, inside = max(0, r.start - 1), b"", r.start == 0
    f.seek(at)
    while at < r.end or (inside and rest):
        block = f.read(BLOCK)
        at_line = at - len(rest)
        *lines, rest = (rest + block).split(b"\n")
        for line in lines:
            if inside and at_line < r.end and (row := parsed(camera, line)):
                yield row
            at_line += len(line) + 1
            inside = True
        at += len(block)
        if not block or at_line >= r.end:
            return


class CameraLogReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part_bytes = max(1, int(options.get("partbytes", 64_000_000)))
        self.looked_at: dict[str, tuple[int, int]] = {}  # a log's size and where its last line ended then

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        files, root = opened(self.path)
        ends = {}
        for i in files.get_file_info(arrow_fs.FileSelector(root, allow_not_found=True)):
            stem, dot, kind = i.base_name.rpartition(".")
            if i.is_file and dot and kind == "log" and stem.isascii() and stem.isdigit():
                size, end = self.looked_at.get(i.base_name, (-1, 0))
                ends[i.base_name] = end if size == i.size else last_line_end(files, i.path, i.size)
                self.looked_at[i.base_name] = i.size, ends[i.base_name]
        return dict(sorted(ends.items()))

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts, room = [], 0
        for name, last in end.items():
            at = start.get(name, 0)
            while at < last:
                if room <= 0:
                    parts.append(Part([]))
                    room = self.part_bytes
                to = min(last, at + room)
                parts[-1].ranges.append(Range(name, at, to))
                room -= to - at
                at = to
        return parts

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        files, root = opened(self.path)
        rows = []
        for r in part.ranges:
            with files.open_input_file(posixpath.join(root, r.name)) as f:
                for row in rows_in(f, r):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
        if rows:
            yield batch(rows)

    def commit(self, end: dict) -> None:
        """Nothing to give back: logs stay as they are."""


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)


class CameraLogs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "camera_logs"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> CameraLogReader:  # noqa: N802
        return CameraLogReader(self.options)


def read_logs(spark: SparkSession, path: str, **options) -> DataFrame:
    """The logs below a path as a stream; option: partBytes."""
    spark.dataSource.register(CameraLogs)
    reader = spark.readStream.format("camera_logs").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()
