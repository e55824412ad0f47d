"""Frames of uncompressed videos (Y4M) as a data source, and a writer that puts a video in a file.

    spark.dataSource.register(FrameSource)
    spark.read.format("frames").option("path", folder).option("step", 2).load()

Rows are (path, frame_idx, ms, width, height, gray), gray the luma plane. Every frame of a file has
the same size, so a task gets a range of frame numbers and reads nothing else: only every step-th
frame, up to the time limit, and of these only the numbers that filters on frame_idx leave. A file
without a frame rate counts as 25 a second; one that cannot be read has no frames. Paths may be any
that pyarrow opens (a plain path is a local or mounted one). Compressed videos are decoded outside.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)

from .files import FilesWriter, opened

SCHEMA = "path string, frame_idx long, ms long, width int, height int, gray binary"
ARROW = pa.schema([("path", pa.string()), ("frame_idx", pa.int64()), ("ms", pa.int64()), ("width", pa.int32()), ("height", pa.int32()), ("gray", pa.binary())])
#: Fixed values of the format: the marks a file and a frame begin with, and the planes' bytes for each luma byte, by colour space.
MAGIC, FRAME = b"YUV4MPEG2", b"FRAME\n"
PLANES = {"mono": 1.0, "420": 1.5, "422": 2.0, "444": 3.0}
FPS = 25.0


@dataclass
class Shape:
    """Where a file's frames are."""

    width: int
    height: int
    fps: float
    start: int
    stride: int
    frames: int


def shape_of(files: arrow_fs.FileSystem, path: str, size: int) -> Shape | None:
    """A file's shape from its first line; None if it is none of this format."""
    try:
        with files.open_input_file(path) as f:
            head = f.read(min(size, 512)).split(b"\n", 1)
        if len(head) < 2 or not head[0].startswith(MAGIC):
            return None
        tags = {t[:1]: t[1:] for t in head[0].decode("ascii").split(" ")[1:] if t}
        width, height = int(tags["W"]), int(tags["H"])
        a, _, b = tags.get("F", "0:1").partition(":")
        fps = int(a) / int(b or 1) if int(b or 1) else 0.0
        per = PLANES.get(re.match("mono|[0-9]{3}|", tags.get("C", "420")).group(), 1.5)
        stride = len(FRAME) + (width * height if per == 1 else int(width * height) + (2 * ((width + 1) // 2) * ((height + 1) // 2) if per == 1.5 else int(width * height * (per - 1))))
        start = len(head[0]) + 1
        return Shape(width, height, fps if fps > 1e-3 else FPS, start, stride, max(0, size - start) // stride)
    except (OSError, ValueError, KeyError, UnicodeDecodeError):
        return None


@dataclass
class Part(InputPartition):
    path: str
    first: int
    last: int
    shape: Shape


class FrameReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.glob = options.get("pathglobfilter", "*.y4m")
        self.step = max(1, int(options.get("step", 1)))
        self.max_ms = int(options["maxms"]) if options.get("maxms") else None
        self.part_bytes = int(options.get("partbytes", 64_000_000))
        self.low, self.high, self.wanted = 0, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes bounds and lists of frame_idx; the rest, and these too, Spark checks again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("frame_idx",):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    top = f.value - isinstance(f, LessThan)
                    self.high = top if self.high is None else min(self.high, top)
                elif isinstance(f, (EqualTo, In)):
                    values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                    self.wanted = values if self.wanted is None else self.wanted & values
            yield f

    def limits(self, shape: Shape) -> tuple[int, int]:
        """The first frame number that may be wanted of a file, and the one after the last."""
        high = shape.frames if self.high is None else min(shape.frames, self.high + 1)
        if self.max_ms is not None:
            # Times grow with numbers: the first frame at or past the limit ends the file.
            at = max(0, int(self.max_ms / 1000 * shape.fps) - 1)
            while int(at / shape.fps * 1000) < self.max_ms:
                at += 1
            high = min(high, at)
        low = self.low
        if self.wanted is not None:
            inside = [n for n in self.wanted if n is not None and low <= n < high]
            low, high = (min(inside), max(inside) + 1) if inside else (0, 0)
        return low, high

    def partitions(self) -> list[Part]:
        files, root = opened(self.path)
        info = files.get_file_info(root)
        if info.type == arrow_fs.FileType.Directory:
            found = [i for i in files.get_file_info(arrow_fs.FileSelector(root, recursive=True)) if i.is_file and fnmatch.fnmatch(i.base_name, self.glob)]
        else:
            found = [info] if info.is_file else []
        parts = []
        for i in sorted(found, key=lambda i: i.path):
            shape = shape_of(files, i.path, i.size)
            if shape is None:
                continue
            low, high = self.limits(shape)
            low = -(-low // self.step) * self.step
            many = max(1, self.part_bytes // shape.stride) * self.step
            parts += [Part(i.path, n, min(high, n + many), shape) for n in range(low, high, many)]
        return parts

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # without partitions Spark asks once for none
            return
        files, _ = opened(self.path)
        s, rows = part.shape, []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

        held = 0
        with files.open_input_file(part.path) as f:
            for n in range(part.first, part.last, self.step):
                if self.wanted is not None and n not in self.wanted:
                    continue
                f.seek(s.start + n * s.stride)
                raw = f.read(len(FRAME) + s.width * s.height)
                if len(raw) < len(FRAME) + s.width * s.height or not raw.startswith(FRAME):
                    break  # what follows a damaged frame cannot be placed
                rows.append((part.path, n, int(n / s.fps * 1000), s.width, s.height, raw[len(FRAME) :]))
                held += len(raw)
                if held > 8_000_000:
                    yield batch()
                    rows, held = [], 0
        if rows:
            yield batch()


class FrameWriter(FilesWriter):
    """Writes rows (path, frame_idx, width, height, gray) as a grey video for each path below the folder.

    Rows must come sorted by (path, frame_idx), a path in one task, as `write_frames` deals them.
    """

    by = "path"

    def __init__(self, options: dict):
        super().__init__(options)
        self.fps = options.get("fps", "25:1")

    def pieces(self, row: dict, first: bool) -> Iterator[bytes]:
        if first:
            yield f"YUV4MPEG2 W{row['width']} H{row['height']} F{self.fps} Cmono\n".encode()
        yield FRAME + bytes(row["gray"])


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FrameReader:
        return FrameReader(self.options)

    def writer(self, schema, overwrite: bool) -> FrameWriter:
        return FrameWriter(self.options)


def read_frames(spark, path: str, **options):
    """The frames below a path; options: step, maxMs, pathGlobFilter, partBytes."""
    spark.dataSource.register(FrameSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("frames").option("path", path)
    for name, value in options.items():
        reader = reader.option(name, value)
    return reader.load()


def write_frames(frames, path: str, fps: str = "25:1") -> None:
    """Writes frames (path, frame_idx, width, height, gray) as one grey video for each path."""
    spark = frames.sparkSession
    spark.dataSource.register(FrameSource)
    rows = frames.select("path", "frame_idx", "width", "height", "gray").repartition("path").sortWithinPartitions("path", "frame_idx")
    rows.write.format("frames").option("path", path).option("fps", fps).mode("append").save()
