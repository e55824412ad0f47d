"""Files written from rows, a file for each name: pictures, copies, traces, logs.

    write_files(rows, folder, "frame")     rows (name, content, frame): the contents of a name, in order, are its file
    copy_files(rows, folder)               rows (name, source): the file `source` is copied to `name`

Tasks write drafts in a hidden folder of the write; when all of them are done the drafts get their names, in tasks again,
and files that have such a name are replaced. Each attempt notes the names of its drafts in a file beside them, so neither
names nor drafts pass through the driver. A task that fails or runs twice leaves nothing: the hidden folder goes as a whole.
A driver lost while names are given leaves some files old and some new, none of them in part; the write is then repeated.
A file is written by one task, in pieces, so its size is not bound by memory.
"""

from __future__ import annotations

import functools
import io
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..scratch import written

PIECE = 4_000_000
#: In the folder of an attempt: the names its drafts are to get, one a line. In the folder of a write: the attempts that count.
NAMES, KEPT = "names", "kept"
#: Rows of a listing (folder: path of a folder, else null) and of files read.
LISTED, STORED = "path string, length long, folder string", "path string, length long, content binary"
ARROW_LISTED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("folder", pa.string())])
ARROW_STORED = pa.schema([("path", pa.string()), ("length", pa.int64()), ("content", pa.binary())])


def opened(path: str) -> tuple[arrow_fs.FileSystem, str]:
    """The file system of a path and the path in it; a plain path is a local or mounted one. As in Spark, `file:` paths are not percent-encoded."""
    if path.startswith("file:"):
        return arrow_fs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    return arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path)


@dataclass
class Drafts(WriterCommitMessage):
    """The folder of an attempt's drafts, below the hidden one of the write; None where it wrote nothing."""

    attempt: str | None


class FilesWriter(DataSourceArrowWriter):
    """Writes each run of rows with one value in the column `by` to the file of that name."""

    by = "name"

    def __init__(self, options: dict):
        self.path = options["path"]
        # Made on the driver, so all tasks of a write share it. Who gives one gives the names too, to the attempts that commit() notes.
        self.hidden = options.get("hidden") or f".drafts-{uuid.uuid4().hex}"
        self.named = "hidden" not in options

    def pieces(self, row: dict, first: bool) -> Iterator[bytes]:
        """What a row adds to its file; first: the file is new."""
        if row["content"] is not None:
            yield bytes(row["content"])

    def write(self, batches: Iterator[pa.RecordBatch]) -> Drafts:
        files, root = opened(self.path)
        attempt = uuid.uuid4().hex
        drafts = posixpath.join(root, self.hidden, attempt)
        many, names, out, now = 0, None, None, None
        try:
            for b in batches:
                for part in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
                    for row in part.to_pylist():
                        first = out is None or row[self.by] != now
                        if first:
                            if out is not None:
                                out.close()
                            now = checked(row[self.by])
                            if names is None:
                                files.create_dir(drafts, recursive=True)
                                names = files.open_output_stream(posixpath.join(drafts, NAMES), buffer_size=1 << 16)
                            names.write(json.dumps(now).encode() + b"\n")
                            out = files.open_output_stream(posixpath.join(drafts, str(many)))
                            many += 1
                        for piece in self.pieces(row, first):
                            out.write(piece)
        finally:
            for f in (out, names):
                if f is not None:
                    f.close()
        return Drafts(attempt if many else None)

    def commit(self, messages: list[Drafts | None]) -> None:
        kept = [m.attempt for m in messages if m and m.attempt]
        if self.named:
            for attempt in kept:
                give_names(self.path, self.hidden, attempt)
            self.abort(messages)
        elif kept:
            files, root = opened(self.path)
            with files.open_output_stream(posixpath.join(root, self.hidden, KEPT)) as f:
                f.write(json.dumps(kept).encode())

    def abort(self, messages: list[Drafts | None]) -> None:
        clear(self.path, self.hidden)


def give_names(path: str, hidden: str, attempt: str) -> int:
    """Moves an attempt's drafts to their names, which may be begun and done again; gives their number."""
    files, root = opened(path)
    drafts, many = posixpath.join(root, hidden, attempt), 0
    with files.open_input_stream(posixpath.join(drafts, NAMES), buffer_size=1 << 16) as f:
        for line in io.TextIOWrapper(f, "ascii"):
            draft, target = posixpath.join(drafts, str(many)), posixpath.join(root, json.loads(line))
            try:
                files.move(draft, target)
            except OSError:
                if files.get_file_info(draft).type != arrow_fs.FileType.NotFound:  # the name's folder is new
                    files.create_dir(posixpath.dirname(target), recursive=True)
                    files.move(draft, target)
                elif files.get_file_info(target).type != arrow_fs.FileType.File:  # nor has an earlier try moved it
                    raise
            many += 1
    return many


def clear(path: str, hidden: str) -> None:
    files, root = opened(path)
    folder = posixpath.join(root, hidden)
    if files.get_file_info(folder).type == arrow_fs.FileType.Directory:
        files.delete_dir(folder)


def checked(name: str | None) -> str:
    """A name below the folder that is written to; any other is an error."""
    if not name or name.startswith("/") or ".." in name.split("/"):
        raise ValueError(f"no name of a file below the folder: {name!r}")
    return name


class CopyWriter(FilesWriter):
    """Writes copies: a row names the file whose bytes are read."""

    def pieces(self, row: dict, first: bool) -> Iterator[bytes]:
        if not first:
            return
        files, path = opened(row["source"])
        with files.open_input_stream(path) as f:
            while piece := f.read(PIECE):
                yield piece


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return CopyWriter(self.options) if "source" in schema.names else FilesWriter(self.options)


def _put(rows: DataFrame, folder: str) -> None:
    """Writes the drafts, then gives names: a task for each attempt that counts."""
    spark, hidden = rows.sparkSession, f".drafts-{uuid.uuid4().hex}"
    spark.dataSource.register(FileSink)
    rows.write.format("files").option("path", folder).option("hidden", hidden).mode("append").save()
    files, root = opened(folder)
    files.create_dir(root, recursive=True)
    note = posixpath.join(root, hidden, KEPT)
    try:
        if files.get_file_info(note).type == arrow_fs.FileType.NotFound:  # no rows
            return
        with files.open_input_stream(note) as f:
            kept = json.loads(f.read())

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                done = [give_names(folder, hidden, kept[at]) for at in b.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(done, pa.int64())], names=["many"])

        spark.range(0, len(kept), 1, len(kept)).mapInArrow(named, "many long").write.format("noop").mode("overwrite").save()
    finally:
        clear(folder, hidden)


def write_files(rows: DataFrame, folder: str, *order: str) -> None:
    """Writes rows (name, content: text or bytes) to a file for each name; a name's rows in `order`. Null content is empty."""
    dealt = rows.repartition("name").sortWithinPartitions("name", *order)
    _put(dealt.select("name", F.col("content").cast("binary").alias("content")), folder)


def copy_files(rows: DataFrame, folder: str, order: str = "source") -> None:
    """Copies files to names below a folder; of rows (name, source) that share a name the last by `order` counts.

    Which file counts is settled on the names alone, so a file that is not kept is not read. A source that cannot be read is an error.
    """
    last = rows.groupBy("name").agg(F.max_by("source", F.struct(order, "source")).alias("source"))
    _put(last.select("name", "source"), folder)


def grey_picture(width: Column, height: Column, gray: Column) -> Column:
    """A luma plane as the bytes of a PGM picture."""
    head = F.concat(F.lit("P5\n"), width.cast("string"), F.lit(" "), height.cast("string"), F.lit("\n255\n"))
    return F.concat(head.cast("binary"), gray)


def _unseen(name: str) -> bool:
    """Names that Spark's readers leave out."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _looked(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The files and folders in each folder (column folder)."""
    files, _ = opened(folder)
    for b in batches:
        for at in b.column("folder").to_pylist():
            found = [i for i in files.get_file_info(arrow_fs.FileSelector(at)) if not _unseen(i.base_name)]
            for n in range(0, len(found), 10_000):
                rows = [(i.path, i.size, None) if i.is_file else (None, None, i.path) for i in found[n : n + 10_000]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_LISTED.types, strict=True)], schema=ARROW_LISTED)


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """The files listed, with their content; about 8 MB of it at once, or one file."""
    files, _ = opened(folder)
    # A path as Spark writes it.
    scheme = "file:" if isinstance(files, arrow_fs.LocalFileSystem) else folder[: len(folder.rstrip("/")) - len(opened(folder)[1].rstrip("/"))]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW_STORED.types, strict=True)], schema=ARROW_STORED)

    rows, held = [], 0
    for b in batches:
        for path in b.column("path").to_pylist():
            with files.open_input_file(path) as f:
                content = f.read()
            if rows and held + len(content) > 8_000_000:
                yield batch(rows)
                rows, held = [], 0
            rows.append((scheme + path, len(content), content))
            held += len(content) + 200
    if rows:
        yield batch(rows)


def stored_files(spark, folder: str) -> DataFrame:
    """The files below a folder, empty ones too: path, length, content.

    Tasks look through the folders, level by level, and write what they find, so no list of files is held in one place;
    only a folder by itself is listed by one task.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    level = spark.createDataFrame([(opened(folder)[1],)], "folder string")
    listed, folders, many, held = None, 1, 0, 0
    while folders:
        dealt = level.repartition(min(tasks, folders), "folder")
        found = written(dealt.mapInArrow(functools.partial(_looked, folder=folder), LISTED), "listing")
        folders, n, size = found.agg(F.count("folder"), F.count("path"), F.coalesce(F.sum("length"), F.lit(0))).first()
        many, held = many + n, held + size
        level = found.filter("folder IS NOT NULL").select("folder")
        of_level = found.filter("path IS NOT NULL").select("path")
        listed = of_level if listed is None else listed.unionByName(of_level)
    dealt = listed.repartition(max(1, min(tasks, many), held // (16 * PIECE)), "path")
    return dealt.mapInArrow(functools.partial(_read, folder=folder), STORED)
