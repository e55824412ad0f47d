"""Stored tables that change together: one commit for several tables, and changes that rewrite only what they touch.

A store is a folder. `data/` holds Parquet folders that are never changed, `log/` one small file
per version. A version names, for each table and key bucket, the folders that hold its rows, and
the last batch of each writer. A commit creates the next version's file if it is not there yet;
who comes second reads the new version and works out its change again. Readers see the folders of
one version: never half of a change, and nothing of a write that stopped before its commit.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.maintenance import accepted, inserted_rows
from ..schemas import DETECTIONS, VIDEOS, conform
from ..scratch import written


class Conflict(Exception):
    """Another writer has committed the version that was to be made."""


@dataclass
class Version:
    """Folders by table and bucket, and each writer's last batch, as of one commit."""

    number: int = 0
    tables: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    writers: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Table:
    """A table's schema, the column whose hash deals its rows to buckets, and the number of buckets."""

    schema: T.StructType
    key: str
    buckets: int = 16


EVENT_ROWS = T.StructType([T.StructField("detection_id", T.IntegerType()), T.StructField("t_ms", T.LongType()), T.StructField("plate", T.StringType())])
TABLES = {
    "videos": Table(VIDEOS, "path"),
    "detections": Table(DETECTIONS, "id"),
    "events": Table(EVENT_ROWS, "detection_id"),
}


class Store:
    def __init__(self, spark: SparkSession, root: str, tables: dict[str, Table] = TABLES):
        self.spark, self.root, self.kinds = spark, root.rstrip("/"), tables
        self._jvm = spark.sparkContext._jvm
        log = self._path("log")
        self._fs = log.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(log)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    # Versions

    def version(self, number: int | None = None) -> Version:
        """The version of a number, by default the last; 0 is the empty store."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("log"))]
        known = sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())
        number = (known[-1] if known else 0) if number is None else number
        if number == 0:
            return Version()
        stream = self._fs.open(self._path(f"log/{number:012d}.json"))
        try:
            return Version(**json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
        finally:
            stream.close()

    def _commit(self, after: Version) -> None:
        """Creates the version's file, whole or not at all: a file of another name is renamed to it, which fails where it exists."""
        target, draft = self._path(f"log/{after.number:012d}.json"), self._path(f"log/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(json.dumps(after.__dict__).encode()))
        out.close()
        try:
            if self._fs.getScheme() == "file":  # a local rename replaces its target; a link does not
                files = self._jvm.java.nio.file
                files.Files.createLink(files.Path.of(target.toUri().getPath(), self._none()), files.Path.of(draft.toUri().getPath(), self._none()))
            else:
                context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri())
                none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
                context.rename(draft, target, none)
        except Exception as e:
            if self._fs.exists(target):
                raise Conflict(after.number) from e
            raise
        finally:
            self._fs.delete(draft, False)

    def _none(self):
        return self.spark.sparkContext._gateway.new_array(self._jvm.java.lang.String, 0)

    def change(self, writer: str, batch: int, work: Callable[[Version], dict[str, dict[str, list[str]]]], attempts: int = 20) -> bool:
        """Commits what work(version) gives: for tables and buckets the folders that take the place of the old ones.

        A batch that this writer has committed already changes nothing (False). Where another writer comes first,
        `work` is done again on its version.
        """
        for _ in range(attempts):
            now = self.version()
            if now.writers.get(writer, -1) >= batch:
                return False
            tables = {name: {**now.tables.get(name, {}), **found} for name, found in work(now).items()}
            try:
                self._commit(Version(now.number + 1, {**now.tables, **tables}, {**now.writers, writer: batch}))
                return True
            except Conflict:
                continue
        raise Conflict(f"{writer} {batch}: {attempts} attempts")

    # Rows

    def read(self, name: str, version: Version | None = None, buckets: list[str] | None = None) -> DataFrame:
        """A table's rows as of a version; of all buckets, or those named."""
        held = (self.version() if version is None else version).tables.get(name, {})
        folders = [f"{self.root}/{f}" for b, found in held.items() if buckets is None or b in buckets for f in found]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in self.kinds[name].schema.fields])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def bucket(self, name: str, column: str | None = None):
        kind = self.kinds[name]
        return F.pmod(F.xxhash64(F.col(column or kind.key).cast("string")), F.lit(kind.buckets)).cast("string")

    def write(self, name: str, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows as new folders: the folder of each bucket that has any. Nothing points to them before a commit."""
        folder = f"data/{name}/{uuid.uuid4().hex}"
        dealt = conform(rows, self.kinds[name].schema).withColumn("__bucket", self.bucket(name))
        dealt.repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.root}/{folder}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(folder)) if s.isDirectory()]
        return {n.split("=", 1)[1]: [f"{folder}/{n}"] for n in names}

    def appended(self, name: str, rows: DataFrame, now: Version) -> dict[str, list[str]]:
        held = now.tables.get(name, {})
        return {b: held.get(b, []) + found for b, found in self.write(name, rows).items()}

    def rewritten(self, name: str, keys: DataFrame, change: Callable[[DataFrame], DataFrame], now: Version) -> dict[str, list[str]]:
        """The buckets that hold `keys` (one column, the table's key), with change(their rows) in place of their rows."""
        touched = [r[0] for r in keys.select(self.bucket(name, keys.columns[0]).alias("b")).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return {}
        return {b: [] for b in touched} | self.write(name, change(self.read(name, now, touched)))


def insert_detections(store: Store, requests: DataFrame, writer: str, batch: int) -> bool:
    """Adds detections and their events in one commit: all of both or nothing, once, however often it is run."""

    def work(now: Version) -> dict:
        existing = store.read("detections", now)
        last = existing.agg(F.max("id")).first()[0] or 0
        new = written(accepted(existing, requests).withColumn("id", last + F.col("request_id")), "accepted")
        detections, events = inserted_rows(new)
        return {"detections": store.appended("detections", detections, now), "events": store.appended("events", events, now)}

    return store.change(writer, batch, work)


def upsert_videos(store: Store, videos: DataFrame, writer: str, batch: int) -> bool:
    """Videos (path, fps, frames, created_at; of a path the last by created_at counts): a known path keeps its id and creation time.

    Only the buckets of the given paths are read and rewritten. New paths get ids after the largest, in the order of path.
    """
    given = videos.groupBy("path").agg(F.max_by(F.struct("fps", "frames", "created_at"), "created_at").alias("v"))
    given = written(given.select("path", "v.*"), "videos")

    def work(now: Version) -> dict:
        last = store.read("videos", now).agg(F.max("id")).first()[0] or 0
        known = store.read("videos", now).select("path").distinct()
        fresh = written(given.join(known, "path", "left_anti").select("path"), "fresh")
        # A range sort numbers the new paths; no task holds them all.
        from ..operators.stretches import numbered

        ids = numbered(fresh.withColumn("one", F.lit(1)), "one", ["path"]).select("path", (F.col("idx") + last + 1).cast("int").alias("new_id"))

        def change(held: DataFrame) -> DataFrame:
            old = held.select("path", F.col("id").alias("old_id"), F.col("fps").alias("old_fps"), F.col("frames").alias("old_frames"), F.col("created_at").alias("old_at"))
            all_rows = old.join(given, "path", "full").join(ids, "path", "left")
            either = lambda a, b, name: F.coalesce(a, b).alias(name)
            return all_rows.select(either("old_id", "new_id", "id"), "path", either("fps", "old_fps", "fps"), either("frames", "old_frames", "frames"), either("old_at", "created_at", "created_at"))

        return {"videos": store.rewritten("videos", given.select("path"), change, now)}

    return store.change(writer, batch, work)


def delete_detections(store: Store, gone: DataFrame, writer: str, batch: int) -> bool:
    """Deletes detections (column id) and, in the same commit, their events; other buckets stay as they are."""
    gone = written(gone.select("id").distinct(), "gone")

    def work(now: Version) -> dict:
        hit = written(store.read("detections", now).select("id").join(gone, "id", "left_semi"), "hit")
        detections = store.rewritten("detections", hit, lambda rows: rows.join(hit, "id", "left_anti"), now)
        events = store.rewritten("events", hit, lambda rows: rows.join(hit.withColumnRenamed("id", "detection_id"), "detection_id", "left_anti"), now)
        return {"detections": detections, "events": events}

    return store.change(writer, batch, work)


def delete_videos(store: Store, gone: DataFrame, writer: str, batch: int) -> bool:
    """Deletes videos (column id) with their detections and events, in one commit."""
    gone = written(gone.select("id").distinct(), "gone")

    def work(now: Version) -> dict:
        paths = written(store.read("videos", now).join(gone, "id", "left_semi").select("path"), "paths")
        of_video = gone.select(F.col("id").alias("video_id"))
        hit = written(store.read("detections", now).join(of_video, "video_id", "left_semi").select("id"), "hit")
        return {
            "videos": store.rewritten("videos", paths, lambda rows: rows.join(paths, "path", "left_anti"), now),
            "detections": store.rewritten("detections", hit, lambda rows: rows.join(hit, "id", "left_anti"), now),
            "events": store.rewritten("events", hit, lambda rows: rows.join(hit.withColumnRenamed("id", "detection_id"), "detection_id", "left_anti"), now),
        }

    return store.change(writer, batch, work)
