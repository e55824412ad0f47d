"""Maintenance as pure queries: upserts, cascades, dedup, camera and queue state, ingest."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import blank, clamp, error_text, file_name
from ..schemas import DETECTIONS, conform
from ..scratch import written
from ..sources.files import copy_files, opened, write_files
from ..sources.views import manifest_lines


def upsert_videos(log: DataFrame) -> DataFrame:
    """Current videos of a log (seq, id, path, fps, frames, created_at): a path keeps its first id and creation time."""
    return log.groupBy("path").agg(
        F.min_by("id", "seq").alias("id"),
        F.max_by("fps", "seq").alias("fps"),
        F.max_by("frames", "seq").alias("frames"),
        F.min_by("created_at", "seq").alias("created_at"),
    )


def dedup_detections(detections: DataFrame) -> DataFrame:
    """The newest detection of each (video_id, merge_ms); equal times: the larger id."""
    w = Window.partitionBy("video_id", "merge_ms").orderBy(F.desc("created_at"), F.desc("id"))
    return detections.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def detection_conflicts(detections: DataFrame) -> DataFrame:
    """Detections that a unique (video_id, merge_ms) would refuse: all but the first id."""
    w = Window.partitionBy("video_id", "merge_ms").orderBy("id")
    return detections.withColumn("rn", F.row_number().over(w)).filter("rn > 1").drop("rn")


def accepted(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (request_id, video_id, merge_ms and more) that a unique (video_id, merge_ms) lets in: of several the first, none that exists."""
    first = requests.groupBy("video_id", "merge_ms").agg(F.min("request_id").alias("request_id"))
    fresh = first.join(existing.select("video_id", "merge_ms"), ["video_id", "merge_ms"], "left_anti")
    return requests.join(fresh.select("request_id"), "request_id")


def refused(existing: DataFrame, requests: DataFrame) -> DataFrame:
    """The requests that are not let in."""
    return requests.join(accepted(existing, requests).select("request_id"), "request_id", "left_anti")


def inserted(existing: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New detections and their events (detection_id, t_ms, plate) of requests with lists `stamps` and `plates`.

    Ids follow the largest existing one by request_id, so a refused request leaves a gap, as a
    sequence does. plates may be null or shorter than stamps; blank plates are null.
    """
    last = existing.agg(F.coalesce(F.max("id"), F.lit(0)).alias("last"))
    return inserted_rows(accepted(existing, requests).crossJoin(last).withColumn("id", F.col("last") + F.col("request_id")))


def inserted_rows(new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Detections and events of accepted requests that have their id."""
    detections = new.select("id", "video_id", "merge_ms", F.coalesce(F.size("stamps"), F.lit(0)).alias("events_count"), "created_at")
    events = new.select(F.col("id").alias("detection_id"), "plates", F.posexplode("stamps").alias("pos", "t_ms"))
    plate = F.get("plates", F.col("pos"))
    return conform(detections, DETECTIONS), events.select("detection_id", "t_ms", F.when(~blank(plate), plate).alias("plate"))


def delete_cascade(parents: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key (column `key`) is not in gone (column id)."""
    return parents.join(gone.select(F.col("id").alias(key)), key, "left_anti")


LOGGED = ("name", "url", "active", "last_seen_at", "last_error")


def camera_state(log: DataFrame) -> DataFrame:
    """Cameras after a log (seq, id, op, name, url, active, last_seen_at, last_error); deleted ones are gone.

    insert and edit set name, url and active, active sets only that, health sets both health columns.
    """
    when = lambda ops: F.when(F.col("op").isin(*ops), F.col("seq"))
    latest = lambda c, ops: F.max_by(c, when(ops)).alias(c)
    state = log.groupBy("id").agg(
        latest("name", ["insert", "edit"]),
        latest("url", ["insert", "edit"]),
        latest("active", ["insert", "edit", "active"]),
        latest("last_seen_at", ["health"]),
        latest("last_error", ["health"]),
        F.max_by("op", "seq").alias("op"),
    )
    return state.filter("op <> 'delete'").drop("op")


def name_conflicts(cameras: DataFrame) -> DataFrame:
    return cameras.groupBy(F.lower("name").alias("name_key")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def cameras_to_start(cameras: DataFrame, running: DataFrame) -> DataFrame:
    return cameras.filter("active").join(running.select("id"), "id", "left_anti")


def queue_state(log: DataFrame) -> DataFrame:
    """Tasks after a log (seq, task_id, op, progress): enqueue, start, progress, done, fail, cancel.

    A cancel counts only while the task is pending; progress is kept within 0 and 100.
    """
    first_start = F.min(F.when(F.col("op") == "start", F.col("seq")))
    first_cancel = F.min(F.when(F.col("op") == "cancel", F.col("seq")))
    end = F.max_by("op", F.when(F.col("op").isin("done", "fail"), F.col("seq")))
    reached = F.max_by("progress", F.when(F.col("op") == "progress", F.col("seq")))
    tasks = log.groupBy("task_id").agg(
        first_start.alias("started"), first_cancel.alias("canceled"), end.alias("ended"), reached.alias("progress")
    )
    is_canceled = F.col("canceled").isNotNull() & (F.col("started").isNull() | (F.col("canceled") < F.col("started")))
    status = (
        F.when(is_canceled, "CANCELED")
        .when(F.col("ended") == "done", "DONE")
        .when(F.col("ended") == "fail", "FAILED")
        .when(F.col("started").isNotNull(), "RUNNING")
        .otherwise("PENDING")
    )
    progress = F.when(is_canceled, 0).when(F.col("ended") == "done", 100).otherwise(clamp(F.coalesce("progress", F.lit(0)), 0, 100))
    return tasks.select("task_id", status.alias("status"), progress.cast("int").alias("progress"))


def unfinished(tasks: DataFrame) -> DataFrame:
    return tasks.filter(~F.col("status").isin("DONE", "FAILED", "CANCELED"))


def processed(tasks: DataFrame, work: Callable[[int], None]) -> DataFrame:
    """A queue log (task_id, op, progress, error) of running `work` for each unfinished task, in Spark tasks.

    A task starts, then is done, or fails with its error cut to 1000 characters; one failure stops no other task.
    The work is done once, here: the log is stored, and reading it again runs nothing. (A Spark task that is lost midway
    is run again with the tasks it held, so work must bear being repeated after a crash.)
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for task in pdf["task_id"].tolist():
                rows.append((task, "start", 0, None))
                try:
                    work(task)
                    rows.append((task, "done", 100, None))
                except Exception as e:
                    rows.append((task, "fail", 0, str(e)))
            yield pd.DataFrame(rows, columns=["task_id", "op", "progress", "error"])

    log = unfinished(tasks).select(F.col("task_id").cast("long").alias("task_id"))
    done = log.mapInPandas(run, "task_id long, op string, progress int, error string")
    return written(done.withColumn("error", error_text(F.col("error"))), "queue-log")


def notify(log: DataFrame, listener: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs `listener` on each batch of a streamed queue log; started, to be awaited by the caller."""
    return log.writeStream.foreachBatch(listener).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def glob_pattern(patterns: list[str]) -> str:
    """Glob patterns as one regular expression over a full path or a file name."""
    import re

    parts = []
    for p in patterns:
        out = ""
        for bit in re.split(r"(\*\*/|\*\*|\*|\?)", p):
            out += {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(bit, re.escape(bit))
        parts.append(out)
    return "^(?:" + "|".join(parts) + ")$"


def matching_files(files: DataFrame, patterns: list[str]) -> DataFrame:
    rx = glob_pattern(patterns)
    return files.filter(F.col("path").rlike(rx) | file_name(F.col("path")).rlike(rx))


def new_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to ingest (ord, path, sha256): contents not in the manifest, the first walked of each."""
    hashed = files.withColumn("sha256", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit("").cast("binary")), 256))
    first = hashed.groupBy("sha256").agg(F.min(F.struct("ord", "path")).alias("f"))
    return first.join(manifest.select("sha256"), "sha256", "left_anti").select("f.ord", "f.path", "sha256")


def manifest_line(sha256: Column, path: Column, duration_ms: Column) -> Column:
    return F.concat(sha256, F.lit(" "), path, F.lit(" duration="), duration_ms.cast("string"), F.lit("ms"))


def known_lines(spark: SparkSession, manifest: str) -> DataFrame:
    """What a text manifest holds (sha256, path, duration_ms); nothing where there is none yet."""
    files, root = opened(manifest)
    lines = spark.createDataFrame([], "value string") if files.get_file_info(root).type == arrow_fs.FileType.NotFound else spark.read.text(manifest)
    return manifest_lines(lines)


def append_manifest(files: DataFrame, duration_ms: Column, manifest: str) -> None:
    """Appends a line for each file (sha256, path) whose hash is not there yet: a call that is repeated adds nothing.

    A call adds one file of lines, or one for each million; all of them when the write is committed.
    """
    spark = files.sparkSession
    fresh = files.join(known_lines(spark, manifest).select("sha256"), "sha256", "left_anti")
    lines = written(fresh.select("sha256", manifest_line(F.col("sha256"), F.col("path"), duration_ms).alias("line")), "lines")
    many = lines.count()
    part = F.pmod(F.xxhash64("sha256"), F.lit(many // 1_000_000 + 1))
    name = F.format_string(f"part-{uuid.uuid4().hex}-%d.txt", part)
    if many:
        write_files(lines.select(name.alias("name"), F.concat("line", F.lit("\n")).alias("content"), "sha256"), manifest, "sha256")


def ingest(files: DataFrame, duration_ms: Column, manifest: str, inbox: str) -> DataFrame:
    """Copies the files (ord, path, content) whose content the manifest does not know to the inbox, then adds their lines; gives them.

    duration_ms is a column over (ord, path, sha256). Where it stops after copying, the next call copies once more: lines come last.
    """
    new = written(new_files(files, known_lines(files.sparkSession, manifest)), "new-files")
    copy_files(new.select(file_name(F.col("path")).alias("name"), F.col("path").alias("source"), "ord"), inbox, "ord")
    append_manifest(new, duration_ms, manifest)
    return new


def inbox_collisions(files: DataFrame) -> DataFrame:
    """File names that several ingested files share: the last copied stays in the inbox."""
    named = files.withColumn("file_name", file_name(F.col("path")))
    return named.groupBy("file_name").agg(F.count(F.lit(1)).alias("n"), F.max_by("path", "ord").alias("stays")).filter("n > 1")
