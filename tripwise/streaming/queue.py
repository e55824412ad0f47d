"""A work queue as a stream: requests come in, each task is claimed once, worked on once, and its result kept by its id.

A request is (seq, task_id, op), op `enqueue` or `cancel`. The claim is state: what is pending at the end of a batch is
claimed by it, and a task that was claimed or canceled stays so. A cancel counts only while its task is pending.
So a task is settled by the first batch that enqueues it: the state is Spark's own, of ids that were enqueued, and what
becomes of a new one is an aggregate of that batch.
Results are files named by the task, dealt over folders. Work whose result is there is not done again, whether a batch is run again, its
rows are asked for twice, or a lost Spark task is repeated; only the task that was in work then is begun anew.
(Speculative attempts could work on one task at the same time: leave `spark.speculation` off for a queue.)
"""

from __future__ import annotations

import functools
import json
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import error_text
from ..scratch import remove
from ..sources.files import opened
from . import trips as streamed

CLAIM = "task_id long, op string"
RESULT = "task_id long, status string, progress int, error string"
ARROW = pa.schema([("task_id", pa.int64()), ("status", pa.string()), ("progress", pa.int32()), ("error", pa.string())])
#: Folders that results are dealt over, by the task's remainder.
FOLDERS = 1000


def marked(requests: DataFrame) -> DataFrame:
    """A stream of requests as it is, and with it a row marked `new` for each task that is enqueued for the first time ever."""
    first = requests.filter("op = 'enqueue'").select("task_id").dropDuplicates(["task_id"])
    blank = [F.lit(None).cast(requests.schema[c].dataType).alias(c) for c in ("seq", "op")]
    return requests.select("task_id", "seq", "op", F.lit(False).alias("new")).unionByName(first.select("task_id", *blank, F.lit(True).alias("new")))


def claims(batch: DataFrame) -> DataFrame:
    """Rows (task_id, op) of a marked batch, one for each new task: `cancel` if one comes after its first enqueue, else `claim`."""
    seq = lambda op: F.when(F.col("op") == op, F.col("seq"))
    found = batch.groupBy("task_id").agg(F.max("new").alias("new"), F.min(seq("enqueue")).alias("asked"), F.max(seq("cancel")).alias("canceled"))
    return found.filter("new").select("task_id", F.when(F.col("canceled") > F.col("asked"), "cancel").otherwise("claim").alias("op"))


def result_of(task: int, work: Callable[[int], None], folder: str) -> tuple[int, str, int, str | None]:
    """The stored result of a task; where there is none the work is done and what comes of it stored."""
    files, root = opened(folder)
    dealt = posixpath.join(root, str(task % FOLDERS))
    path = posixpath.join(dealt, f"{task}.json")
    if files.get_file_info(path).type == arrow_fs.FileType.File:
        with files.open_input_stream(path) as f:
            return tuple(json.loads(f.read()))
    try:
        work(task)
        found = (task, "DONE", 100, None)
    except Exception as e:
        found = (task, "FAILED", 0, str(e))
    draft = posixpath.join(dealt, f".{task}-{uuid.uuid4().hex}")
    try:
        out = files.open_output_stream(draft)
    except FileNotFoundError:  # the first of its folder
        files.create_dir(dealt, recursive=True)
        out = files.open_output_stream(draft)
    with out:
        out.write(json.dumps(found).encode())
    files.move(draft, path)
    return found


def results(batches: Iterator[pa.RecordBatch], work: Callable[[int], None], folder: str) -> Iterator[pa.RecordBatch]:
    """Results of batches of tasks; one for each, more where their errors pass 4 MB."""
    for b in batches:
        rows, held = [], 0
        # One by one: a result is stored before the next task begins.
        for n, task in enumerate(tasks := b.column("task_id").to_pylist(), 1):
            rows.append(result_of(task, work, folder))
            held += 100 + len(rows[-1][3] or "")
            if held > 4_000_000 or n == len(tasks):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                rows, held = [], 0


def worked(claimed: DataFrame, work: Callable[[int], None], folder: str) -> DataFrame:
    """Results (task_id, status, progress, error cut to 1000 characters) of claimed tasks, in Spark tasks; one failure stops no other."""
    run = functools.partial(results, work=work, folder=folder)
    return claimed.select("task_id").mapInArrow(run, RESULT).withColumn("error", error_text(F.col("error")))


def worked_to(at: str, work: Callable[[int], None]) -> Callable[[DataFrame, int], None]:
    """A sink that works on a batch's claims and writes their results, and the canceled tasks, to the folder of the batch."""

    def sink(batch: DataFrame, epoch: int) -> None:
        files, root = opened(f"{at}/results")
        files.create_dir(root, recursive=True)
        canceled = F.lit("CANCELED").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error")
        kept = f"{at}/claims/epoch={epoch}"
        batch.write.mode("overwrite").parquet(kept)  # the state is asked once
        settled = batch.sparkSession.read.schema(CLAIM).parquet(kept)
        claimed = settled.filter("op = 'claim'")
        # Files say nothing of the work in them: it is dealt evenly.
        tasks = min(claimed.count(), int(batch.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        done = worked(claimed.repartition(max(1, tasks)), work, f"{at}/results")
        done.unionByName(settled.filter("op = 'cancel'").select("task_id", *canceled)).write.mode("overwrite").parquet(f"{at}/out/epoch={epoch}")
        remove(batch.sparkSession, kept)

    return sink


def work_off(requests: DataFrame, work: Callable[[int], None], at: str) -> DataFrame:
    """Runs a stream of requests to its end, going on from the checkpoint below `at`; gives the results of all runs so far."""
    sink = worked_to(at, work)
    return streamed.stateful_to_end(marked(requests), at, lambda batch, epoch: sink(claims(batch), epoch))
