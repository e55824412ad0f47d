import collections
import os

import pytest

from tripwise.streaming import queue

REQUEST = "seq long, task_id long, op string"


@pytest.fixture
def bench(spark, tmp_path):
    """Requests put in a folder, worked off run by run; calls counts the times each task was begun."""
    asked, at, begun = tmp_path / "asked", tmp_path / "at", tmp_path / "begun"
    begun.mkdir()

    def work(task):
        (begun / f"{task}-{os.urandom(6).hex()}").touch()
        if task % 10 == 3:
            raise ValueError(f"{task} " + "x" * 2000)

    def run(*rows):
        if rows:
            spark.createDataFrame(rows, REQUEST).write.mode("append").parquet(str(asked))
        found = queue.work_off(spark.readStream.schema(REQUEST).parquet(str(asked)), work, str(at))
        return {r.task_id: r.status for r in found.collect()}, found

    run.work, run.at = work, at
    run.calls = lambda: collections.Counter(int(p.name.split("-")[0]) for p in begun.iterdir())
    return run


def test_tasks_are_worked_on_once(spark, bench):
    got, found = bench((1, 1, "enqueue"), (2, 2, "enqueue"), (3, 2, "cancel"), (4, 3, "enqueue"), (5, 4, "cancel"), (6, 1, "enqueue"))
    assert got == {1: "DONE", 2: "CANCELED", 3: "FAILED"}
    error = {r.task_id: (r.progress, r.error) for r in found.collect()}
    assert error[1] == (100, None) and error[2] == (0, None) and error[3][1].startswith("3 x") and len(error[3][1]) == 1000
    assert bench.calls() == {1: 1, 3: 1}
    # Later: a cancel of what is done and an enqueue of what is canceled change nothing; a cancel that came too early neither.
    got, _ = bench((7, 1, "cancel"), (8, 2, "enqueue"), (9, 3, "enqueue"), (10, 4, "enqueue"))
    assert got == {1: "DONE", 2: "CANCELED", 3: "FAILED", 4: "DONE"} and bench.calls() == {1: 1, 3: 1, 4: 1}
    assert bench()[0] == got and bench.calls() == {1: 1, 3: 1, 4: 1}


def test_a_batch_that_is_run_again(spark, bench):
    rows = [(t, "claim") for t in range(20, 30)] + [(40, "cancel")]
    batch = spark.createDataFrame(rows, queue.CLAIM)
    sink = queue.worked_to(str(bench.at), bench.work)
    for _ in range(2):
        sink(batch, 0)
        found = spark.read.parquet(str(bench.at / "out"))
        assert {r.task_id: r.status for r in found.collect()} == {t: "FAILED" if t == 23 else "DONE" for t in range(20, 30)} | {40: "CANCELED"}
    assert bench.calls() == dict.fromkeys(range(20, 30), 1)
    again = queue.worked(batch.filter("op = 'claim'"), bench.work, str(bench.at / "results"))
    assert again.count() == again.count() == 10 and bench.calls() == dict.fromkeys(range(20, 30), 1)


def test_a_task_lost_midway_begins_where_it_stopped(spark, bench, tmp_path):
    (bench.at / "results").mkdir(parents=True)
    results = str(bench.at / "results")
    stop, work = tmp_path / "stop", bench.work
    stop.touch()

    def lost(task):
        work(task)
        if task == 25 and stop.exists():
            raise KeyboardInterrupt  # as a killed worker: no result of this task

    claimed = spark.createDataFrame([(t, "claim") for t in range(20, 28)], queue.CLAIM).coalesce(1)
    with pytest.raises(Exception, match="KeyboardInterrupt|crashed|Interrupt"):
        queue.worked(claimed, lost, results).collect()
    assert bench.calls()[25] == 1 and bench.calls()[26] == 0
    stop.unlink()
    assert queue.worked(claimed, lost, results).count() == 8
    assert bench.calls() == dict.fromkeys(range(20, 28), 1) | {25: 2}
