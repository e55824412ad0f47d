"""The queue with many tasks: claims against a plain Python version, few batches of results, no Python state."""

import json
import random

import pyarrow as pa

from tripwise.streaming import queue

REQUEST = "seq long, task_id long, op string"


def test_claims_over_runs_as_in_plain_python(spark, tmp_path):
    draw, settled, seq = random.Random(4), {}, 0
    for _ in range(3):
        batch = []
        for _ in range(400):
            seq += draw.random() < 0.8  # some seqs are shared
            batch.append((seq, draw.randrange(-40, 160), draw.choice(["enqueue", "cancel", "other"])))
        for task in {t for _, t, _ in batch}:
            asked = sorted((n, op) for n, t, op in batch if t == task and op != "other")
            start = next((i for i, (_, op) in enumerate(asked) if op == "enqueue"), None)
            if start is not None:
                settled.setdefault(task, "CANCELED" if any(op == "cancel" for _, op in asked[start:]) else "DONE")
        draw.shuffle(batch)
        spark.createDataFrame(batch, REQUEST).repartition(5).write.mode("append").parquet(str(tmp_path / "asked"))
        found = queue.work_off(spark.readStream.schema(REQUEST).parquet(str(tmp_path / "asked")), lambda task: None, str(tmp_path / "at"))
        rows = found.collect()
        assert len(rows) == len(settled) and {r.task_id: r.status for r in rows} == settled
    assert set(settled.values()) == {"CANCELED", "DONE"}
    # No folder holds all results.
    kept = [p for p in (tmp_path / "at" / "results").rglob("*") if p.is_file()]
    assert len(kept) == sum(x == "DONE" for x in settled.values())
    assert len({p.parent for p in kept}) > len(kept) // 2


def test_state_is_asked_in_the_jvm(spark, tmp_path):
    """Each task took several calls between Spark and Python, and a frame of its own."""
    (tmp_path / "asked").mkdir()
    asked = spark.readStream.schema(REQUEST).parquet(str(tmp_path / "asked"))
    plan = queue.marked(asked)._jdf.queryExecution().logical().toString()
    assert "Deduplicate" in plan and "TransformWithState" not in plan


def test_results_come_in_large_batches(tmp_path):
    tasks = pa.RecordBatch.from_pydict({"task_id": pa.array(range(2000), pa.int64())})

    def work(task):
        if task >= 1000:
            raise ValueError("x" * 10_000)

    for _ in range(2):  # worked on, then read
        found = list(queue.results(iter([tasks, tasks.slice(0, 0)]), work, str(tmp_path / "results")))
        assert [b.num_rows for b in found][:2] == [1387, 397] and sum(b.num_rows for b in found) == 2000
        rows = pa.Table.from_batches(found).to_pylist()
        assert [r["task_id"] for r in rows] == list(range(2000))
        assert {(r["status"], r["progress"], r["error"]) for r in rows} == {("DONE", 100, None), ("FAILED", 0, "x" * 10_000)}
        work = None  # a call would fail otherwise
    assert json.loads((tmp_path / "results" / "7" / "1007.json").read_bytes())[:3] == [1007, "FAILED", 0]
