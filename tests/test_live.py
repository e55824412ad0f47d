import datetime
import os
import random

from pyspark.sql import functions as F

from tripwise.operators import sequence
from tripwise.streaming import live
from tripwise.streaming import trips as streamed

SCHEMA = "detection_id long, ts timestamp, t_ms long, plate string"
START = datetime.datetime(2024, 1, 1)
MINUTE = 60_000


def streamed_in(spark, tmp_path, rows, files):
    """The rows as a stream that reads them in the order given, a file a batch; the last file moves the watermark past all."""
    folder = tmp_path / "in"
    folder.mkdir()
    per = -(-len(rows) // files)
    closing = (-1, datetime.datetime(2200, 1, 1), 7_258_118_400_000, None)
    parts = [rows[i : i + per] for i in range(0, len(rows), per)] + [[closing]]
    for n, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"w{n}"))
        (made,) = (tmp_path / f"w{n}").glob("*.parquet")
        made.rename(folder / f"{n:03}.parquet")
        os.utime(folder / f"{n:03}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled(seed, keys=4, n=160):
    """Events of each key, some minutes or hours apart, arriving up to half an hour out of order."""
    rng, rows = random.Random(seed), []
    for k in range(keys):
        t = 0
        for _ in range(n // keys):
            t += rng.choice([0, 1, 5, 9, 10, 11, 40, 200]) * MINUTE
            rows.append((k, START + datetime.timedelta(milliseconds=t), 1_704_067_200_000 + t, rng.choice([None, " ", "A", "A", "B"])))
    rows.sort(key=lambda r: r[2] + rng.randrange(30) * MINUTE)
    return rows


def test_live_trips_equal_the_batch_in_any_order(spark, tmp_path):
    rows = shuffled(4)
    stream = streamed_in(spark, tmp_path, rows, 9)
    got = streamed.stateful_to_end(live.live_trips(stream, 10 * MINUTE), str(tmp_path / "at"))
    want = sequence.trips(spark.createDataFrame(rows, SCHEMA).select("detection_id", "t_ms", "plate"), "detection_id", 10 * MINUTE)
    assert got.columns == want.columns and got.count() > 30
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    late = [p for p in (tmp_path / "at" / "out").glob("epoch=*")]
    assert sum(spark.read.parquet(str(p)).count() > 0 for p in late) > 2  # trips come as they close, not all at the end


def plain_retries(times, timeout, waits):
    out, failed, last = [], 0, None
    for t in [*sorted(times), None]:
        if last is not None:
            at, failed = last + timeout, 0
            while failed <= 3 and (t is None or at < t):
                failed += 1
                out.append((at, "STOPPED" if failed > 3 else "ERROR", failed, 0 if failed > 3 else waits[failed - 1], last))
                at += 0 if failed > 3 else waits[failed - 1]
            if failed and t is not None:
                out.append((t, "OK", 0, 0, t))
        last = t
    return sorted(out)


def test_cameras_back_off_and_stop(spark, tmp_path):
    rows = shuffled(8)
    beats = streamed_in(spark, tmp_path, rows, 9).withColumnRenamed("detection_id", "camera_id").drop("plate")
    got = streamed.stateful_to_end(live.camera_retries(beats, 8 * MINUTE, wait_ms=MINUTE, max_wait_ms=4 * MINUTE), str(tmp_path / "at")).collect()
    kinds = set()
    for k in range(4):
        want = plain_retries([r[2] for r in rows if r[0] == k], 8 * MINUTE, [MINUTE, 2 * MINUTE, 4 * MINUTE])
        assert sorted((r.at_ms, r.state, r.retries, r.wait_ms, r.last_seen_ms) for r in got if r.camera_id == k) == want
        kinds |= {(w[1], w[2]) for w in want}
    assert kinds == {("OK", 0), ("ERROR", 1), ("ERROR", 2), ("ERROR", 3), ("STOPPED", 4)}
    assert live.Retries(1).waits == [500, 1000, 2000]
