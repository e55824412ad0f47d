import threading

import pytest
from pyspark.sql import functions as F

from tripwise.sources import store

REQUEST = "request_id long, video_id long, merge_ms int, stamps array<long>, plates array<string>, created_at timestamp"


def asked(spark, rows):
    return spark.createDataFrame([(i, v, m, t, p) for i, v, m, t, p in rows], REQUEST.rsplit(",", 1)[0]).withColumn("created_at", F.expr("timestamp'2024-01-01 00:00:00'"))


def state(held):
    detections = sorted((r.video_id, r.merge_ms, r.events_count, r.id) for r in held.read("detections").collect())
    events = sorted((r.detection_id, r.t_ms, r.plate or "") for r in held.read("events").collect())
    return detections, events


def whole(held):
    """No orphan event, no detection without its events, no double (video, merge time)."""
    detections, events = state(held)
    assert len({d[:2] for d in detections}) == len(detections) == len({d[3] for d in detections})
    for d in detections:
        assert sum(e[0] == d[3] for e in events) == d[2]
    assert {e[0] for e in events} <= {d[3] for d in detections}
    return len(detections)


def test_one_commit_for_two_tables(spark, tmp_path, monkeypatch):
    held = store.Store(spark, str(tmp_path / "s"))
    first = asked(spark, [(1, 5, 1000, [10, 20], ["A", " "]), (2, 5, 1000, [30], None), (3, 6, 2000, None, None)])
    assert store.insert_detections(held, first, "a", 0) and whole(held) == 2
    assert not store.insert_detections(held, first, "a", 0) and whole(held) == 2  # the same batch again
    before = state(held)

    written = held.write

    def stops(name, rows):
        if name == "events":
            raise RuntimeError("lost")
        return written(name, rows)

    more = asked(spark, [(1, 7, 1000, [40], None), (2, 5, 1000, [50], None)])
    monkeypatch.setattr(held, "write", stops)
    with pytest.raises(RuntimeError):
        store.insert_detections(held, more, "a", 1)
    assert state(held) == before  # detections were written, nothing is seen of them
    monkeypatch.undo()
    monkeypatch.setattr(held, "_commit", lambda after: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.insert_detections(held, more, "a", 1)
    assert state(held) == before
    monkeypatch.undo()
    assert store.insert_detections(held, more, "a", 1) and whole(held) == 3


def test_writers_at_once(spark, tmp_path):
    """Both ask for the same detection and one each of their own; each commit is on top of the other's."""
    store.Store(spark, str(tmp_path / "s"))
    failed = []

    def run(name, video):
        try:
            held = store.Store(spark, str(tmp_path / "s"))
            for batch in range(2):
                store.insert_detections(held, asked(spark, [(1, 1, 1000, [1], None), (2, video, batch, [2, 3], ["P"])]), name, batch)
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(n, v)) for n, v in (("a", 10), ("b", 20))]
    [t.start() for t in threads]
    [t.join() for t in threads]
    held = store.Store(spark, str(tmp_path / "s"))
    assert not failed and held.version().number == 4 and whole(held) == 5
    with pytest.raises(store.Conflict):
        held._commit(store.Version(4))


def test_changes_rewrite_only_what_they_touch(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    rows = asked(spark, [(i, i, 1000, [10 * i, 10 * i + 1], None) for i in range(1, 201)])
    store.insert_detections(held, rows, "a", 0)
    old = held.version()
    ids = [r.id for r in held.read("detections").filter("video_id IN (3, 4)").collect()]
    gone = spark.createDataFrame([(i,) for i in [*ids, ids[0], 10**6]], "id int")
    store.delete_detections(held, gone, "a", 1)
    new = held.version()
    assert whole(held) == 198 and held.read("detections", old).count() == 200  # the old version can still be read
    for name in ("detections", "events"):
        changed = [b for b in old.tables[name] if old.tables[name][b] != new.tables[name][b]]
        assert 1 <= len(changed) <= 2 and len(old.tables[name]) == 16
    unchanged = old.tables["detections"]
    store.delete_detections(held, spark.createDataFrame([], "id int"), "a", 2)
    assert held.version().tables["detections"] == new.tables["detections"] != unchanged


def test_upserts_keep_ids_and_deletes_cascade(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "s"))
    video = lambda rows: spark.createDataFrame(rows, "path string, fps double, frames long, day string").select("path", "fps", "frames", F.to_timestamp("day").alias("created_at"))
    store.upsert_videos(held, video([(f"/v{i:02}", 25.0, 100, "2024-01-01") for i in range(50)]), "a", 0)
    before = held.version()
    store.upsert_videos(held, video([("/v07", 30.0, 7, "2024-01-02"), ("/v07", 31.0, 8, "2024-01-03"), ("/x", 5.0, 1, "2024-01-02")]), "a", 1)
    rows = {r.path: r for r in held.read("videos").collect()}
    assert len(rows) == 51 and {r.id for r in rows.values()} == set(range(1, 52))
    assert (rows["/v07"].id, rows["/v07"].fps, rows["/v07"].frames, rows["/v07"].created_at.day) == (8, 31.0, 8, 1) and rows["/x"].id == 51
    after = held.version()
    assert sum(before.tables["videos"].get(b) != f for b, f in after.tables["videos"].items()) <= 2
    store.insert_detections(held, asked(spark, [(1, 8, 1000, [1, 2], None), (2, 9, 1000, [3], None)]), "a", 2)
    store.delete_videos(held, spark.createDataFrame([(8,)], "id int"), "a", 3)
    assert held.read("videos").filter("id = 8").count() == 0 and [d[0] for d in state(held)[0]] == [9] and whole(held) == 1
