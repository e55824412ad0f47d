import threading

import pytest
from pyspark.sql import functions as F

from tripwise.sources import store, upgrade

AT = "timestamp'2024-01-0{} 00:00:00'"


def filled(spark, root, number, detections=(), events=(), cameras=()):
    """A store as that version left it. Events are (detection, time), plates come with version 6."""
    held = store.Store(spark, root, upgrade.tables_of(number))
    rows = {
        "detections": spark.createDataFrame(list(detections), "id int, video_id int, merge_ms int, day int").select(
            "id", "video_id", "merge_ms", F.lit(1).alias("events_count"), F.expr("make_timestamp(2024, 1, day, 0, 0, 0)").alias("created_at")
        ),
        "events": spark.createDataFrame(list(events), "detection_id int, t_ms long").withColumn("plate", F.lit("A1")),
    }
    if number >= 4:
        named = spark.createDataFrame(list(cameras), "id int, name string").withColumns({"url": F.lit("u"), "active": F.lit(True), "created_at": F.expr(AT.format(1))})
        rows["cameras"] = named.withColumns({"last_seen_at": F.expr(AT.format(2)), "last_error": F.lit("e")})
    held.change("load", 0, lambda now: {name: held.appended(name, part, now) for name, part in rows.items()})
    if number > 1:
        held.change(upgrade.LEDGER, number, lambda now: {})
    return held


def state(held):
    got = sorted(r.id for r in held.read("detections").collect())
    return got, sorted((r.detection_id, r.t_ms, r.plate) for r in held.read("events").collect())


DOUBLE = [(1, 5, 1000, 1), (2, 5, 1000, 3), (3, 5, 1000, 3), (4, 5, 2000, 1), (5, 6, 1000, 1)]
EVENTS = [(i, i * 10) for i in (1, 2, 3, 4, 5)]


def test_the_first_version_becomes_the_last(spark, tmp_path):
    old = filled(spark, str(tmp_path / "s"), 1, DOUBLE, EVENTS)
    assert set(old.read("events").columns) == {"detection_id", "t_ms"} and "cameras" not in old.kinds
    held = store.Store(spark, old.root, upgrade.tables_of(6))
    assert upgrade.schema_version(held) == 1
    before = held.version()
    assert upgrade.upgrade(held) == [2, 3, 4, 5, 6] and upgrade.schema_version(held) == 6
    assert state(held) == ([3, 4, 5], [(3, 30, None), (4, 40, None), (5, 50, None)])
    assert held.read("cameras").count() == 0 and "last_error" in held.read("cameras").columns
    assert len(held.read("detections", before).collect()) == 5  # the old version can still be read
    assert upgrade.upgrade(held) == [] and state(held)[0] == [3, 4, 5]
    number = held.version().number
    # Inserting goes on as in any store, plates included.
    asked = spark.createDataFrame([(1, 9, 1, [70], ["B2"])], "request_id long, video_id long, merge_ms int, stamps array<long>, plates array<string>")
    store.insert_detections(held, asked.withColumn("created_at", F.expr(AT.format(4))), "app", 0)
    assert held.version().number == number + 1 and (6, 70, "B2") in state(held)[1]


def test_only_buckets_with_doubles_are_rewritten(spark, tmp_path):
    old = filled(spark, str(tmp_path / "s"), 1, DOUBLE + [(i, i, 7, 1) for i in range(10, 80)], EVENTS)
    held = store.Store(spark, old.root, upgrade.tables_of(6))
    before = held.version().tables
    upgrade.upgrade(held, to=2)
    after = held.version().tables
    changed = {b for b in before["detections"] if before["detections"][b] != after["detections"][b]}
    hit = {r[0] for r in spark.createDataFrame([(1,), (2,)], "id int").select(held.bucket("detections", "id")).collect()}
    assert changed == hit and len(before["detections"]) > len(hit)
    upgrade.upgrade(held)
    assert held.version().tables == after  # no other step writes


def test_later_versions(spark, tmp_path):
    three = filled(spark, str(tmp_path / "3"), 3, DOUBLE[2:], EVENTS[2:])
    held = store.Store(spark, three.root, upgrade.tables_of(6))
    assert upgrade.upgrade(held) == [4, 5, 6] and state(held)[0] == [3, 4, 5]
    five = filled(spark, str(tmp_path / "5"), 5, DOUBLE[2:], EVENTS[2:], [(1, "a")])
    held = store.Store(spark, five.root, upgrade.tables_of(6))
    assert upgrade.upgrade(held) == [6] and {e[2] for e in state(held)[1]} == {None}
    assert [(r.name, r.last_error) for r in held.read("cameras").collect()] == [("a", "e")]
    four = filled(spark, str(tmp_path / "4"), 4, (), (), [(1, "a")])
    held = store.Store(spark, four.root, upgrade.tables_of(6))
    assert upgrade.upgrade(held) == [5, 6] and held.read("cameras").first().last_seen_at is None and state(held) == ([], [])


def test_stores_that_break_a_rule_are_refused(spark, tmp_path):
    held = store.Store(spark, filled(spark, str(tmp_path / "2"), 2, DOUBLE, EVENTS).root, upgrade.tables_of(6))
    with pytest.raises(ValueError, match="share"):
        upgrade.upgrade(held)
    assert upgrade.schema_version(held) == 2 and len(state(held)[0]) == 5
    named = store.Store(spark, filled(spark, str(tmp_path / "4"), 4, (), (), [(1, "Cam"), (2, "cAM")]).root, upgrade.tables_of(6))
    named.change(upgrade.LEDGER, 3, lambda now: {})
    with pytest.raises(ValueError, match="name"):
        upgrade.demand_names(named, named.version())


def test_a_step_that_stops_and_two_at_once(spark, tmp_path, monkeypatch):
    held = store.Store(spark, filled(spark, str(tmp_path / "s"), 1, DOUBLE, EVENTS).root, upgrade.tables_of(6))
    written = held.write

    def stops(name, rows):
        if name == "events":
            raise RuntimeError("lost")
        return written(name, rows)

    monkeypatch.setattr(held, "write", stops)
    with pytest.raises(RuntimeError):
        upgrade.upgrade(held)
    assert upgrade.schema_version(held) == 1 and len(state(held)[0]) == len(state(held)[1]) == 5
    monkeypatch.undo()
    taken = []
    both = [threading.Thread(target=lambda: taken.extend(upgrade.upgrade(store.Store(spark, held.root, upgrade.tables_of(6))))) for _ in range(2)]
    [t.start() for t in both]
    [t.join() for t in both]
    assert sorted(taken) == [2, 3, 4, 5, 6] and state(held)[0] == [3, 4, 5]
