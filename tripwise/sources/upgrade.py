"""Versions of the stored tables' schema, and the steps that bring a store of any of them to the last.

    upgrade(Store(spark, folder, tables_of(LAST)))

The ledger is the store's own log: each step is one commit of the writer `schema` under its number, so a step is done
once, by whoever comes first, and one that stops midway leaves nothing. Steps that only add a column or a table
rewrite no file: files of older versions are read with the newest schema, a column they lack is null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.maintenance import name_conflicts
from ..schemas import CAMERAS
from ..scratch import written
from .store import TABLES, Store, Table, Version

LEDGER = "schema"
ALL = {**TABLES, "cameras": Table(CAMERAS, "id")}
#: The version that a table or column came with; all others are of the first.
SINCE = {("cameras", None): 4, ("cameras", "last_seen_at"): 5, ("cameras", "last_error"): 5, ("events", "plate"): 6}
LAST = 6


def tables_of(number: int) -> dict[str, Table]:
    """The tables as a version of the schema had them."""
    there = lambda *of: SINCE.get(of, 1) <= number
    return {
        name: Table(T.StructType([f for f in kind.schema.fields if there(name, f.name)]), kind.key, kind.buckets)
        for name, kind in ALL.items()
        if there(name, None)
    }


def schema_version(store: Store) -> int:
    """The last step the store has been through; 1 where it keeps no ledger yet."""
    return store.version().writers.get(LEDGER, 1)


def double_detections(detections: DataFrame) -> DataFrame:
    """Ids (id) of the detections that share (video_id, merge_ms) with a newer one; at equal times the larger id is newer."""
    newest = detections.groupBy("video_id", "merge_ms").agg(F.max(F.struct("created_at", "id")).alias("top"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    of = newest.select(F.col("video_id").alias("v"), F.col("merge_ms").alias("m"), F.col("top.id").alias("stays"))
    same = (F.col("video_id") == F.col("v")) & (F.col("merge_ms") == F.col("m"))
    return detections.join(of, same).filter("id <> stays").select("id")


def drop_doubles(store: Store, now: Version) -> dict:
    """Of detections with one (video_id, merge_ms) the newest stays; the others go with their events."""
    gone = written(double_detections(store.read("detections", now)), "doubles")
    events = gone.withColumnRenamed("id", "detection_id")
    return {
        "detections": store.rewritten("detections", gone, lambda rows: rows.join(gone, "id", "left_anti"), now),
        "events": store.rewritten("events", events, lambda rows: rows.join(events, "detection_id", "left_anti"), now),
    }


def demand_unique(store: Store, now: Version) -> dict:
    """A store with doubles is refused: they came after the step that drops them."""
    if not double_detections(store.read("detections", now)).isEmpty():
        raise ValueError("detections that share (video_id, merge_ms)")
    return {}


def demand_names(store: Store, now: Version) -> dict:
    """Camera names are unique whatever their case."""
    if not name_conflicts(store.read("cameras", now)).isEmpty():
        raise ValueError("cameras that share a name")
    return {}


def nothing(store: Store, now: Version) -> dict:
    return {}


#: What each version asks of a store of the one before. Versions 5 and 6 add columns, which older files' rows have as null.
STEPS: dict[int, Callable[[Store, Version], dict]] = {2: drop_doubles, 3: demand_unique, 4: demand_names, 5: nothing, 6: nothing}


def upgrade(store: Store, to: int = LAST) -> list[int]:
    """Takes the steps that the store lacks, in order; gives those that were taken here."""
    taken = []
    for number in range(2, to + 1):
        if store.change(LEDGER, number, lambda now, step=STEPS[number]: step(store, now)):
            taken.append(number)
    return taken
