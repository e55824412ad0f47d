"""Ordered-sequence operators: anchored suppression and merging, gap trips, votes, throttling.

Anchored operators compare with the last kept event, trips with the previous one. Folds run
as higher-order functions over a key's sorted events, one shuffle by the key; keys too long for
that are cut into stretches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import blank
from . import stretches
from .folds import bound, stepped

EVENT = "array<struct<t_ms:bigint,plate:string>>"


def sorted_events(events: DataFrame, key: str, order: list[str] | None = None) -> DataFrame:
    """One row per key with `events`, its (t_ms, plate) in time order (ties: by `order`)."""
    cols = ["t_ms", *(order or []), "plate"]
    packed = F.array_sort(F.collect_list(F.struct(*cols)))
    return events.groupBy(key).agg(
        F.transform(packed, lambda e: F.struct(e["t_ms"].alias("t_ms"), e["plate"].alias("plate"))).alias("events")
    )


def suppressed(events: Column, window_ms: int) -> Column:
    """Events kept: the first, then each that comes more than window_ms after the last kept one."""

    def step(last: Column, e: Column) -> Column:
        keep = last.isNull() | (e["t_ms"] - last > window_ms)
        return F.struct(
            F.when(keep, e["t_ms"]).otherwise(last).alias("state"), F.when(keep, F.array(e)).otherwise(F.expr(f"cast(array() as {EVENT})")).alias("emitted")
        )

    return stepped(events, F.lit(None).cast("bigint"), step, EVENT)["out"]


def merged(events: Column, merge_ms: int) -> Column:
    """Events more than merge_ms after the last kept one; a blank head takes the first plate of its group.

    The open group's head is the state; it is put out once the next group begins.
    """
    none = F.expr(f"cast(array() as {EVENT})")
    head = "struct<t_ms:bigint,plate:string>"

    def step(held: Column, e: Column) -> Column:
        opens = held.isNull() | (e["t_ms"] - held["t_ms"] > merge_ms)
        filled = F.struct(held["t_ms"].alias("t_ms"), F.when(blank(held["plate"]) & ~blank(e["plate"]), e["plate"]).otherwise(held["plate"]).alias("plate"))
        return F.struct(
            F.when(opens, e.cast(head)).otherwise(filled.cast(head)).alias("state"),
            F.when(opens & held.isNotNull(), F.array(held)).otherwise(none).alias("emitted"),
        )

    folded = stepped(events, F.lit(None).cast(head), step, EVENT)
    return bound(folded, lambda fold: F.concat(fold["out"], F.filter(F.array(fold["state"]), lambda h: h.isNotNull())))


def exploded(keyed: DataFrame, key: str) -> DataFrame:
    return keyed.select(key, F.explode("events").alias("e")).select(key, "e.t_ms", "e.plate")


#: Keys with more events than this are worked in stretches instead of one list; the rows are the same.
LISTED = 100_000


def by_size(events: DataFrame, key: str, listed, cut) -> DataFrame:
    """listed(events) of the keys that fit a list, and cut(events) of longer ones, if there are any."""
    long = events.groupBy(F.col(key).alias("__long")).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > LISTED).select("__long")
    if long.isEmpty():
        return listed(events)
    long = stretches.written(long, "long-keys")
    same = F.col(key).eqNullSafe(F.col("__long"))
    return listed(events.join(long, same, "left_anti")).unionByName(cut(events.join(long, same, "left_semi")))


def suppress(events: DataFrame, key: str, window_ms: int) -> DataFrame:
    """(key, t_ms, plate): of each key the first event, then each that comes more than window_ms after the last kept one."""
    rows = events.select(key, "t_ms", "plate")

    def listed(part: DataFrame) -> DataFrame:
        return exploded(sorted_events(part, key).withColumn("events", suppressed(F.col("events"), window_ms)), key)

    return by_size(rows, key, listed, lambda part: stretches.anchored(part, key, window_ms, ["plate"]).filter("keep").select(key, "t_ms", "plate"))


def merge(events: DataFrame, key: str, window_ms: int, merge_ms: int) -> DataFrame:
    """(key, t_ms, plate): suppressed events, those up to merge_ms after the last head merged into it; see `merged`."""
    rows = events.select(key, "t_ms", "plate")

    def listed(part: DataFrame) -> DataFrame:
        kept = merged(suppressed(F.col("events"), window_ms), merge_ms)
        return exploded(sorted_events(part, key).withColumn("events", kept), key)

    def cut(part: DataFrame) -> DataFrame:
        kept = stretches.anchored(part, key, window_ms, ["plate"]).filter("keep").select(key, "t_ms", "plate")
        groups = stretches.anchored(kept, key, merge_ms, ["plate"]).groupBy(key, "head")
        named = F.min_by("plate", F.when(~blank(F.col("plate")), F.col("idx")))
        heads = groups.agg(F.min("t_ms").alias("t_ms"), F.coalesce(named, F.min_by("plate", "idx")).alias("plate"))
        return heads.select(key, "t_ms", "plate")

    return by_size(rows, key, listed, cut)


def with_trips(events: DataFrame, key: str, gap_ms: int, order: list[str] | None = None) -> DataFrame:
    """Adds trip (from 0) and idx (from 0): a trip ends where the next event comes more than gap_ms later."""
    w = Window.partitionBy(key).orderBy("t_ms", *(order or []))
    new = (F.col("t_ms") - F.lag("t_ms").over(w) > gap_ms).cast("int")
    return (
        events.withColumn("idx", (F.row_number().over(w) - 1).cast("int"))
        .withColumn("new", F.coalesce(new, F.lit(0)))
        .withColumn("trip", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
        .drop("new")
    )


def counted(marked: DataFrame, key: str) -> DataFrame:
    """One row per (key, trip, plate, blank plates as null): its votes and what the trip's sums need."""
    plate = F.when(~blank(F.col("plate")), F.col("plate"))
    return marked.groupBy(key, "trip", plate.alias("plate")).agg(
        F.count(F.lit(1)).alias("n"), *[f("idx").alias(f"{f.__name__}_idx") for f in (F.min, F.max)], *[f("t_ms").alias(f"{f.__name__}_ms") for f in (F.min, F.max)]
    )


def winner() -> Column:
    """The (votes, plate) of the plate most named, at least twice; ties go to the smallest plate."""
    ballot = F.struct((-F.col("n")).alias("n"), "plate")
    return F.min(F.when(F.col("plate").isNotNull() & (F.col("n") >= 2), ballot))


def votes(events: DataFrame, key: str) -> DataFrame:
    """(key, trip, plate, votes): the winner of each trip that has one."""
    best = counted(events, key).groupBy(key, "trip").agg(winner().alias("w"))
    return best.filter("w IS NOT NULL").select(key, "trip", "w.plate", (-F.col("w.n")).alias("votes"))


def trips(events: DataFrame, key: str, gap_ms: int = 60_000, with_plates: bool = True, order: list[str] | None = None) -> DataFrame:
    """Trips of each key: plate, from_index, to_index, t_start_ms, t_end_ms, events_count; one shuffle, by the key."""
    marked = counted(with_trips(events, key, gap_ms, order), key)
    plate = winner()["plate"] if with_plates else F.lit(None).cast("string")
    return marked.groupBy(key, "trip").agg(
        plate.alias("plate"),
        F.min("min_idx").alias("from_index"),
        F.max("max_idx").alias("to_index"),
        F.min("min_ms").alias("t_start_ms"),
        F.max("max_ms").alias("t_end_ms"),
        F.sum("n").cast("int").alias("events_count"),
    )


def zipped(times: Column, plates: Column) -> Column:
    """Parallel lists as events; lists of different length are an error, null plates are none."""
    given = F.coalesce(plates, F.transform(times, lambda _: F.lit(None).cast("string")))
    same = F.assert_true(F.size(times) == F.size(given), F.lit("times and plates differ in length"))
    return F.when(same.isNull(), F.zip_with(times, given, lambda t, p: F.struct(t.alias("t_ms"), p.alias("plate"))))


def throttled(ticks: DataFrame, key: str, every_ms: int = 2000) -> DataFrame:
    """Heartbeats: ticks at least every_ms after the last one sent; anchored like suppression."""
    return suppress(ticks.withColumn("plate", F.lit(None).cast("string")), key, every_ms - 1).drop("plate")
