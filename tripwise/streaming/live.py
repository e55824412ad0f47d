"""Stateful streams in event time: trips with plate votes, and the retry cycle of cameras.

Both keep what may still change and put it out once the watermark has passed it, so rows may come
in any order within the lateness that the watermark allows, and a row is put out once. State is one
value per key: open trips with their votes, or heartbeats that are not settled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from ..functions import plates
from ..sources.views import raw_plate
from . import trips as files


class Held(StatefulProcessor):
    """A processor with one JSON value per key and one timer at the time its value says."""

    def init(self, handle) -> None:
        self.handle = handle
        self.value = handle.getValueState("held", "json string")

    def load(self, empty: dict) -> dict:
        return json.loads(self.value.get()[0]) if self.value.exists() else empty

    def save(self, held: dict, at: int | None) -> None:
        self.value.update((json.dumps(held),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def close(self) -> None:
        pass


TRIP = "detection_id long, trip int, plate string, from_index int, to_index int, t_start_ms long, t_end_ms long, events_count int"


class Trips(Held):
    """Trips of a key: an event up to gap_ms from one joins it, and joins two if it is near both; the plate most named, at least twice, names it."""

    def __init__(self, gap_ms: int):
        self.gap_ms = gap_ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.load({"open": [], "events": 0, "trips": 0})
        trips = [(a, b, n, dict(v)) for a, b, n, v in held["open"]]
        for pdf in rows:
            for t, plate in zip(pdf["t_ms"].tolist(), pdf["plate"].tolist(), strict=True):
                trips.append((t, t, 1, {plate: 1} if isinstance(plate, str) and plate.strip() else {}))
        trips.sort(key=lambda x: x[:2])
        joined: list = []
        for a, b, n, votes in trips:
            if joined and a - joined[-1][1] <= self.gap_ms:
                last = joined[-1]
                last[1], last[2] = max(last[1], b), last[2] + n
                for plate, count in votes.items():
                    last[3][plate] = last[3].get(plate, 0) + count
            else:
                joined.append([a, b, n, votes])
        held["open"] = joined
        self.save(held, joined[0][1] + self.gap_ms if joined else None)
        yield pd.DataFrame(columns=[c.split()[0] for c in TRIP.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, now, out = self.load({"open": [], "events": 0, "trips": 0}), timerValues.getCurrentWatermarkInMs(), []
        # Trips close in the order of time, so the numbers of all events before are known.
        while held["open"] and held["open"][0][1] + self.gap_ms <= now:
            a, b, n, votes = held["open"].pop(0)
            best = min(((-count, plate) for plate, count in votes.items() if count >= 2), default=(0, None))[1]
            out.append((key[0], held["trips"], best, held["events"], held["events"] + n - 1, a, b, n))
            held["trips"], held["events"] = held["trips"] + 1, held["events"] + n
        self.save(held, held["open"][0][1] + self.gap_ms if held["open"] else None)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRIP.split(", ")])


def live_trips(events: DataFrame, gap_ms: int, lateness: str = "1 hour") -> DataFrame:
    """Trips (all columns of the batch `trips`) of a stream (detection_id, ts, t_ms, plate), put out once closed."""
    marked = events.withWatermark("ts", lateness)
    return marked.groupBy("detection_id").transformWithStateInPandas(Trips(gap_ms), TRIP, "Append", "EventTime")


RETRY = "camera_id long, at_ms long, state string, retries int, wait_ms long, last_seen_ms long"


class Retries(Held):
    """A camera's health: without heartbeat for timeout_ms it errs, waits 1, 2 and 4 times wait_ms (max_wait_ms at most) between tries
    and stops once `most` retries have failed; a heartbeat sets it right again."""

    def __init__(self, timeout_ms: int, wait_ms: int = 500, max_wait_ms: int = 2000, most: int = 3):
        self.timeout_ms, self.most = timeout_ms, most
        self.waits = [min(max_wait_ms, wait_ms * 2 ** min(3, k)) for k in range(most)]

    def due(self, last: int, failed: int) -> int | None:
        """When the next try fails, if no heartbeat comes until then."""
        return None if failed > self.most else last + self.timeout_ms + sum(self.waits[:failed])

    def fail(self, camera, held: dict, until: int) -> list[tuple]:
        out = []
        while (at := self.due(held["last"], held["failed"])) is not None and at <= until:
            held["failed"] += 1
            stopped = held["failed"] > self.most
            out.append((camera, at, "STOPPED" if stopped else "ERROR", held["failed"], 0 if stopped else self.waits[held["failed"] - 1], held["last"]))
        return out

    def settle(self, camera, held: dict, now: int) -> list[tuple]:
        """What is certain once all heartbeats up to `now` are known."""
        out, left = [], []
        for t in held["beats"]:
            if t > now:
                left.append(t)
                continue
            if held["last"] is not None:
                out += self.fail(camera, held, t - 1)
                if held["failed"]:
                    out.append((camera, t, "OK", 0, 0, t))
            held["last"], held["failed"] = t, 0
        held["beats"] = left
        if held["last"] is not None:
            out += self.fail(camera, held, now)
        return out

    def next_at(self, held: dict) -> int | None:
        due = None if held["last"] is None else self.due(held["last"], held["failed"])
        return min([t for t in (due, *held["beats"][:1]) if t is not None], default=None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.load({"last": None, "failed": 0, "beats": []})
        held["beats"] = sorted(held["beats"] + [t for pdf in rows for t in pdf["t_ms"].tolist()])
        self.save(held, self.next_at(held))
        yield pd.DataFrame(columns=[c.split()[0] for c in RETRY.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self.load({"last": None, "failed": 0, "beats": []})
        out = self.settle(key[0], held, timerValues.getCurrentWatermarkInMs())
        self.save(held, self.next_at(held))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RETRY.split(", ")])


def camera_retries(beats: DataFrame, timeout_ms: int, lateness: str = "1 hour", **waits: int) -> DataFrame:
    """Health rows (see RETRY) of a stream of heartbeats (camera_id, ts, t_ms)."""
    marked = beats.withWatermark("ts", lateness)
    return marked.groupBy("camera_id").transformWithStateInPandas(Retries(timeout_ms, **waits), RETRY, "Append", "EventTime")


def _events(spark: SparkSession, path: str, at: str) -> DataFrame:
    """The events of a finite stream and one far in the future, of user -1, that moves the watermark past them all."""
    return files.closed_by_an_event(spark, path, at, -1).withColumn("t_ms", F.unix_millis("ts"))


def live_trips_once(spark: SparkSession, path: str, gap_ms: int) -> DataFrame:
    """All trips of a finite stream of the events table, with plates."""
    at = files._folder(spark)
    k = F.regexp_extract("props", "[0-9]+", 0).try_cast("int")
    events = _events(spark, path, at).select(F.col("user_id").alias("detection_id"), "ts", "t_ms", plates.normalize(raw_plate(k)).alias("plate"))
    return files.stateful_to_end(live_trips(events, gap_ms), at)


def camera_retries_once(spark: SparkSession, path: str, timeout_ms: int, **waits: int) -> DataFrame:
    """All health rows of a finite stream of the events table, each event a heartbeat of its user."""
    at = files._folder(spark)
    beats = _events(spark, path, at).select(F.col("user_id").alias("camera_id"), "ts", "t_ms")
    return files.stateful_to_end(camera_retries(beats, timeout_ms, **waits), at)
