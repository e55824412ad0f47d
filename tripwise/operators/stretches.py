"""Sequential operators over stretches of a key's rows, so that one key may be longer than a task holds.

A key is cut into stretches of bounded length. Each stretch is summed up by what it does to the
state that comes in (a few numbers), the sums of a key are folded in order, and then every stretch
runs on its own from the state that really enters it. Stretches are written once, since they are
read twice; only their sums meet in one task per key.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DetectParams
from ..scratch import written
from .folds import stepped

#: Rows of a stretch, at most.
SIZE = 8192


def numbered(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """rows with idx, from 0 along `order` in each key.

    A range sort gives each task a part of all rows; a row's number is its place in that part of its
    key and what the parts before hold of the key. Of a key only one row a part meets in one task.
    """
    sorted_rows = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = written(sorted_rows.withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id()), "numbered")
    parts = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__held"))
    before = F.sum("__held").over(Window.partitionBy("__key").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    starts = parts.select("__key", "__of", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    found = placed.join(starts, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return found.withColumn("idx", F.col("__place") + F.col("__shift")).select(*rows.columns, "idx")


# The motion machine


def averages_before(stretches: DataFrame, alpha: float) -> DataFrame:
    """(video_id, stretch, ema): the average that enters each stretch (frames with ratio).

    A frame maps the average by e -> alpha r + (1 - alpha) e, so a stretch of n frames maps it by
    e -> b + (1 - alpha) ** n e, with b its average from 0. Where n is so small that this would round
    otherwise than frame by frame does, the stretch's few ratios are folded themselves.
    """
    averaged = lambda ratios, e: F.aggregate(ratios, e, lambda e, r: alpha * r + (1 - alpha) * e)
    few = 2048 if alpha <= 0 else 1 if alpha >= 1 else min(2048, math.ceil(-60 * math.log(2) / math.log(1 - alpha)))
    ratios = F.transform("frames", lambda f: f["ratio"])
    own = F.when(F.size("frames") < few, ratios)
    a = F.pow(F.lit(1 - alpha), F.size("frames"))
    sums = stretches.select("video_id", F.struct("stretch", averaged(ratios, F.lit(0.0)).alias("b"), a.alias("a"), own.alias("own")).alias("s"))
    after = lambda e, s: F.when(s["own"].isNull(), s["b"] + s["a"] * e).otherwise(averaged(s["own"], e))
    step = lambda e, s: F.struct(after(e, s).alias("state"), F.array(F.struct(s["stretch"].alias("stretch"), e.alias("ema"))).alias("emitted"))
    folded = sums.groupBy("video_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    out = stepped(F.col("s"), F.lit(0.0), step, "array<struct<stretch:bigint,ema:double>>")["out"]
    return folded.select("video_id", F.explode(out).alias("e")).select("video_id", "e.stretch", "e.ema")


class Transitions:
    """What a stretch does to the machine's state, from the frames at or above `high` (ups) and below `low` (downs).

    opened at ups[i] it closes at the next down; the next opening is the first up after that, or after
    its cooldown if an event was put out. Following these links to the end gives the state that leaves:
    `start` (-1: idle) and `last`, the last event's end (-1: the one that came in).
    """

    def __init__(self, frames: np.ndarray, ema: np.ndarray, p: DetectParams, fps: float):
        self.p, self.fps = p, fps
        self.ups, self.downs = frames[ema >= p.high], frames[ema < p.low]
        m = len(self.ups)
        at = np.searchsorted(self.downs, self.ups, "right")
        closed = at < len(self.downs)
        ends = self.downs[np.minimum(at, len(self.downs) - 1)] if len(self.downs) else np.zeros(m, np.int64)
        put_out = closed & self.emits(self.ups, ends)
        follows = np.searchsorted(self.ups, ends + np.where(put_out, p.cooldown_frames, 0), "right")
        final = ~closed | (follows == m)
        link = np.where(final, np.arange(m), follows)
        while m and (link[link] != link).any():
            link = link[link]
        self.start = np.where(closed[link], -1, self.ups[link]) if m else self.ups
        self.last = np.where(put_out[link], ends[link], -1) if m else self.ups

    def emits(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Whether an opening and a closing frame make an event: long enough, and past the warm-up."""
        fit = end - start >= self.p.min_frames(self.fps)
        if self.p.warmup_ms > 0:
            fit &= (np.maximum(start, end - 1) / self.fps * 1000).astype(np.int64) > self.p.warmup_ms
        return fit

    def after(self, blocked: int) -> tuple[int, int]:
        """(start, last) that leave if the machine comes in idle and may not open up to frame `blocked`."""
        i = int(np.searchsorted(self.ups, blocked, "right"))
        return (int(self.start[i]), int(self.last[i])) if i < len(self.ups) else (-1, -1)

    def summary(self, first: int) -> dict:
        """The states that leave, for all that can come in at frame `first`; equal ones of neighbouring openings are one."""
        p, m = self.p, len(self.ups)
        reach = min(m, int(np.searchsorted(self.ups, first - 1 + p.cooldown_frames, "right")) + 1)
        s, e = self.start[:reach], self.last[:reach]
        ends = np.flatnonzero((s[1:] != s[:-1]) | (e[1:] != e[:-1])) if reach else np.zeros(0, np.int64)
        ends = np.append(ends, reach - 1) if reach else ends
        down = int(self.downs[0]) if len(self.downs) else -1
        kept, dropped = (self.after(down + p.cooldown_frames), self.after(down)) if down >= 0 else ((-1, -1), (-1, -1))
        return {"upto": self.ups[ends], "starts": s[ends], "lasts": e[ends], "down": down, "kept": list(kept), "dropped": list(dropped)}


SUMMARY = "upto array<long>, starts array<long>, lasts array<long>, down long, kept array<long>, dropped array<long>"


def states_before(averaged: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """(video_id, stretch, active, start, last) that enter each stretch of averaged (video_id, stretch, ema, frames), and those
    that leave the last one, as stretch -1."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for ema, frames, ratios in zip(pdf["ema"], pdf["frame"], pdf["ratio"], strict=True):
                out = np.empty(len(ratios))
                for i, r in enumerate(np.asarray(ratios, float).tolist()):
                    ema = p.ema_alpha * r + (1 - p.ema_alpha) * ema
                    out[i] = ema
                frames = np.asarray(frames, np.int64)
                rows.append(Transitions(frames, out, p, fps).summary(int(frames[0])))
            yield pd.concat([pdf[["video_id", "stretch"]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    lists = averaged.select("video_id", "stretch", "ema", F.transform("frames", lambda f: f["frame_idx"]).alias("frame"), F.transform("frames", lambda f: f["ratio"]).alias("ratio"))
    key = lists.schema["video_id"].dataType.simpleString()
    sums = lists.mapInPandas(summed, f"video_id {key}, stretch long, {SUMMARY}")
    rule = Transitions(np.zeros(0, np.int64), np.zeros(0), p, fps)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        start, last, rows = -1, -p.cooldown_frames - 1, []
        for r in pdf.sort_values("stretch").itertuples(index=False):
            rows.append((r.video_id, r.stretch, start >= 0, start, last))
            left = None
            if start >= 0:
                if r.down >= 0:
                    if rule.emits(np.array([start]), np.array([r.down]))[0]:
                        last, left = r.down, r.kept
                    else:
                        left = r.dropped
            else:
                i = int(np.searchsorted(r.upto, last + p.cooldown_frames, "right"))
                if i < len(r.upto):
                    left = (r.starts[i], r.lasts[i])
            if left is not None:
                start, last = int(left[0]), int(left[1]) if left[1] >= 0 else last
        rows.append((pdf["video_id"].iloc[0], -1, start >= 0, start, last))
        return pd.DataFrame(rows, columns=["video_id", "stretch", "active", "start", "last"])

    return sums.groupBy("video_id").applyInPandas(fold, f"video_id {key}, stretch long, active boolean, start long, last long")


# Anchored suppression


def anchored(events: DataFrame, key: str, window_ms: int, order: list[str], size: int | None = None) -> DataFrame:
    """events (key, t_ms and more) with idx, keep and head: kept are the first, then each more than window_ms after the last kept one.

    Events are ordered by (t_ms, *order); head is the idx of the last kept event up to each. Null times are passed over.
    Within a stretch each event links to the first beyond its window; following the links from any entry to the end gives
    what leaves. A stretch is entered by an event within one window of its first, so few entries differ.
    """
    size = size or SIZE
    columns = events.columns
    rows = numbered(events.filter("t_ms IS NOT NULL"), key, ["t_ms", *order])
    stretch = F.floor(F.col("idx") / size).cast("bigint").alias("stretch")
    packed = F.array_sort(F.collect_list(F.struct("idx", F.struct(*columns).alias("e"))))
    stretches = written(rows.groupBy(F.col(key).alias("__key"), stretch).agg(packed.alias("rows")), "anchored")
    times = stretches.select("__key", "stretch", F.transform("rows", lambda r: r["e"]["t_ms"]).alias("t"))
    kind = times.schema["__key"].dataType.simpleString()

    def ends(t: np.ndarray) -> np.ndarray:
        """For each event the last kept one of its stretch, if it is kept itself."""
        link = np.searchsorted(t, t + window_ms, "right")
        link = np.where(link == len(t), np.arange(len(t)), link)
        while (link[link] != link).any():
            link = link[link]
        return link

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for number, times in zip(pdf["stretch"], pdf["t"], strict=True):
                t = np.asarray(times, np.int64)
                last = ends(t)[: int(np.searchsorted(t, t[0] + window_ms, "right")) + 1]
                turns = np.append(np.flatnonzero(last[1:] != last[:-1]), len(last) - 1)
                out.append((t[turns], t[last[turns]], last[turns] + number * size))
            yield pdf[["__key", "stretch"]].assign(upto=[o[0] for o in out], times=[o[1] for o in out], heads=[o[2] for o in out])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        at, head, out = None, -1, []
        for r in pdf.sort_values("stretch").itertuples(index=False):
            out.append((r[0], r.stretch, at, head))
            i = 0 if at is None else int(np.searchsorted(r.upto, at + window_ms, "right"))
            if i < len(r.upto):
                at, head = int(r.times[i]), int(r.heads[i])
        return pd.DataFrame(out, columns=["__key", "stretch", "at", "head"]).astype({"at": "Int64"})

    sums = times.mapInPandas(summed, f"__key {kind}, stretch long, upto array<long>, times array<long>, heads array<long>")
    entered = written(sums.groupBy("__key").applyInPandas(fold, f"__key {kind}, stretch long, at long, head long"), "anchored-entries")

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            heads = []
            for number, times, at, head in zip(pdf["stretch"], pdf["t"], pdf["at"], pdf["head"], strict=True):
                t = np.asarray(times, np.int64)
                own = np.full(len(t), head, np.int64)
                i = 0 if pd.isna(at) else int(np.searchsorted(t, int(at) + window_ms, "right"))
                while i < len(t):
                    own[i:] = i + number * size
                    i = int(np.searchsorted(t, t[i] + window_ms, "right"))
                heads.append(own)
            yield pdf[["__key", "stretch"]].assign(heads=heads)

    joined = times.join(entered.withColumnRenamed("__key", "__of").withColumnRenamed("stretch", "__at"), F.col("__key").eqNullSafe(F.col("__of")) & (F.col("stretch") == F.col("__at")))
    found = joined.select("__key", "stretch", "t", "at", "head").mapInPandas(marked, f"__key {kind}, stretch long, heads array<long>")
    found = found.withColumnRenamed("__key", "__of").withColumnRenamed("stretch", "__at")
    both = stretches.join(found, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("stretch") == F.col("__at")))
    pairs = both.select(F.explode(F.arrays_zip("rows", "heads")).alias("z"))
    return pairs.select("z.rows.e.*", F.col("z.rows.idx").alias("idx"), (F.col("z.heads") == F.col("z.rows.idx")).alias("keep"), F.col("z.heads").alias("head"))


def grouped_from(frames: DataFrame, key: str, number: Column, size: int | None = None) -> DataFrame:
    """(key, stretch, frames): rows (frame_idx, ms, ratio) of each stretch of frame numbers, in order; written."""
    packed = F.array_sort(F.collect_list(F.struct("frame_idx", "ms", "ratio"))).alias("frames")
    return written(frames.groupBy(key, F.floor(number / (size or SIZE)).cast("bigint").alias("stretch")).agg(packed), "stretches")
