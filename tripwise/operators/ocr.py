"""Plate reading around events: frames to look at, regions, gates, budgets and the choice of a plate."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..config import OcrParams
from ..functions import plates
from ..functions.text import blank, clamp, int_list, jround
from ..scratch import written

# The fractions of a frame at which regions begin, and their sizes, in scanning order.
FX = [0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85]
FW = [0.12, 0.18, 0.25]
FY = [0.35, 0.45, 0.55, 0.65]
FH = [0.08, 0.12, 0.18]


class OcrBackend(Protocol):
    """What reads words and their confidence from an image region; called in tasks."""

    def words(self, png: bytes) -> list[tuple[str, float]]: ...


def read_tokens(regions: DataFrame, backend: OcrBackend) -> DataFrame:
    """(event, offset_ord, roi_idx, raw, conf) of regions (event, offset_ord, roi_idx, png): a row per word.

    A region that cannot be read gives a row without text, so it still counts as a call.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for event, offset, roi, png in zip(pdf["event"], pdf["offset_ord"], pdf["roi_idx"], pdf["png"], strict=True):
                try:
                    found = backend.words(bytes(png)) if png is not None else []
                except Exception:  # a backend's failure is one region's, not the job's
                    found = []
                rows += [(event, offset, roi, text, conf) for text, conf in found] or [(event, offset, roi, None, None)]
            yield pd.DataFrame(rows, columns=["event", "offset_ord", "roi_idx", "raw", "conf"])

    wanted = regions.select("event", "offset_ord", "roi_idx", "png")
    return wanted.mapInPandas(read, "event long, offset_ord int, roi_idx int, raw string, conf double")


def observed(tokens: DataFrame, perf: Observation) -> DataFrame:
    """tokens as they are; once a job has run over them, `perf` holds its rows, regions read and mean confidence."""
    read = F.col("raw").isNotNull()
    return tokens.observe(perf, F.count(F.lit(1)).alias("rows"), F.count_if(read).alias("words"), F.avg(F.when(read, F.col("conf"))).alias("conf"))


def snapshot_frames(events: DataFrame, fps: float, offsets: str) -> DataFrame:
    """Events (key, mid_frame, frames) times the offsets in seconds: offset_ord and the frame, within the video."""
    seconds = int_list(F.lit(offsets))
    return events.select("*", F.posexplode(seconds).alias("offset_ord", "sec")).withColumn(
        "frame", clamp(F.col("mid_frame") + jround(F.col("sec") * fps), F.lit(0), F.col("frames") - 1)
    )


def roi_grid(frames: DataFrame) -> DataFrame:
    """The 324 regions of each frame size (width, height) of frames, in scanning order: width, height, roi_idx, rx, ry, rw, rh."""
    axis = lambda name, values: F.posexplode(F.array(*[F.lit(v) for v in values])).alias(f"{name}_i", name)
    grid = frames.select("width", "height").distinct().select("*", axis("fx", FX))
    for name, values in (("fw", FW), ("fy", FY), ("fh", FH)):
        grid = grid.select("*", axis(name, values))
    idx = ((F.col("fx_i") * 3 + F.col("fw_i")) * 4 + F.col("fy_i")) * 3 + F.col("fh_i")
    width, height = F.col("width").cast("bigint"), F.col("height").cast("bigint")
    at = lambda size, f: clamp(jround(size * F.col(f)), F.lit(0), size - 1)
    placed = grid.select("width", "height", idx.alias("roi_idx"), at(width, "fx").alias("rx"), at(height, "fy").alias("ry"), "fw", "fh")
    return placed.select(
        "width",
        "height",
        "roi_idx",
        "rx",
        "ry",
        clamp(jround(width * F.col("fw")), F.lit(1), width - F.col("rx")).alias("rw"),
        clamp(jround(height * F.col("fh")), F.lit(1), height - F.col("ry")).alias("rh"),
    )


def quality_gate(rois: DataFrame, p: OcrParams) -> DataFrame:
    return rois.withColumn(
        "passes", (F.col("contrast") >= p.min_contrast) & F.col("fill").between(p.fill_min, p.fill_max)
    )


def within_budget(calls: DataFrame, key: str, p: OcrParams) -> DataFrame:
    """The first max_calls calls of each event, over all its offsets."""
    order = Window.partitionBy(key).orderBy("offset_ord", "roi_idx")
    return calls.withColumn("call", F.row_number().over(order)).filter(F.col("call") <= p.max_calls)


def best_plates(tokens: DataFrame, key: str, p: OcrParams, stop: str | None = None) -> DataFrame:
    """(key, plate): regions in order; stop at enough votes or a full plate, else the best score wins.

    tokens: key, roi_idx, raw. Votes of a plate run along roi_idx; the score of a token that is
    no plate never wins. `stop` names a column that says whether reading was stopped.
    """
    read = tokens.filter(F.col("roi_idx") < p.max_roi).withColumn("norm", plates.normalize(F.col("raw"), p.include_region))
    length = F.length("norm")
    votes = F.count(F.lit(1)).over(Window.partitionBy(key, "norm").orderBy("roi_idx"))
    ends = F.col("norm").isNotNull() & (((votes >= p.stop_votes) & (length >= p.stop_votes_min_len)) | (length >= 8))
    rank = Window.partitionBy(key).orderBy(F.desc(F.col("norm").isNotNull()), F.desc("score"), F.desc("kind"), "roi_idx")
    scored = read.withColumn("ends", ends).withColumn("score", 100 + length).withColumn("kind", plates.kind(F.col("norm")))
    ranked = scored.withColumn("rk", F.row_number().over(rank)).withColumn(
        "stop", F.min(F.when(F.col("ends"), F.col("roi_idx"))).over(Window.partitionBy(key))
    )
    return ranked.groupBy(key).agg(
        F.coalesce(
            F.max(F.when(F.col("roi_idx") == F.col("stop"), F.col("norm"))), F.max(F.when(F.col("rk") == 1, F.col("norm")))
        ).alias("plate"),
        *([F.max(F.col("stop").isNotNull()).alias(stop)] if stop else []),
    )


def read_in_rounds(regions: DataFrame, backend: OcrBackend, p: OcrParams, first: int = 1) -> tuple[DataFrame, DataFrame]:
    """(event, plate, calls) and the tokens read, of regions (event, offset_ord, roi_idx, png) that a backend is asked for only while it matters.

    An event's regions are ranked by offset, then region; those from max_roi on, or beyond its budget of max_calls, are
    never read. Each round sends the next `first` ranks (twice as many each time) of the events that are still open: an
    offset is done where its votes stop it or its last region is read, an event with the first offset that has a plate.
    What a round reads is written, so that no region is read twice. The plates are those of reading everything.
    """
    at = F.struct("event", "offset_ord")
    wanted = regions.filter(F.col("roi_idx") < p.max_roi)
    ranked = within_budget(wanted, "event", p).withColumn("last", F.max("call").over(Window.partitionBy("event", "offset_ord")))
    ranked = written(ranked.select("event", "offset_ord", "roi_idx", "png", "call", "last"), "regions")
    most = ranked.agg(F.max("call")).first()[0] or 0
    rounds, low, high, width = [], 0, first, first
    open_events = ranked.select("event").distinct()
    done = None
    while low < most:
        asked = ranked.filter((F.col("call") > low) & (F.col("call") <= high)).join(open_events, "event", "left_semi")
        if done is not None:
            asked = asked.join(done, ["event", "offset_ord"], "left_anti")
        rounds.append(written(read_tokens(asked, backend), "tokens"))
        tokens = reduce(DataFrame.unionByName, rounds)
        plated = best_plates(tokens.withColumn("at", at), "at", p, stop="stops").select("at.*", "plate", "stops")
        complete = ranked.select("event", "offset_ord", "last").distinct().filter(F.col("last") <= high).select("event", "offset_ord", F.lit(True).alias("read"))
        state = plated.join(complete, ["event", "offset_ord"], "left")
        done = written(state.filter("stops OR read").select("event", "offset_ord", "plate"), "offsets-done")
        decided = done.filter(~blank(F.col("plate"))).select("event").distinct()
        low, high, width = high, high + 2 * width, 2 * width
        open_events = written(ranked.filter(F.col("call") > low).select("event").distinct().join(decided, "event", "left_anti"), "open")
        done = done.select("event", "offset_ord")
        if open_events.isEmpty():
            break
    if not rounds:
        tokens = read_tokens(ranked, backend)
    found = first_offset_plates(best_plates(tokens.withColumn("at", at), "at", p).select("at.*", "plate"), "event")
    calls = tokens.select("event", "offset_ord", "roi_idx").distinct().groupBy("event").agg(F.count(F.lit(1)).alias("calls"))
    return found.join(calls, "event"), tokens


def first_offset_plates(found: DataFrame, key: str) -> DataFrame:
    """(key, plate): the plate of the first offset that has one."""
    return found.groupBy(key).agg(F.min_by("plate", F.when(~blank(F.col("plate")), F.col("offset_ord"))).alias("plate"))


def best_tokens(tokens: DataFrame, key: str, order: str) -> DataFrame:
    """(key, text): tokens of 3 to 10 characters in order; one replaces another if it beats its confidence cut to an integer."""
    fit = tokens.filter(F.length("text").between(3, 10))
    keyed = fit.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "text", "conf"))).alias("t"))
    best = F.aggregate(
        "t",
        F.expr("named_struct('text', cast(null as string), 'conf', -1)"),
        lambda b, t: F.when(t["conf"] > b["conf"], F.struct(t["text"].alias("text"), t["conf"].cast("int").alias("conf"))).otherwise(b),
    )
    return keyed.select(key, best["text"].alias("text"))


def choose_candidates(candidates: DataFrame, key: str) -> DataFrame:
    """(key, text): of candidates (ord, text) of three characters or more the best shape, then the longest, then the first."""
    fit = candidates.filter(F.length("text") >= 3)
    return fit.groupBy(key).agg(F.max_by("text", F.struct(plates.shape_score(F.col("text")), F.length("text"), -F.col("ord"))).alias("text"))


def otsu(histogram: DataFrame, key: str) -> DataFrame:
    """(key, threshold): the level (level, n) that splits a histogram with the greatest variance between its parts."""
    w = Window.partitionBy(key).orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(key)
    sums = histogram.select(
        key,
        "level",
        F.sum("n").over(w).cast("double").alias("w0"),
        F.sum(F.col("level") * F.col("n")).over(w).cast("double").alias("s0"),
        F.sum("n").over(whole).cast("double").alias("total"),
        F.sum(F.col("level") * F.col("n")).over(whole).cast("double").alias("all"),
    ).filter("w0 < total")
    split = (F.col("s0") / F.col("w0") - (F.col("all") - F.col("s0")) / (F.col("total") - F.col("w0"))) ** 2
    between = F.round(F.col("w0") * (F.col("total") - F.col("w0")) * split, 3)
    return sums.groupBy(key).agg(F.max_by("level", F.struct(between, -F.col("level"))).alias("threshold"))
