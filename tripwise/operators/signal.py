"""Motion signal: frame sampling, low-motion filter, smoothing and the two-threshold state machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DetectParams
from ..functions.text import frame_ms
from ..scratch import written
from . import stretches
from .folds import stepped


def sampled(signal: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """Every step-th frame from the first on, up to the time limit; adds ms and ratio."""
    kept = signal.filter((F.col("frame_idx") > 0) & (F.col("frame_idx") % p.step_frames == 0))
    kept = kept.withColumn("ms", frame_ms(F.col("frame_idx"), F.lit(fps)))
    if p.max_ms is not None:
        kept = kept.filter(F.col("ms") < p.max_ms)
    return kept.withColumn("ratio", F.col("changed_px") / F.col("total_px"))


def moving(signal: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """Sampled frames with enough changed pixels; the others neither smooth nor step the state machine."""
    return sampled(signal, p, fps).filter(F.col("changed_px") >= p.min_changed_pixels)


def eof_frames(signal: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """(video_id, eof): the frame at which a video ends for the state machine; frames must be all decoded ones but the first."""
    end = signal.groupBy("video_id").agg(F.max("frame_idx").alias("n"))
    last = F.floor(F.col("n") / p.step_frames) * p.step_frames
    eof = F.greatest(last + 1, F.col("n")).cast("bigint")
    if p.max_ms is None:
        return end.select("video_id", eof.alias("eof"))
    cut = signal.filter((F.col("frame_idx") % p.step_frames == 0) & (frame_ms(F.col("frame_idx"), F.lit(fps)) >= p.max_ms))
    first = cut.groupBy("video_id").agg(F.min("frame_idx").alias("cut"))
    return end.join(first, "video_id", "left").select("video_id", F.coalesce("cut", eof).alias("eof"))


STATE = "struct<ema:double,active:boolean,start:bigint,last:bigint>"
END = "struct<active:boolean,start:bigint>"
STEP = "struct<ms:bigint,frame:bigint,ratio:double,ema:double,state:string,event:int,t_ms:bigint>"


def machine(signal: DataFrame, p: DetectParams, fps: float, every: bool) -> DataFrame:
    """The two-threshold machine over each video's moving frames: (video_id, out, end), rows for stretches of it.

    end is the state (active, start) at the video's end, in one of its rows. out lists its steps in order: all of them (`every`), or those that end an event; t_ms is the event's middle. The
    state shown is the one before the step, IDLE once closed. A video may be of any length: see `stretches`.
    """
    least = p.min_frames(fps)
    ms = lambda frame: frame_ms(frame, F.lit(fps))

    def step(state: Column, s: Column) -> Column:
        def judged(ema: Column) -> Column:
            idx, length = s["frame_idx"], s["frame_idx"] - state["start"]
            opens = ~state["active"] & (idx - state["last"] > p.cooldown_frames) & (ema >= p.high)
            closes = state["active"] & (ema < p.low)
            emits = closes & (length >= least)
            if p.warmup_ms > 0:
                emits = emits & (ms(F.greatest(state["start"], idx - 1)) > p.warmup_ms)
            after = F.struct(
                ema.alias("ema"),
                (opens | (state["active"] & ~closes)).alias("active"),
                F.when(opens, idx).otherwise(state["start"]).alias("start"),
                F.when(emits, idx).otherwise(state["last"]).alias("last"),
            )
            shown = F.struct(
                s["ms"].alias("ms"),
                idx.alias("frame"),
                s["ratio"].alias("ratio"),
                ema.alias("ema"),
                F.when(state["active"] & ~closes, "ACTIVE").otherwise("IDLE").alias("state"),
                emits.cast("int").alias("event"),
                F.when(emits, ms(state["start"] + F.floor(length / 2).cast("bigint"))).alias("t_ms"),
            )
            emitted = F.array(shown) if every else F.when(emits, F.array(shown)).otherwise(F.expr(f"cast(array() as array<{STEP}>)"))
            return F.struct(after.cast(STATE).alias("state"), emitted.cast(f"array<{STEP}>").alias("emitted"))

        return F.transform(F.array(p.ema_alpha * s["ratio"] + (1 - p.ema_alpha) * state["ema"]), judged)[0]

    def folded(entered: DataFrame) -> DataFrame:
        fold = entered.select("video_id", stepped(F.col("frames"), F.col("entering"), step, f"array<{STEP}>").alias("fold"))
        return fold.select("video_id", "fold.out", F.struct("fold.state.active", "fold.state.start").cast(END).alias("end"))

    of = F.struct("video_id", "stretch")
    cut = stretches.grouped_from(moving(signal, p, fps), "video_id", F.col("frame_idx") / p.step_frames)
    begin = F.expr(f"named_struct('ema', 0D, 'active', false, 'start', -1L, 'last', {-p.cooldown_frames - 1}L)").cast(STATE)
    # Most videos are one stretch and are folded as they are.
    long = cut.groupBy(F.col("video_id").alias("long")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("long")
    if long.isEmpty():
        return folded(cut.withColumn("entering", begin))
    long = written(long, "long-videos")
    whole = folded(cut.join(long, F.col("video_id").eqNullSafe(F.col("long")), "left_anti").withColumn("entering", begin))
    cut = cut.join(long, F.col("video_id").eqNullSafe(F.col("long")), "left_semi")
    before = stretches.averages_before(cut, p.ema_alpha).select(of.alias("of"), "ema")
    averaged = cut.join(before, of == F.col("of")).drop("of")
    states = written(stretches.states_before(averaged, p, fps), "states")
    entering = states.filter("stretch >= 0").select(of.alias("of"), "active", "start", "last")
    parts = averaged.join(entering, of == F.col("of")).withColumn("entering", F.struct("ema", "active", "start", "last").cast(STATE))
    inner = folded(parts).withColumn("end", F.lit(None).cast(END))
    ends = states.filter("stretch < 0").select("video_id", F.expr(f"cast(array() as array<{STEP}>)").alias("out"), F.struct("active", "start").cast(END).alias("end"))
    return whole.unionByName(inner).unionByName(ends)


def motion_events(signal: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """(video_id, t_ms) of the events: the machine's, and one flushed at a video's end if it is active then."""
    p = p.clamped()
    rows = machine(signal, p, fps, every=False).join(eof_frames(signal, p, fps), "video_id")
    length = F.col("eof") - F.col("end.start")
    flushed = F.col("end.active") & (length >= p.min_frames(fps))
    middle = F.array(frame_ms(F.col("end.start") + F.floor(length / 2).cast("bigint"), F.lit(fps)))
    tail = F.when(flushed, middle).otherwise(F.expr("cast(array() as array<bigint>)"))
    return rows.select("video_id", F.explode(F.concat(F.transform("out", lambda s: s["t_ms"]), tail)).alias("t_ms"))


def motion_trace(signal: DataFrame, p: DetectParams, fps: float) -> DataFrame:
    """A row per moving frame: video_id, ms, frame, ratio, ema (6 decimals), state, event (1 where one ends)."""
    steps = machine(signal, p.clamped(), fps, every=True).select("video_id", F.explode("out").alias("s"))
    six = lambda c: (F.floor(F.col(f"s.{c}") * 1e6 + 0.5) / 1e6).alias(c)
    return steps.select("video_id", "s.ms", "s.frame", six("ratio"), six("ema"), "s.state", "s.event")


def trace_lines(trace: DataFrame) -> DataFrame:
    """(video_id, frame, line): the trace as CSV lines; a header line has frame -1."""
    line = F.format_string("%d,%d,%.6f,%.6f,%s,%d", "ms", "frame", "ratio", "ema", "state", "event")
    head = trace.select("video_id").distinct().select("video_id", F.lit(-1).cast("long").alias("frame"), F.lit("ms,frame,ratio,ema,state,event").alias("line"))
    return trace.select("video_id", "frame", line.alias("line")).unionByName(head)


def opened(mask: np.ndarray, size: int) -> np.ndarray:
    """Erosion, then dilation, with a square of `size` pixels; of one mask, or of each in a stack."""

    def swept(m: np.ndarray, how) -> np.ndarray:
        around = [(0, 0)] * (m.ndim - 2) + [(size // 2, size // 2)] * 2
        padded = np.pad(m, around, constant_values=how is np.minimum)
        out = None
        for i in range(size):
            for j in range(size):
                part = padded[..., i : i + m.shape[-2], j : j + m.shape[-1]]
                out = part if out is None else how(out, part)
        return out

    return swept(swept(mask, np.minimum), np.maximum) if size > 1 else mask


def blurred(gray: np.ndarray) -> np.ndarray:
    """A 5 x 5 Gaussian blur with binomial weights, of one picture or of each in a stack."""
    weights = np.array([1, 4, 6, 4, 1]) / 16
    padded = np.pad(gray.astype(float), [(0, 0)] * (gray.ndim - 2) + [(2, 2)] * 2, mode="reflect")
    rows = sum(w * padded[..., i : i + gray.shape[-2], :] for i, w in enumerate(weights))
    return np.rint(sum(w * rows[..., i : i + gray.shape[-1]] for i, w in enumerate(weights))).astype(np.uint8)


#: Pixels of a stack of pictures that is worked on at once.
STACK = 4_000_000


def changed_pixels(frames: DataFrame, p: DetectParams) -> DataFrame:
    """The signal of decoded frames (video_id, frame_idx, width, height, gray): differences of neighbours in the sampled order.

    Frame 0 is the first reference. Each video's pairs are formed by a shuffle on video_id.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("video_id").orderBy("frame_idx")
    pairs = frames.filter(F.col("frame_idx") % p.step_frames == 0).withColumn("before", F.lag("gray").over(w)).filter("before IS NOT NULL")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            changed = np.zeros(len(pdf), np.int64)
            # Pictures of one size are worked on together, a stack of bounded size at a time.
            for (width, height), same in pdf.groupby(["width", "height"]).indices.items():
                many = max(1, STACK // (width * height))
                for at in (same[i : i + many] for i in range(0, len(same), many)):
                    stack = lambda c, at=at, shape=(-1, height, width): np.frombuffer(b"".join(pdf[c].iloc[at]), np.uint8).reshape(shape)
                    moved = np.abs(blurred(stack("gray")).astype(np.int16) - blurred(stack("before"))) > p.diff_threshold
                    changed[at] = opened(moved, p.morph_kernel).sum((1, 2))
            yield pd.DataFrame(
                {"video_id": pdf["video_id"], "frame_idx": pdf["frame_idx"], "changed_px": changed, "total_px": pdf["width"] * pdf["height"]}
            )

    return pairs.select("video_id", "frame_idx", "width", "height", "gray", "before").mapInPandas(
        count, "video_id long, frame_idx long, changed_px long, total_px long"
    )
