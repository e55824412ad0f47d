import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwise.config import DEFAULT, SHIPPED, DetectParams
from tripwise.operators import folds, signal, stretches

FPS = 10.0
P = DetectParams(1, 45, 0.5, 2, 10, 1, 0.5, 0.5, 200, 0, 0)


def frames(spark, ratios, video=1):
    return spark.createDataFrame([(video, i + 1, int(r * 1000), 1000) for i, r in enumerate(ratios)], "video_id long, frame_idx long, changed_px long, total_px long")


def loop(ratios, p, fps):
    ema, active, start, last, out, end = 0.0, False, -1, -p.cooldown_frames - 1, [], len(ratios) + 1
    for i, r in enumerate(ratios, 1):
        ms = int(i / fps * 1000)
        if p.max_ms is not None and ms >= p.max_ms:
            end = i
            break
        if int(r * 1000) < p.min_changed_pixels:
            continue
        ema = p.ema_alpha * (int(r * 1000) / 1000) + (1 - p.ema_alpha) * ema
        if not active:
            if i - last > p.cooldown_frames and ema >= p.high:
                active, start = True, i
        elif ema < p.low:
            if i - start >= p.min_frames(fps) and not (p.warmup_ms > 0 and int(max(start, i - 1) / fps * 1000) <= p.warmup_ms):
                out.append(int((start + (i - start) // 2) / fps * 1000))
                last = i
            active = False
    if active and end - start >= p.min_frames(fps):
        out.append(int((start + (end - start) // 2) / fps * 1000))
    return out


CASES = [
    [0.9] * 4 + [0.02] * 6,
    [0.9] * 4 + [0.0] * 10 + [0.02] * 3,
    [0.02] * 5 + [0.95] * 6,
    [0.9, 0.02, 0.9, 0.02] * 8,
    ([0.9] * 4 + [0.02] * 6) * 3,
    [0.0] * 5,
]


@pytest.mark.parametrize("ratios", CASES)
@pytest.mark.parametrize("more", [{}, {"warmup_ms": 700}, {"max_ms": 1500}, {"cooldown_frames": 0}])
def test_events_follow_the_loop(spark, ratios, more):
    p = DetectParams(**(P.__dict__ | more))
    got = sorted(r.t_ms for r in signal.motion_events(frames(spark, ratios), p, FPS).collect())
    assert got == loop(ratios, p, FPS)


def test_random_signals(spark):
    rng = np.random.default_rng(3)
    all_frames, want = None, {}
    for v in range(12):
        ratios = np.round(np.clip(rng.normal(0.4, 0.35, 120), 0, 1), 3).tolist()
        want[v] = loop(ratios, P, FPS)
        part = frames(spark, ratios, v)
        all_frames = part if all_frames is None else all_frames.unionByName(part)
    got = {v: [] for v in want}
    for r in signal.motion_events(all_frames, P, FPS).orderBy("video_id", "t_ms").collect():
        got[r.video_id].append(r.t_ms)
    assert got == want
    trace = signal.motion_trace(all_frames, P, FPS)
    assert trace.agg(F.sum("event")).first()[0] <= sum(map(len, want.values()))


def test_strides_agree_with_the_loop_over_every_nth_frame(spark):
    rng = np.random.default_rng(9)
    for step, n in ((2, 61), (2, 60), (5, 123)):
        ratios = np.round(np.clip(rng.normal(0.4, 0.35, n), 0, 1), 3).tolist()
        p = DetectParams(**(P.__dict__ | {"step_frames": step}))
        thinned = [r if (i + 1) % step == 0 else 0.0 for i, r in enumerate(ratios)]
        last = n // step * step
        want = loop(thinned[:last], p, FPS)
        if len(loop(thinned[:last] + [0.0] * (max(last + 1, n) - last - 1), p, FPS)) == len(want):
            want = loop(thinned[:last] + [0.0] * (max(last + 1, n) - last - 1), p, FPS)
        assert sorted(r.t_ms for r in signal.motion_events(frames(spark, ratios), p, FPS).collect()) == want


def test_trace_is_the_machine_step_by_step(spark):
    ratios = [0.9] * 4 + [0.02] * 6 + [0.9] * 3
    rows = signal.motion_trace(frames(spark, ratios), P, FPS).orderBy("frame").collect()
    assert [r.state for r in rows[:5]] == ["IDLE", "IDLE", "ACTIVE", "ACTIVE", "ACTIVE"]
    ended = [r for r in rows if r.event]
    assert len(ended) == 1 and ended[0].state == "IDLE" and [r.t_ms for r in signal.motion_events(frames(spark, ratios), P, FPS).orderBy("t_ms").collect()][0] < ended[0].ms
    lines = {r.frame: r.line for r in signal.trace_lines(signal.motion_trace(frames(spark, ratios), P, FPS)).collect()}
    assert lines[-1] == "ms,frame,ratio,ema,state,event" and lines[1] == "100,1,0.900000,0.450000,IDLE,0"


def test_folds_carry_state_over_stretches(spark, monkeypatch):
    monkeypatch.setattr(folds, "STRETCH", 7)
    step = lambda state, x: F.struct((state + x).alias("state"), F.when(x % 3 == 0, F.array(state + x)).otherwise(F.expr("cast(array() as array<bigint>)")).alias("emitted"))
    for n in (0, 1, 6, 7, 8, 50):
        df = spark.range(1).select(F.expr(f"slice(sequence(0L, 60L), 1, {n})").alias("x"))
        got = df.select(folds.stepped(F.col("x"), F.lit(0).cast("bigint"), step, "array<bigint>").alias("r")).first().r
        assert got.state == sum(range(n)) and got.out == [sum(range(i + 1)) for i in range(n) if i % 3 == 0]


def test_sampling_and_limits(spark):
    p = DetectParams(step_frames=5, max_ms=1600, min_changed_pixels=0)
    kept = signal.sampled(frames(spark, [0.5] * 22), p, FPS)
    assert [r.frame_idx for r in kept.orderBy("frame_idx").collect()] == [5, 10, 15]
    assert signal.eof_frames(frames(spark, [0.5] * 22), p, FPS).first().eof == 20
    assert DetectParams(ema_alpha=3.0, step_frames=0).clamped().ema_alpha == 1.0
    assert SHIPPED.min_frames(30) == 9 and DEFAULT.min_frames(30) == 36


def test_pixels(spark):
    dark, lit = np.zeros((20, 30), np.uint8), np.zeros((20, 30), np.uint8)
    lit[5:15, 5:15] = 255
    rows = [(1, i, 30, 20, bytearray(img.tobytes())) for i, img in enumerate([dark, dark, lit])]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, width long, height long, gray binary")
    got = signal.changed_pixels(df, DetectParams(step_frames=1, morph_kernel=3)).orderBy("frame_idx").collect()
    assert [r.frame_idx for r in got] == [1, 2]
    assert got[0].changed_px == 0 and 90 <= got[1].changed_px <= 160 and got[1].total_px == 600


@pytest.mark.parametrize(("size", "more"), [(3, {}), (7, {"cooldown_frames": 9}), (16, {"warmup_ms": 2500}), (5, {"min_active_ms": 600, "cooldown_frames": 40})])
def test_stretches_carry_the_state(spark, monkeypatch, size, more):
    monkeypatch.setattr(stretches, "SIZE", size)
    rng = np.random.default_rng(size)
    p = DetectParams(**(P.__dict__ | more))
    rows, want = [], {}
    for v in range(6):
        ratios = np.round(np.clip(rng.normal(0.45, 0.35, 150), 0, 1), 3)
        ratios[40:70], ratios[90:99] = 0.9, 0.0  # an event and a gap longer than a stretch
        want[v] = loop(ratios.tolist(), p, FPS)
        rows += [(v, i + 1, int(r * 1000), 1000) for i, r in enumerate(ratios.tolist())]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, changed_px long, total_px long")
    got = {v: [] for v in want}
    for r in signal.motion_events(df, p, FPS).orderBy("video_id", "t_ms").collect():
        got[r.video_id].append(r.t_ms)
    assert got == want
    traced = signal.motion_trace(df, p, FPS).collect()
    monkeypatch.setattr(stretches, "SIZE", 100_000)
    assert sorted(traced) == sorted(signal.motion_trace(df, p, FPS).collect())


def test_one_video_runs_in_many_tasks(spark, monkeypatch):
    """A signal of 400,000 frames in 49 stretches: events as the loop finds them, and no task folds more than a stretch."""
    n = 400_000
    df = spark.range(1, n + 1).select(
        F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_idx"), (F.pmod(F.xxhash64("id"), F.lit(600)) + 400 * (F.col("id") % 5000 < 1500).cast("long")).alias("changed_px"), F.lit(1000).cast("long").alias("total_px")
    )
    ratios = [r.changed_px / 1000 for r in df.orderBy("frame_idx").select("changed_px").collect()]
    p = DetectParams(**(P.__dict__ | {"min_active_ms": 500, "cooldown_frames": 20}))
    want = loop([(r * 1000 + 0.5) // 1 / 1000 for r in ratios], p, FPS)
    got = sorted(r.t_ms for r in signal.motion_events(df, p, FPS).collect())
    assert len(want) > 80 and got == sorted(want)
    cut = stretches.grouped_from(signal.moving(df, p, FPS), "video_id", F.col("frame_idx"))
    sizes = [r[0] for r in cut.select(F.size("frames")).collect()]
    assert len(sizes) == 49 and max(sizes) <= stretches.SIZE
