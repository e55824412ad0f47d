import numpy as np
import pytest
from pyspark.sql import functions as F

from tripwise.sources import frames

W, H, N = 6, 4, 50
SCHEMA = "path string, frame_idx long, width int, height int, gray binary"


def picture(v, i):
    return bytes(((v * 31 + i * 7 + k) % 256) for k in range(W * H))


@pytest.fixture
def folder(spark, tmp_path):
    rows = [(f"a/v{v}.y4m", i, W, H, bytearray(picture(v, i))) for v in range(3) for i in reversed(range(N))]
    frames.write_frames(spark.createDataFrame(rows, SCHEMA), str(tmp_path), "10:1")
    return tmp_path


def test_frames_come_back(spark, folder):
    assert sorted(p.name for p in folder.rglob("*") if p.is_file()) == [f"v{v}.y4m" for v in range(3)]
    got = {(r.path[-4 - 2 :], r.frame_idx): r for r in frames.read_frames(spark, str(folder)).collect()}
    assert len(got) == 3 * N
    for v in range(3):
        for i in range(N):
            r = got[f"v{v}.y4m", i]
            assert bytes(r.gray) == picture(v, i) and (r.ms, r.width, r.height) == (i * 100, W, H)


def reader(folder, filters=(), **options):
    r = frames.FrameReader({"path": str(folder), **{k: str(v) for k, v in options.items()}})
    assert len(list(r.pushFilters(list(filters)))) == len(filters)
    return r


def read(r):
    return [row["frame_idx"] for part in r.partitions() for b in r.read(part) for row in b.to_pylist()]


def test_only_wanted_frames_are_read(spark, folder):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    one = folder / "a/v1.y4m"
    col = ("frame_idx",)
    assert read(reader(one, step=7)) == list(range(0, N, 7))
    assert read(reader(one, maxms=1000)) == list(range(10)) and read(reader(one, maxms=0)) == []
    assert read(reader(one, [GreaterThan(col, 5), LessThanOrEqual(col, 12)], step=2)) == [6, 8, 10, 12]
    assert read(reader(one, [In(col, (3, 40, 99, 4))])) == [3, 4, 40] and read(reader(one, [EqualTo(col, 70)])) == []
    parts = reader(one, partbytes=5 * (W * H + 6), step=2).partitions()
    assert [(p.first, p.last) for p in parts] == [(k, min(N, k + 10)) for k in range(0, N, 10)]  # byte ranges of five frames
    plan = frames.read_frames(spark, str(folder), step=2).filter("frame_idx BETWEEN 3 AND 9 AND width = 6")
    assert sorted({r.frame_idx for r in plan.collect()}) == [4, 6, 8]


def test_colour_planes_rates_and_damage(spark, tmp_path):
    luma = [picture(9, i) for i in range(5)]
    (tmp_path / "c.y4m").write_bytes(b"YUV4MPEG2 W6 H4 F30000:1001 Ip C420jpeg\n" + b"".join(b"FRAME\n" + x + bytes(W * H // 2) for x in luma))
    (tmp_path / "norate.y4m").write_bytes(b"YUV4MPEG2 W6 H4 F0:0 C444\n" + b"".join(b"FRAME\n" + x + bytes(2 * W * H) for x in luma))
    (tmp_path / "cut.y4m").write_bytes(b"YUV4MPEG2 W6 H4 Cmono\nFRAME\n" + luma[0] + b"FRAME\n" + luma[1][:5])
    (tmp_path / "bad.y4m").write_bytes(b"RIFF....")
    (tmp_path / "empty.y4m").write_bytes(b"")
    (tmp_path / "broken.y4m").write_bytes(b"YUV4MPEG2 W6 H4 Cmono\nFRAME\n" + luma[0] + b"XXXXX\n" + luma[1] + b"FRAME\n" + luma[2])
    got = {}
    for r in frames.read_frames(spark, str(tmp_path)).orderBy("path", "frame_idx").collect():
        got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.frame_idx, r.ms, bytes(r.gray)))
    assert [g[2] for g in got["c.y4m"]] == luma and [g[1] for g in got["c.y4m"]] == [int(i / (30000 / 1001) * 1000) for i in range(5)]
    assert [g[1] for g in got["norate.y4m"]] == [0, 40, 80, 120, 160] and [g[2] for g in got["norate.y4m"]] == luma
    assert len(got["cut.y4m"]) == len(got["broken.y4m"]) == 1 and not {"bad.y4m", "empty.y4m"} & set(got)
    assert frames.read_frames(spark, str(tmp_path / "none")).count() == 0


def test_a_failed_write_leaves_no_file(spark, tmp_path):
    rows = [(f"v{v}.y4m", i, W, H, bytearray(picture(v, i))) for v in range(4) for i in range(5)]
    bad = spark.createDataFrame(rows, SCHEMA).withColumn("gray", F.when((F.col("path") == "v2.y4m") & (F.col("frame_idx") == 4), F.raise_error(F.lit("lost")).cast("binary")).otherwise(F.col("gray")))
    with pytest.raises(Exception, match="lost"):
        frames.write_frames(bad, str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_stacks_equal_single_pictures(spark):
    from tripwise.operators import signal

    rng = np.random.default_rng(5)
    stack = rng.integers(0, 256, (4, 9, 7)).astype(np.uint8)
    assert (signal.blurred(stack) == np.stack([signal.blurred(x) for x in stack])).all()
    assert (signal.opened(stack > 100, 3) == np.stack([signal.opened(x > 100, 3) for x in stack])).all()
