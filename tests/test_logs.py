import random

from tripwise.streaming import logs
from tripwise.streaming import trips as streamed


def read(folder, start, end, part):
    r = logs.CameraLogReader({"path": str(folder), "partbytes": str(part)})
    return [tuple(row.values()) for p in r.partitions(start, end) for b in r.read(p) for row in b.to_pylist()]


def test_ranges_of_any_size_give_each_line_once(tmp_path, monkeypatch):
    monkeypatch.setattr(logs, "BLOCK", 7)
    rng = random.Random(3)
    lines = [f"{rng.choice([1, 22, 333, 4444444])}{rng.choice(['', ',late', ',' + 'x' * 40, ',é,b'])}" for _ in range(60)]
    (tmp_path / "5.log").write_text("\n".join(lines) + "\n77,half")
    end = logs.CameraLogReader({"path": str(tmp_path)}).latestOffset()
    whole = (tmp_path / "5.log").read_bytes()
    assert end == {"5.log": len(whole) - len(b"77,half")}
    want = [(int(t), e or None) for t, _, e in (line.partition(",") for line in lines)]
    for part in (1, 2, 3, 8, 50, 10_000):
        assert [(r[1], r[3]) for r in read(tmp_path, {}, end, part)] == want
    cut = whole.index(b"\n", 100) + 1  # an offset ends where a line does
    assert len(read(tmp_path, {}, {"5.log": cut}, 11)) + len(read(tmp_path, {"5.log": cut}, end, 11)) == len(want)


def test_what_is_no_line_of_a_camera(tmp_path):
    (tmp_path / "1.log").write_bytes(b"\n\nx\n12\r\n-3,\n1.5\n\xff,e\n99999999999999999\n999999999999999\n4,\xff\n")
    (tmp_path / "a.log").write_text("1\n")
    (tmp_path / "2.txt").write_text("1\n")
    (tmp_path / "3.log").write_text("no end")
    (tmp_path / "4.log").write_text("")
    r = logs.CameraLogReader({"path": str(tmp_path)})
    assert r.latestOffset().keys() == {"1.log", "3.log", "4.log"} and r.latestOffset()["3.log"] == 0
    assert [(c, t, e) for c, t, _, e in read(tmp_path, {}, r.latestOffset(), 6)] == [(1, 12, None), (1, -3, None), (1, 4, "�")]
    assert logs.CameraLogReader({"path": str(tmp_path / "none")}).latestOffset() == {}
    assert read(tmp_path, {"1.log": 5000}, r.latestOffset(), 6) == []  # shorter than before


def test_a_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    folder, at = tmp_path / "logs", tmp_path / "at"
    folder.mkdir()
    want = []

    def add(camera, ts, tail=""):
        with open(folder / f"{camera}.log", "a") as f:
            f.write("".join(f"{t}\n" for t in ts) + tail)
        want.extend((camera, t) for t in ts)

    def run():
        streamed.run_to_end(logs.read_logs(spark, str(folder), partBytes=9), "append", str(at))
        return sorted((r.camera_id, r.t_ms) for r in spark.read.parquet(str(at / "out")).collect())

    add(1, range(100, 140), "14")
    add(2, [5])
    assert run() == sorted(want)
    assert run() == sorted(want)  # nothing new
    with open(folder / "1.log", "a") as f:
        f.write("0\n")  # ends the line that was half there
    want.append((1, 140))
    add(3, [7, 7, 8])  # a new camera, and lines that are equal
    add(2, [6])
    assert run() == sorted(want)
