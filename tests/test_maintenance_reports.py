from pyspark.sql import functions as F

from tripwise.config import OcrParams
from tripwise.operators import maintenance, ocr
from tripwise.plans import reports
from tripwise.sources import views


def test_camera_log(spark):
    rows = [
        (1, 1, "insert", "Cam", "u1", True, None, None),
        (2, 2, "insert", "cam", "u2", True, None, None),
        (3, 1, "health", None, None, None, 100, None),
        (4, 1, "health", None, None, None, None, "timeout"),
        (5, 2, "active", None, None, False, None, None),
        (6, 3, "insert", "x", "u3", True, None, None),
        (7, 3, "delete", None, None, None, None, None),
        (8, 2, "health", None, None, None, 300, None),
    ]
    log = spark.createDataFrame(rows, "seq long, id long, op string, name string, url string, active boolean, last_seen_at long, last_error string")
    state = {r.id: r for r in maintenance.camera_state(log).collect()}
    assert set(state) == {1, 2}
    assert (state[1].last_seen_at, state[1].last_error) == (None, "timeout")
    assert (state[2].active, state[2].last_seen_at, state[2].last_error) == (False, 300, None)
    assert [tuple(r) for r in maintenance.name_conflicts(maintenance.camera_state(log)).collect()] == [("cam", 2)]


def test_queue_log(spark):
    rows = [(1, 1, "enqueue", None), (2, 1, "start", None), (3, 1, "progress", 150), (4, 1, "cancel", None), (5, 2, "enqueue", None), (6, 2, "cancel", None), (7, 3, "enqueue", None)]
    log = spark.createDataFrame(rows, "seq long, task_id long, op string, progress int")
    got = {r.task_id: (r.status, r.progress) for r in maintenance.queue_state(log).collect()}
    assert got == {1: ("RUNNING", 100), 2: ("CANCELED", 0), 3: ("PENDING", 0)}


def test_ingest(spark):
    rows = [(0, "/u/a/x.mp4", "one"), (1, "/u/b/x.mp4", "two"), (2, "/u/c/y.mkv", "one"), (3, "/u/c/z.txt", "three"), (4, "/u/d/w.ts", None)]
    files = spark.createDataFrame(rows, "ord long, path string, content string")
    videos = maintenance.matching_files(files, ["**/*.mp4", "**/*.mkv", "**/*.ts"])
    assert sorted(r.ord for r in videos.collect()) == [0, 1, 2, 4]
    none = spark.createDataFrame([], "sha256 string")
    fresh = maintenance.new_files(videos, none)
    assert sorted(r.ord for r in fresh.collect()) == [0, 1, 4]
    assert [tuple(r) for r in maintenance.inbox_collisions(fresh).collect()] == [("x.mp4", 2, "/u/b/x.mp4")]
    known = fresh.filter("ord = 0").select("sha256")
    assert sorted(r.ord for r in maintenance.new_files(videos, known).collect()) == [1, 4]


def test_text_sources(spark):
    lines = spark.createDataFrame([("abc /p q.mp4 duration=12ms",), ("nospace",), (" lead",)], "value string")
    assert [tuple(r) for r in views.manifest_lines(lines).collect()] == [("abc", "/p q.mp4", 12)]
    lines = spark.createDataFrame([(0, "Video_Path,t,d,e"), (1, "/a.mp4,5,d1,e1"), (2, "/a.mp4,5"), (3, "/b.mp4,x,d,e,more")], "ord long, value string")
    got = views.snapshot_lines(lines).orderBy("ord").collect()
    assert [(r.video_path, r.t_ms) for r in got] == [("/a.mp4", 5), ("/b.mp4", None)]


def test_paths_to_plates(spark):
    rows = [(1, 0, "A123BC"), (1, 1, "AB1234"), (2, 0, "A123BC"), (2, 1, "AB1234"), (2, 5, "AB1234CD"), (2, 7, "XX1234YY")]
    df = spark.createDataFrame(rows, "event long, roi_idx int, raw string")
    got = {r.event: r.plate for r in ocr.best_plates(df, "event", OcrParams()).collect()}
    assert got == {1: "AB1234", 2: "AB1234CD"}
    rows = [(1, 0, "AAA1", 90.9), (1, 1, "BBB2", 90.5), (1, 2, "CC", 99.0)]
    df = spark.createDataFrame(rows, "event long, roi int, text string, conf double")
    assert ocr.best_tokens(df, "event", "roi").first().text == "BBB2"
    sizes = spark.createDataFrame([(640, 480), (640, 480), (1, 1)], "width int, height int")
    assert {(r.width, r["count"]) for r in ocr.roi_grid(sizes).groupBy("width").count().collect()} == {(640, 324), (1, 324)}


def test_page_fallback_and_filter(spark):
    pages = spark.createDataFrame([(0, 0), (1, 10), (2, 10)], "page int, total long")
    assert [r.shown for r in reports.page_fallback(pages, 10).orderBy("page").collect()] == [0, 0, 1]
    rows = spark.createDataFrame([("#1 | 3 ev",), ("#2 | 4 ev",)], "row_text string")
    assert reports.text_filter(rows, "row_text", "  3 EV ").count() == 1 and reports.text_filter(rows, "row_text", " ").count() == 2
    empty = spark.createDataFrame([], "id int, video_id int, merge_ms int, events_count int, created_at timestamp")
    week = reports.week_agg(empty).orderBy("iso").collect()
    assert [r.detections for r in week] == [0] * 7 and week[0].day == "MONDAY"
    assert reports.week_heatmap(empty).agg(F.max("width")).first()[0] == 40
