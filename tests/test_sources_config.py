"""Readers, writers, configuration, hooks: what no query over the driver's tables reaches."""

import datetime

import pytest
from pyspark.sql import Observation, Window
from pyspark.sql import functions as F

from tripwise import config, schemas
from tripwise.operators import maintenance, ocr
from tripwise.sources import views
from tripwise.streaming import trips as streamed

AT = datetime.datetime(2024, 1, 1)


def test_settings_take_precedence(spark, tmp_path):
    file = tmp_path / "application.yaml"
    file.write_text("# settings\ndetect:\n  step_frames: 7   # frames\n  ema_alpha: 0.5\n  trace: 'true'\nother: 1\nstep_frames: 9\n")
    assert config.settings_of(file.read_text().splitlines()) == {
        "detect.step_frames": "7", "detect.ema_alpha": "0.5", "detect.trace": "true", "other": "1", "step_frames": "9"
    }
    assert config.resolved(spark.conf, str(tmp_path / "none.yaml")) == config.SHIPPED.clamped()
    got = config.resolved(spark.conf, str(file))
    assert (got.step_frames, got.ema_alpha, got.trace, got.merge_ms) == (7, 0.5, True, config.SHIPPED.merge_ms)
    spark.conf.set("tripwise.detect.step_frames", "3")
    spark.conf.set("tripwise.config", str(file))
    try:
        got = config.resolved(spark.conf)
        assert (got.step_frames, got.ema_alpha) == (3, 0.5)
        assert config.resolved(spark.conf, step_frames=0, defaults=config.LEGACY6).step_frames == 1
    finally:
        spark.conf.unset("tripwise.detect.step_frames")
        spark.conf.unset("tripwise.config")
    assert config.LEGACY6.trace and config.LEGACY6.min_changed_pixels == 5000


def test_arguments():
    assert config.parse_args(["--a=1", "b", "--c", "-d=4", "--e=x=y", "--a=2", "--f="]) == {"a": "2", "e": "x=y", "f": ""}


def test_video_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    for name in ("a.mp4", "sub/b.mkv", "sub/c.txt", "d.ts"):
        (tmp_path / name).write_bytes(b"x" * 3)
    got = sorted(r.path.rsplit("/", 1)[1] for r in views.video_files(spark, str(tmp_path)).select("path").collect())
    assert got == ["a.mp4", "b.mkv", "d.ts"]


def test_database_tables_are_read_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").alias("ID"), (F.col("id") * 2).alias("TWICE"))
    derby = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable="T", **derby).save()
    whole, ranged = views.jdbc_table(spark, url, "T", **derby), views.jdbc_table(spark, url, "T", key='"ID"', tasks=4, **derby)
    assert ranged.rdd.getNumPartitions() == 4 and whole.rdd.getNumPartitions() == 1
    assert sorted(map(tuple, ranged.collect())) == sorted(map(tuple, whole.collect())) == [(i, 2 * i) for i in range(100)]
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="EMPTY", **derby).save()
    assert views.jdbc_table(spark, url, "EMPTY", key='"ID"', **derby).count() == 0


def test_detections_are_inserted_once(spark):
    existing = spark.createDataFrame([(5, 1, 1000, 0, AT)], schemas.DETECTIONS)
    rows = [
        (1, 1, 1000, [1], None, AT),  # exists
        (2, 1, 2000, [10, 20, 30], ["A1", " "], AT),
        (3, 1, 2000, [40], ["B2"], AT),  # taken by request 2
        (4, 2, 1000, [], None, AT),
        (5, 3, 1000, None, None, AT),
    ]
    asked = spark.createDataFrame(rows, "request_id int, video_id int, merge_ms int, stamps array<long>, plates array<string>, created_at timestamp")
    detections, events = maintenance.inserted(existing, asked)
    assert sorted((r.id, r.video_id, r.merge_ms, r.events_count) for r in detections.collect()) == [(7, 1, 2000, 3), (9, 2, 1000, 0), (10, 3, 1000, 0)]
    assert sorted((r.detection_id, r.t_ms, r.plate) for r in events.collect()) == [(7, 10, "A1"), (7, 20, None), (7, 30, None)]
    assert sorted(r.request_id for r in maintenance.refused(existing, asked).collect()) == [1, 3]
    with pytest.raises(Exception, match="created_at is null"):
        schemas.conform(existing.withColumn("created_at", F.lit(None)), schemas.DETECTIONS).collect()


def test_manifest_grows_by_new_files(spark, tmp_path):
    at = f"{tmp_path}/manifest"
    files = spark.createDataFrame([(0, "/u/x.mp4", "one"), (1, "/u/y.mp4", "two"), (2, "/u/z.mp4", "one")], "ord long, path string, content string")
    spark.createDataFrame([("# header",)], "value string").write.text(at)
    for grown in (2, 0):
        fresh = maintenance.new_files(files, views.manifest_lines(spark.read.text(at)).filter("duration_ms IS NOT NULL"))
        assert fresh.count() == grown
        for _ in range(2):  # a call that is repeated
            maintenance.append_manifest(fresh, F.lit(1500), at)
    got = views.manifest_lines(spark.read.text(at)).filter("duration_ms = 1500").collect()
    assert sorted(r.path for r in got) == ["/u/x.mp4", "/u/y.mp4"]


def test_ingest_copies_new_contents_once(spark, tmp_path):
    usb, inbox, manifest = tmp_path / "usb stick", tmp_path / "inbox", tmp_path / "manifest"
    for name, content in {"a/x 1.mp4": b"one", "b/x 1.mp4": b"two", "b/y.ts": b"one", "c/z.mkv": b"\xff\x00", "c/n.txt": b"no video"}.items():
        (usb / name).parent.mkdir(parents=True, exist_ok=True)
        (usb / name).write_bytes(content)

    def run():
        walked = views.video_files(spark, str(usb)).withColumn("ord", F.row_number().over(Window.orderBy("path")))
        return sorted(r.path.rpartition("usb stick/")[2] for r in maintenance.ingest(walked, F.lit(40), str(manifest), str(inbox)).collect())

    assert run() == ["a/x 1.mp4", "b/x 1.mp4", "c/z.mkv"]
    want = {"x 1.mp4": b"two", "z.mkv": b"\xff\x00"}  # of one name the last walked
    assert {p.name: p.read_bytes() for p in inbox.iterdir()} == want
    assert run() == [] and len(list(manifest.iterdir())) == 1
    (usb / "d.mp4").write_bytes(b"three")
    assert run() == ["d.mp4"] and {p.name for p in inbox.iterdir()} == {*want, "d.mp4"}
    lines = maintenance.known_lines(spark, str(manifest)).collect()
    assert len(lines) == 4 and {r.duration_ms for r in lines} == {40} and any(r.path.endswith("/b/x 1.mp4") for r in lines)


def test_regions_are_read_by_a_backend(spark):
    class Backend:
        def words(self, png: bytes) -> list[tuple[str, float]]:
            if png == b"bad":
                raise OSError("no image")
            return [(w, 90.5) for w in png.decode().split()]

    rows = [(1, 0, 0, b"AB1234CD x"), (1, 0, 1, b"bad"), (1, 1, 0, None), (2, 0, 0, b"A123BC")]
    regions = spark.createDataFrame(rows, "event long, offset_ord int, roi_idx int, png binary")
    perf = Observation()
    ocr.observed(ocr.read_tokens(regions, Backend()), perf).write.format("noop").mode("overwrite").save()
    assert perf.get == {"rows": 5, "words": 3, "conf": 90.5}
    got = ocr.read_tokens(regions, Backend())
    assert sorted((r.event, r.roi_idx, r.raw or "") for r in got.collect()) == [(1, 0, ""), (1, 0, "AB1234CD"), (1, 0, "x"), (1, 1, ""), (2, 0, "A123BC")]
    plates = {r.event: r.plate for r in ocr.best_plates(got, "event", config.OcrParams()).collect()}
    assert plates == {1: "AB1234CD", 2: "A123BC"}


def test_queue_hooks(spark, tmp_path):
    tasks = spark.createDataFrame([(1, "PENDING"), (2, "RUNNING"), (3, "DONE")], "task_id long, status string")
    calls = tmp_path / "calls"
    calls.mkdir()
    at = str(calls)

    def work(task: int) -> None:
        import uuid

        with open(f"{at}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(task))
        if task == 2:
            raise ValueError("y" * 3000)

    log = maintenance.processed(tasks, work)
    got = sorted((r.task_id, r.op, r.progress, len(r.error or "")) for r in log.collect())
    assert got == [(1, "done", 100, 0), (1, "start", 0, 0), (2, "fail", 0, 1000), (2, "start", 0, 0)]
    log.write.parquet(f"{tmp_path}/log")
    assert log.count() == 4 and len(list(calls.iterdir())) == 2  # three actions on the log, each task worked once
    seen = []
    stream = spark.readStream.schema(log.schema).parquet(f"{tmp_path}/log")
    maintenance.notify(stream, lambda batch, epoch: seen.extend(r.op for r in batch.collect()), f"{tmp_path}/c").awaitTermination()
    assert sorted(seen) == ["done", "fail", "start", "start"]


def test_a_batch_run_again_replaces_itself(spark, tmp_path):
    sink = streamed.batches_to(f"{tmp_path}/out")
    for epoch in (0, 1, 1):
        sink(spark.range(3), epoch)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6
