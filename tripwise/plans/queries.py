"""One query per operator over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FPS, HOUR_MS, SERIES, DetectParams, OcrParams
from ..functions import plates, text
from ..operators import maintenance, ocr, sequence, signal
from ..scratch import new_folder
from ..sources import files, frames, store, upgrade, views
from ..streaming import live, logs, queue
from ..streaming import trips as streamed
from . import reports

TRIP_GAP = 6 * HOUR_MS
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def plated(s, d) -> DataFrame:
    """Events of the series with normalised plates, keyed as detections."""
    return views.series(s, d).select(F.col("video_id").alias("detection_id"), "t_ms", plates.normalize(F.col("raw")).alias("plate"))


def now(s, d) -> DataFrame:
    return views.table(s, d, "orders").agg(F.max("o_orderdate").alias("now"))


# Trips and other sequences


@query
def trips(s, d):
    return sequence.trips(plated(s, d), "detection_id", TRIP_GAP)


@query
def trips_time_only(s, d):
    return sequence.trips(plated(s, d), "detection_id", TRIP_GAP, with_plates=False)


@query
def trip_plate_vote(s, d):
    return sequence.votes(sequence.with_trips(plated(s, d), "detection_id", 40 * HOUR_MS), "detection_id")


@query
def nms_events(s, d):
    return sequence.suppress(plated(s, d), "detection_id", SERIES.nms_window_ms)


@query
def merge_events(s, d):
    return sequence.merge(plated(s, d), "detection_id", SERIES.nms_window_ms, SERIES.merge_ms)


@query
def heartbeat_throttle(s, d):
    return sequence.throttled(views.series(s, d).select("video_id", "t_ms"), "video_id", 12 * HOUR_MS)


# Motion signal


@query
def motion_filter(s, d):
    return signal.moving(views.series(s, d), SERIES, FPS).select("video_id", "frame_idx", "ms", "ratio")


@query
def motion_trace(s, d):
    return signal.motion_trace(views.series(s, d), SERIES, FPS)


@query
def motion_trace_lines(s, d):
    return signal.trace_lines(signal.motion_trace(views.series(s, d), SERIES, FPS))


@query
def motion_ema(s, d):
    return signal.motion_trace(views.series(s, d), SERIES, FPS).select("video_id", "frame", "ema")


@query
def motion_events(s, d):
    return signal.motion_events(views.series(s, d), SERIES, FPS)


@query
def motion_events_warmup(s, d):
    p = DetectParams(**(SERIES.__dict__ | {"warmup_ms": 1000, "max_ms": 2200}))
    return signal.motion_events(views.series(s, d), p, FPS)


# Reports


@query
def summary_counts(s, d):
    return reports.summary_counts(views.videos(s, d), views.detections(s, d), views.detection_events(s, d))


@query
def week_agg(s, d):
    return reports.week_agg(views.detections(s, d))


@query
def week_heatmap(s, d):
    return reports.week_heatmap(views.detections(s, d))


@query
def daily_agg(s, d):
    return reports.daily_agg(views.detections(s, d), now(s, d), 30)


@query
def daily_agg_year(s, d):
    return reports.daily_agg(views.detections(s, d), now(s, d), 365)


@query
def video_agg(s, d):
    return reports.video_agg(views.detections(s, d), views.videos(s, d), 20)


@query
def merge_agg(s, d):
    return reports.merge_agg(views.detections(s, d))


@query
def detections_page(s, d):
    return reports.detections_page(views.detections(s, d), views.videos(s, d), 50, 100)


@query
def recent_detections(s, d):
    return reports.recent_detections(views.detections(s, d), views.videos(s, d), 200)


@query
def report_text_filter(s, d):
    return reports.text_filter(reports.recent_detections(views.detections(s, d), views.videos(s, d), 500), "row_text", " 3 EV ")


@query
def page_info(s, d):
    return reports.page_info(views.detections(s, d).agg(F.count(F.lit(1)).alias("total")), 3, 200)


@query
def page_fallback(s, d):
    total = views.detections(s, d).agg(F.count(F.lit(1)).alias("total"))
    pages = s.createDataFrame([(p,) for p in (0, 1, 74, 75, 76, 10_000)], "page int")
    return reports.page_fallback(pages.crossJoin(total), 200)


@query
def events_of_detection(s, d):
    return views.detection_events(s, d).filter("detection_id = 3").orderBy("t_ms")


@query
def video_path_of_detection(s, d):
    return reports.joined(views.detections(s, d).filter("id = 3"), views.videos(s, d)).select("id", "path")


@query
def event_preview(s, d):
    return reports.event_preview(views.detection_events(s, d), "detection_id", 3)


@query
def events_csv_lines(s, d):
    path = reports.joined(views.detections(s, d).filter("id = 3"), views.videos(s, d)).select("path")
    return reports.events_csv_lines(3, path, views.detection_events(s, d).filter("detection_id = 3"))


@query
def report_csv_lines(s, d):
    det, vid = views.detections(s, d), views.videos(s, d)
    summary = reports.summary_counts(vid, det, views.detection_events(s, d))
    return reports.report_csv_lines(summary, reports.daily_agg(det, now(s, d), 365), reports.video_agg(det, vid, 1000))


@query
def snapshot_plan(s, d):
    """Where each event's picture goes and the time it is taken at."""
    events = views.detection_events(s, d)
    full = reports.joined(views.detections(s, d).withColumnRenamed("id", "detection_id").join(events, "detection_id"), views.videos(s, d))
    return full.select(
        "path",
        "detection_id",
        "t_ms",
        F.greatest(F.lit(0), F.col("t_ms") - 700).cast("bigint").alias("seek_ms"),
        F.format_string("out/%s/det_%d/event_%d.jpg", text.base_name(F.col("path")), "detection_id", "t_ms").alias("target"),
    )


@query
def snapshot_tally(s, d):
    """Pictures of the plan that lie within their video, and those that do not."""
    lasts = views.videos(s, d).select("path", (text.frame_ms(F.col("frames"), text.known_fps(F.col("fps"))) * 50).alias("lasts_ms"))
    return reports.snapshot_tally(snapshot_plan(s, d).join(lasts, "path"), F.col("lasts_ms"))


@query
def snapshot_sql(s, d):
    """Events of a user's own SQL over the stored tables."""
    reports.joined(views.detections(s, d).withColumnRenamed("id", "detection_id"), views.videos(s, d)).createOrReplaceTempView("stored_detections")
    views.detection_events(s, d).createOrReplaceTempView("stored_events")
    user_sql = "SELECT path, t_ms, detection_id AS d, t_ms % 10 FROM stored_detections JOIN stored_events USING (detection_id) WHERE merge_ms = 1000"
    return views.sql_events(s, user_sql)


@query
def detection_event_counts(s, d):
    """Stored event counts that differ from the events there are: each seventh detection has lost one."""
    stored = (F.col("events_count") + F.when(F.col("id") % 7 == 0, 1).otherwise(0)).alias("events_count")
    real = views.detection_events(s, d).groupBy(F.col("detection_id").alias("id")).agg(F.count(F.lit(1)).alias("real"))
    both = views.detections(s, d).select("id", stored).join(real, "id", "left").select("events_count", F.coalesce("real", F.lit(0)).alias("real"))
    return both.groupBy("events_count").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("real") != F.col("events_count")).alias("wrong"))


# Scalars


def raws(s, d):
    return views.series(s, d).select("event_id", "raw", "k")


@query
def plate_normalize(s, d):
    return raws(s, d).select("event_id", "raw", plates.normalize(F.col("raw")).alias("plate"))


@query
def plate_normalize_region(s, d):
    with_region = F.concat("raw", (F.col("event_id") % 1000).cast("string"))
    return raws(s, d).select("event_id", plates.normalize(with_region, include_region=True).alias("plate"))


@query
def plate_kind(s, d):
    return raws(s, d).select("event_id", plates.kind(F.coalesce(plates.normalize(F.col("raw")), F.lit(""))).alias("kind"))


@query
def plate_shape_score(s, d):
    return raws(s, d).select("event_id", plates.shape_score(F.coalesce(plates.compact(F.col("raw")), F.lit(""))).alias("score"))


@query
def plate_loose_equal(s, d):
    plate = F.coalesce(plates.normalize(F.col("raw")), F.lit(""))
    return raws(s, d).select("event_id", plates.loose_equal(plate, F.translate(plate, "AO", "HH")).alias("same"))


@query
def fmt_ms(s, d):
    return views.series(s, d).select("event_id", text.fmt_ms(F.col("t_ms") % 500_000_000).alias("clock"))


def urls(s, d):
    masked = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://u:p@")).when(
        F.col("page_id") % 3 == 1, F.regexp_replace("url", "://", "://u@")
    )
    return views.table(s, d, "pages").select("page_id", F.coalesce(masked, F.col("url")).alias("url"))


@query
def mask_url(s, d):
    return urls(s, d).select("page_id", text.mask_url(F.col("url")).alias("masked"))


@query
def camera_url_class(s, d):
    both = urls(s, d).select("page_id", "url").unionByName(views.cameras(s, d).select(F.col("id").alias("page_id"), "url"))
    return both.select("page_id", "url", text.url_class(F.col("url")).alias("kind"))


@query
def parse_detection_id(s, d):
    rows = reports.joined(views.detections(s, d), views.videos(s, d)).select("id", reports.row_text().alias("row_text"))
    line = F.when(F.col("id") % 5 == 0, F.concat(F.lit("x"), "row_text")).when(F.col("id") % 5 == 1, F.replace("row_text", F.lit(" |"), F.lit(""))).otherwise(F.col("row_text"))
    return rows.select("id", text.parse_detection_id(line).alias("parsed"))


@query
def ocr_token_clean(s, d):
    return raws(s, d).select("event_id", plates.clean_token(F.concat("raw", F.lit("-"))).alias("token"))


@query
def camera_error_text(s, d):
    return views.table(s, d, "pages").select("page_id", text.error_text(F.col("html")).alias("last_error"))


@query
def ocr_line_fold(s, d):
    return views.table(s, d, "pages").select("page_id", text.fold_lines(F.col("html")).alias("line"))


@query
def parallel_lists(s, d):
    """Events of parallel lists of times and plates; each third video has no list of plates."""
    lists = plated(s, d).groupBy("detection_id").agg(F.array_sort(F.collect_list(F.struct("t_ms", F.coalesce("plate", F.lit("")).alias("plate")))).alias("e"))
    names = F.when(F.col("detection_id") % 3 > 0, F.transform("e", lambda e: e["plate"]))
    both = lists.select("detection_id", sequence.zipped(F.transform("e", lambda e: e["t_ms"]), names).alias("events"))
    return sequence.exploded(both, "detection_id")


@query
def undefined_plates(s, d):
    return raws(s, d).groupBy(text.plate_label(F.trim("raw")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# Plate reading


@query
def ocr_snapshot_frames(s, d):
    events = views.series(s, d).join(views.videos(s, d).select(F.col("id").alias("video_id"), "frames"), "video_id")
    return ocr.snapshot_frames(events.select("event_id", F.col("frame_idx").alias("mid_frame"), "frames"), FPS, "0,-4, x,4").select(
        "event_id", "offset_ord", "frame"
    )


@query
def roi_grid(s, d):
    """Regions of frames whose sizes the parts tell: their number times 16 wide, and 9 in 16 of that high."""
    width = (F.col("p_size") * 16 + 640).cast("int")
    return ocr.roi_grid(views.table(s, d, "part").select(width.alias("width"), F.floor(width * 9 / 16).cast("int").alias("height")))


@query
def roi_quality_gate(s, d):
    rois = views.series(s, d).select(
        "event_id", (F.col("changed_px") / 500_000).alias("contrast"), ((F.col("changed_px") % 1000) / 1000).alias("fill")
    )
    return ocr.quality_gate(rois, OcrParams()).select("event_id", "passes")


def tokens(s, d):
    """The series as tokens: each user's samples are the regions of 50-sample events."""
    return views.series(s, d).select(
        (F.col("video_id") * 10_000 + F.floor(F.col("frame_idx") / 50)).cast("bigint").alias("event"),
        (F.col("frame_idx") % 50).cast("int").alias("roi_idx"),
        (F.col("frame_idx") % 3).cast("int").alias("offset_ord"),
        "raw",
        (F.col("changed_px") / 5000).alias("conf"),
    )


@query
def ocr_budget(s, d):
    return ocr.within_budget(tokens(s, d), "event", OcrParams(max_calls=20)).select("event", "offset_ord", "roi_idx", F.col("call").cast("bigint").alias("call"))


@query
def roi_best_plate(s, d):
    return ocr.best_plates(tokens(s, d), "event", OcrParams(max_roi=40, stop_votes_min_len=6))


class Written:
    """A backend for pictures that hold their text as bytes."""

    def words(self, png: bytes) -> list[tuple[str, float]]:
        return [(png.decode(), 90.0)]


@query
def roi_read_in_rounds(s, d):
    """Plates as `roi_best_plate` finds them, and the regions read for each: fewer than there are where votes stop the reading."""
    regions = tokens(s, d).select("event", F.lit(0).alias("offset_ord"), "roi_idx", F.col("raw").cast("binary").alias("png"))
    return ocr.read_in_rounds(regions, Written(), OcrParams(max_roi=40, stop_votes_min_len=6))[0]


@query
def event_plate_first_offset(s, d):
    found = tokens(s, d).groupBy("event", "offset_ord").agg(F.max(plates.normalize(F.col("raw"))).alias("plate"))
    return ocr.first_offset_plates(found, "event")


@query
def ocr_best_token(s, d):
    return ocr.best_tokens(tokens(s, d).withColumn("text", plates.clean_token(F.col("raw"))), "event", "roi_idx")


@query
def ocr_choose_candidate(s, d):
    return ocr.choose_candidates(tokens(s, d).select("event", F.col("roi_idx").alias("ord"), plates.clean_token(F.col("raw")).alias("text")), "event")


@query
def otsu_threshold(s, d):
    level = F.floor(F.col("changed_px") / 2000).cast("int")
    return ocr.otsu(views.series(s, d).groupBy("video_id", level.alias("level")).agg(F.count(F.lit(1)).alias("n")), "video_id")


@query
def perf_summary(s, d):
    calls = tokens(s, d).groupBy("event").agg(
        F.count_if(F.col("raw").isNotNull()).alias("calls"), F.sum(F.floor(F.col("conf") * 10)).cast("bigint").alias("ms")
    )
    return calls.select("event", "calls", "ms", F.when(F.col("calls") > 0, F.expr("ms div calls")).otherwise(0).alias("avg_ms"))


# Ingest and maintenance


@query
def ingest_pattern_filter(s, d):
    return maintenance.matching_files(views.files(s, d), ["**/*.mp4", "**/*.mkv", "**/*.ts"]).select("ord", "path")


def manifest(s, d):
    known = views.files(s, d).filter("ord % 7 = 0")
    return known.select(
        F.col("ord"), F.concat(F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256), F.lit(" "), "path", F.lit(" duration=1200ms")).alias("value")
    )


@query
def manifest_parse(s, d):
    return views.manifest_lines(manifest(s, d))


@query
def manifest_append(s, d):
    """The manifest's lines once the new files are appended."""
    known = manifest(s, d)
    new = maintenance.new_files(views.files(s, d), views.manifest_lines(known))
    line = maintenance.manifest_line(F.col("sha256"), F.col("path"), F.col("ord") * 40)
    return known.select("value").unionByName(new.select(line.alias("value")))


@query
def ingest_new_files(s, d):
    return maintenance.new_files(views.files(s, d), views.manifest_lines(manifest(s, d)))


@query
def inbox_collisions(s, d):
    return maintenance.inbox_collisions(maintenance.new_files(views.files(s, d), views.manifest_lines(manifest(s, d))))


@query
def video_duration_ms(s, d):
    rate = F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("fps"))
    return views.videos(s, d).select("id", text.frame_ms(F.col("frames"), text.known_fps(rate)).alias("duration_ms"))


@query
def upsert_videos(s, d):
    log = views.detections(s, d).select(
        F.col("id").alias("seq"),
        "id",
        F.concat(F.lit("/inbox/"), (F.col("video_id") % 500).cast("string"), F.lit(".mp4")).alias("path"),
        (F.col("merge_ms") / 100).alias("fps"),
        F.col("events_count").alias("frames"),
        "created_at",
    )
    return maintenance.upsert_videos(log)


def requests(s, d) -> DataFrame:
    """A detection of each video to insert, with up to three events and at most two plates."""
    key = F.col("c_custkey")
    stamps = F.slice(F.array(*[(key * 1000 + n).cast("bigint") for n in (10, 20, 30)]), F.lit(1), (key % 4).cast("int"))
    names = F.slice(F.array(F.concat(F.lit("A"), key.cast("string")), F.lit(" ")), F.lit(1), (key % 3).cast("int"))
    return views.table(s, d, "customer").select(
        (key + 1).alias("request_id"),
        (key % 400).alias("video_id"),
        (1000 * (key % 7 + 1)).cast("int").alias("merge_ms"),
        stamps.alias("stamps"),
        F.when(key % 5 > 0, names).alias("plates"),
        F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"),
    )


@query
def insert_detections(s, d):
    return maintenance.inserted(views.detections(s, d), requests(s, d))[0].drop("created_at")


@query
def insert_detection_events(s, d):
    return maintenance.inserted(views.detections(s, d), requests(s, d))[1]


@query
def insert_detections_refused(s, d):
    return maintenance.refused(views.detections(s, d), requests(s, d)).select("request_id", "video_id", "merge_ms")


def stored(s, d) -> store.Store:
    """A store that holds the detections and their events."""
    held = store.Store(s, new_folder(s, "store"))
    rows = {"detections": views.detections(s, d), "events": views.detection_events(s, d).withColumn("plate", F.lit(None).cast("string"))}
    held.change("load", 0, lambda now: {name: held.appended(name, part, now) for name, part in rows.items()})
    return held


@query
def stored_detections(s, d):
    """Detections read back after requests were inserted twice by the same batch."""
    held = stored(s, d)
    for _ in range(2):
        store.insert_detections(held, requests(s, d), "app", 1)
    return held.read("detections").select("id", "video_id", "merge_ms", "events_count")


@query
def stored_events_left(s, d):
    """Stored events of each detection once the videos with an id divisible by 3 are deleted from the store."""
    held = stored(s, d)
    gone = views.detections(s, d).filter("video_id % 3 = 0").select("id")
    store.delete_detections(held, gone, "app", 1)
    return held.read("events").groupBy("detection_id").agg(F.count(F.lit(1)).alias("n"))


@query
def stored_videos(s, d):
    """Videos read back after each third was given again at another rate, together with some new ones."""
    held = store.Store(s, new_folder(s, "store"))
    first = views.videos(s, d).select("id", "path", "fps", "frames", F.expr("timestamp'2024-01-01 00:00:00'").alias("created_at"))
    store.upsert_videos(held, first.drop("id"), "app", 1)
    day = F.expr("timestamp'2024-01-02 00:00:00'")
    again = first.filter("id % 3 = 0").select("path", F.lit(30.0).alias("fps"), (F.col("frames") + 1).alias("frames"), day.alias("created_at"))
    new = first.filter("id % 5 = 0").select(F.concat(F.lit("/new/"), "id").alias("path"), "fps", "frames", day.alias("created_at"))
    store.upsert_videos(held, again.unionByName(new), "app", 2)
    return held.read("videos").select("id", "path", "fps", "frames", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query
def stored_upgrade(s, d):
    """A store of the first schema version that holds every detection, brought to the last: doubles and their events go, events get a plate."""
    old = store.Store(s, new_folder(s, "store"), upgrade.tables_of(1))
    rows = {"detections": views.detections(s, d), "events": views.detection_events(s, d)}
    old.change("load", 0, lambda now: {name: old.appended(name, part, now) for name, part in rows.items()})
    held = store.Store(s, old.root, upgrade.tables_of(upgrade.LAST))
    upgrade.upgrade(held)
    found = held.read("events").groupBy(F.col("detection_id").alias("id")).agg(F.count(F.lit(1)).alias("n_events"), F.count("plate").alias("n_plates"))
    kept = held.read("detections").join(found, "id", "left").select("id", "video_id", "merge_ms", F.coalesce("n_events", F.lit(0)).alias("n_events"), F.coalesce("n_plates", F.lit(0)).alias("n_plates"))
    return kept.withColumn("version", F.lit(upgrade.schema_version(held)))


@query
def dedup_detections(s, d):
    return maintenance.dedup_detections(views.detections(s, d))


@query
def detection_conflicts(s, d):
    return maintenance.detection_conflicts(views.detections(s, d)).select("id", "video_id", "merge_ms")


@query
def delete_detection_cascade(s, d):
    """Events left once the videos with an id divisible by 3 are deleted."""
    gone = views.videos(s, d).filter("id % 3 = 0")
    left = maintenance.delete_cascade(views.detections(s, d), gone, "video_id")
    lost = views.detections(s, d).join(left.select("id"), "id", "left_anti")
    events = maintenance.delete_cascade(views.detection_events(s, d), lost, "detection_id")
    return events.groupBy("detection_id").agg(F.count(F.lit(1)).alias("n"))


@query
def list_cameras(s, d):
    return views.cameras(s, d).orderBy("id")


def camera_log(s, d):
    """Every camera is inserted, then changed by the series' samples in order."""
    n = 40
    start = views.cameras(s, d).select(
        F.col("id").alias("seq"), (F.col("id") % n).alias("id"), F.lit("insert").alias("op"), "name", "url", "active",
        F.lit(None).cast("bigint").alias("last_seen_at"), F.lit(None).cast("string").alias("last_error"),
    )
    op = F.element_at(F.array(*[F.lit(x) for x in ("health", "health", "active", "edit", "health", "delete", "insert")]), (F.col("event_id") % 7 + 1).cast("int"))
    bad = F.col("event_id") % 3 == 0
    later = views.series(s, d).select(
        (F.col("event_id") + 1_000_000).alias("seq"),
        (F.col("event_id") * 31 % n).alias("id"),
        op.alias("op"),
        F.concat(F.lit("cam "), (F.col("k")).cast("string")).alias("name"),
        F.lit("rtsp://x").alias("url"),
        (F.col("event_id") % 2 == 0).alias("active"),
        F.when(~bad, F.col("t_ms")).alias("last_seen_at"),
        F.when(bad, "timeout").alias("last_error"),
    )
    return start.unionByName(later)


@query
def camera_state(s, d):
    return maintenance.camera_state(camera_log(s, d))


@query
def camera_name_conflicts(s, d):
    return maintenance.name_conflicts(maintenance.camera_state(camera_log(s, d)))


@query
def cameras_to_start(s, d):
    return maintenance.cameras_to_start(views.cameras(s, d), views.cameras(s, d).filter("id % 4 = 0")).select("id", "name")


def queue_log(s, d):
    op = F.element_at(F.array(*[F.lit(x) for x in ("enqueue", "start", "progress", "progress", "done", "cancel", "fail")]), (F.col("k") % 7 + 1).cast("int"))
    return views.series(s, d).select(
        F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 5).cast("bigint").alias("task_id"), op.alias("op"), (F.col("k") * 3 - 50).alias("progress")
    )


@query
def queue_state(s, d):
    return maintenance.queue_state(queue_log(s, d))


@query
def queue_unfinished(s, d):
    return maintenance.unfinished(maintenance.queue_state(queue_log(s, d))).select("task_id")


@query
def queue_processed(s, d):
    """The log of working off all unfinished tasks; each fifth one fails."""

    def work(task: int) -> None:
        if task % 5 == 0:
            raise ValueError(f"task {task} " + "x" * 2000)

    return maintenance.processed(maintenance.queue_state(queue_log(s, d)), work)


@query
def queue_progress(s, d):
    return queue_log(s, d).select("seq", text.clamp(F.col("progress"), 0, 100).cast("int").alias("progress"))


@query
def snapshot_csv_parse(s, d):
    lines = views.series(s, d).select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_id") == 0, "VIDEO_PATH,t,d,e")
        .when(F.col("k") % 10 == 0, F.concat(F.lit("/v.mp4,"), "t_ms"))
        .otherwise(F.concat(F.lit("/v"), "video_id", F.lit(".mp4,"), "t_ms", F.lit(","), "video_id", F.lit(","), "event_id"))
        .alias("value"),
    )
    return views.snapshot_lines(lines)


@query
def frame_differences(s, d):
    """Neighbouring vectors as frames: how many of their values differ by more than a threshold."""
    w = Window.partitionBy("label").orderBy("vec_id")
    pairs = views.table(s, d, "embeddings").select("vec_id", "embedding", F.lag("embedding").over(w).alias("before")).filter("before IS NOT NULL")
    moved = F.filter(F.zip_with("embedding", "before", lambda a, b: F.abs(a - b)), lambda x: x > 0.05)
    return pairs.select("vec_id", F.size(moved).cast("bigint").alias("changed"))


def pictures(s, d) -> DataFrame:
    """Vectors as pictures of 8 x 8 grey pixels (video_id, frame_idx, width, height, gray), numbered along each label."""
    number = F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1
    level = F.transform(F.slice("embedding", 1, 64), lambda x: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(x.cast("double") * 400 + 128))))
    hexed = F.array_join(F.transform(level, lambda x: F.lpad(F.hex(x.cast("long")), 2, "0")), "")
    return views.table(s, d, "embeddings").select(
        F.col("label").cast("bigint").alias("video_id"), number.cast("bigint").alias("frame_idx"), F.lit(8).alias("width"), F.lit(8).alias("height"), F.unhex(hexed).alias("gray")
    )


@query
def pixel_changes(s, d):
    """Blurred differences of neighbouring pictures, opened by a square of three pixels."""
    return signal.changed_pixels(pictures(s, d), DetectParams(step_frames=2, diff_threshold=12, morph_kernel=3))


def videos_of_pictures(s, d) -> str:
    """A folder with the pictures of each label as a video file."""
    folder = new_folder(s, "videos")
    frames.write_frames(pictures(s, d).withColumn("path", F.concat(F.lit("cam/"), "video_id", F.lit(".y4m"))), folder)
    return folder


def scanned(s, folder: str, **options) -> DataFrame:
    video = F.regexp_extract("path", r"([0-9]+)\.y4m$", 1).cast("bigint")
    return frames.read_frames(s, folder, **options).withColumn("video_id", video)


@query
def frame_scan(s, d):
    """Every second frame of all video files, of the frame numbers from 3 to 40: other frames are not read."""
    rows = scanned(s, videos_of_pictures(s, d), step=2).filter("frame_idx >= 3 AND frame_idx <= 40")
    return rows.select("video_id", "frame_idx", "ms", "width", "height", F.hex("gray").alias("luma"))


@query
def frame_events(s, d):
    """From video files to motion events: frames, changed pixels, the two-threshold machine."""
    p = DetectParams(**(SERIES.__dict__ | {"diff_threshold": 12, "morph_kernel": 3, "event_ratio": 0.4, "min_changed_pixels": 6}))
    return signal.motion_events(signal.changed_pixels(scanned(s, videos_of_pictures(s, d), step=p.step_frames), p), p, FPS)


@query
def wanted_frames(s, d):
    """Frames fetched by number."""
    wanted = views.series(s, d).select("video_id", (F.col("frame_idx") * 3).alias("frame_idx")).distinct()
    return views.series(s, d).join(wanted, ["video_id", "frame_idx"], "left_semi").select("video_id", "frame_idx", "changed_px")


# Files


def hashed_files(s, folder: str, name: str) -> DataFrame:
    """Files read back: name (what the pattern finds of the path), length and the hash of the content."""
    return files.stored_files(s, folder).select(F.regexp_extract("path", f"({name})$", 1).alias("name"), "length", F.sha2("content", 256).alias("sha256"))


@query
def snapshot_files(s, d):
    """A picture for each event that lies within its video, taken out of the video files 700 ms before the event."""
    video, seek = F.col("event_id") % 10, F.greatest(F.lit(0), F.col("k") * 40 - 700)
    events = views.series(s, d).select(
        video.alias("video_id"), F.floor(seek * FPS / 1000).alias("frame_idx"), F.format_string("v%d/det_%d/event_%d.pgm", video, "video_id", "event_id").alias("name")
    )
    taken = scanned(s, videos_of_pictures(s, d)).join(events, ["video_id", "frame_idx"])
    folder = new_folder(s, "snapshots")
    files.write_files(taken.select("name", files.grey_picture(F.col("width"), F.col("height"), F.col("gray")).alias("content")), folder)
    return hashed_files(s, folder, "v[0-9]+/det_[0-9]+/event_[0-9]+[.]pgm")


@query
def inbox_files(s, d):
    """The inbox once all new files are copied to it: of files with one name the last walked stays."""
    source = new_folder(s, "usb")
    walked = views.files(s, d)
    files.write_files(walked.select(F.concat(F.col("ord").cast("string"), F.lit("/"), text.file_name(F.col("path"))).alias("name"), "content"), source)
    new = maintenance.new_files(walked, views.manifest_lines(manifest(s, d)))
    name = text.file_name(F.col("path"))
    folder = new_folder(s, "inbox")
    files.copy_files(new.select("ord", name.alias("name"), F.concat_ws("/", F.lit(source), F.col("ord").cast("string"), name).alias("source")), folder, "ord")
    return hashed_files(s, folder, "[^/]+")


@query
def trace_files(s, d):
    """The motion trace of each video as a CSV file."""
    lines = signal.trace_lines(signal.motion_trace(views.series(s, d), SERIES, FPS))
    folder = new_folder(s, "traces")
    files.write_files(lines.select(F.format_string("%d.csv", "video_id").alias("name"), F.concat("line", F.lit("\n")).alias("content"), "frame"), folder, "frame")
    return hashed_files(s, folder, "[^/]+")


# Streams


@query
def camera_log_stream(s, d):
    """Events as lines of camera logs, streamed until the logs end, and on from the checkpoint once they have grown: no line lost or read twice."""
    late = F.when(F.col("event_id") % 3 == 0, ",timeout").otherwise("")
    lines = views.series(s, d).select(F.format_string("%d.log", "video_id").alias("name"), F.concat(F.col("t_ms").cast("string"), late, F.lit("\n")).alias("content"), "frame_idx")
    folder, at = new_folder(s, "logs"), new_folder(s, "stream")
    for part in (lines.filter("frame_idx <= 10"), lines):
        files.write_files(part, folder, "frame_idx")
        streamed.run_to_end(logs.read_logs(s, folder, partBytes=65_536), "append", at)
    read = s.read.parquet(f"{at}/out").groupBy("camera_id")
    return read.agg(F.count(F.lit(1)).alias("lines"), F.count("error").alias("errors"), F.max("t_ms").alias("last_ms"), F.count_distinct("epoch").alias("batches"))


@query
def queue_stream(s, d):
    """Tasks asked for and canceled by a stream in two runs: what the first run has claimed, the second cannot cancel. Each fifth task fails."""

    def work(task: int) -> None:
        if task % 5 == 0:
            raise ValueError(f"task {task} " + "x" * 2000)

    asked, at = new_folder(s, "requests"), new_folder(s, "stream")
    requests = queue_log(s, d).select("seq", "task_id", F.when(F.col("op").isin("cancel", "fail", "done"), "cancel").otherwise("enqueue").alias("op"))
    for part in ("seq % 5 < 2", "seq % 5 >= 2"):
        requests.filter(part).write.mode("append").parquet(asked)
        found = queue.work_off(s.readStream.schema(requests.schema).parquet(asked), work, at)
    return found


@query
def trips_stream(s, d):
    return streamed.session_trips_once(s, f"{d}/events.parquet", "6 hours")


@query
def heartbeat_throttle_stream(s, d):
    return streamed.throttled_once(s, f"{d}/events.parquet", 12 * HOUR_MS)


@query
def heartbeat_stream(s, d):
    return streamed.camera_health_once(s, f"{d}/events.parquet")


@query
def live_trips(s, d):
    """Trips with plates and index ranges as a stream with state: the rows of `trips`."""
    return live.live_trips_once(s, f"{d}/events.parquet", TRIP_GAP)


@query
def camera_retries(s, d):
    """The events replayed as heartbeats: errors after 12 hours, tries 2, 4 and 8 hours apart, then the camera is stopped."""
    return live.camera_retries_once(s, f"{d}/events.parquet", 12 * HOUR_MS, wait_ms=2 * HOUR_MS, max_wait_ms=8 * HOUR_MS)
