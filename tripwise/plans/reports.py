"""The fixed reports. Each is one declarative plan over detections, videos and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import detection_row, fmt_ms, jround, quoted

# Days by their ISO number.
DAYS = ["MONDAY", "TUESDAY", "WEDNESDAY", "THURSDAY", "FRIDAY", "SATURDAY", "SUNDAY"]


def counted() -> list[F.Column]:
    return [F.count(F.lit(1)).alias("detections"), F.coalesce(F.sum("events_count"), F.lit(0)).cast("bigint").alias("events")]


def joined(detections: DataFrame, videos: DataFrame) -> DataFrame:
    """Detections with their video's path; Spark broadcasts videos if they are small enough."""
    return detections.join(videos.select(F.col("id").alias("v_id"), "path"), F.col("video_id") == F.col("v_id")).drop("v_id")


def summary_counts(videos: DataFrame, detections: DataFrame, events: DataFrame) -> DataFrame:
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(videos, "videos").crossJoin(n(detections, "detections")).crossJoin(n(events, "events"))


def week_agg(detections: DataFrame) -> DataFrame:
    """Seven rows, Monday to Sunday; days without detections have zeros."""
    spark = detections.sparkSession
    by_day = detections.groupBy((F.weekday("created_at") + 1).alias("iso")).agg(*counted())
    days = spark.range(1, 8).select(F.col("id").cast("int").alias("iso"))
    return days.join(by_day, "iso", "left").select(
        "iso",
        F.element_at(F.array(*[F.lit(x) for x in DAYS]), F.col("iso")).alias("day"),
        F.coalesce("detections", F.lit(0)).alias("detections"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )


def week_heatmap(detections: DataFrame) -> DataFrame:
    """The week with bar width and colour, scaled by its busiest day."""
    most = F.max("events").over(Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    r = F.when(most == 0, 0.0).otherwise(F.col("events") / most)
    week = week_agg(detections).withColumn("r", r)
    red = (230 - jround(F.col("r") * 180)).cast("int")
    return week.select(
        "iso",
        "events",
        (40 + jround(F.col("r") * 240)).cast("int").alias("width"),
        red.alias("red"),
        (240 - F.floor((230 - red) / 2)).cast("int").alias("green"),
        F.lit(255).alias("blue"),
    )


def daily_agg(detections: DataFrame, now: DataFrame, last_days: int) -> DataFrame:
    """Days with detections in the trailing days, newest first; `now` is one row with the column now.

    The bound is a scalar subquery, so the scan gets it as a literal.
    """
    bound = now.select((F.col("now") - F.make_interval(days=F.lit(max(1, last_days)))).alias("bound")).scalar()
    recent = detections.filter(F.col("created_at") >= bound)
    return recent.groupBy(F.to_date("created_at").alias("day")).agg(*counted()).orderBy(F.desc("day"))


def video_agg(detections: DataFrame, videos: DataFrame, limit: int) -> DataFrame:
    grouped = joined(detections, videos).groupBy("path").agg(*counted(), F.max("created_at").alias("newest"))
    return grouped.orderBy(F.desc("newest"), "path").limit(max(1, limit)).drop("newest")


def merge_agg(detections: DataFrame) -> DataFrame:
    return detections.groupBy("merge_ms").agg(*counted()).orderBy("merge_ms")


def detections_page(detections: DataFrame, videos: DataFrame, limit: int, offset: int) -> DataFrame:
    """A page of detections, newest id first. Each has a video (a foreign key), so the page is taken before the join."""
    page = detections.orderBy(F.desc("id")).offset(max(0, offset)).limit(max(1, limit))
    return joined(page, videos).orderBy(F.desc("id")).select("id", "video_id", "path", "merge_ms", "events_count", "created_at")


def row_text() -> F.Column:
    return detection_row(
        F.col("id").cast("string"),
        F.col("events_count").cast("string"),
        F.col("merge_ms").cast("string"),
        F.col("created_at"),
        F.col("path"),
    )


def recent_detections(detections: DataFrame, videos: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return detections_page(detections, videos, limit, offset).select("id", row_text().alias("row_text"))


def text_filter(rows: DataFrame, column: str, wanted: str) -> DataFrame:
    q = wanted.strip().lower()
    return rows.filter(F.contains(F.lower(column), F.lit(q))) if q else rows


def page_info(total: DataFrame, page: int, size: int) -> DataFrame:
    """from, to, banner and which buttons are off; total is one row with the column total."""
    low = F.least(F.lit(page * size + 1).cast("bigint"), F.col("total"))
    high = F.least(F.lit((page + 1) * size).cast("bigint"), F.col("total"))
    return total.select(
        low.alias("from_row"),
        high.alias("to_row"),
        F.format_string("Showing %d-%d of %d", low, high, F.col("total")).alias("banner"),
        F.lit(page == 0).alias("prev_off"),
        (high >= F.col("total")).alias("next_off"),
    )


def page_fallback(pages: DataFrame, size: int) -> DataFrame:
    """(page, total) and the page shown: an empty page steps back by one."""
    empty = (F.col("page") * size >= F.col("total")) & (F.col("page") > 0)
    return pages.select("page", "total", F.when(empty, F.col("page") - 1).otherwise(F.col("page")).alias("shown"))


def event_preview(events: DataFrame, key: str, n: int = 10) -> DataFrame:
    """One line per key: its first n event times, then how many more."""
    keyed = events.groupBy(key).agg(F.sort_array(F.collect_list("t_ms")).alias("t"))
    head = F.array_join(F.transform(F.slice("t", 1, n), fmt_ms), ", ")
    more = F.when(F.size("t") > n, F.concat(F.lit(" +"), (F.size("t") - n).cast("string"), F.lit(" more"))).otherwise("")
    return keyed.select(key, F.concat(head, more).alias("preview"))


def events_csv_lines(detection_id: int, path: DataFrame, events: DataFrame) -> DataFrame:
    """Numbered lines (ord, line): two header lines, a blank one, column names, then an event a line."""
    head = path.select(
        F.posexplode(
            F.array(
                F.lit(f"Detection,{detection_id}"), F.concat(F.lit("Video,"), quoted(F.col("path"))), F.lit(""), F.lit("#;t_ms;time")
            )
        ).alias("ord", "line")
    ).select(F.col("ord").cast("bigint").alias("ord"), "line")
    n = F.row_number().over(Window.orderBy("t_ms"))
    body = events.select(n.cast("bigint").alias("n"), "t_ms").select(
        (F.col("n") + 3).alias("ord"), F.concat_ws(";", F.col("n").cast("string"), F.col("t_ms").cast("string"), fmt_ms(F.col("t_ms"))).alias("line")
    )
    return head.unionByName(body)


def report_csv_lines(summary: DataFrame, daily: DataFrame, per_video: DataFrame) -> DataFrame:
    """(section, ord, line) of the whole report: Summary, Daily and Videos."""
    line = lambda *c: F.concat_ws(",", *[F.col(x).cast("string") if isinstance(x, str) else x for x in c])
    days = daily.select(
        F.lit("daily").alias("section"), F.row_number().over(Window.orderBy(F.desc("day"))).cast("bigint").alias("ord"), line("day", "detections", "events").alias("line")
    )
    tops = per_video.select(
        F.lit("videos").alias("section"),
        F.row_number().over(Window.orderBy("path")).cast("bigint").alias("ord"),
        line(quoted(F.col("path")), "detections", "events").alias("line"),
    )
    head = summary.select(F.lit("summary").alias("section"), F.lit(1).cast("bigint").alias("ord"), line("videos", "detections", "events").alias("line"))
    return head.unionByName(days).unionByName(tops)


def snapshot_tally(plan: DataFrame, lasts_ms: F.Column) -> DataFrame:
    """How many pictures of a plan can be taken (their time lies within the video) and how many fail."""
    fits = F.col("seek_ms") < lasts_ms
    return plan.agg(F.count_if(fits).alias("ok"), F.count_if(~F.coalesce(fits, F.lit(False))).alias("failed"))
