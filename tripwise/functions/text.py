"""Formatting and parsing of clocks, rows, URLs and paths as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | c.rlike(r"^\s*$")


def fmt_ms(ms: Column) -> Column:
    """HH:MM:SS.mmm; hours go on beyond 24."""
    d = lambda a, b: F.floor(a / b).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", d(ms, 3_600_000), d(ms, 60_000) % 60, d(ms, 1000) % 60, ms % 1000)


def frame_ms(frame: Column, fps: Column) -> Column:
    return (frame / fps * 1000).cast("bigint")


def known_fps(fps: Column) -> Column:
    """A video's frame rate, 25 where it says none."""
    return F.when(fps > 1e-3, fps).otherwise(25.0)


def mask_url(url: Column) -> Column:
    """Credentials of a URL hidden; a URL without a password unchanged; null becomes empty."""
    scheme = F.instr(url, "://")
    rest = F.substring(url, scheme + 3, F.length(url))
    at = F.instr(rest, "@")
    hidden = F.concat(F.substring(url, F.lit(1), scheme + 2), F.lit("*****"), F.substring(rest, at, F.length(rest)))
    has = (scheme > 0) & (at > 0) & F.contains(F.substring(rest, F.lit(1), at - 1), F.lit(":"))
    return F.when(url.isNull(), "").when(has, hidden).otherwise(url)


def url_class(url: Column) -> Column:
    return (
        F.when(url.rlike(r"(?i)(youtube\.com|youtu\.be)"), "youtube")
        .when(url.rlike(r"(?i)^rtsp://"), "rtsp")
        .when(url.rlike(r"(?i)^https?://"), "http")
        .otherwise("file")
    )


def local_stamp(ts: Column) -> Column:
    """Date and time as the JVM's local date-time prints it, with a space: zero seconds are left out; null is empty."""
    seconds = F.when(F.second(ts) == 0, "").otherwise(F.date_format(ts, ":ss"))
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), seconds), F.lit(""))


def detection_row(id_: Column, events: Column, merge_ms: Column, created: Column, path: Column) -> Column:
    return F.concat_ws(
        " | ", F.concat(F.lit("#"), id_), F.concat(events, F.lit(" ev")), F.concat(F.lit("merge="), merge_ms), local_stamp(created), path
    )


def parse_detection_id(row: Column) -> Column:
    return F.regexp_extract(row, "^#([+-]?[0-9]+) ", 1).try_cast("int")


def quoted(text: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]+)$", 1)


def base_name(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"\.[^.]+$", "")


def backoff_ms(retries: Column) -> Column:
    """Wait before the next try; null once three retries are used up."""
    wait = F.least(F.lit(2000), 500 * F.pow(F.lit(2), F.least(F.lit(3), retries - 1)).cast("int"))
    return F.when(retries <= 3, wait)


def plate_label(plate: Column) -> Column:
    return F.when(blank(plate), "undefined").otherwise(plate)


def fold_lines(text: Column) -> Column:
    """Line breaks as spaces, trimmed; null if nothing is left."""
    folded = F.trim(F.translate(text, "\n\r", "  "))
    return F.when(folded != "", folded)


def int_list(text: Column) -> Column:
    """Integers of a comma-separated list; other entries are skipped."""
    return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull())


def clamp(x: Column, low, high) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.greatest(as_col(low), F.least(as_col(high), x))


def jround(x: Column) -> Column:
    """Half up, as the JVM rounds."""
    return F.floor(x + 0.5).cast("bigint")


def error_text(message: Column) -> Column:
    return F.left(message, F.lit(1000))
