"""The driver's tables as domain views; readers for manifests, snapshot lists and videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# File patterns scanned by default.
VIDEO_PATTERNS = ["*.mp4", "*.mkv", "*.ts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def videos(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("/inbox/"), "c_name", F.lit(".mp4")).alias("path"),
        F.lit(25.0).alias("fps"),
        (250 + (F.col("c_custkey") * 37) % 5000).cast("bigint").alias("frames"),
    )


def detections(spark, d) -> DataFrame:
    counted = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, d, "orders")
    return orders.join(counted, orders["o_orderkey"] == counted["l_orderkey"], "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("video_id"),
        (1000 * F.substring("o_orderpriority", 1, 1).cast("int")).alias("merge_ms"),
        F.coalesce("n", F.lit(0)).cast("int").alias("events_count"),
        F.col("o_orderdate").alias("created_at"),
    )


def detection_events(spark, d) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint")
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("detection_id"), (day * 1000 + F.col("l_linenumber")).alias("t_ms")
    )


def raw_plate(k):
    """Plate texts with look-alike characters, by a number."""
    four = F.lpad((k * 83 % 10000).cast("string"), 4, "0")
    return (
        F.when(k % 5 == 0, F.concat(F.lit("о"), F.lpad(k.cast("string"), 3, "O"), F.lit("рр")))
        .when(k % 5 == 1, F.concat(F.lit("be "), four, F.lit("a0")))
        .when(k % 5 == 2, F.concat(F.lit("A8"), F.translate(four, "0", "O")))
        .when(k % 5 == 3, F.lit(" "))
    )


def series(spark, d) -> DataFrame:
    """Samples of each user as a video: video_id, event_id, t_ms, frame_idx, changed_px, total_px, raw."""
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    return table(spark, d, "events").select(
        F.col("user_id").alias("video_id"),
        "event_id",
        "event_type",
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        F.row_number().over(Window.partitionBy("user_id").orderBy("ts")).cast("bigint").alias("frame_idx"),
        F.floor(F.col("value") * 1000).cast("bigint").alias("changed_px"),
        F.lit(100_000).cast("bigint").alias("total_px"),
        k.alias("k"),
        raw_plate(k).alias("raw"),
    )


def cameras(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.concat(F.lit("rtsp://user:pw@cam"), "s_suppkey", F.lit("/stream")).alias("url"),
        (F.col("s_acctbal") > 0).alias("active"),
    )


def files(spark, d) -> DataFrame:
    """Documents as files to ingest, walked in the order of doc_id."""
    ext = F.element_at(F.array(*[F.lit(x) for x in (".mp4", ".mkv", ".ts", ".txt")]), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("/usb/"), "source", F.lit("/clip"), (F.col("doc_id") % 100).cast("string"), ext).alias("path"),
        F.col("text").alias("content"),
    )


def video_files(spark: SparkSession, root: str) -> DataFrame:
    """Video files below a folder: path, modification time, length and content; unreadable files are skipped."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "{" + ",".join(VIDEO_PATTERNS) + "}")
        .option("ignoreCorruptFiles", "true")
        .load(root)
    )


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, tasks: int = 8, **options: str) -> DataFrame:
    """A database table; with a numeric `key`, read by `tasks` tasks that each take a range of it."""
    table_reader = lambda **more: spark.read.format("jdbc").options(url=url, **options, **more)
    reader = table_reader()
    if key:
        ends = table_reader().option("query", f"SELECT MIN({key}) AS low, MAX({key}) AS high FROM {name}").load().first()
        if ends[0] is not None:
            reader = table_reader(partitionColumn=key, lowerBound=str(ends[0]), upperBound=str(ends[1] + 1), numPartitions=str(tasks))
    return reader.option("dbtable", name).load()


def manifest_lines(lines: DataFrame) -> DataFrame:
    """`<sha256> <path> duration=<ms>ms` lines (column value): the hash is what stands before the first space."""
    found = F.regexp_extract("value", "^([^ ]+) ", 1)
    return lines.select(
        found.alias("sha256"),
        F.regexp_extract("value", r"^[^ ]+ (.*?)( duration=[0-9]+ms)?$", 1).alias("path"),
        F.regexp_extract("value", r" duration=([0-9]+)ms$", 1).try_cast("bigint").alias("duration_ms"),
    ).filter(F.col("sha256") != "")


def snapshot_lines(lines: DataFrame) -> DataFrame:
    """video_path,t_ms,detection_id,event_id lines (ord, value): no quoting, a first line naming video_path is a header."""
    parts = F.split("value", ",")
    header = (F.col("ord") == 0) & F.contains(F.lower("value"), F.lit("video_path"))
    return lines.filter(~header).select("ord", parts.alias("p")).filter(F.size("p") >= 4).select(
        "ord",
        F.col("p")[0].alias("video_path"),
        F.trim(F.col("p")[1]).try_cast("bigint").alias("t_ms"),
        F.col("p")[2].alias("detection_id"),
        F.col("p")[3].alias("event_id"),
    )


def sql_events(spark: SparkSession, query: str) -> DataFrame:
    """A user's SQL giving (video path, t_ms, detection, event) by position."""
    return spark.sql(query).toDF("video_path", "t_ms", "detection_id", "event_id")
