"""Shared helpers: scratch tables on the cluster's shared folder and text blocks."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.folds import stepped

SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"

_own_dir: list[str] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset a temporary one in local mode, else the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        found = spark.conf.get("spark.sql.warehouse.dir")
    if found:
        return found
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own_dir[0]


_cleared: set[str] = set()


def tables_root(spark: SparkSession) -> str:
    """This application's folder for tables; removed when the process ends."""
    root = f"{scratch_root(spark)}/tables-{spark.sparkContext.applicationId}"
    if root not in _cleared:
        _cleared.add(root)
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

        def clear() -> None:
            with contextlib.suppress(Exception):  # the session may be gone already
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)

        atexit.register(clear)
    return root


_made: list[str] = []


def drop_tables(spark: SparkSession, since: int) -> None:
    """Deletes the tables written after the first `since` ones, but the last: the result that was made from them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in _made[since:-1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
        path.getFileSystem(conf).delete(path, True)
    del _made[since:-1]


def tables_made() -> int:
    return len(_made)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet below the shared folder and reads it again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{tables_root(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(column: str = "text"):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def running(numbers: Column) -> Column:
    """The list's sums up to and with each element, as longs."""
    step = lambda total, x: F.struct((total + x).alias("state"), F.array(total + x).alias("emitted"))
    return stepped(numbers, F.lit(0).cast("long"), step, "array<bigint>")["out"]


def doc_bucket(modulus: int, column: str = "doc_id"):
    """crc32 of the id as text, modulo; a null id counts as the empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus
