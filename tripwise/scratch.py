"""Tables that a job writes between its steps, below the cluster's shared folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_cleared: set[str] = set()


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where it is unset a temporary one in local mode, else the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        return spark.conf.get("spark.sql.warehouse.dir")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="spark-scratch-"))
    return _own[0]


def remove(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below this application's, which is removed when the process ends."""
    root = f"{shared_root(spark)}/steps-{spark.sparkContext.applicationId}"
    if root not in _cleared:
        _cleared.add(root)

        def clear() -> None:
            with contextlib.suppress(Exception):  # the session may be gone already
                remove(spark, root)

        atexit.register(clear)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and reads it again: it is worked out once, and lost executors lose nothing of it."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
