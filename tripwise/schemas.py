"""Schemas of the persistent tables, version 6."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_KINDS = {"int": T.IntegerType, "bigint": T.LongType, "double": T.DoubleType, "string": T.StringType, "timestamp": T.TimestampType, "boolean": T.BooleanType}


def _table(columns: str) -> T.StructType:
    """A schema from `name kind` pairs; `name kind!` may not be null. Needs no session, so it can be a constant."""
    pairs = [c.split() for c in columns.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("!")](), not kind.endswith("!")) for name, kind in pairs])


VIDEOS = _table("id int!, path string!, fps double!, frames bigint!, created_at timestamp!")
DETECTIONS = _table("id int!, video_id int!, merge_ms int!, events_count int!, created_at timestamp!")
CAMERAS = _table("id int!, name string!, url string!, active boolean!, created_at timestamp, last_seen_at timestamp, last_error string")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The schema's columns of df, cast; a null where none may be is an error that names the column."""

    def column(f: T.StructField):
        cast = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            cast = F.when(cast.isNull(), F.raise_error(F.lit(f"{f.name} is null")).cast(f.dataType)).otherwise(cast)
        return cast.alias(f.name)

    return df.select(*[column(f) for f in schema.fields])
