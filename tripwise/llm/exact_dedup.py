"""Exact deduplication through an extendible-hash index kept in shared files.

Every document is keyed by a 64-bit hash of its normalised text. The directory maps the
leading bits of a key (a cell) to a bucket; it is doubled, and overfull buckets are split by
one more bit, until no bucket holds more than `capacity` keys. Buckets are ranges of the key:
the index is range-partitioned by them, so an owner task has whole buckets, numbers the entries
of each key along a chain and writes them to files in key order. Entries are made by grouping
the texts themselves, so bytes are compared and a group of copies of any size is one row before
anything is shuffled by its key.

Documents are looked up in the index: the directory names the bucket of their cell, the bucket
the key's chain. A chain of one entry is the document's own, since every text has been entered;
along a longer one the document's bytes are compared with each entry's.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, materialize, text_or_empty

#: Bits by which the directory is looked at beyond its first depth before it is doubled further.
AHEAD = 4


def _norm() -> Column:
    return F.regexp_replace(text_or_empty(), SPACES, " ")


def _key(norm: Column, key_bits: int) -> Column:
    """The leading `key_bits` bits of the text's hash; fewer than 64 make texts collide."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(norm), 64 - key_bits), 64 - key_bits)


def cell_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """The directory (cell, local_depth, bucket) of distinct keys (column key), and its global depth.

    It starts with about four cells for each `capacity` keys and is doubled until the fullest cell
    fits. A bucket is the shortest prefix, from the first depth on, with at most `capacity` keys
    below it; `bucket` is its first key, so buckets in order are ranges of the key.
    """
    n = keys.count()
    first = max(0, math.floor(math.log2(max(1, n / capacity))) - 1)
    depth = min(64, first + AHEAD)
    while True:
        cells = materialize(keys.groupBy(cell_of(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("n")), "exact-cells")
        if depth == 64 or (cells.agg(F.max("n")).first()[0] or 0) <= capacity:
            break
        depth = min(64, depth + AHEAD)
    prefix = F.expr(f"shiftrightunsigned(cell, cast({depth} - d AS int))")
    levels = (
        cells.select("cell", "n", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("d"))
        .groupBy("d", prefix.alias("prefix"))
        .agg(F.sum("n").alias("n"))
    )
    split = levels.filter(F.col("n") > capacity).select(
        (F.col("d") + 1).alias("d"), F.explode(F.array(F.shiftleft("prefix", 1), F.shiftleft("prefix", 1) + 1)).alias("prefix")
    )
    fits = levels.filter(F.col("n") <= capacity)
    buckets = fits.filter(F.col("d") == first).unionByName(fits.join(split, ["d", "prefix"], "left_semi"))
    named = buckets.select("d", "prefix", F.expr(f"shiftleft(prefix, cast({64} - d AS int) % 64)").alias("bucket"))
    named = named.withColumn("bucket", F.when(F.col("d") == 0, F.lit(0).cast("long")).otherwise(F.col("bucket")))
    held = cells.select("cell", F.explode(F.sequence(F.lit(first), F.lit(depth))).alias("d")).withColumn("prefix", prefix)
    return held.join(named, ["d", "prefix"]).select("cell", F.col("d").alias("local_depth"), "bucket"), depth


class Index:
    """An index in shared files: the directory, its depth, and the bucket files.

    Bucket rows are (bucket, key, chain, chained, norm, keep_id, group_size): `chain` numbers the
    entries of one key, `chained` counts them; norm, the entry's text, is kept for chains of several.
    """

    def __init__(self, cells: DataFrame, depth: int, buckets: DataFrame):
        self.cells, self.depth, self.buckets = cells, depth, buckets

    def located(self, keyed: DataFrame) -> DataFrame:
        """Rows with a key, and the bucket that the directory names for it."""
        return keyed.withColumn("cell", cell_of(F.col("key"), self.depth)).join(self.cells.select("cell", "bucket"), "cell").drop("cell")


def build_index(docs: DataFrame, capacity: int = 8192, key_bits: int = 64) -> Index:
    """The index of all distinct normalised texts of docs."""
    entries = materialize(
        docs.select("doc_id", _norm().alias("norm"))
        .groupBy(_key(F.col("norm"), key_bits).alias("key"), "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")),
        "exact-entries",
    )
    keys = materialize(entries.groupBy("key").agg(F.count(F.lit(1)).alias("chained")), "exact-keys")
    cells, depth = directory(keys, capacity)
    index = Index(materialize(cells, "exact-directory"), depth, entries)
    # Only texts of keys that several texts share are moved to their owners. Such keys are written, so that Spark knows how few they are.
    crowded = materialize(keys.filter("chained > 1"), "exact-crowded")
    alone = entries.select("key", "keep_id", "group_size").join(crowded, "key", "left_anti")
    alone = alone.select("key", F.lit(1).cast("long").alias("chained"), F.lit(None).cast("string").alias("norm"), "keep_id", "group_size")
    chains = entries.join(crowded, "key").select("key", "chained", "norm", "keep_id", "group_size")
    owned = index.located(alone.unionByName(chains)).repartitionByRange("bucket").sortWithinPartitions("bucket", "key", "norm")
    along = Window.partitionBy("bucket", "key").orderBy("norm")
    index.buckets = materialize(
        owned.select("bucket", "key", F.row_number().over(along).alias("chain"), "chained", "norm", "keep_id", "group_size"), "exact-index"
    )
    return index


def exact_groups(docs: DataFrame, capacity: int = 8192, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of white space became one space; null
    counts as empty. The smallest doc_id of a group stays (a null id only if all are null);
    rows that repeat that id are one document and are all marked kept. Empty input gives no
    rows; columns other than doc_id and text are not looked at. key_bits shortens the hash.
    """
    index = build_index(docs, capacity, key_bits)
    keyed = docs.select("doc_id", _norm().alias("norm"))
    probes = materialize(
        keyed.select("doc_id", _key(F.col("norm"), key_bits).alias("key"), F.sha2("norm", 256).alias("text_sha256")), "exact-probes"
    )
    slots = index.buckets.filter("chained = 1").select("bucket", "key", "keep_id", "group_size")
    found = index.located(probes).join(slots, ["bucket", "key"])
    chains = index.buckets.filter("chained > 1")
    if not chains.isEmpty():
        # Documents whose key has a chain bring their bytes along.
        several = chains.select("key").distinct()
        texts = keyed.select("doc_id", "norm", _key(F.col("norm"), key_bits).alias("key")).join(several, "key", "left_semi")
        along = index.located(texts).join(chains.select("bucket", "key", "norm", "keep_id", "group_size"), ["bucket", "key", "norm"])
        found = found.select("doc_id", "keep_id", "group_size", "text_sha256").unionByName(
            along.select("doc_id", "keep_id", "group_size", F.sha2("norm", 256).alias("text_sha256"))
        )
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_copies(docs: DataFrame, capacity: int = 8192) -> DataFrame:
    """docs without the rows whose text another row with a smaller doc_id has; columns unchanged.

    A row is known by its id and its text: other texts under the same id stay. A null id comes
    after all others; rows that agree in id (or in having none) and text stay or go together.
    Null texts are empty texts; an empty table stays empty.
    """
    gone = exact_groups(docs, capacity).filter(~F.col("kept")).select(F.col("doc_id").alias("__gone"), F.col("text_sha256").alias("__sha")).distinct()
    same = docs["doc_id"].eqNullSafe(gone["__gone"]) & (F.sha2(_norm(), 256) == gone["__sha"])
    return docs.join(gone, same, "left_anti")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
