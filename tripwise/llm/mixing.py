"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a reproducible shuffled order, repeated up to
`repeats` times. A document's virtual finish time is its source's cumulative size divided
by the source's weight; all queues are merged in the order of that time and cut where the
total budget is used up. Prefix sums run in two levels (bins, then rows within a bin), so
no source and no range of times has to fit into one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORDS, materialize, text_or_empty

WEIGHTS = (1, 2, 3)
REPEATS = 3


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, digest of the text, size in words, and the shuffled position `h` (hex digits)."""
    return docs.select(
        "doc_id",
        F.col("source").cast("string").alias("source"),
        F.xxhash64(text_or_empty()).alias("digest"),
        F.regexp_count(text_or_empty(), F.lit(WORDS)).cast("long").alias("size"),
        F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")).alias("h"),
    )


def levels(sources: DataFrame, budget, repeats: int) -> DataFrame:
    """Water-filling: adds `target`, weight times a common level, at most `repeats` times source_size.

    Sources are taken in the order of the level at which they are used up; one is used up
    exactly if the level without it would lie above its own.
    """
    order = Window.orderBy("full", "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cap = F.col("source_size") * repeats
    tested = sources.withColumn("full", cap / F.col("weight")).select(
        "*",
        (
            (budget - F.coalesce(F.sum(cap).over(before), F.lit(0))) / F.sum("weight").over(after) >= F.col("full")
        ).alias("used_up"),
    )
    # Null once all sources are used up, which an enlarged budget or an empty table does.
    level = F.try_divide(
        budget - F.sum(F.when(F.col("used_up"), cap).otherwise(0)).over(whole),
        F.sum(F.when(F.col("used_up"), 0).otherwise(F.col("weight"))).over(whole),
    )
    return tested.select(
        *sources.columns,
        F.when(F.col("used_up"), cap.cast("double")).otherwise(F.col("weight") * level).alias("target"),
        F.coalesce(level, F.max("full").over(whole)).alias("level"),
    )


def plan_sources(rows: DataFrame, weights=WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """One row per source: rank, weight, source_size, target, level, last_time; a few rows, whatever the input."""
    per_source = rows.groupBy("source").agg(
        F.sum("size").alias("source_size"), F.max("size").alias("longest"), F.count(F.lit(1)).alias("n")
    )
    ranked = per_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("long")
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = ranked.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(whole))
    base = base.withColumn("slack", F.sum("longest").over(whole)).withColumn("n_docs", F.sum("n").over(whole))
    # A document that finishes after the level of a budget enlarged by one document of each source is never taken.
    last = levels(base, F.col("total") + F.col("slack"), repeats).select("rank", F.col("level").alias("last_time"))
    return levels(base, F.col("total"), repeats).join(last, "rank")


def before(sums: DataFrame, key: str, value: str, name: str, by: list[str] | None = None, fan: int = 4096) -> DataFrame:
    """Adds `name`, the sum of `value` at smaller keys (of the same `by`); keys are whole numbers from 0, each once.

    Sums of `fan` keys each are added up first, so one task has a `fan`-th of the keys at most.
    """
    by = by or []
    group = F.expr(f"{key} div {fan}")
    smaller = Window.rowsBetween(Window.unboundedPreceding, -1)
    coarse = sums.groupBy(*by, group.alias("__group")).agg(F.sum(value).alias("__held"))
    coarse = coarse.select(*by, "__group", F.sum("__held").over(smaller.partitionBy(*by).orderBy("__group")).alias("__before"))
    fine = sums.withColumn("__group", group).join(coarse, [*by, "__group"])
    within = F.sum(value).over(smaller.partitionBy(*by, "__group").orderBy(key))
    return fine.withColumn(name, F.coalesce("__before", F.lit(0)) + F.coalesce(within, F.lit(0))).drop("__group", "__before")


def mix(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, rows_per_bin: int = 1024) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken.

    size counts words (null text: 0); source_size and target belong to the row's source (null
    is a source, ranked last). taken is size times the number of repeats the mix takes, 0 to
    `repeats`. Reruns agree; ties in virtual time fall to the source's rank, then the repeat,
    the shuffled position, the id, the size and the text. Rows repeating a doc_id are documents
    of their own; of rows that agree in id, source and text any may be the one taken more often.
    """
    return _mixed(docs, weights, repeats, rows_per_bin).select("doc_id", "size", "source_size", "target", "taken")


def _mixed(docs: DataFrame, weights, repeats: int, rows_per_bin: int) -> DataFrame:
    spark = docs.sparkSession
    rows = materialize(sized(docs), "mix-sizes")
    plan = materialize(plan_sources(rows, weights, repeats), "mix-sources")
    n_rows = rows.count()
    bins = max(1, n_rows // rows_per_bin)

    keyed = rows.join(
        plan.select(F.col("source").alias("s"), "rank", "weight", "source_size", "level", "last_time", "total"),
        F.col("source").eqNullSafe(F.col("s")),
    ).drop("s")
    position = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    cells = keyed.filter("size > 0").withColumn("cell", (position * bins / F.lit(2**32)).cast("long"))
    offsets = cells.groupBy("rank", "cell").agg(F.sum("size").alias("held"))
    offsets = before(offsets, "cell", "held", "offset", ["rank"]).drop("held")
    queue = Window.partitionBy("rank", "cell").orderBy("h", "doc_id", "size", "digest")
    within = queue.rowsBetween(Window.unboundedPreceding, 0)
    queued = (
        cells.withColumn("within", F.sum("size").over(within))
        .withColumn("copy", F.row_number().over(queue))
        .join(offsets, ["rank", "cell"])
        .withColumn("round", F.explode(F.array(*[F.lit(k) for k in range(repeats)])))
        .withColumn("time", (F.col("round") * F.col("source_size") + F.col("offset") + F.col("within")) / F.col("weight"))
        .filter(F.col("last_time").isNull() | (F.col("time") <= F.col("last_time")))
        .withColumn("bin", (F.col("time") / F.col("level") * F.lit(float(bins))).cast("long"))
    )
    queued = materialize(
        queued.select("doc_id", "rank", "cell", "copy", "round", "h", "size", "digest", "time", "bin", "total"), "mix-queue"
    )
    starts = before(queued.groupBy("bin").agg(F.sum("size").alias("held")), "bin", "held", "start").drop("held")
    order = Window.partitionBy("bin").orderBy("time", "rank", "round", "h", "doc_id", "size", "digest")
    taken = (
        queued.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .join(starts, "bin")
        .filter(F.col("start") + F.col("upto") <= F.col("total"))
        .groupBy("rank", "cell", "copy")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    numbered = cells.select("doc_id", "source", "digest", "h", "size", "rank", "cell").withColumn("copy", F.row_number().over(queue))
    counted = numbered.join(taken, ["rank", "cell", "copy"], "left").select(
        "doc_id", "source", "digest", "size", "rank", (F.col("size") * F.coalesce("times", F.lit(0))).alias("taken")
    )
    empty = keyed.filter("size = 0").select("doc_id", "source", "digest", "size", "rank", F.lit(0).cast("long").alias("taken"))
    return counted.unionByName(empty).join(plan.select("rank", "source_size", F.col("target").cast("double").alias("target")), "rank")


def mixed_documents(docs: DataFrame, weights=WEIGHTS, repeats: int = REPEATS, rows_per_bin: int = 1024) -> DataFrame:
    """The documents the mix takes, with their columns, `n_words` and `copies` (1 to `repeats`).

    A row is known by its id, its source and 64 bits of its text, so rows that repeat an id keep
    their own size and copies. Of rows that agree in all three some may be taken more often than
    others; then as many rows have each number of copies as the mix says. Rows without words (null
    or blank texts) are never taken. An input column named n_words or copies is replaced; an
    empty table stays empty.
    """
    name = ["__id", "__source", "__digest"]
    times = (
        _mixed(docs, weights, repeats, rows_per_bin)
        .filter("size > 0")
        .groupBy(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("digest").alias("__digest"), F.col("size").alias("n_words"),
                 F.expr("taken div size").cast("int").alias("copies"))
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    known = Window.partitionBy(*name)
    times = times.withColumn("__split", F.count(F.lit(1)).over(known) > 1).withColumn(
        "__upto", F.sum("__n").over(known.orderBy(F.desc("copies")).rowsBetween(Window.unboundedPreceding, 0))
    )
    times = materialize(times.filter("__split OR copies > 0"), "mix-times")
    kept = docs.drop("n_words", "copies")
    mine = [F.col("doc_id"), F.col("source").cast("string"), F.xxhash64(text_or_empty())]

    def same(mark: DataFrame) -> list:
        return [a.eqNullSafe(mark[n]) for a, n in zip(mine, name, strict=True)]

    whole = times.filter("NOT __split").drop("__n", "__split", "__upto")
    found = kept.join(whole, same(whole)).drop(*name)
    split = times.filter("__split")
    if not split.isEmpty():
        # Rows that only differ in how often they are taken are numbered: the first ones are taken most often.
        ids = split.select(*name).distinct()
        rows = kept.join(ids, same(ids), "left_semi")
        rows = rows.select("*", *[m.alias(n) for m, n in zip(mine, ["__a", "__b", "__c"], strict=True)])
        rows = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("__a", "__b", "__c").orderBy(F.lit(1))))
        cut = [F.col(a).eqNullSafe(split[n]) for a, n in zip(("__a", "__b", "__c"), name, strict=True)]
        cut += [F.col("__nth") <= split["__upto"], F.col("__nth") > split["__upto"] - split["__n"], split["copies"] > 0]
        found = found.unionByName(rows.join(split, cut).select(*found.columns))
    return found


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
      FROM d GROUP BY source),
w AS (SELECT *, 1 + (rank - 1) % 3 AS weight, CAST(sum(source_size) OVER () AS BIGINT) AS total FROM s),
f AS (SELECT *, source_size * 3 / weight AS fill FROM w),
t AS (SELECT *, (total - coalesce(sum(source_size * 3) OVER (ORDER BY fill, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY fill, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) >= fill AS used_up FROM f),
p AS (SELECT *, CASE WHEN used_up THEN CAST(source_size * 3 AS DOUBLE) ELSE weight * (
        (total - sum(CASE WHEN used_up THEN source_size * 3 ELSE 0 END) OVER ())
        / sum(CASE WHEN used_up THEN 0 ELSE weight END) OVER ()) END AS target FROM t),
q AS (SELECT d.doc_id, d.size, d.h, p.rank, p.weight, p.source_size, p.total,
        CAST(sum(d.size) OVER (PARTITION BY p.rank ORDER BY d.h, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS c
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE d.size > 0),
e AS (SELECT q.*, r.round, (r.round * source_size + c) / weight AS time FROM q, (VALUES (0), (1), (2)) r(round)),
g AS (SELECT *, sum(size) OVER (ORDER BY time, rank, round, h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM e),
k AS (SELECT doc_id, count(*) AS times FROM g WHERE upto <= total GROUP BY doc_id)
SELECT d.doc_id, d.size, p.source_size, CAST(p.target AS DOUBLE) AS target,
       CAST(d.size * coalesce(k.times, 0) AS BIGINT) AS taken
FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source LEFT JOIN k ON k.doc_id = d.doc_id
"""
