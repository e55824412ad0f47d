"""Quality classifier by Bradley-Terry pairwise ranking.

Each document has a score, linear in features of its text. Preference pairs set a document
labelled 1 against one labelled 0; the weights minimise the logistic loss on the pairs'
feature differences. The scores are then cut at the quantile that the labels' share of 0
names. Fitting reads every labelled row: each is in some pair, and centre, scale and quantile are
those of all of them. Pairs are made by a join and stay in the cluster, as do the rows; the driver
gets sums of fixed size. Scoring is a column expression.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import doc_bucket, drop_tables, materialize, tables_made
from .words import NOT_SPACE, doc_slices, text_bytes, words_of

CUT = 0.7  # documents with a score of CUT or more are predicted 1
RIVALS, PENALTY = 40, 1e-3
#: Rivals are drawn for so many documents from one generator; so many different scores are read at the quantile.
BLOCK, LISTED = 4_096, 4_096

_classes = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": range(0x30, 0x3A),
    "other": range(0x80, 0x100),
    "line": [10],
    "stop": b".,;:",
    "loud": b"!?",
    "bar": b"|<>{}[]\\",
    "odd": b"#&%$*^@~=+_",
}
_MARKS = {k: np.isin(np.arange(256), list(v)) for k, v in _classes.items()}
#: Words are counted in this many groups by their hash, so that what a text says counts as well as how it looks.
GROUPS = 64
FEATURES = ("upper", "digit", "odd", "bar", "loud", "repeat", "short", "long", "length", "lines", "stops", *(f"words{k}" for k in range(GROUPS)))


def features(texts: pa.Array) -> np.ndarray:
    """One row of FEATURES per text; an empty or null text has only `short` set."""
    raw, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, len(FEATURES)))
    for i, j in doc_slices(offsets):
        at = offsets[i : j + 1] - offsets[i]
        out[i:j] = _features(raw[offsets[i] : offsets[j]], at)
    return out


def _features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    def per_text(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(total[at]).astype(float)

    n = {k: per_text(mark[raw], at) for k, mark in _MARKS.items()}
    hashes, words_at = words_of(raw, at, NOT_SPACE)
    words = np.diff(words_at).astype(float)
    again = np.zeros(len(hashes), bool)
    again[1:] = hashes[1:] == hashes[:-1]
    first = words_at[:-1][words_at[:-1] < len(hashes)]
    again[first] = False
    again = per_text(again, words_at)
    letters = n["upper"] + n["lower"] + n["other"]
    size = np.diff(at).astype(float)
    share = lambda a, b: np.sqrt(a / np.maximum(b, 1))
    owner = np.repeat(np.arange(len(words)), np.diff(words_at))
    group = (hashes >> np.uint64(64 - 6)).astype(np.int64)
    said = np.bincount(owner * GROUPS + group, minlength=len(words) * GROUPS).reshape(len(words), GROUPS)
    mean = (size - words) / np.maximum(words, 1)
    return np.stack(
        [
            share(n["upper"], letters),
            share(n["digit"], size),
            share(n["odd"], size),
            share(n["bar"], words),
            share(n["loud"], words),
            share(again, words),
            1 / (1 + words),
            np.minimum(mean, 40) / 10,
            np.log1p(words) / 10,
            share(n["line"], words),
            share(n["stop"], words),
            *share(said, words[:, None]).T,
        ],
        axis=1,
    )


def drawn(block: int, others: int, rivals: int) -> np.ndarray:
    """The rivals (ranks below `others`) of the BLOCK documents of the rarer label that have ranks from block * BLOCK on."""
    return np.random.default_rng([7, block]).integers(0, others, BLOCK * rivals).reshape(BLOCK, rivals)


def loss_sums(d: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The pairs' number, and the sums of their loss's first and second derivatives, in one list; d: good minus bad."""
    d = d.astype(float)
    p = 1 / (1 + np.exp(np.clip(d @ w, -40, 40)))  # chance that the pair comes out the wrong way round
    return np.concatenate([[len(d)], -(p @ d), ((d * (p * (1 - p))[:, None]).T @ d).ravel()])


def newton(sums: Callable[[np.ndarray], np.ndarray], size: int, penalty: float) -> np.ndarray:
    """Newton's method on the mean loss of all pairs; sums(w) gives loss_sums over them."""
    w = np.zeros(size)
    for _ in range(30):
        found = sums(w)
        slope, curve = found[1 : size + 1] / found[0], found[size + 1 :].reshape(size, size) / found[0]
        step = np.linalg.solve(curve + penalty * np.eye(size), slope + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_weights(x: np.ndarray, y: np.ndarray, rivals: int = RIVALS, penalty: float = PENALTY) -> np.ndarray:
    """What pairs() and newton() find, for rows in memory in the order of their ranks."""
    good, bad = x[y == 1], x[y == 0]
    if not len(good) or not len(bad):
        return np.zeros(x.shape[1])
    few, many, sign = (bad, good, 1) if len(good) >= len(bad) else (good, bad, -1)
    pick = np.concatenate([drawn(k, len(many), rivals) for k in range(-(-len(few) // BLOCK))])[: len(few)].ravel()
    left = np.setdiff1d(np.arange(len(many)), pick)
    d = sign * (many[np.concatenate([pick, left])] - few[np.concatenate([np.repeat(np.arange(len(few)), rivals), left % len(few)])])
    return newton(lambda w: loss_sums(d, w), x.shape[1], penalty)


def matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, len(FEATURES))


def packed(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -8, 8)


def weighed(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """z @ w; each row is summed by itself, so that equal rows come to the same bits in every batch."""
    return (z * w).sum(axis=1)


def summed(rows: DataFrame, column: str, kind: str, part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all batches of part(matrix of the column), a flat list of fixed length; empty without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                found = part(matrix(batch.column(column), kind))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "v"])

    sums = rows.select(column).mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    out = np.zeros(sums.num_rows)
    out[sums["at"].to_numpy()] = sums["v"].to_numpy()
    return out


def labelled(docs: DataFrame, known: DataFrame) -> DataFrame:
    """id, y and x (features, 8 bytes each) of every row of docs whose id has a label; texts stay where they are, features move."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).filter("id IS NOT NULL")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), packed(features(batch.column("text")))], ["id", "x"])

    described_as = f"id {texts.schema['id'].dataType.simpleString()}, x binary"
    return materialize(texts.mapInArrow(described, described_as).join(known, "id").select("id", "y", "x"), "quality-features")


def pairs(rows: DataFrame, n_bad: int, n_good: int, centre: np.ndarray, scale: np.ndarray, rivals: int = RIVALS) -> DataFrame:
    """One row for each pair: d, features of the good document minus those of the bad one (4 bytes each).

    Documents of a label are ranked by their id's hash. Each one of the rarer label meets `rivals` of the other, drawn
    by rank; each of the other label that no draw has met meets the one at its own rank, modulo the number of the rarer.
    So every labelled document is in some pair.
    """
    keys = ["y", "h", "id", "hx"]  # short ones: Spark gathers some of them to lay the ranges
    hashed = rows.withColumns({"h": F.xxhash64("id"), "hx": F.xxhash64("x")})
    ranged = hashed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ranked = materialize(ranged.select(F.monotonically_increasing_id().alias("at"), "y", "x"), "quality-ranked")
    sizes = dict(ranked.groupBy(F.shiftright("at", 33)).count().collect())
    starts = np.zeros(max(sizes) + 1, np.int64)
    for part in sorted(sizes):
        starts[part + 1 :] += sizes[part]
    rare = 0 if n_good >= n_bad else 1
    few, many, sign = (n_bad, n_good, 1) if rare == 0 else (n_good, n_bad, -1)

    def placed(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at, y = batch.column("at").to_numpy(), batch.column("y").to_numpy()
        return starts[at >> 33] + (at & (2**33 - 1)) - n_bad * y, standard(matrix(batch.column("x"), "f8"), centre, scale).astype("f4")

    def asks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, picks = None, None
        for batch in batches:
            rank, z = placed(batch)
            for i in range(0, len(rank), 500):
                met = np.empty((len(rank[i : i + 500]), rivals), np.int64)
                for block in np.unique(rank[i : i + 500] // BLOCK):
                    if block != held:
                        held, picks = block, drawn(int(block), many, rivals)
                    own = rank[i : i + 500] // BLOCK == block
                    met[own] = picks[rank[i : i + 500][own] % BLOCK]
                z_again = packed(z[i : i + 500]).take(pa.array(np.repeat(np.arange(len(met)), rivals)))
                yield pa.RecordBatch.from_arrays([pa.array(met.ravel()), z_again], ["rank", "z"])

    def stands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, z = placed(batch)
            yield pa.RecordBatch.from_arrays([pa.array(rank), packed(z)], ["rank", "own"])

    def differ(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """d of those that met a rival; the others' own features and rank."""
        for batch in batches:
            if batch.num_rows:
                met = pc.is_valid(batch.column("z"))
                at, d = met.to_numpy(zero_copy_only=False), matrix(batch.column("own"), "f4").copy()
                d[at] -= matrix(batch.column("z").filter(met), "f4")
                d[at] *= sign
                yield pa.RecordBatch.from_arrays([packed(d), pc.if_else(met, None, batch.column("rank"))], ["d", "rank"])

    common = ranked.filter(F.col("y") != rare).mapInArrow(stands, "rank long, own binary")
    scarce = ranked.filter(F.col("y") == rare)
    asked = scarce.mapInArrow(asks, "rank long, z binary")
    met = common.join(asked.hint("merge"), "rank", "left").select("rank", "own", "z").mapInArrow(differ, "d binary, rank long")
    met = materialize(met, "quality-pairs")
    left = met.filter("rank IS NOT NULL").select(F.pmod("rank", F.lit(few)).alias("rank"), F.col("d").alias("own"))
    found = met.filter("rank IS NULL").select("d")
    if left.isEmpty():
        return found
    rivals_left = scarce.mapInArrow(stands, "rank long, own binary").withColumnRenamed("own", "z")
    # A small number of rivals would make few keys.
    rivals_left = F.broadcast(rivals_left) if few <= BLOCK else rivals_left.hint("merge")
    alone = left.join(rivals_left, "rank").select("rank", "own", "z").mapInArrow(differ, "d binary, rank long")
    return found.unionByName(materialize(alone.select("d"), "quality-alone"))


def value_at(tallies: DataFrame, target: float, weight: tuple[float, float]) -> float:
    """The score up to which the weights add to `target`, between the middles of neighbouring rows; nothing is estimated.

    tallies: one row for each score, with n0 and n1, how many rows of each label have it. The range that holds
    the target is cut into 512 until at most LISTED scores are left to be read.
    """
    heavy = lambda n0, n1: n0 * weight[0] + n1 * weight[1]
    low, high = tallies.agg(F.min("score"), F.max("score")).first()
    below = (0, 0)
    while True:
        inside = tallies.filter(F.col("score").between(low, high))
        bins = inside.groupBy(F.width_bucket("score", F.lit(low), F.lit(high), F.lit(512)).alias("bin")).agg(
            F.min("score").alias("low"), F.max("score").alias("high"), F.count("*").alias("scores"), F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
        ).orderBy("low").collect()
        for b in bins:
            upto = (below[0] + b["n0"], below[1] + b["n1"])
            if heavy(*upto) > target or b is bins[-1]:
                break
            below = upto
        low, high = b["low"], b["high"]
        if b["scores"] <= LISTED:
            break
    score, counts = F.col("score"), F.struct("score", "n0", "n1")
    before = tallies.filter(score < low).agg(F.max_by(counts, score)).first()[0]
    after = tallies.filter(score > high).agg(F.min_by(counts, score)).first()[0]
    n0, n1 = below
    if before:
        n0, n1 = n0 - before["n0"], n1 - before["n1"]
    at, values = [], []
    for r in [before, *tallies.filter(score.between(low, high)).orderBy("score").select("score", "n0", "n1").collect(), after]:
        if r:  # the middles of the first and the last row with this score; rows of label 0 come first
            at += [heavy(n0, n1) + weight[0 if r["n0"] else 1] / 2]
            n0, n1 = n0 + r["n0"], n1 + r["n1"]
            at += [heavy(n0, n1) - weight[1 if r["n1"] else 0] / 2]
            values += [r["score"]] * 2
    return float(np.interp(target, at, values))


def cut_score(scores: DataFrame, share_bad: float, margin: float = 0.03) -> float:
    """The score at the quantile `share_bad` of all rows of scores (score, y), the labels weighted by their shares in all labelled rows.

    The middle of the quantiles just below and above it, so that a gap between the labels is cut in its middle.
    """
    tallies = materialize(scores.groupBy("score").agg(F.sum(1 - F.col("y")).alias("n0"), F.sum("y").alias("n1")), "quality-scores")
    n0, n1 = tallies.agg(F.sum("n0"), F.sum("n1")).first()
    weight = share_bad / max(n0, 1), (1 - share_bad) / max(n1, 1)
    low, high = (value_at(tallies, share_bad * k, weight) for k in (1 - margin, 1 + margin))
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame) -> tuple[list[float], list[float], list[float], float]:
    """(centre, scale, weights, cut) from all labelled documents.

    Rows without a label or an id are passed over; without both labels every score is the same.
    Sums are rounded, as the order of their terms differs between runs.
    """
    known = labels.select(F.col("doc_id").alias("id"), F.col("quality").cast("int").alias("y")).filter("id IS NOT NULL AND y IN (0, 1)")
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    spark, before, size = docs.sparkSession, tables_made(), len(FEATURES)
    rows = labelled(docs, known.distinct())
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(n) < 2:
        drop_tables(spark, before)
        return [0.0] * size, [1.0] * size, [0.0] * size, 0.0
    total = n[0] + n[1]
    centre = np.round(summed(rows, "x", "f8", lambda x: x.sum(0)) / total, 12)
    scale = np.maximum(np.round(np.sqrt(summed(rows, "x", "f8", lambda x: np.square(x - centre).sum(0)) / total), 12), 1e-6)
    met = pairs(rows, n[0], n[1], centre, scale)
    w = np.round(newton(lambda w: summed(met, "d", "f4", lambda d: loss_sums(d, w)), size, PENALTY), 8)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = weighed(standard(matrix(batch.column("x"), "f8"), centre, scale), w)
                yield pa.RecordBatch.from_arrays([pa.array(found), batch.column("y")], ["score", "y"])

    scores = rows.select("x", "y").mapInArrow(judged, "score double, y int")
    cut = cut_score(scores, shares.get(0, 0) / sum(shares.values()))
    drop_tables(spark, before)
    return list(centre), list(scale), list(w), cut


def score_column(model: tuple, text: Column) -> Column:
    """The score (0 to 1) of a text; CUT falls on the model's quantile."""
    centre, scale, weights, cut = (np.array(v) for v in model)
    shift = math.log(CUT / (1 - CUT))

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        raw = weighed(standard(features(texts), centre, scale), weights)
        return pa.array(1 / (1 + np.exp(-np.clip(shift + (raw - cut), -40, 40))))

    return score(F.coalesce(text.cast("string"), F.lit("")))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of docs.

    Labels of held-out ids (crc32 of the id modulo 4 is 2) are not learned from. Null texts
    score like empty ones; a null id counts as the empty text in the split; rows that repeat an id
    are texts of their own; an empty table gives no rows; no other columns are looked at.
    """
    learned = doc_bucket(4) != 2
    model = fit(docs.filter(learned), labels.filter(learned))
    scored = docs.select("doc_id", (doc_bucket(4) == 2).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those that the classifier rejects; columns unchanged.

    Each row is judged by its own text, whatever its id; null texts are judged like empty ones; rows
    that repeat an id or a text are judged one by one. Without labels of both kinds all rows stay.
    Every label is learned from; only quality_report holds some ids out.
    """
    model = fit(docs, labels)
    return docs.filter(score_column(model, F.col("text")) >= CUT)
