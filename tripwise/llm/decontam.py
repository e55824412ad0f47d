"""Benchmark decontamination with suffix arrays over the training words.

Training documents are sharded; each shard sorts the suffixes of its word sequence that
can begin a match (those whose first words begin some test suffix) into a suffix array.
Every suffix of the test items is binary-searched in every shard; the range found holds
all locations of its window, and the matches are extended to their full length. Test
items travel to the shards in blocks of bounded size; documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import ALNUM, doc_slices, text_bytes, words_of

WINDOW = 10
FIRST = 3  # words that decide whether a suffix enters the array
FOUND = "row long, doc_id long, n_words long, runs array<struct<start:long,end:long>>, items array<string>, longest long"


class TestSuffixes:
    """The words of a block of items as ids of the block's own vocabulary, and their distinct windows."""

    def __init__(self, item_ids: list[str], texts: pa.Array, window: int):
        raw, offsets = text_bytes(texts)
        hashes, at = words_of(raw, offsets, ALNUM)
        self.vocabulary = np.unique(hashes)
        self.ids = np.concatenate([np.searchsorted(self.vocabulary, hashes) + 1, np.zeros(1, np.int64)]).astype(np.uint32)
        self.window, self.item_ids, self.at = window, item_ids, at
        sizes = np.diff(at)
        lengths = np.minimum(sizes, window)
        counts = np.where(sizes > 0, sizes - lengths + 1, 0)
        owner = np.repeat(np.arange(len(sizes)), counts)
        start = spread(at[:-1], counts)
        long = lengths[owner]
        keys = suffix_keys(self.ids, start, start + long, window)
        # Windows that items share are searched once; `items_of` lists the items of each.
        both = np.concatenate([keys, long[:, None].astype(keys.dtype)], axis=1)
        rows, inverse = np.unique(both, axis=0, return_inverse=True)
        inverse = inverse.ravel()
        self.keys, self.lengths = rows[:, :-1], rows[:, -1].astype(np.int64)
        order = np.argsort(inverse, kind="stable")
        self.starts, self.ends = start[order], at[1:][owner[order]]
        self.starts_at = np.searchsorted(inverse[order], np.arange(len(rows) + 1))
        pairs = np.unique(np.stack([inverse, owner], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        self.items_of, self.items_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1))
        self.least = int(min(FIRST, self.lengths.min())) if len(rows) else 0
        self.openings = np.unique(opening(self.keys, self.least)) if len(rows) else np.zeros(0, np.uint64)


def suffix_keys(ids: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int) -> np.ndarray:
    """The first `window` word ids from each start, 0 from stop on."""
    at = start[:, None] + np.arange(window)[None, :]
    keys = ids[np.minimum(at, len(ids) - 1)]
    keys[at >= stop[:, None]] = 0
    return keys


def opening(keys: np.ndarray, n: int) -> np.ndarray:
    code = np.zeros(len(keys), np.uint64)
    for k in range(n):
        code = code * np.uint64(0x100000001B3) + keys[:, k].astype(np.uint64)
    return code


def as_bytes(keys: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(keys.astype(">u4")).view(f"S{4 * keys.shape[1]}").ravel()


def search(ids: np.ndarray, at: np.ndarray, tests: TestSuffixes) -> tuple[np.ndarray, np.ndarray]:
    """All (window, location) pairs of one shard: word ids (0: not in any item) of texts at offsets `at`."""
    none = np.zeros(0, np.int64)
    if not len(tests.keys) or not len(ids):
        return none, none
    k = tests.least
    inside = ids > 0
    can = inside.copy()
    for j in range(1, k):
        can[:-j] &= inside[j:]
        can[-j:] = False
    start = np.flatnonzero(can)
    stop = at[1:][np.searchsorted(at, start, "right") - 1]
    fits = start + k <= stop
    start, stop = start[fits], stop[fits]
    keys = suffix_keys(ids, start, stop, k)
    known = np.isin(opening(keys, k), tests.openings)
    start, stop = start[known], stop[known]
    keys = as_bytes(suffix_keys(ids, start, stop, tests.window))
    order = np.argsort(keys, kind="stable")
    array, sorted_keys = start[order], keys[order]
    top = tests.keys.copy()
    top[np.arange(tests.window)[None, :] >= tests.lengths[:, None]] = 0xFFFFFFFF
    low = np.searchsorted(sorted_keys, as_bytes(tests.keys), "left")
    high = np.searchsorted(sorted_keys, as_bytes(top), "right")
    n = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(n)), n)
    where = array[spread(low, n)]
    return which, where


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1, ... with n[i] entries for each i, one after another."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


def extended(ids: np.ndarray, at: np.ndarray, tests: TestSuffixes, which: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Full length of each match: the words that go on agreeing after the window, in any item that has it."""
    n = tests.starts_at[which + 1] - tests.starts_at[which]
    pair = np.repeat(np.arange(len(which)), n)
    q = spread(tests.starts_at[which], n)
    length = tests.lengths[which][pair]
    stop = at[1:][np.searchsorted(at, where, "right") - 1][pair]
    live = np.arange(len(pair))
    while len(live):
        here, there = where[pair[live]] + length[live], tests.starts[q[live]] + length[live]
        ok = (here < stop[live]) & (there < tests.ends[q[live]])
        ok[ok] = ids[here[ok]] == tests.ids[there[ok]]
        live = live[ok]
        length[live] += 1
    best = np.zeros(len(which), np.int64)
    np.maximum.at(best, pair, length)
    return best


def scan_shard(doc_ids: pa.Array, rows: pa.Array, texts: pa.Array, tests: TestSuffixes) -> pa.RecordBatch:
    raw, offsets = text_bytes(texts)
    hashes, at = words_of(raw, offsets, ALNUM)
    ids = np.zeros(len(hashes), np.uint32)
    if len(tests.vocabulary):
        bit = np.zeros(1 << 20, bool)
        bit[tests.vocabulary & np.uint64(0xFFFFF)] = True
        maybe = np.flatnonzero(bit[hashes & np.uint64(0xFFFFF)])
        slot = np.minimum(np.searchsorted(tests.vocabulary, hashes[maybe]), len(tests.vocabulary) - 1)
        same = tests.vocabulary[slot] == hashes[maybe]
        ids[maybe[same]] = slot[same] + 1
    which, where = search(ids, at, tests)
    length = extended(ids, at, tests, which, where)
    n = len(doc_ids)
    # Hit words as maximal runs within a text.
    step = np.zeros(len(ids) + 1, np.int64)
    np.add.at(step, where, 1)
    np.add.at(step, where + tests.lengths[which], -1)
    hit = np.cumsum(step)[:-1] > 0
    before = np.concatenate([[False], hit[:-1]])
    after = np.concatenate([hit[1:], [False]])
    edge = at[:-1][at[:-1] < len(hit)]
    before[edge] = False
    after[edge[edge > 0] - 1] = False
    run_at, run_to = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1
    run_doc = np.searchsorted(at, run_at, "right") - 1
    runs = pa.StructArray.from_arrays(
        [pa.array(run_at - at[run_doc], pa.int64()), pa.array(run_to - at[run_doc], pa.int64())], ["start", "end"]
    )
    doc = np.searchsorted(at, where, "right") - 1
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, doc, length)
    seen = np.unique(np.stack([doc, which], 1), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    reps = tests.items_at[seen[:, 1] + 1] - tests.items_at[seen[:, 1]]
    item = tests.items_of[spread(tests.items_at[seen[:, 1]], reps)]
    pairs = np.unique(np.stack([np.repeat(seen[:, 0], reps), item], 1), axis=0) if len(item) else np.zeros((0, 2), np.int64)
    names = pa.array([tests.item_ids[i] for i in pairs[:, 1]], pa.string())
    cuts = lambda docs: pa.array(np.searchsorted(docs, np.arange(n + 1)).astype(np.int32))
    return pa.RecordBatch.from_arrays(
        [
            rows,
            doc_ids,
            pa.array(np.diff(at), pa.int64()),
            pa.ListArray.from_arrays(cuts(run_doc), runs),
            pa.ListArray.from_arrays(cuts(pairs[:, 0]), names),
            pa.array(longest, pa.int64()),
        ],
        ["row", "doc_id", "n_words", "runs", "items", "longest"],
    )


def item_blocks(benchmark: DataFrame, window: int, block_bytes: int) -> Iterator[tuple]:
    """Broadcast blocks of at most `block_bytes` of item text (or one item), one after another."""
    spark = benchmark.sparkSession
    items = benchmark.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).toArrow()
        # The name lets a worker keep what it built of a block from task to task.
        yield k, blocks, spark.sparkContext.broadcast((uuid.uuid4().hex, block["item_id"].to_pylist(), block["text"].combine_chunks(), window))


_latest: dict[str, TestSuffixes] = {}


def tests_of(sent) -> TestSuffixes:
    """The suffixes of a block, built once in each Python worker, which holds those of its latest block only."""
    name, ids, texts, window = sent.value
    if name not in _latest:
        _latest.clear()
        _latest[name] = TestSuffixes(ids, texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts, window)
    return _latest[name]


def find_matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 32_000_000) -> DataFrame:
    """One row per document: doc_id, n_words, runs of hit words, items with occurring windows, longest match in words.

    Words are lower-cased runs of ASCII letters, digits and non-ASCII characters, compared by 64
    bits each; null has none. A window is `window` consecutive words of an item, or all words of a
    shorter item. Items without words match nothing; without items nothing is hit; a null item_id
    is the item "". Rows that repeat an id are documents of their own, a null id stays null. Items
    come in blocks of at most `block_bytes` of text (or one item), each searched by a job of its
    own, so what a task and the driver hold of them is bounded.
    """
    keyed = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")
    )
    parts: list[DataFrame] = []
    for _, blocks, sent in item_blocks(benchmark, window, block_bytes):

        def scan(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = tests_of(sent)
            for batch in batches:
                _, offsets = text_bytes(batch.column("text"))
                for i, j in doc_slices(offsets):
                    part = batch.slice(i, j - i)
                    yield scan_shard(part.column("doc_id"), part.column("row"), part.column("text"), tests)

        if blocks == 1:
            return keyed.mapInArrow(scan, FOUND).drop("row")
        if not parts:  # the rows' numbers must be the same for every block
            keyed = materialize(keyed, "decontam-docs")
        parts.append(materialize(keyed.mapInArrow(scan, FOUND), "decontam-block"))
        sent.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    merged = found.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.max("longest").alias("longest"),
    )
    fold = F.expr(
        "aggregate(runs, cast(array() as array<struct<start:bigint,end:bigint>>), (done, r) -> "
        "CASE WHEN size(done) > 0 AND element_at(done, -1).end >= r.start THEN "
        "concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'end', "
        "greatest(element_at(done, -1).end, r.end)))) ELSE concat(done, array(r)) END)"
    )
    return merged.select("doc_id", "n_words", fold.alias("runs"), "items", "longest")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of a window, n_items the items with occurring
    windows, items_sha256 is of their sorted ids, comma-joined. See find_matches for nulls,
    repeated ids and empty tables; columns other than doc_id and text are not looked at.
    """
    found = find_matches(docs, benchmark, window)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    items = F.array_sort(F.array_distinct("items"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = 32_000_000) -> DataFrame:
    """docs without the rows whose text holds a benchmark window; columns unchanged.

    Each row is judged by its own text, whatever its id: rows that repeat an id, or have none, stay
    or go on their own. Where items fill one block, rows are filtered where they are. Several blocks
    search the rows one after another, each broadcast dropped before the next; the rows they hit
    then leave by an anti-join on a row number that is written beside the row.
    """
    name = "__text"
    while name in docs.columns:
        name += "_"
    left = docs.withColumn(name, F.col("text").cast("string"))
    row = name + "_row"
    while row in docs.columns:
        row += "_"
    hits: list[DataFrame] = []
    for _, blocks, sent in item_blocks(benchmark, window, block_bytes):

        def clean(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = tests_of(sent)
            for batch in batches:
                yield from (part.filter(pc.invert(hit)) for part, hit in judged(batch, name, tests))

        def dirty(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            tests = tests_of(sent)
            for batch in batches:
                for part, hit in judged(batch, name, tests):
                    yield pa.RecordBatch.from_arrays([part.column(row).filter(hit)], [row])

        if blocks == 1:
            return left.mapInArrow(clean, left.schema).drop(name)
        if not hits:  # the rows' numbers must be the same for every block
            left = materialize(left.withColumn(row, F.monotonically_increasing_id()), "decontam-docs")
        hits.append(materialize(left.select(row, name).mapInArrow(dirty, f"`{row}` long"), "decontam-hits"))
        sent.destroy()
    for hit in hits:
        left = left.join(hit, row, "left_anti")
    return left.select(*[F.col(f"`{c}`") for c in docs.columns])


def judged(batch: pa.RecordBatch, name: str, tests: TestSuffixes) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """A batch in slices of bounded text, with whether each row's text in column `name` holds a window."""
    at = batch.schema.get_field_index(name)
    _, offsets = text_bytes(batch.column(at))
    for i, j in doc_slices(offsets):
        part = batch.slice(i, j - i)
        none = pa.nulls(j - i, pa.int64())
        found = scan_shard(none, none, part.column(at), tests)
        yield part, pc.greater(pc.list_value_length(found.column("runs")), 0)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, h.n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
