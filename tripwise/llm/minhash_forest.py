"""Near-duplicate join on word shingles with a MinHash LSH forest.

Each distinct text gets one label string per tree: LABELS min-hash labels of a few bits. The
label strings of a tree, sorted, are a prefix trie: the texts below a node share its prefix, and
the least and the largest string below it tell where the node branches. The forest is worked on
from the longest prefixes upwards. At each depth only the nodes that branch there are looked
at, since in all others the texts have met further down already; exact Jaccard similarity
decides over every pair that meets for the first time. The similarities found say how many
links prefixes of that depth miss, and the prefixes are shortened for as long as the share
missed is above what the target recall allows. The shortest prefix ever needed is the one at
which each single pair at the threshold is found with the target probability.

A node's smallest id is its hub. Nodes of any size are worked on in chunks of bounded size, each
with a copy of the hub and in a task of its own. In one that needs several chunks, members
linked to the hub are already in one class; all others are compared with every other chunk
too, so no class misses a link. Where link counts are wanted, the members linked to the hub
are compared across chunks as well, in pairs of bounded blocks. Tasks send on a spanning
forest and link counts instead of pairs.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import NOT_SPACE, doc_slices, mixed, text_bytes, words_of

SHINGLE = 5
THRESHOLD = 0.8
TREES, LABELS, LABEL_BITS = 16, 6, 10
RECALL = 0.9995
CHUNK_DOCS, CHUNK_WORDS = 512, 1_000_000
BLOCK_DOCS, STRIP = 4096, 256
PRIOR = 10  # links at the threshold that are taken to exist besides those found

U = np.uint64
_rng = np.random.Generator(np.random.PCG64(1729))
_FACTORS = _rng.integers(0, 2**63, TREES * LABELS, dtype=np.uint64) * U(2) + U(1)
_STEPS = _rng.integers(0, 2**63, SHINGLE, dtype=np.uint64) * U(2) + U(1)
_ORDER = [_rng.integers(0, 2**63, 1, dtype=np.uint64)[0] * U(2) + U(1) for _ in range(2)]


def prefix_depth(threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES) -> int:
    """The longest prefix at which a pair at the threshold is found in some tree with the target probability."""
    depth = LABELS
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and offsets, shingle hashes and offsets of the texts.

    A text of fewer than SHINGLE words, but not none, is one shingle.
    """
    words, at = words_of(raw, offsets, NOT_SPACE)
    n = np.diff(at)
    count = np.where(n > 0, np.maximum(n - SHINGLE + 1, 1), 0)
    to = np.concatenate([[0], np.cumsum(count)])
    first = np.repeat(at[:-1] - to[:-1], count) + np.arange(to[-1])
    padded = np.concatenate([words, np.zeros(SHINGLE, U)])
    code = np.zeros(len(first), U)
    short = np.repeat(np.minimum(n, SHINGLE), count)
    for k in range(SHINGLE):
        code += np.where(short > k, padded[first + k], U(0)) * _STEPS[k]
    return words, at, mixed(code), to


def _segment_min(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Least value of each segment; the largest number for empty ones."""
    out = np.full(len(at) - 1, ~U(0))
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = np.minimum.reduceat(values, at[:-1][full])
    return out


def _segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, U), np.cumsum(values, dtype=U)])
    return total[at[1:]] - total[at[:-1]]


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, two order-dependent hashes of the words, number of words, one label string per tree."""
    for batch in batches:
        raw, offsets = text_bytes(batch.column("text"))
        for i, j in doc_slices(offsets):
            part = raw[offsets[i] : offsets[j]]
            words, at, code, to = shingles(part, offsets[i : j + 1] - offsets[i])
            n = np.diff(at)
            place = mixed((np.arange(len(words)) - np.repeat(at[:-1], n)).astype(U) + U(1))
            h = [_segment_sum(mixed(words * f + place), at) ^ n.astype(U) for f in _ORDER]
            trees = np.zeros((j - i, TREES), U)
            for t in range(TREES):
                for k in range(LABELS):
                    least = _segment_min((code ^ (code >> U(29))) * _FACTORS[t * LABELS + k], to)
                    trees[:, t] = (trees[:, t] << U(LABEL_BITS)) | (mixed(least) >> U(64 - LABEL_BITS))
            cuts = pa.array(np.arange(j - i + 1, dtype=np.int32) * TREES)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(i, j - i),
                    pa.array(h[0].view(np.int64)),
                    pa.array(h[1].view(np.int64)),
                    pa.array(n, pa.int64()),
                    pa.ListArray.from_arrays(cuts, pa.array(trees.ravel().view(np.int64))),
                ],
                ["doc_id", "h1", "h2", "n_words", "trees"],
            )


SIGNED = "doc_id long, h1 long, h2 long, n_words long, trees array<long>"
LINKS = "hub long, chunk long, chunks long, blocks long, doc_id long, root long, links long, with_hub boolean, missed array<double>"


def _sets(texts: pa.Array) -> list[np.ndarray]:
    raw, offsets = text_bytes(texts)
    _, _, code, to = shingles(raw, offsets)
    return [np.unique(code[a:b]) for a, b in zip(to[:-1], to[1:], strict=True)]


def common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many codes each set of a has in common with each set of b.

    Codes that many sets hold are counted by matrix products, the others pair by pair.
    """
    m, n = len(a), len(b)
    out = np.zeros((m, n), np.float32)
    codes = [np.concatenate(sets) if sets else np.zeros(0, U) for sets in (a, b)]
    both = np.intersect1d(*codes)
    if not len(both):
        return out
    sides = []
    for own, sets in zip(codes, (a, b), strict=True):
        column = np.minimum(np.searchsorted(both, own), len(both) - 1)
        held = np.flatnonzero(both[column] == own)
        held = held[np.argsort(column[held], kind="stable")]
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        sides.append((column[held], owner[held]))
    (ca, oa), (cb, ob) = sides
    na, nb = np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))
    often = na * nb * 256 >= m * n
    dense = np.flatnonzero(often)
    width = max(1, 4_000_000 // max(m, n))
    for lo in range(0, len(dense), width):
        some = dense[lo : lo + width]
        parts = []
        for column, owner, rows in ((ca, oa, m), (cb, ob, n)):
            i, j = np.searchsorted(column, [some[0], some[-1] + 1])
            inside = often[column[i:j]]
            part = np.zeros((rows, len(some)), np.float32)
            part[owner[i:j][inside], np.searchsorted(some, column[i:j][inside])] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    rare = ~often[ca]
    ca, oa = ca[rare], oa[rare]
    first_b = np.cumsum(nb) - nb
    ends = np.cumsum(nb[ca])
    lo = 0
    while lo < len(ca):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 4_000_000, "right")))
        times = nb[ca[lo:hi]]
        nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        with_b = ob[np.repeat(first_b[ca[lo:hi]], times) + nth]
        out += np.bincount(np.repeat(oa[lo:hi], times) * n + with_b, minlength=m * n).reshape(m, n)
        lo = hi
    return out


def similarity(sets: list[np.ndarray], others: list[np.ndarray] | None = None) -> np.ndarray:
    """Jaccard similarity of each set with each other one (of the same sets, where none are given; 0 with
    itself); sets without elements have none with any."""
    shared = common(sets, sets if others is None else others)
    if others is None:
        np.fill_diagonal(shared, 0)
    sizes = [np.array([len(s) for s in side], np.int64) for side in (sets, sets if others is None else others)]
    return shared / np.maximum(sizes[0][:, None] + sizes[1][None, :] - shared, 1)


def chance(similar: np.ndarray, depth: int, trees: int = TREES) -> np.ndarray:
    """The chance that a pair so similar shares a prefix of `depth` labels in some tree."""
    return 1 - (1 - similar**depth) ** trees


def _missed(similar: np.ndarray, counted: np.ndarray, floor: int) -> pa.Array:
    """For each row, and each depth from LABELS to `floor`: how many links that depth misses for those it found."""
    out = np.zeros((len(similar), LABELS - floor + 1))
    at, other = np.nonzero(counted)
    p = [chance(similar[at, other].astype(float), d) for d in range(LABELS, floor - 1, -1)]
    for k, found in enumerate(p):
        out[:, k] = np.bincount(at, (1 - found) / found, len(out))
    return pa.array(list(out), pa.list_(pa.float64()))


def _met(table: pa.Table, hub: int) -> list[np.ndarray]:
    """Codes of the nodes in which each member met others before: all further down, and this depth's with smaller hubs."""
    return [
        np.array([*met, *(h for h in hubs if h < hub)], np.int64).view(U)
        for met, hubs in zip(table["met"].to_pylist(), table["hubs"].to_pylist(), strict=True)
    ]


def roots(linked: np.ndarray) -> np.ndarray:
    """Least index of each row's connected component."""
    label = np.arange(len(linked))
    a, b = np.nonzero(linked)
    while True:
        low = label.copy()
        np.minimum.at(low, a, label[b])
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _verify(threshold: float, floor: int):
    def verify(table: pa.Table) -> pa.Table:
        """Links within a chunk, or between a chunk's members and visitors from other chunks."""
        table = table.sort_by("doc_id")
        ids = table["doc_id"].to_numpy()
        hub = table["hub"][0].as_py()
        guest, alone = np.array(table["visitor"].to_pylist(), bool), np.array(table["alone"].to_pylist(), bool)
        similar = similarity(_sets(table["text"].combine_chunks()))
        linked = (similar >= threshold) & (ids[:, None] != ids[None, :])
        if guest.any():
            # Both members without the hub's link visit each other: counted where the guest's id is smaller.
            twice = alone[:, None] & alone[None, :]
            first = np.where(guest[:, None], ids[:, None] < ids[None, :], ids[None, :] < ids[:, None])
            counted = linked & (guest[:, None] ^ guest[None, :]) & (~twice | first)
            linked &= guest[:, None] ^ guest[None, :]
        else:
            counted = linked.copy()
        earlier = _met(table, hub)
        counted &= common(earlier, earlier) == 0
        at_hub = np.flatnonzero((ids == hub) & ~guest)
        with_hub = linked[:, at_hub].any(axis=1) | (ids == hub)
        return pa.table(
            [
                *(table[c] for c in ("hub", "chunk", "chunks", "blocks", "doc_id")),
                pa.array(ids[roots(linked)]),
                pa.array(counted.sum(axis=1)),
                pa.array(with_hub),
                _missed(similar, counted, floor),
            ],
            ["hub", "chunk", "chunks", "blocks", "doc_id", "root", "links", "with_hub", "missed"],
        )

    return verify


def _count(threshold: float, floor: int):
    def count(table: pa.Table) -> pa.Table:
        """Link counts between different chunks of two blocks of a node, or of one block."""
        hub, left, right = (table[c][0].as_py() for c in ("hub", "left", "right"))
        block, chunk, ids = (table[c].to_numpy() for c in ("block", "chunk", "doc_id"))
        a, b = np.flatnonzero(block == left), np.flatnonzero(block == right)
        sets = _sets(table["text"].combine_chunks())
        earlier = _met(table, hub)
        pick = lambda items, at: [items[i] for i in at]
        links = np.zeros(len(ids), np.int64)
        sets_b, earlier_b = pick(sets, b), pick(earlier, b)
        for lo in range(0, len(a), STRIP):
            rows = a[lo : lo + STRIP]
            linked = (similarity(pick(sets, rows), sets_b) >= threshold) & (chunk[rows][:, None] != chunk[b][None, :])
            linked &= common(pick(earlier, rows), earlier_b) == 0
            links[rows] += linked.sum(axis=1)
            if left != right:
                links[b] += linked.sum(axis=0)
        n = len(ids)
        return pa.table(
            [
                *(table[c] for c in ("hub", "chunk", "chunks", "blocks", "doc_id", "doc_id")),
                pa.array(links),
                pa.array(np.zeros(n, bool)),
                pa.array([None] * n, pa.list_(pa.float64())),
            ],
            ["hub", "chunk", "chunks", "blocks", "doc_id", "root", "links", "with_hub", "missed"],
        )

    return count


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root): the least id of each node's connected component, for the nodes of edges (a, b) but the roots.

    Nodes of one edge to a smaller id join nothing, so they are taken off first and follow their
    neighbour; chunks send mostly such edges. The rest alternates large-star and small-star steps:
    each edge moves towards the least neighbour, so the number of rounds grows with the logarithm of
    a component's diameter.
    """
    every = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-edges")
    ends = every.select(F.explode(F.array("a", "b")).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    single = ends.filter("n = 1").select(F.col("v").alias("a"))
    leaves = every.join(single, "a", "left_semi")
    core = materialize(_stars(materialize(every.join(single, "a", "left_anti"), "near-core"), max_rounds), "near-roots")
    placed = leaves.join(core.select(F.col("id").alias("b"), "root"), "b", "left")
    return core.unionByName(placed.select(F.col("a").alias("id"), F.coalesce("root", "b").alias("root")))


def _stars(held: DataFrame, max_rounds: int) -> DataFrame:
    seen = None
    for _ in range(max_rounds):
        both = held.unionByName(held.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # A node of very many edges is hot in this join; where the nodes fit, Spark sends them to all tasks instead.
        low = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "near-low")
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        held = materialize(
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct(),
            "near-edges",
        )
        now = held.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return held.select(F.col("a").alias("id"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("components did not settle")


def branching(strings: DataFrame, depth: int) -> DataFrame:
    """Members (hub, doc_id, n_words) of the trie nodes of `depth` labels that branch there.

    strings has copy_id, n_words, tree and labels. A node's hub is its least copy_id. Where all
    its texts share one label more, they meet in that child already. Nodes of one hub are one.
    """
    prefix = lambda d, c: F.shiftrightunsigned(c, LABEL_BITS * (LABELS - d))
    placed = strings.withColumn("prefix", prefix(depth, "labels"))
    nodes = (
        placed.groupBy("tree", "prefix")
        .agg(F.min("copy_id").alias("hub"), F.max("copy_id").alias("top"), F.min("labels").alias("low"), F.max("labels").alias("high"))
        .filter("hub <> top")
    )
    if depth < LABELS:
        nodes = nodes.filter(prefix(depth + 1, "low") != prefix(depth + 1, "high"))
    return placed.join(nodes.select("tree", "prefix", "hub"), ["tree", "prefix"]).select("hub", F.col("copy_id").alias("doc_id"), "n_words").distinct()


def placements(strings: DataFrame, depth: int) -> DataFrame:
    """(depth, hub, doc_id, chunks, blocks): a depth's members, and in how many parts their node is worked on."""
    members = materialize(branching(strings, depth), "near-members")
    parts = lambda docs: F.greatest(F.ceil(F.col("n") / docs), F.ceil(F.col("words") / CHUNK_WORDS))
    sizes = members.groupBy("hub").agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("words"))
    # One row for some CHUNK_DOCS members at most; written, so that Spark knows whether it may be broadcast.
    crowded = materialize(sizes.select("hub", parts(CHUNK_DOCS).alias("chunks"), parts(BLOCK_DOCS).alias("blocks")).filter("chunks > 1"), "near-crowded")
    one = F.lit(1).cast("long")
    return members.join(crowded, "hub", "left").select(
        F.lit(depth).alias("depth"), "hub", "doc_id", F.coalesce("chunks", one).alias("chunks"), F.coalesce("blocks", one).alias("blocks")
    )


def _with_texts(held: DataFrame, narrow: DataFrame, depth: int) -> DataFrame:
    """Rows of narrow (doc_id, hub and more) with the text and the nodes met before; texts move by doc_id, so no hub is hot."""
    more = [c for c in narrow.columns if c != "doc_id"]
    lists = narrow.groupBy("doc_id").agg(F.collect_list(F.struct(*more)).alias("p"))
    hubs = F.transform(F.filter("at", lambda x: x["depth"] == depth), lambda x: x["hub"])
    met = F.transform(F.filter("at", lambda x: x["depth"] > depth), lambda x: F.xxhash64(x["depth"], x["hub"]))
    rows = held.join(lists, "doc_id").select("doc_id", "text", hubs.alias("hubs"), met.alias("met"), F.explode("p").alias("p"))
    return rows.select("doc_id", "text", "hubs", "met", "p.*")


CARRIED = ("chunks", "blocks", "doc_id", "hubs", "met", "text")


def _in_chunks(held: DataFrame, depth: int, threshold: float, floor: int) -> DataFrame:
    """Links within the chunks of a depth's nodes; the hub itself goes to every chunk."""
    here = F.filter("at", lambda x: x["depth"] == depth)
    met = F.transform(F.filter("at", lambda x: x["depth"] > depth), lambda x: F.xxhash64(x["depth"], x["hub"]))
    rows = held.select("doc_id", "text", F.transform(here, lambda x: x["hub"]).alias("hubs"), met.alias("met"), F.explode(here).alias("p"))
    rows = rows.select("doc_id", "text", "hubs", "met", "p.hub", "p.chunks", "p.blocks")
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    spread = F.when(F.col("hub") == F.col("doc_id"), every).otherwise(F.array(F.pmod(F.xxhash64("doc_id"), "chunks")))
    own = rows.select("hub", F.explode(spread).alias("chunk"), F.lit(False).alias("visitor"), F.lit(False).alias("alone"), *CARRIED)
    return own.groupBy("hub", "chunk").applyInArrow(_verify(threshold, floor), LINKS)


def _between_chunks(held: DataFrame, found: DataFrame, depth: int, threshold: float, floor: int) -> DataFrame:
    """Links of members that their crowded node's hub does not link, with the other chunks of the node."""
    crowd = found.filter("chunks > 1 AND doc_id <> hub").select("hub", "doc_id", "chunk", "chunks", "blocks", (~F.col("with_hub")).alias("alone"))
    counts = materialize(
        crowd.filter("alone").groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / CHUNK_DOCS).alias("parties")), "near-parties"
    )
    crowd = crowd.join(counts, "hub").withColumn("party", F.pmod(F.xxhash64("doc_id", F.lit(1)), "parties"))
    rows = _with_texts(held, crowd, depth)
    every = F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)
    parties = F.sequence(F.lit(0).cast("long"), F.col("parties") - 1)
    others = F.explode(F.filter(every, lambda c: c != F.col("chunk")))
    guests = rows.filter("alone").select("hub", others.alias("chunk"), "party", F.lit(True).alias("visitor"), "alone", *CARRIED)
    hosts = rows.select("hub", "chunk", F.explode(parties).alias("party"), F.lit(False).alias("visitor"), "alone", *CARRIED)
    return hosts.unionByName(guests).groupBy("hub", "chunk", "party").applyInArrow(_verify(threshold, floor), LINKS)


def _across_chunks(held: DataFrame, found: DataFrame, depth: int, threshold: float, floor: int) -> DataFrame:
    """Link counts between chunks of members that their crowded node's hub links, block by block."""
    linked = found.filter("chunks > 1 AND with_hub AND doc_id <> hub")
    block = F.floor(F.col("chunk") * F.col("blocks") / F.col("chunks"))
    rows = _with_texts(held, linked.select("hub", "doc_id", "chunk", "chunks", "blocks", block.alias("block")), depth)
    own = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = own.select("hub", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "chunk", *CARRIED)
    return met.groupBy("hub", "left", "right").applyInArrow(_count(threshold, floor), LINKS)


def links_by_depth(held: DataFrame, threshold: float, recall: float, floor: int, count_links: bool) -> DataFrame:
    """Links (doc_id, root, links) found at prefixes of LABELS labels and shorter, down to the depth that reaches the recall.

    What a depth misses is estimated from the links it found, each standing for 1 / chance of them;
    PRIOR links at the threshold are taken to exist besides, so that few links prove nothing.
    """
    every: list[DataFrame] = []
    for k, depth in enumerate(range(LABELS, floor - 1, -1)):
        found = materialize(_in_chunks(held, depth, threshold, floor), "near-links")
        parts = [found]
        crowded = found.filter("chunks > 1")
        if not crowded.filter("NOT with_hub").isEmpty():
            parts.append(_between_chunks(held, found, depth, threshold, floor))
        if count_links and not crowded.isEmpty():
            parts.append(_across_chunks(held, found, depth, threshold, floor))
        if len(parts) > 1:
            found = materialize(functools.reduce(DataFrame.unionByName, parts), "near-found")
        every.append(found)
        if depth > floor:
            so_far = functools.reduce(DataFrame.unionByName, every)
            n, missed = so_far.agg(F.sum("links"), F.sum(F.get("missed", F.lit(k)))).first()
            missed = (missed or 0) + PRIOR * (1 - chance(np.float64(threshold), depth))
            if missed <= (1 - recall) * (n or 0):
                break
    return functools.reduce(DataFrame.unionByName, every).select("doc_id", "root", "links")


def near_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, count_links: bool = True) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_id, n_links.

    Words are lower-cased (A-Z) runs of other than white space; similarity is Jaccard's over the
    sets of five-word shingles (fewer words: one shingle of all). Rows of equal words are
    copies: copy_id is their least doc_id. class_id is the least doc_id of all documents joined
    by links of at least `threshold`, directly or through others. n_links counts all links of
    the copies' text with other texts. Without `count_links` it leaves out, in nodes of more
    than a chunk, those between chunks of two texts that are both linked to the hub: classes
    don't need them. Texts without words (null, empty, blank) are copies of each other and have
    no links. A row without doc_id has neither class nor links; rows that repeat an id are one
    document. An empty table gives no rows.
    """
    floor = prefix_depth(threshold, recall)
    texts = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    signed = materialize(texts.mapInArrow(signatures, SIGNED), "near-signatures")
    copies = materialize(
        signed.filter("doc_id IS NOT NULL")
        .groupBy("h1", "h2")
        .agg(F.min("doc_id").alias("copy_id"), F.first("n_words").alias("n_words"), F.first("trees").alias("trees")),
        "near-copies",
    )
    strings = copies.filter("n_words > 0").select("copy_id", "n_words", F.posexplode("trees").alias("tree", "labels"))
    placed = functools.reduce(DataFrame.unionByName, [placements(strings, d) for d in range(LABELS, floor - 1, -1)])
    # A text is in one node of a tree and depth at most, so these lists are short.
    wanted = placed.groupBy("doc_id").agg(F.collect_list(F.struct("depth", "hub", "chunks", "blocks")).alias("at"))
    # The texts that meet others are read and moved once, and by a shuffle whatever their number.
    held = materialize(texts.join(wanted.hint("shuffle_merge"), "doc_id").select("doc_id", "text", "at"), "near-texts")
    found = links_by_depth(held, threshold, recall, floor, count_links)
    joined = components(found.select(F.col("doc_id").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy(F.col("doc_id").alias("copy_id")).agg(F.sum("links").alias("n_links"))
    named = (
        copies.select("h1", "h2", "copy_id")
        .join(joined.withColumnRenamed("id", "copy_id"), "copy_id", "left")
        .join(degree, "copy_id", "left")
        .select("h1", "h2", "copy_id", F.coalesce("root", "copy_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    known = F.col("doc_id").isNotNull()
    return signed.select("doc_id", "h1", "h2").join(named, ["h1", "h2"], "left").select(
        "doc_id",
        F.when(known, F.col("class_id")).alias("class_id"),
        F.when(known, F.col("copy_id")).alias("copy_id"),
        F.when(known, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def drop_near_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with the least doc_id of each class only; columns unchanged.

    Where rows repeat an id with other texts or have none, each (id, text) is a document of its
    own, known by 64 bits. A null id comes after all others; rows that agree in id (or in having
    none) and text stay or go together.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    seen = docs.groupBy("doc_id").agg(F.min(F.xxhash64(text)).alias("low"), F.max(F.xxhash64(text)).alias("high"))
    split = materialize(seen.filter("doc_id IS NULL OR low <> high").select(F.col("doc_id").alias("__split")), "near-split")
    if split.isEmpty():
        gone = near_classes(docs, threshold, count_links=False).filter("doc_id <> class_id").select(F.col("doc_id").alias("__gone")).distinct()
        return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    own = F.when(F.col("doc_id").isNull() | F.col("__split").isNotNull(), F.xxhash64("doc_id", text)).otherwise(F.col("doc_id").cast("long"))
    marked = docs.join(split, docs["doc_id"] == split["__split"], "left").withColumn("__own", own)
    each = materialize(marked.select("__own", F.col("doc_id").alias("id"), "text").dropDuplicates(["__own"]), "near-each")
    classes = near_classes(each.select(F.col("__own").alias("doc_id"), "text"), threshold, count_links=False)
    named = materialize(classes.select(F.col("doc_id").alias("__own"), "class_id").join(each.select("__own", "id"), "__own"), "near-named")
    least = named.groupBy("class_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "__own"))["__own"].alias("stays"))
    gone = named.join(least, "class_id").filter("__own <> stays").select(F.col("__own").alias("__gone"))
    return marked.join(gone, marked["__own"] == gone["__gone"], "left_anti").select(*docs.columns)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
c AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS copy_id FROM d),
s AS (SELECT DISTINCT copy_id, CASE WHEN len(w) < 5 THEN hash(w) ELSE hash(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) END AS g
      FROM (SELECT copy_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM c WHERE doc_id = copy_id AND len(w) > 0)),
n AS (SELECT copy_id, count(*) AS n FROM s GROUP BY copy_id),
l AS (SELECT a.copy_id AS a, b.copy_id AS b FROM s a JOIN s b ON a.g = b.g AND a.copy_id <> b.copy_id
      JOIN n na ON na.copy_id = a.copy_id JOIN n nb ON nb.copy_id = b.copy_id
      GROUP BY a.copy_id, b.copy_id HAVING count(*) >= CAST(0.8 AS DOUBLE) * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
k AS (SELECT a, min(b) AS b FROM r GROUP BY a),
m AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT c.doc_id, least(c.copy_id, coalesce(k.b, c.copy_id)) AS class_id, c.copy_id, coalesce(m.n, 0) AS n_links
FROM c LEFT JOIN k ON k.a = c.copy_id LEFT JOIN m ON m.a = c.copy_id
UNION ALL SELECT NULL, NULL, NULL, 0 FROM documents WHERE doc_id IS NULL
"""
