"""Language-model scoring by context-tree weighting over bytes.

A byte is eight binary decisions; each decision has, for each depth 0 to DEPTH, a node named
by that many preceding bytes and the decisions already made. A node's Krichevsky-Trofimov
estimate comes from the training counts; its weighted probability is half its own estimate
and half the product of its children's. Scoring walks down the contexts and mixes the
estimates of all depths with the weights that training has left them.

Counts are gathered over the whole corpus: each text block lists its distinct byte grams with
their training counts and sends them to buckets that own whole subtrees; it gets back what it
needs to score its own grams. A subtree is cut off at the shortest context, of two bytes or more,
that holds no more than a small share of all listed grams, so no bucket owns a frequent context
whole. The nodes above the cuts (depth 0 and 1 and those of frequent contexts, whose number the
share bounds whatever the corpus) are added up by Spark and sent to all tasks. Word counts for
the baseline travel the same way, in buckets by hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import combine, make_blocks, rows_of, unpack
from .common import doc_bucket, materialize
from .words import LOWER, NOT_SPACE, mixed, words_of

DEPTH = 5
END_BYTE = 0xFF  # never occurs in UTF-8; closes each text
END_WORD = np.uint64(0x51ED270B35A7F9C5)
BUCKET_BYTES = 8_000_000
SHARE = 1 / 1024  # of all listed grams: contexts with more are frequent
PIECE = 1_000_000  # positions worked on at once

U = np.uint64
CONTEXT = np.array([(1 << 8 * d) - 1 for d in range(DEPTH + 1)], U)  # the latest d bytes of a context
LEVEL = 48  # a top node is named by its depth from this bit on, then its context and the decisions made


def _lgamma(x: np.ndarray) -> np.ndarray:
    """log Gamma for x >= 0.5: shifted by 8, then Stirling's series."""
    z = x + 8
    down = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    r = 1 / z
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + r / 12 - r**3 / 360 + r**5 / 1260 - r**7 / 1680 - down


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of so many zeros and ones."""
    return _lgamma(zeros + 0.5) + _lgamma(ones + 0.5) - _lgamma(zeros + ones + 1.0) - np.log(np.pi)


def grams(raw: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Codes of the DEPTH context bytes and the byte itself, for positions lo to hi of the closed texts.

    `raw` are the texts, each closed by END_BYTE; contexts do not reach beyond a text's start: 0 stands there.
    """
    first = max(0, lo - DEPTH)
    part = np.zeros(hi - lo + DEPTH, np.uint8)
    part[DEPTH - (lo - first) :] = raw[first:hi]
    starts = offsets[np.searchsorted(offsets, first) : np.searchsorted(offsets, hi)] - lo
    code = part[DEPTH:].astype(U)
    for k in range(1, DEPTH + 1):
        before = part[DEPTH - k : len(part) - k].astype(U)
        at = (starts[:, None] + np.arange(k)).ravel()
        before[at[(at >= 0) & (at < len(before))]] = 0
        code |= before << U(8 * k)
    return code


def texts_at(offsets: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The text of each position from lo to hi; every text has a closing byte, so none is empty."""
    i, j = np.searchsorted(offsets, [lo, hi - 1], "right") - 1
    edges = np.clip(offsets[i : j + 2], lo, hi)
    return np.repeat(np.arange(i, j + 1), np.diff(edges))


def closed(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts, each followed by END_BYTE, and their offsets."""
    n = len(offsets) - 1
    out = np.full(len(raw) + n, END_BYTE, np.uint8)
    keep = np.ones(len(out), bool)
    at = offsets + np.arange(n + 1)
    keep[at[1:] - 1] = False
    out[keep] = LOWER[raw]
    return out, at


def _distinct(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coded = pa.array(codes).dictionary_encode()
    return coded.dictionary.to_numpy(), coded.indices.to_numpy()


def block_grams(raw: np.ndarray, offsets: np.ndarray, train: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct grams of a block and how often training texts have each; `piece` positions are worked on at once."""
    raw, at = closed(raw, offsets)
    keys, counts = [], []
    for lo in range(0, len(raw), piece):
        hi = min(len(raw), lo + piece)
        own, index = _distinct(grams(raw, at, lo, hi))
        learned = train[texts_at(at, lo, hi)]
        keys.append(own)
        counts.append(np.bincount(index[learned], minlength=len(own)))
    return combine(keys, counts)


def block_words(raw: np.ndarray, offsets: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct word hashes, their training counts; the texts' words as hashes and offsets."""
    hashes, at = words_of(raw, offsets, NOT_SPACE)
    own, index = _distinct(hashes)
    learned = np.repeat(train, np.diff(at))
    keys, counts = combine([own, np.array([END_WORD])], [np.bincount(index[learned], minlength=len(own)), np.array([train.sum()])])
    return keys, counts, hashes, at


def split_by(bucket: np.ndarray, *arrays: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_bucket[1:] != sorted_bucket[:-1]]))
    for a, b in zip(first, [*first[1:], len(bucket)], strict=True):
        yield int(sorted_bucket[a]), [x[order[a:b]] for x in arrays]


def word_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys % U(buckets)).astype(np.int64)


def gram_bucket(keys: np.ndarray, cuts: np.ndarray, buckets: int) -> np.ndarray:
    """By the context at which the gram's subtree is cut off, so that whole subtrees stay together."""
    context = (keys >> U(8)) & CONTEXT[cuts]
    return (mixed(context | (cuts.astype(U) << U(LEVEL))) % U(buckets)).astype(np.int64)


def frequent_in(keys: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Contexts of 2 to DEPTH - 1 bytes with `least` of a block's grams or more: length, contexts, numbers of grams."""
    context = keys >> U(8)
    for d in range(2, DEPTH):
        own, inverse, n = np.unique(context & CONTEXT[d], return_inverse=True, return_counts=True)
        yield d, own[n >= least], n[n >= least]
        context = context[(n >= least)[inverse]]


def depths_of_cuts(keys: np.ndarray, frequent: dict[int, np.ndarray]) -> np.ndarray:
    """The length of each gram's shortest context that is not frequent; DEPTH where all shorter ones are."""
    context = keys >> U(8)
    cuts = np.full(len(keys), 2)
    for d, named in frequent.items():  # by rising length
        at = np.flatnonzero(cuts == d)
        x = context[at] & CONTEXT[d]
        cuts[at[named[np.minimum(np.searchsorted(named, x), len(named) - 1)] == x]] += 1
    return cuts


class Subtrees:
    """Nodes from the depths at which they are cut off down to DEPTH, over the grams of one bucket."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, cuts: np.ndarray):
        self.keys, y = keys, keys & U(0xFF)
        n = counts.astype(float)
        self.mix = np.full((len(keys), 8), np.nan)  # the mixture from the cut downwards for each decision; nan: unseen
        context = keys >> U(8)
        within = {d: np.flatnonzero(cuts <= d) for d in range(2, DEPTH + 1)}
        self.top: list[tuple[np.ndarray, np.ndarray]] = []
        for k in range(8):
            made = U(1 << k) | (y >> U(8 - k))
            bit = ((y >> U(7 - k)) & U(1)).astype(bool)
            child, child_log = np.zeros(0, np.int64), np.zeros(0)  # a row of each node one depth further down, its log weighted probability
            mixture = np.full(len(keys), np.nan)
            for d in range(DEPTH, 1, -1):
                rows = within[d]
                node = ((context[rows] & CONTEXT[d]) << U(8)) | made[rows]
                _, first, inverse = np.unique(node, return_index=True, return_inverse=True)
                ones = np.bincount(inverse, (n * bit)[rows], len(first))
                zeros = np.bincount(inverse, (n * ~bit)[rows], len(first))
                own = log_kt(zeros, ones)
                if d == DEPTH:
                    weighted, stay = own, np.zeros(len(first))
                else:
                    inside = cuts[child] <= d
                    parent = inverse[np.searchsorted(rows, child[inside])]
                    children = np.bincount(parent, child_log[inside], len(first))
                    weighted = np.logaddexp(own, children) + np.log(0.5)
                    stay = own + np.log(0.5) - weighted
                said = np.where(bit[rows], ones[inverse], zeros[inverse])
                both = (zeros + ones)[inverse]
                local = (said + 0.5) / (both + 1)
                w, deeper = np.exp(stay)[inverse], mixture[rows]
                mixed_in = np.where(np.isnan(deeper), local, w * local + (1 - w) * deeper)
                mixture[rows] = np.where(both > 0, mixed_in, np.nan)
                child, child_log = rows[first], weighted
                # What the nodes above the cut need: their counts and their children's log probabilities.
                edge = cuts[child] == d
                above = ((context[child[edge]] & CONTEXT[d - 1]) << U(8)) | made[child[edge]] | U((d - 1) << LEVEL)
                self.top.append(_added(above, np.stack([zeros[edge], ones[edge], weighted[edge]], axis=1)))
            self.mix[:, k] = mixture


def _added(nodes: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct nodes and the sums of their rows."""
    own, inverse = np.unique(nodes, return_inverse=True)
    return own, np.stack([np.bincount(inverse, c, len(own)) for c in sums.T], axis=1)


class TopNodes:
    """The nodes above the cuts, from the sums that all buckets sent.

    Depth 0 and 1 are tables of 256 by 256; deeper nodes are sorted lists: at most 255 for each frequent context.
    """

    def __init__(self, nodes: np.ndarray, sums: np.ndarray):
        depth, code = nodes >> LEVEL, nodes & ((1 << LEVEL) - 1)
        self.deep: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        up, up_sums = np.zeros(0, np.int64), np.zeros((0, 3))
        for d in range(DEPTH - 1, 1, -1):
            own, held = _added(np.concatenate([code[depth == d], up]), np.concatenate([sums[depth == d], up_sums]))
            zeros, ones, children = held.T
            kt = log_kt(zeros, ones)
            weighted = np.logaddexp(kt, children) + np.log(0.5)
            self.deep[d] = own, zeros, ones, np.exp(kt + np.log(0.5) - weighted)
            up = (((own >> 8) & int(CONTEXT[d - 1])) << 8) | (own & 255)
            up_sums = np.stack([zeros, ones, weighted], axis=1)
        own, held = _added(np.concatenate([code[depth == 1], up]), np.concatenate([sums[depth == 1], up_sums]))
        self.zeros, self.ones = np.zeros((256, 256)), np.zeros((256, 256))
        children = np.zeros((256, 256))
        c, m = own >> 8, own & 255
        self.zeros[c, m], self.ones[c, m], children[c, m] = held.T
        kt = log_kt(self.zeros, self.ones)
        weighted = np.logaddexp(kt, children) + np.log(0.5)
        self.stay = np.exp(kt + np.log(0.5) - weighted)
        self.zeros0, self.ones0 = self.zeros.sum(0), self.ones.sum(0)
        kt0 = log_kt(self.zeros0, self.ones0)
        self.stay0 = np.exp(kt0 + np.log(0.5) - (np.logaddexp(kt0, weighted.sum(0)) + np.log(0.5)))

    def log10(self, keys: np.ndarray, mix: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's byte in its context."""
        y, context = (keys & U(0xFF)).astype(np.int64), (keys >> U(8)).astype(np.int64)
        c = context & 0xFF
        above = {d: np.flatnonzero(cuts > d) for d in self.deep}
        total = np.zeros(len(keys))
        for k in range(8):
            m = (1 << k) | (y >> (8 - k))
            bit = ((y >> (7 - k)) & 1).astype(bool)
            p = mix[:, k].copy()
            for d, rows in above.items():  # by falling depth
                own, zeros, ones, stay = self.deep[d]
                at = np.searchsorted(own, ((context[rows] & int(CONTEXT[d])) << 8) | m[rows])
                z, o, w, deeper = zeros[at], ones[at], stay[at], p[rows]
                local = (np.where(bit[rows], o, z) + 0.5) / (z + o + 1)
                p[rows] = np.where(z + o > 0, np.where(np.isnan(deeper), local, w * local + (1 - w) * deeper), np.nan)
            z, o = self.zeros[c, m], self.ones[c, m]
            p1 = (np.where(bit, o, z) + 0.5) / (z + o + 1)
            w = self.stay[c, m]
            p1 = np.where(np.isnan(p), p1, w * p1 + (1 - w) * p)
            z0, o0 = self.zeros0[m], self.ones0[m]
            p0 = (np.where(bit, o0, z0) + 0.5) / (z0 + o0 + 1)
            w = self.stay0[m]
            p0 = np.where(z + o > 0, w * p0 + (1 - w) * p1, p0)
            total += np.log10(p0)
        return total


LISTED = "kind string, block string, n long, keys binary, counts binary"
ASKED = "kind string, bucket long, block string, keys binary, counts binary"
OWNED = "kind string, bucket long, known binary, sums binary, blocks array<string>, places array<binary>"
ANSWER = "block string, kind string, bucket long, answer binary"


def _schema(fields: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    schema = _schema(fields)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _narrow(counts: np.ndarray) -> bytes:
    return counts.astype(np.uint32 if counts.max(initial=0) < 2**32 else np.int64).tobytes()


def _wide(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint32 if len(data) == 4 * n else np.int64).astype(np.int64)


def _list(piece: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            raw, offsets = unpack(row)
            train = np.array(row["train"], bool)
            keys, counts, _, _ = block_words(raw, offsets, train)
            yield _batch([("word", row["block"], len(keys), keys.tobytes(), _narrow(counts))], LISTED)
            keys, counts = block_grams(raw, offsets, train, piece)
            yield _batch([("gram", row["block"], len(keys), keys.tobytes(), _narrow(counts))], LISTED)

    return listed


def _frequent(share: float):
    """Contexts with half the share of a block's grams or more: what is left out anywhere stays below half the share in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            for d, context, n in frequent_in(np.frombuffer(row["keys"], U), row["n"] * share / 2):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d)), pa.array(context.astype(np.int64)), pa.array(n)], ["length", "context", "n"])

    return count


def frequent_contexts(listed: DataFrame, grams: int, share: float) -> dict[int, np.ndarray]:
    """By length, the contexts that hold more than `share` of all listed grams, and none with less than half of it.

    A context with the share in all has half of it, less than half left out, in the blocks that name it.
    At most 2 / share contexts of a length come to the driver.
    """
    named = listed.filter("kind = 'gram'").select("n", "keys").mapInArrow(_frequent(share), "length long, context long, n long")
    found = named.groupBy("length", "context").agg(F.sum("n").alias("n")).filter(F.col("n") >= grams * share / 2).toArrow()
    length, context = found["length"].to_numpy(), found["context"].to_numpy().astype(U)
    return {d: np.sort(context[length == d]) for d in range(2, DEPTH) if (length == d).any()}


def _ask(buckets: int, frequent: dict[int, np.ndarray]):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            keys = np.frombuffer(row["keys"], U)
            counts = _wide(row["counts"], len(keys))
            words = row["kind"] == "word"
            bucket = word_bucket(keys, buckets) if words else gram_bucket(keys, depths_of_cuts(keys, frequent), buckets)
            yield _batch([(row["kind"], b, row["block"], k.tobytes(), _narrow(c)) for b, (k, c) in split_by(bucket, keys, counts)], ASKED)

    return ask


def _own(frequent: dict[int, np.ndarray]):
    """What all blocks sent to one bucket, summed: known keys, their counts or mixtures, and where each block's keys are.

    For grams, `sums` holds 8 mixtures of each key; a second row has what the nodes above the cuts need.
    """

    def own(table: pa.Table) -> pa.Table:
        kind, bucket = table["kind"][0].as_py(), table["bucket"][0].as_py()
        keys = [np.frombuffer(k, U) for k in table["keys"].to_pylist()]
        counts = [_wide(c, len(k)) for c, k in zip(table["counts"].to_pylist(), keys, strict=True)]
        known, total = combine(keys, counts)
        places = [np.searchsorted(known, k).astype(np.uint32).tobytes() for k in keys]
        blocks = table["block"].to_pylist()
        if kind == "word":
            rows = [(kind, bucket, known.tobytes(), total.tobytes(), blocks, places)]
            rows.append(("words", bucket, b"", np.array([total.sum(), (total > 0).sum()], np.int64).tobytes(), [], []))
        else:
            tree = Subtrees(known, total, depths_of_cuts(known, frequent))
            rows = [(kind, bucket, known.tobytes(), tree.mix.astype(np.float32).tobytes(), blocks, places)]
            nodes = np.concatenate([n for n, _ in tree.top]).astype(np.int64)
            rows.append(("top", bucket, nodes.tobytes(), np.concatenate([s for _, s in tree.top]).tobytes(), [], []))
        return pa.Table.from_batches([_batch(rows, OWNED)])

    return own


def _answer(top, frequent: dict[int, np.ndarray]):
    """To each block, in the order of its keys: word counts, or the log10 probabilities of its grams."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = TopNodes(*top.value)
        for row in rows_of(batches):
            known = np.frombuffer(row["known"], U)
            if row["kind"] == "word":
                said = np.frombuffer(row["sums"], np.int64)
                send = _narrow
            else:
                mix = np.frombuffer(row["sums"], np.float32).reshape(-1, 8).astype(float)
                said = nodes.log10(known, mix, depths_of_cuts(known, frequent))
                send = lambda x: x.astype(np.float32).tobytes()
            out = [
                (b, row["kind"], row["bucket"], send(said[np.frombuffer(p, np.uint32)]))
                for b, p in zip(row["blocks"], row["places"], strict=True)
            ]
            yield _batch(out, ANSWER)

    return answer


SUMS = "node long, zeros double, ones double, children double"
WORDS = -1  # the node number of the word totals, kept in zeros (tokens) and ones (distinct ones)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a bucket says about nodes above the cuts, or about words, as rows that can be added up."""
    for row in rows_of(batches):
        if row["kind"] == "words":
            n, v = np.frombuffer(row["sums"], np.int64).tolist()
            nodes, sums = np.array([WORDS]), np.array([[n, v, 0]], float)
        else:
            nodes, sums = np.frombuffer(row["known"], np.int64), np.frombuffer(row["sums"], np.float64).reshape(-1, 3)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.array(np.ascontiguousarray(c)) for c in sums.T)], ["node", "zeros", "ones", "children"])


SCORES = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long"


def _in_order(keys: np.ndarray, bucket: np.ndarray, answers: dict[int, bytes], read) -> np.ndarray:
    """Answers of all buckets put in the order of the block's sorted keys."""
    order = np.argsort(bucket, kind="stable")
    own, n = np.unique(bucket, return_counts=True)
    out = np.empty(len(keys))
    out[order] = np.concatenate([read(answers[int(b)], int(k)) for b, k in zip(own, n, strict=True)]) if len(keys) else []
    return out


def _score(totals: tuple[int, int], buckets: int, frequent: dict[int, np.ndarray], piece: int):
    n_all, v_all = totals

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            raw, offsets = unpack(row)
            n = len(offsets) - 1
            answers: dict[str, dict[int, bytes]] = {"word": {}, "gram": {}}
            for a in row["answers"]:
                answers[a["kind"]][a["bucket"]] = a["answer"]
            hashes, at = words_of(raw, offsets, NOT_SPACE)
            own, index = _distinct(hashes)
            keys = np.unique(np.append(own, END_WORD))
            count = _in_order(keys, word_bucket(keys, buckets), answers["word"], _wide)
            base_log = np.log10((count + 0.1) / (n_all + 0.1 * (v_all + 1)))
            slot, end = np.searchsorted(keys, own), int(np.searchsorted(keys, END_WORD))
            doc = np.repeat(np.arange(n), np.diff(at))
            base = np.bincount(doc, base_log[slot][index], n) + base_log[end]
            known = np.bincount(doc, (count[slot] > 0)[index], n) + (count[end] > 0)

            text, at_closed = closed(raw, offsets)
            pieces = [(lo, min(len(text), lo + piece)) for lo in range(0, len(text), piece)]
            seen = [_distinct(grams(text, at_closed, lo, hi)) for lo, hi in pieces]
            keys = np.unique(np.concatenate([k for k, _ in seen]))
            bucket = gram_bucket(keys, depths_of_cuts(keys, frequent), buckets)
            logs = _in_order(keys, bucket, answers["gram"], lambda a, _: np.frombuffer(a, np.float32))
            total = np.zeros(n)
            for (lo, hi), (own, index) in zip(pieces, seen, strict=True):
                total += np.bincount(texts_at(at_closed, lo, hi), logs[np.searchsorted(keys, own)][index], n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["ids"], pa.int64()),
                    pa.array(np.diff(at) + 1, pa.int64()),
                    pa.array(np.rint(known).astype(np.int64)),
                    pa.array(np.full(n, n_all, np.int64)),
                    pa.array(base),
                    pa.array(total),
                    pa.array(np.diff(at_closed), pa.int64()),
                ],
                ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes"],
            )

    return score


def score_documents(docs: DataFrame, training, block_bytes: int = 8_000_000, piece: int = PIECE, share: float = SHARE) -> DataFrame:
    """Scores every row of docs with a tree and word counts learned from the rows where `training` holds.

    training is a condition on doc_id. Returns doc_id, n_tokens, n_known, train_tokens,
    base_score, score (log10) and n_bytes. Texts are lower-cased (A-Z); null texts are empty; every
    text is closed by an end symbol, counted in n_bytes, so an empty one has a score too. A depth whose context training
    never saw is left out of the mixture. Without training rows all decisions are even.
    Repeated rows count as often as they occur. What a task holds is bounded by the block and
    bucket sizes (one longer text: by that text). Contexts with more than `share` of all listed
    grams are split over buckets; no score depends on it.
    """
    spark = docs.sparkSession
    blocks = make_blocks(docs.select("doc_id", "text"), block_bytes, "ctw-blocks")
    flagged = blocks.withColumn("train", F.transform("ids", lambda i: training(i)))
    listed = materialize(flagged.mapInArrow(_list(piece), LISTED), "ctw-grams")
    grams = listed.filter("kind = 'gram'").agg(F.sum("n")).first()[0] or 0
    frequent = frequent_contexts(listed, grams, share)
    # A listed gram takes 12 bytes.
    buckets = int(max(8, -(-12 * grams // BUCKET_BYTES)))
    asked = listed.mapInArrow(_ask(buckets, frequent), ASKED)
    owned = materialize(asked.groupBy("kind", "bucket").applyInArrow(_own(frequent), OWNED), "ctw-model")
    # At most 65,536 nodes, 255 for each frequent context, and one row for the words.
    added = (
        owned.filter("kind IN ('words', 'top')").mapInArrow(_sums, SUMS).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "children")]).toArrow()
    )
    node, sums = added["node"].to_numpy(), np.stack([added[c].to_numpy() for c in ("zeros", "ones", "children")], 1).reshape(-1, 3)
    totals = tuple(int(x) for x in sums[node == WORDS, :2].sum(0))
    nodes, held = node[node >= 0], sums[node >= 0]
    top = spark.sparkContext.broadcast((nodes, held))
    answers = (
        owned.filter("kind IN ('word', 'gram')")
        .mapInArrow(_answer(top, frequent), ANSWER)
        .groupBy("block")
        .agg(F.collect_list(F.struct("kind", "bucket", "answer")).alias("answers"))
    )
    return blocks.join(answers, "block").mapInArrow(_score(totals, buckets, frequent, piece), SCORES)


def language_model_report(docs: DataFrame) -> DataFrame:
    """Scores learned from the documents whose id's crc32 modulo 10 is not 0; the others are held out.

    One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of
    the text's probability), bits_per_byte (its code length for each byte and the end). A null id
    counts as the empty text in the split; rows that repeat an id are texts of their own; an empty
    table gives no rows; columns other than doc_id and text are not looked at.
    """
    scored = score_documents(docs, lambda i: F.crc32(F.coalesce(i.cast("string"), F.lit("")).cast("binary")) % 10 != 0)
    bits = -F.col("score") / math.log10(2) / F.col("n_bytes")
    return scored.select(
        "doc_id", (doc_bucket(10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", bits.alias("bits_per_byte")
    )
