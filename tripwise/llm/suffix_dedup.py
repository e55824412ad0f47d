"""Substring deduplication over sharded suffix arrays with a common-prefix interval tree.

Every string of MIN_LENGTH bytes holds an anchor: the position of the least hash among its
grams of GRAM bytes. Equal strings have equal anchors, so it is enough to sort the suffixes
around anchors that occur in more than one document:

1. Text blocks send the hashes of their anchors to buckets, which answer which ones repeat.
2. Blocks send the context of each repeated anchor (the bytes that any string of MIN_LENGTH
   through it can cover) to the bucket that owns the anchor's hash; equal contexts of a block
   are sent once, with their least doc_id.
3. A bucket sorts its distinct contexts' suffixes, start by start: the order for one start
   comes from that of the next by one stable pass over a single byte. Adjacent common prefixes
   form the interval tree; a stack scan yields its intervals of MIN_LENGTH and more, and those
   whose left extensions differ are the maximal repeats, each with all its contexts.
4. Occurrences in other documents than the one with the least doc_id are removed.

Repeats longer than a context come out as overlapping pieces, one for each anchor in them;
`repeat_groups` puts them together.
An anchor that very many blocks share is dealt by the strings through it, not by its hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import make_blocks, opened, pressed, rows_of, unpack
from .common import materialize
from .words import _VALUE, mixed, powers

MIN_LENGTH = 50
GRAM = 24
WINDOW = MIN_LENGTH - GRAM + 1  # grams in a string of MIN_LENGTH
LEFT, RIGHT = WINDOW - 1, MIN_LENGTH  # bytes of a context before and from its anchor
WIDTH = LEFT + RIGHT
HOT_BLOCKS = 4096
PIECE = 1_000_000  # positions worked on at once
HASH_BYTES, CONTEXT_BYTES = 2_000_000, 5_000_000  # of what a bucket gets; it needs some 30 and 15 times as much
LAST = np.iinfo(np.int64).max  # stands for a null doc_id: after all others

U = np.uint64


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of the anchors of all strings of MIN_LENGTH bytes within a text."""
    found, hashes = [np.zeros(0, np.int64)], [np.zeros(0, U)]
    for lo in range(0, len(raw), PIECE):
        hi = min(len(raw), lo + PIECE)  # starts of strings
        part = raw[lo : hi + MIN_LENGTH - 1]
        if len(part) < MIN_LENGTH:
            break
        up, down = powers(len(part))
        total = np.zeros(len(part) + 1, U)
        np.cumsum(_VALUE[part] * up[: len(part)], out=total[1:])
        h = mixed((total[GRAM:] - total[:-GRAM]) * down[: len(part) - GRAM + 1])
        low = (h >> U(32)).astype(np.uint32)
        at = np.arange(len(low), dtype=np.int32)
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            right = low[step:] < low[:-step]
            low = np.where(right, low[step:], low[:-step])
            at = np.where(right, at[step:], at[:-step])
            width += step
        valid = np.ones(len(at), bool)
        ends = offsets[np.searchsorted(offsets, lo, "right") : np.searchsorted(offsets, lo + len(at) + MIN_LENGTH) + 1]
        bad = (ends[:, None] - lo - np.arange(1, MIN_LENGTH)).ravel()
        valid[bad[(bad >= 0) & (bad < len(valid))]] = False
        own = at[valid]
        if len(own):
            own = own[np.concatenate([[True], own[1:] != own[:-1]])]
            found.append(own.astype(np.int64) + lo)
            hashes.append(h[own])
    position, code = np.concatenate(found), np.concatenate(hashes)
    new = np.concatenate([[True], position[1:] != position[:-1]]) if len(position) else np.zeros(0, bool)
    return position[new], code[new]


def _doc_ids(row: dict) -> np.ndarray:
    return np.array([LAST if i is None else i for i in row["ids"]], np.int64)


def _digests(raw: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    view = memoryview(np.ascontiguousarray(raw))
    return [hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _hash_bucket(codes: np.ndarray, buckets: int) -> np.ndarray:
    """Anchors are least hashes, so their leading bits are mostly 0; mixed once more they fill all buckets evenly."""
    return ((mixed(codes + U(7)) >> U(32)) * U(buckets) >> U(32)).astype(np.int64)


def _groups(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    held = bucket[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    for a, b in zip(first, [*first[1:], len(held)], strict=True):
        yield int(held[a]), order[a:b]


NAMES = "block string, digest binary, doc long"
ASKED = "bucket long, block string, keys binary, twice binary"
REPEATS = "block string, bucket long, answer binary"
CONTEXTS = "bucket long, block string, rows binary, left binary, right binary, docs binary"
COVER = "block string, bucket long, answer binary"
GROUPS = "block string, bucket long, answer binary"
#: A context's part in a repeat: its number among those that the block sent to the bucket, where the repeat starts in it, its length and name.
PART = np.dtype([("context", np.int32), ("start", np.uint8), ("length", np.uint8), ("repeat", np.int64)])


def _batch(rows: list[tuple], fields: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in (f.split(" ") for f in fields.split(", "))])
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


class Block:
    """A text block with its anchors' distinct hashes, in the order in which they are sent."""

    def __init__(self, row: dict):
        self.raw, self.offsets = unpack(row)
        self.docs = _doc_ids(row)
        self.digests = _digests(self.raw, self.offsets)
        self.position, codes = anchors(self.raw, self.offsets)
        self.doc = np.searchsorted(self.offsets, self.position, "right") - 1
        self.codes, self.code_of = np.unique(codes, return_inverse=True)

    def twice(self) -> np.ndarray:
        """Which distinct hashes occur in several documents of this block."""
        first = np.full(len(self.codes), -1)
        first[self.code_of[::-1]] = self.doc[::-1]
        out = np.zeros(len(self.codes), bool)
        out[self.code_of[self.doc != first[self.code_of]]] = True
        return out


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each distinct text of a block once, with its least doc_id there."""
    for row in rows_of(batches):
        raw, offsets = unpack(row)
        least: dict[bytes, int] = {}
        for digest, doc in zip(_digests(raw, offsets), _doc_ids(row).tolist(), strict=True):
            least[digest] = min(doc, least.get(digest, LAST))
        yield _batch([(row["block"], digest, doc) for digest, doc in least.items()], NAMES)


def _ask(buckets: int):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            b = Block(row)
            twice = b.twice()
            out = []
            for bucket, at in _groups(_hash_bucket(b.codes, buckets)):
                code = b.codes[at]
                keys = code.astype(np.uint32).tobytes() + ((code >> U(32)).astype(np.uint16)).tobytes()
                out.append((bucket, row["block"], keys, np.packbits(twice[at]).tobytes()))
            if out:
                yield _batch(out, ASKED)

    return ask


def _keys(data: bytes) -> np.ndarray:
    n = len(data) // 6
    return np.frombuffer(data[: 4 * n], np.uint32).astype(U) | (np.frombuffer(data[4 * n :], np.uint16).astype(U) << U(32))


def _repeats(hot_blocks: int):
    def repeats(table: pa.Table) -> pa.Table:
        """Which hashes occur in more than one document, and which in very many blocks."""
        bucket = table["bucket"][0].as_py()
        blocks, twice = table["block"].to_pylist(), table["twice"].to_pylist()
        codes = [_keys(k) for k in table["keys"].to_pylist()]
        every = np.concatenate(codes)
        known, n = np.unique(every, return_counts=True)
        flags = np.concatenate([np.unpackbits(np.frombuffer(d, np.uint8), count=len(c)) for d, c in zip(twice, codes, strict=True)])
        repeated = (n > 1) | (np.bincount(np.searchsorted(known, every), flags, len(known)) > 0)
        hot = n > hot_blocks
        out = []
        for block, c in zip(blocks, codes, strict=True):
            slot = np.searchsorted(known, c)
            out.append((block, bucket, np.packbits(np.stack([repeated[slot], hot[slot]])).tobytes()))
        return pa.Table.from_batches([_batch(out, REPEATS)])

    return repeats


class Shared:
    """The repeated anchors of a block, their contexts, and the distinct contexts it sends."""

    def __init__(self, row: dict, buckets: int, context_buckets: int):
        b = self.block = Block(row)
        told = {a["bucket"]: a["answer"] for a in row["repeats"] or []}
        flags = np.zeros((2, len(b.codes)), bool)
        for bucket, at in _groups(_hash_bucket(b.codes, buckets)):
            flags[:, at] = np.unpackbits(np.frombuffer(told[bucket], np.uint8), count=2 * len(at)).reshape(2, -1)
        # The least doc_id of each text: another block's, where that is smaller than all of this one's.
        first = {bytes(c["digest"]): c["least"] for c in row["copies"] or []}
        for digest, doc in zip(b.digests, b.docs.tolist(), strict=True):
            first[digest] = min(doc, first.get(digest, LAST))
        least = np.array([first[d] for d in b.digests], np.int64)
        sizes = np.diff(b.offsets)
        self.whole = (least < b.docs) & (sizes >= MIN_LENGTH)  # copies of a text with a smaller doc_id
        # One row stands for rows that repeat id and text.
        shown: dict[bytes, int] = {}
        stands = np.array([shown.setdefault(d, i) == i for i, d in enumerate(b.digests)], bool) & (least == b.docs)
        use = flags[0][b.code_of] & stands[b.doc]
        position, doc, code = b.position[use], b.doc[use], b.codes[b.code_of[use]]
        hot = flags[1][b.code_of[use]]
        left = np.minimum(position - b.offsets[doc], LEFT)
        right = np.minimum(b.offsets[doc + 1] - position, RIGHT)
        target = mixed(code + U(1))
        if hot.any():
            # Each string of MIN_LENGTH through a hot anchor is a context of its own, dealt by its bytes.
            at = np.repeat(np.flatnonzero(hot), LEFT + 1)
            l = np.tile(np.arange(LEFT + 1), hot.sum())
            fits = (l <= left[at]) & (MIN_LENGTH - l <= right[at])
            at, l = at[fits], l[fits]
            keep = np.flatnonzero(~hot)
            strings = b.raw[(position[at] - l)[:, None] + np.arange(MIN_LENGTH)]
            digest = np.array([int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") for s in strings], U)
            target = np.concatenate([target[keep], digest])
            left = np.concatenate([left[keep], l])
            right = np.concatenate([right[keep], MIN_LENGTH - l])
            at = np.concatenate([keep, at])
            position, doc = position[at], doc[at]
        self.position, self.doc, self.left, self.right = position, doc, left, right
        rows = contexts(b.raw, position, left, right)
        self.order, new = sort_contexts(rows, left, right)
        kind = np.cumsum(new) - 1
        self.kind = np.empty(len(position), np.int64)
        self.kind[self.order] = kind
        n = int(kind[-1]) + 1 if len(kind) else 0
        self.least = np.full(n, LAST)
        np.minimum.at(self.least, self.kind, b.docs[doc])
        first = self.order[new]
        self.first = first
        self.rows, self.sent_left, self.sent_right = rows[first], left[first], right[first]
        self.bucket = (target[first] % U(context_buckets)).astype(np.int64)


def contexts(raw: np.ndarray, position: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bytes around each position, 0 where the text has ended."""
    out = np.zeros((len(position), WIDTH), np.uint8)
    for k in range(WIDTH):
        have = (k >= LEFT - left) & (k < LEFT + right)
        out[have, k] = raw[position[have] - LEFT + k]
    return out


def sort_contexts(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the suffix at the anchor, then the bytes before it; and where a new context begins in that order."""
    wide = np.zeros((len(rows), 88), np.uint8)
    wide[:, :RIGHT] = rows[:, LEFT:]
    wide[:, 56 : 56 + LEFT] = rows[:, :LEFT][:, ::-1]
    wide[:, 86], wide[:, 87] = left, right
    keys = np.ascontiguousarray(wide).view(">u8").astype(U)
    order = np.lexsort(keys.T[::-1])
    held = keys[order]
    new = np.ones(len(rows), bool)
    new[1:] = (held[1:] != held[:-1]).any(axis=1)
    return order, new


def _send(buckets: int, context_buckets: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = Shared(row, buckets, context_buckets)
            out = []
            for bucket, at in _groups(s.bucket):
                out.append(
                    (
                        bucket,
                        row["block"],
                        pressed(np.ascontiguousarray(s.rows[at].T).tobytes()),
                        s.sent_left[at].astype(np.uint8).tobytes(),
                        s.sent_right[at].astype(np.uint8).tobytes(),
                        s.least[at].tobytes(),
                    )
                )
            if out:
                yield _batch(out, CONTEXTS)

    return send


def common_prefix(rows: np.ndarray, stop: np.ndarray, order: np.ndarray, start: int) -> np.ndarray:
    """Length of the common prefix of neighbours in `order`, of suffixes from `start` to their stops."""
    a, b = order[:-1], order[1:]
    out = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    most = np.minimum(stop[a], stop[b]) - start
    k = 0
    while len(live := live[most[live] > k]):
        live = live[rows[a[live], start + k] == rows[b[live], start + k]]
        out[live] += 1
        k += 1
    return out


def intervals(prefix: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals (first, last, common prefix) of the common-prefix interval tree, from `least` on, children first.

    prefix[i] belongs to the neighbours i and i + 1; a stack holds the open intervals.
    """
    stack: list[tuple[int, int]] = []
    for i, p in enumerate([*prefix.tolist(), 0]):
        first = i
        while stack and stack[-1][1] > p:
            first, held = stack.pop()
            yield first, i, held
        if p >= least and (not stack or stack[-1][1] < p):
            stack.append((first, p))


def maximal_repeats(rows: np.ndarray, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(start, length, members) of each maximal repeat of MIN_LENGTH and more among distinct contexts.

    rows must be in the order of the suffixes at the anchor. Suffixes of one start are compared
    with each other only: equal strings have their anchor at the same place.
    """
    order = np.arange(len(rows))
    begin, stop = LEFT - left, LEFT + right
    # Contexts that share no gram with a neighbour in this order share it with none.
    near = common_prefix(rows, stop, order, LEFT) >= GRAM
    shared = np.zeros(len(rows), bool)
    shared[1:] |= near
    shared[:-1] |= near
    order = order[shared]
    for start in range(LEFT, -1, -1):
        if start < LEFT:
            order = order[np.argsort(rows[order, start], kind="stable")]
        here = order[(begin[order] <= start) & (stop[order] - start >= MIN_LENGTH)]
        if len(here) < 2:
            continue
        prefix = common_prefix(rows, stop, here, start)
        joined = prefix >= MIN_LENGTH
        edge = np.flatnonzero(np.diff(np.concatenate([[0], joined.view(np.int8), [0]])))
        if not len(edge):
            continue
        # The byte to the left; none at the start of a text or context counts as one of its own.
        before = rows[here, start - 1].astype(np.int64) if start else np.full(len(here), -1)
        before[begin[here] == start] = -1
        change = np.concatenate([[0], np.cumsum((before[1:] != before[:-1]) | (before[1:] < 0))])
        for a, b in zip(edge[::2], edge[1::2], strict=True):
            if change[b] == change[a]:
                continue  # one left extension for the whole run: no interval of it is maximal
            for first, last, length in intervals(prefix[a:b], MIN_LENGTH):
                if change[a + last] != change[a + first]:
                    yield start, length, here[a + first : a + last + 1]


class Gathered:
    """All contexts that blocks sent to one bucket, and the distinct ones in suffix order."""

    def __init__(self, table: pa.Table):
        self.bucket, self.blocks = table["bucket"][0].as_py(), table["block"].to_pylist()
        lefts = [np.frombuffer(x, np.uint8).astype(np.int64) for x in table["left"].to_pylist()]
        self.sizes = [len(x) for x in lefts]
        rows = np.concatenate(
            [
                np.frombuffer(opened(x, WIDTH * n), np.uint8).reshape(WIDTH, n).T
                for x, n in zip(table["rows"].to_pylist(), self.sizes, strict=True)
            ]
        )
        self.left = np.concatenate(lefts)
        self.right = np.concatenate([np.frombuffer(x, np.uint8).astype(np.int64) for x in table["right"].to_pylist()])
        self.docs = np.concatenate([np.frombuffer(x, np.int64) for x in table["docs"].to_pylist()])
        order, new = sort_contexts(rows, self.left, self.right)
        self.kind = np.empty(len(rows), np.int64)
        self.kind[order] = np.cumsum(new) - 1
        first = order[new]
        self.d_rows, self.d_left, self.d_right = np.ascontiguousarray(rows[first]), self.left[first], self.right[first]


def _groups_of(table: pa.Table) -> pa.Table:
    """To each block: which of its contexts are part of which maximal repeat, and where.

    A context counts as a repeat of its own, since many documents may have it whole.
    """
    g = Gathered(table)
    n = len(g.d_rows)
    found = [(np.arange(n), LEFT - g.d_left, g.d_left + g.d_right)]
    for start, length, members in maximal_repeats(g.d_rows, g.d_left, g.d_right):
        found.append((members, np.full(len(members), start), np.full(len(members), length)))
    kinds, starts, lengths = (np.concatenate(x) for x in zip(*found, strict=True))
    name = lambda k, a, m: int.from_bytes(hashlib.blake2b(g.d_rows[k, a : a + m].tobytes(), digest_size=8).digest(), "little", signed=True)
    names = np.array([name(k, a, m) for k, a, m in zip(kinds, starts, lengths, strict=True)], np.int64)
    # All places of a piece are here only if the anchor is that of a string within the piece.
    _, some, which = np.unique(np.stack([names, starts], 1), axis=0, return_index=True, return_inverse=True)
    texts = [g.d_rows[kinds[i], starts[i] : starts[i] + lengths[i]] for i in some]
    edges = np.cumsum([0, *map(len, texts)])
    position, _ = anchors(np.concatenate(texts), edges)
    owner = np.searchsorted(edges, position, "right") - 1
    own = np.zeros(len(some), bool)
    own[owner[position - edges[owner] == LEFT - starts[some][owner]]] = True
    keep = own[which.ravel()]
    kinds, starts, lengths, names = kinds[keep], starts[keep], lengths[keep], names[keep]
    order = np.argsort(kinds, kind="stable")
    at = np.searchsorted(kinds[order], np.arange(n + 1))
    out, lo = [], 0
    for block, size in zip(g.blocks, g.sizes, strict=True):
        mine = g.kind[lo : lo + size]
        lo += size
        times = at[mine + 1] - at[mine]
        which = order[np.repeat(at[mine] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
        part = np.empty(len(which), PART)
        part["context"], part["start"], part["length"], part["repeat"] = np.repeat(np.arange(size), times), starts[which], lengths[which], names[which]
        out.append((block, g.bucket, part.tobytes()))
    return pa.Table.from_batches([_batch(out, GROUPS)])


def _cover(table: pa.Table) -> pa.Table:
    """For each context that a block sent, which of its bytes another, smaller document has too."""
    g = Gathered(table)
    bucket, sizes, kind, docs, left, right = g.bucket, g.sizes, g.kind, g.docs, g.left, g.right
    d_rows, d_left, d_right = g.d_rows, g.d_left, g.d_right
    first = np.arange(len(d_rows))
    least = np.full(len(first), LAST)
    np.minimum.at(least, kind, docs)
    lo, hi = np.full(len(first), WIDTH), np.zeros(len(first), np.int64)
    for start, length, members in maximal_repeats(d_rows, d_left, d_right):
        later = members[least[members] > least[members].min()]
        lo[later] = np.minimum(lo[later], start)
        hi[later] = np.maximum(hi[later], start + length)
    # All strings cover the anchor, so their union is one span. A context that a smaller document has is covered whole.
    whole = docs > least[kind]
    out_lo = np.where(whole, LEFT - left, lo[kind]).astype(np.uint8)
    out_hi = np.where(whole, LEFT + right, hi[kind]).astype(np.uint8)
    cuts = np.cumsum([0, *sizes])
    out = [
        (block, bucket, np.stack([out_lo[a:b], out_hi[a:b]]).tobytes())
        for block, a, b in zip(g.blocks, cuts[:-1], cuts[1:], strict=True)
    ]
    return pa.Table.from_batches([_batch(out, COVER)])


REMOVED = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<struct<start:long,end:long>>"


def _remove(buckets: int, context_buckets: int, texts: bool):
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batches):
            s = Shared(row, buckets, context_buckets)
            b = s.block
            lo, hi = np.zeros(len(s.least), np.int64), np.zeros(len(s.least), np.int64)
            told = {a["bucket"]: a["answer"] for a in row["cover"] or []}
            for bucket, at in _groups(s.bucket):
                lo[at], hi[at] = np.frombuffer(told[bucket], np.uint8).reshape(2, -1)
            later = b.docs[s.doc] > s.least[s.kind]  # the block itself has the context in a smaller document
            start = np.where(later, LEFT - s.left, lo[s.kind])
            stop = np.where(later, LEFT + s.right, hi[s.kind])
            hit = stop > start
            step = np.zeros(len(b.raw) + 1, np.int32)
            np.add.at(step, s.position[hit] - LEFT + start[hit], 1)
            np.add.at(step, s.position[hit] - LEFT + stop[hit], -1)
            gone = np.cumsum(step)[:-1] > 0
            # Rows that repeat id and text of a row of this block share its fate.
            shown: dict[bytes, int] = {}
            for i, d in enumerate(b.digests):
                a, z = b.offsets[i], b.offsets[i + 1]
                j = shown.setdefault(d, i)
                if s.whole[i]:
                    gone[a:z] = True
                elif j != i:
                    gone[a:z] = gone[b.offsets[j] : b.offsets[j + 1]]
            yield _rows_out(row, b, gone, texts)

    return remove


def _rows_out(row: dict, b: Block, gone: np.ndarray, texts: bool) -> pa.RecordBatch:
    at = b.offsets
    n = len(at) - 1
    before, after = np.concatenate([[False], gone[:-1]]), np.concatenate([gone[1:], [False]])
    inner = at[:-1][at[:-1] < len(gone)]
    before[inner] = False
    after[inner[inner > 0] - 1] = False
    first, last = np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1
    doc = np.searchsorted(at, first, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(first - at[doc]), pa.array(last - at[doc])], ["start", "end"])
    total = np.concatenate([[0], np.cumsum(gone)])
    kept = [np.ascontiguousarray(b.raw[a:z][~gone[a:z]]) for a, z in zip(at[:-1], at[1:], strict=True)]
    kept = [k.tobytes() if texts else hashlib.sha256(k).digest() for k in kept]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(row["ids"], pa.int64()),
            pa.array(np.diff(at)),
            pa.array(total[at[1:]] - total[at[:-1]], pa.int64()),
            pa.array(np.bincount(doc, minlength=n).astype(np.int64)),
            pa.array(kept, pa.binary()),
            pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(n + 1)).astype(np.int32)), spans),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans"],
    )


OCCURRENCES = "repeat long, length long, doc_id long, start long"


def _occurrences(buckets: int, context_buckets: int):
    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every place at which a document of the block has a repeat."""
        for row in rows_of(batches):
            s = Shared(row, buckets, context_buckets)
            told = {a["bucket"]: np.frombuffer(a["answer"], PART) for a in row["groups"] or []}
            by_kind = np.argsort(s.kind, kind="stable")
            at = np.searchsorted(s.kind[by_kind], np.arange(len(s.least) + 1))
            for bucket, sent in _groups(s.bucket):
                part = told[bucket]
                kind = sent[part["context"]]
                times = at[kind + 1] - at[kind]
                place = by_kind[np.repeat(at[kind] - (np.cumsum(times) - times), times) + np.arange(times.sum())]
                doc = s.doc[place]
                start = s.position[place] - s.block.offsets[doc] - LEFT + np.repeat(part["start"].astype(np.int64), times)
                ids = s.block.docs[doc]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(part["repeat"], times)),
                        pa.array(np.repeat(part["length"].astype(np.int64), times)),
                        pa.array(ids, pa.int64(), mask=ids == LAST),
                        pa.array(start),
                    ],
                    ["repeat", "length", "doc_id", "start"],
                )

    return occurrences


class Sharded:
    """Text blocks that know which of their anchors repeat, and the contexts that they send."""

    def __init__(self, docs: DataFrame, block_bytes: int, hot_blocks: int):
        blocks = make_blocks(docs.select("doc_id", "text"), block_bytes, "suffix-blocks")
        total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
        # About 0.41 bytes of hashes and, where a sixth of all anchors repeat, 0.8 bytes of contexts for each byte of text.
        buckets = int(max(12, -(-total * 41 // (100 * HASH_BYTES))))
        context_buckets = int(max(12, -(-total * 8 // (10 * CONTEXT_BYTES))))
        self.dealt = buckets, context_buckets
        names = materialize(blocks.mapInArrow(_name, NAMES), "suffix-names")
        least = names.groupBy("digest").agg(F.min("doc").alias("least"))
        copies = names.join(least, "digest").filter("least < doc").groupBy("block").agg(F.collect_list(F.struct("digest", "least")).alias("copies"))
        repeats = blocks.mapInArrow(_ask(buckets), ASKED).groupBy("bucket").applyInArrow(_repeats(hot_blocks), REPEATS)
        repeats = repeats.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("repeats"))
        told = blocks.join(materialize(repeats, "suffix-repeats"), "block", "left")
        self.told = told.join(materialize(copies, "suffix-copies"), "block", "left")
        self.sent = self.told.mapInArrow(_send(*self.dealt), CONTEXTS)

    def answered(self, work, fields: str, name: str) -> DataFrame:
        """The blocks with what the buckets' work on all contexts has for them, as the list `name`."""
        found = self.sent.groupBy("bucket").applyInArrow(work, fields).groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
        return self.told.join(materialize(found, f"suffix-{name}"), "block", "left")


def remove_repeats(docs: DataFrame, texts: bool = True, block_bytes: int = 3_000_000, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept, spans.

    A byte is removed if a string of MIN_LENGTH bytes that covers it also starts in a document
    with a smaller doc_id; strings are bytes of UTF-8, judged on the input, within one text.
    kept holds the remaining bytes (texts=False: their SHA-256 digest), spans the removed runs.
    Null texts are empty; a null doc_id comes after all others; repeats within a document stay;
    rows that repeat an id are one document whose texts don't remove each other.
    """
    shards = Sharded(docs, block_bytes, hot_blocks)
    return shards.answered(_cover, COVER, "cover").mapInArrow(_remove(*shards.dealt, texts), REMOVED)


def repeat_groups(docs: DataFrame, block_bytes: int = 3_000_000, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """(repeat, length, doc_id, start): repeats of MIN_LENGTH bytes and more with all their occurrences, of any length.

    The pieces that contexts give are put together where they overlap and occur at the same
    places: in the same documents, as far apart. A repeat around a more frequent one is listed from
    where it alone goes on. `repeat` numbers a group; a text that equals one with a smaller doc_id is
    listed with that document only; repeats within a document count too.
    """
    shards = Sharded(docs, block_bytes, hot_blocks)
    pieces = materialize(
        shards.answered(_groups_of, GROUPS, "groups").mapInArrow(_occurrences(*shards.dealt), OCCURRENCES).distinct(), "suffix-occurrences"
    )
    first = pieces.groupBy("repeat", "length").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    # Where a piece occurs, told from its first place: the same for all pieces of one repeat.
    pattern = F.bit_xor(F.xxhash64("doc_id", F.col("start") - F.col("first.start"))).alias("pattern")
    shaped = pieces.join(first, ["repeat", "length"]).groupBy("repeat", "length", "first", "n").agg(pattern)
    line = Window.partitionBy("first.doc_id", "n", "pattern").orderBy("first.start", "repeat", "length")
    reach = F.max(F.col("first.start") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first.start") > reach, F.lit(True)).cast("int")
    joined = shaped.withColumn("apart", apart).withColumn("line", F.sum("apart").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("first.doc_id", "n", "pattern", "line").agg(
        F.min_by(F.struct("repeat", F.col("length").alias("piece")), F.struct("first.start", "repeat")).alias("head"),
        (F.max(F.col("first.start") + F.col("length")) - F.min("first.start")).alias("length"),
    )
    heads = whole.select(F.col("head.repeat").alias("repeat"), F.col("head.piece").alias("piece"), "length")
    placed = pieces.withColumnRenamed("length", "piece").join(heads, ["repeat", "piece"])
    return placed.select(F.xxhash64("repeat", "piece").alias("repeat"), "length", "doc_id", "start")


def repeats_report(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256; see remove_repeats for nulls, ties and repeated ids.

    An empty table gives no rows; columns other than doc_id and text are not looked at.
    """
    return remove_repeats(docs, texts=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.lower(F.hex("kept")).alias("kept_sha256")
    )


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, k, substr(h, 2000 * k + 1, 2098) AS h FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 1000 * k + i AS i, hash(substr(h, 2 * i + 1, 100)) AS s
  FROM (SELECT doc_id, k, h, unnest(range(0, least(1000, greatest(len(h) // 2 - 49, 0)))) AS i FROM c)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s),
r AS (SELECT w.doc_id, w.i FROM w JOIN f ON f.s = w.s WHERE f.first < w.doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS span
      FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM r)),
s AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM g GROUP BY doc_id, span),
p AS (SELECT s.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS before FROM s),
k AS (SELECT p.doc_id, sum(z - a) AS gone, count(*) AS spans, max(z) AS last,
             string_agg(substr(d.h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head FROM p JOIN d ON d.doc_id = p.doc_id GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN k.doc_id IS NULL THEN h ELSE head || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
