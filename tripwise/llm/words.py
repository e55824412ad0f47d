"""Vectorised word splitting and hashing over Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Byte classes: what belongs to a word. UTF-8 bytes from 0x80 are letters in both.
NOT_SPACE = ~_SPACE
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

PIECE = 1_000_000

_rng = np.random.Generator(np.random.PCG64(20240229))
_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n + 1 powers of the hash base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n, PIECE) + 1
        _powers[:] = [np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(size, x, np.uint64)])) for x in (_BASE, _INVERSE)]
    return _powers[0], _powers[1]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finisher that spreads entropy over all 64 bits."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 offsets of its texts; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]] if len(at) else raw[:0], at - at[0] if len(at) else np.zeros(1, np.int64)


def doc_slices(offsets: np.ndarray, most: int = PIECE):
    """Ranges of texts of about `most` bytes together (at least one text each)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words_of(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (64 bits) of the lower-cased words of all texts in order, and n + 1 offsets of the texts into them.

    Works in pieces cut between words, so the extra memory doesn't grow with a text.
    """
    n = len(raw)
    inner = np.unique(offsets[:-1][offsets[:-1] < n])
    hashes, firsts, start = [], [], 0
    while start < n:
        stop = min(n, start + PIECE)
        while stop < n and kind[LOWER[raw[stop]]] and kind[LOWER[raw[stop - 1]]]:
            stop += 1
        low = LOWER[raw[start:stop]]
        is_word = kind[low]
        cut = np.zeros(stop - start, bool)
        cut[inner[np.searchsorted(inner, start) : np.searchsorted(inner, stop)] - start] = True
        begins = is_word.copy()
        begins[1:] &= ~is_word[:-1] | cut[1:]
        ends = is_word.copy()
        ends[:-1] &= ~is_word[1:] | cut[1:]
        b, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        up, down = powers(stop - start)
        total = np.zeros(stop - start + 1, np.uint64)
        np.cumsum(_VALUE[low] * up[: stop - start], out=total[1:])
        hashes.append(mixed((total[e] - total[b]) * down[b] + (e - b).astype(np.uint64)))
        firsts.append(b + start)
        start = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    # A word that a cut between pieces would split cannot occur: pieces end between words or at a text's end.
    return np.concatenate(hashes), np.searchsorted(np.concatenate(firsts), offsets, "left")
