"""Text blocks: whole documents packed and compressed, so that jobs that need a text more
than once, or need answers about it from elsewhere, move few large rows.

A job asks and is answered in three steps: each block sends keys to key-owning buckets, the
buckets combine what all blocks sent, and answers go back to the block that asked.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .words import text_bytes

SCHEMA = "block string, ids array<long>, sizes array<long>, n_bytes long, data binary"


def pressed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True) if data else b""


def opened(data: bytes, size: int) -> bytes:
    return pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def make_blocks(docs: DataFrame, block_bytes: int = 8_000_000, name: str = "blocks") -> DataFrame:
    """docs (doc_id, text) as blocks of about `block_bytes` of text, or one longer document.

    ids and sizes are parallel lists; data holds the texts' UTF-8 bytes, compressed. Written to
    the shared folder, since block names are drawn anew each time the job runs.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        sizes: list = []
        texts: list = []
        held = 0

        def flush():
            data = b"".join(texts)
            row = {"block": uuid.uuid4().hex, "ids": list(ids), "sizes": list(sizes), "n_bytes": len(data), "data": pressed(data)}
            ids.clear(), sizes.clear(), texts.clear()
            return pa.RecordBatch.from_pylist([row], schema=ARROW)

        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            doc_ids = batch.column("doc_id").to_pylist()
            i = 0
            while i < len(doc_ids):
                j = int(np.searchsorted(offsets, offsets[i] + max(1, block_bytes - held), "right")) - 1
                j = min(max(i + 1, j), len(doc_ids))
                ids += doc_ids[i:j]
                sizes += np.diff(offsets[i : j + 1]).tolist()
                texts.append(raw[offsets[i] : offsets[j]].tobytes())
                held += int(offsets[j] - offsets[i])
                i = j
                if held >= 0.9 * block_bytes or len(ids) >= 200_000:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    packed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(pack, SCHEMA)
    return materialize(packed, name)


ARROW = pa.schema(
    [
        ("block", pa.string()),
        ("ids", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int64())),
        ("n_bytes", pa.int64()),
        ("data", pa.binary()),
    ]
)


def unpack(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and the n + 1 offsets of a block's texts."""
    offsets = np.concatenate([[0], np.cumsum(np.array(row["sizes"], np.int64))]).astype(np.int64)
    return np.frombuffer(opened(row["data"], int(offsets[-1])), np.uint8), offsets


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def combine(keys: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their values."""
    all_keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    all_values = np.concatenate(values) if values else np.zeros(0, np.int64)
    order = np.argsort(all_keys, kind="stable")
    all_keys, all_values = all_keys[order], all_values[order]
    first = np.flatnonzero(np.concatenate([[True], all_keys[1:] != all_keys[:-1]])) if len(all_keys) else np.zeros(0, np.int64)
    return all_keys[first], np.add.reduceat(all_values, first) if len(first) else all_values
