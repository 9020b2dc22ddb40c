"""32-bit murmur3 (the x86 form) of UTF-8 texts, by numpy over Arrow's buffers: steps over blocks of four bytes, never over rows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The constants of murmur3.
FIRST, SECOND, ADD, MIX_1, MIX_2 = 0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35


def turned(x: np.ndarray, by: int) -> np.ndarray:
    return x << np.uint32(by) | x >> np.uint32(32 - by)


def scrambled(block: np.ndarray) -> np.ndarray:
    return turned(block * np.uint32(FIRST), 15) * np.uint32(SECOND)


def murmur32(texts: pa.Array, seed: int = 0) -> np.ndarray:
    """The unsigned hash of each string; a null counts as empty."""
    data = texts.fill_null("").cast(pa.large_binary())
    _, offsets, values = data.buffers()
    at = np.frombuffer(offsets, np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.append(np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8), np.zeros(4, np.uint8))
    start, size = at[:-1], np.diff(at)
    blocks, out = size // 4, np.full(len(data), seed & 0xFFFFFFFF, np.uint32)
    order = np.argsort(-blocks, kind="stable")
    longer = len(data) - np.searchsorted(blocks[order][::-1], np.arange(blocks.max(initial=0)), "right")
    for k, n in enumerate(longer):
        rows = order[:n]
        word = sum(raw[start[rows] + 4 * k + j].astype(np.uint32) << np.uint32(8 * j) for j in range(4))
        out[rows] = turned(out[rows] ^ scrambled(word), 13) * np.uint32(5) + np.uint32(ADD)
    end, left = start + 4 * blocks, size % 4
    tail = sum(np.where(left > j, raw[end + np.minimum(j, left)].astype(np.uint32) << np.uint32(8 * j), np.uint32(0)) for j in range(3))
    out ^= np.where(left > 0, scrambled(tail), np.uint32(0)) ^ size.astype(np.uint32)
    for mix, by in ((MIX_1, 16), (MIX_2, 13)):
        out = (out ^ out >> np.uint32(by)) * np.uint32(mix)
    return out ^ out >> np.uint32(16)


def murmur_bucket(text: Column, n: int, seed: int = 0) -> Column:
    """The text's murmur3 hash modulo ``n``, in Arrow batches."""

    @F.arrow_udf("long")
    def bucket(texts: pa.Array) -> pa.Array:
        return pa.array(murmur32(texts, seed).astype(np.int64) % n)

    return bucket(F.coalesce(text.cast("string"), F.lit("")))
