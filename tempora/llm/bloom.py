"""A Bloom filter of fixed size over 64-bit hashes, filled by Spark and probed in numpy."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOOM_BITS, BLOOM_HASHES, BLOCK_BITS = 1 << 27, 3, 32_768


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """Bytes of the filter of column ``hash``: fixed at BLOOM_BITS / 8 (16 MB), built from blocks of 4 KB each that come to the driver compressed."""
    h = F.col("hash")
    low, high = h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32)
    bits = hashes.select(F.explode(F.array(*[(low + high * i) % BLOOM_BITS for i in range(BLOOM_HASHES)])).alias("bit"))
    blocks = bits.groupBy((F.col("bit") / BLOCK_BITS).cast("int").alias("block")).agg(F.bitmap_construct_agg(F.col("bit") % BLOCK_BITS).alias("bytes"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"block": b["block"], "bytes": pa.array([zlib.compress(x.as_py(), 1) for x in b["bytes"]], pa.binary())})

    found = blocks.mapInArrow(pack, "block int, bytes binary").toArrow()  # in one job
    out = np.zeros((BLOOM_BITS // BLOCK_BITS, BLOCK_BITS // 8), np.uint8)
    for block, data in zip(found["block"].to_pylist(), found["bytes"], strict=True):
        out[block] = np.frombuffer(zlib.decompress(data.as_py()), np.uint8)
    return out.reshape(-1)


def passing(value: np.ndarray, bloom: np.ndarray) -> np.ndarray:
    """Indices of the hashes (uint64) that the filter lets through."""
    left = np.arange(len(value))
    for i in range(BLOOM_HASHES):
        v = value[left]
        bit = ((v & np.uint64(0xFFFFFFFF)) + np.uint64(i) * (v >> np.uint64(32))) % np.uint64(BLOOM_BITS)
        left = left[(bloom[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return left
