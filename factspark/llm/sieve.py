"""A Bloom filter of 64-bit keys, of at most ``MOST`` bits, that spares an exchange most rows that a join would drop.

It holds all of its keys and lets others through by chance: 1 in 70 at 16 bits a key or more, all of them once the keys far outnumber the bits. So a
join must follow, and the result never depends on the filter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factspark.llm.text import mix

#: 32 MB, in slices of 128 KB.
MOST, SLICE = 1 << 28, 1 << 20


def _bits(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(keys.astype(np.int64).view(np.uint64))
    return (x & np.uint64(size - 1)).astype(np.int64), (x >> np.uint64(64 - size.bit_length() + 1)).astype(np.int64)


def passing(keys: DataFrame, count: int, column: Column) -> Column:
    """Whether ``column`` may be one of the keys, about so many, in the only column of ``keys``; a null never is."""
    size = SLICE
    while size < min(MOST, 16 * count):
        size *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for b in batches:
            for at in _bits(b[0].drop_null().to_numpy(), size):
                seen[at] = True
        packed = np.packbits(seen).reshape(-1, SLICE // 8)
        used = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array([zlib.compress(packed[k].tobytes(), 1) for k in used], pa.binary())], ["slice", "bits"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["slice"].to_pylist(), b["bits"], strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint8)
                held[k] = held[k] | part if k in held else part
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([p.tobytes() for p in held.values()], pa.binary())], ["slice", "bits"])

    schema = "slice int, bits binary"
    filled = np.zeros((size // SLICE, SLICE // 8), np.uint8)
    for r in keys.mapInArrow(mark, schema).repartition(size // SLICE, "slice").mapInArrow(merge, schema).collect():  # MOST bits at most
        filled[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    table = keys.sparkSession.sparkContext.broadcast(filled.reshape(-1))

    def holds(values: pd.Series) -> pd.Series:
        known = values.notna().to_numpy()
        out = known.copy()
        for at in _bits(values[known].to_numpy(), size):
            out[known] &= (table.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
        return pd.Series(out)

    return F.pandas_udf(holds, "boolean")(column)
