"""Texts compressed one by one for an exchange, where they are the most of what stands on disk, and whole again behind it.

Each text's UTF-8 bytes go through zstd by themselves; a text that gets no shorter goes as it is, with as many bytes as its size. A null text stays
null, other columns pass unchanged, and what comes back equals what went in byte for byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from factspark.llm.text import CHUNK_BYTES, chunks

CODEC = "zstd"
_PACKED = [StructField("packed", BinaryType()), StructField("size", LongType())]


def packed(df: DataFrame) -> DataFrame:
    """``packed`` and ``size``, the bytes of the whole text, in place of the column ``text``."""
    rest = [c for c in df.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for b in batches:
            for i, j in chunks(b["text"]):
                raw = b["text"][i:j].cast(pa.large_binary()).to_pylist()
                small = [x if x is None or len(y := codec.compress(x, asbytes=True)) >= len(x) else y for x in raw]
                sizes = pa.array([None if x is None else len(x) for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([*(b[c][i:j] for c in rest), pa.array(small, pa.binary()), sizes], [*rest, "packed", "size"])

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in rest), *_PACKED]))


def unpacked(df: DataFrame) -> DataFrame:
    """The column ``text`` in place of ``packed`` and ``size``; about ``CHUNK_BYTES`` of text at once, or one longer text."""
    rest = [c for c in df.columns if c not in ("packed", "size")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec(CODEC)
        for b in batches:
            done = np.append(0, np.cumsum(pc.fill_null(b["size"], 0).to_numpy(zero_copy_only=False)))
            i = 0
            while i < b.num_rows:
                j = max(i + 1, int(np.searchsorted(done, done[i] + CHUNK_BYTES, side="right")) - 1)
                pairs = zip(b["packed"][i:j].to_pylist(), b["size"][i:j].to_pylist(), strict=True)
                raw = [x if x is None or len(x) == n else codec.decompress(x, n, asbytes=True) for x, n in pairs]
                yield pa.RecordBatch.from_arrays([*(b[c][i:j] for c in rest), pa.array(raw, pa.binary()).view(pa.string())], [*rest, "text"])
                i = j

    return df.mapInArrow(run, StructType([*(df.schema[c] for c in rest), StructField("text", StringType())]))
