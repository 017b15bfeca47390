"""Near-duplicate detection by improved consistent weighted sampling.

Shingles of five words are weighed by tf-idf: the k-th copy of a shingle in a document is an element of its own, and an element weighs
the root of 1 + ln((1 + N) / (1 + df)), on a grid of ``LEVELS`` steps. df counts all documents, in 2**20 hashed features, so the table of
weights has a fixed size; a feature is told from a rarer one down to a share of about 1 in 2,000 documents. The root keeps a large family
of copies from being torn apart by its own frequency.

Each sample draws r, c ~ Gamma(2, 1) and beta ~ U(0, 1) for an element from 65,536 tabled draws, chosen by a hash of (element, sample), and
keeps the element with the least a = c / (y exp(r)), y = exp(r (t - beta)), t = floor(ln w / r + beta); two documents share a sample with the
chance of their weighted Jaccard similarity. Bands of samples are joined in Spark, and pairs are verified by their weighted Jaccard similarity.

``near`` says how bands become classes. A null id takes no part: its class is null and it is kept. A document is an id with a text; equal texts without
a word are one class.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm import near
from factspark.llm.frames import NO_ID, documents, public_id
from factspark.llm.near import THRESHOLD
from factspark.llm.text import chunks, mix, numbered, segment_min, shingles_of_words, word_hashes

FEATURE_BITS, SLICE_BITS = 20, 16
LEVELS, LEVEL_STEP = 16, 1 / 12
_DRAWS = 1 << 16
_EMPTY = (1 << 32) - 1
_CODE_BITS = 20  # ranks of a; 12 bits of the element's hash go below
_RNG = np.random.Generator(np.random.PCG64(4711))
_SALTS = _RNG.integers(0, 1 << 31, (near.SAMPLES, 2), dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@cache
def _table() -> np.ndarray:
    """The rank of a, in the high bits, for each weight level and draw; the same draw and t have the same rank at every level."""
    rng = np.random.Generator(np.random.PCG64(815))
    r, c, beta = rng.gamma(2.0, 1.0, _DRAWS), rng.gamma(2.0, 1.0, _DRAWS), rng.random(_DRAWS)
    t = np.floor((np.arange(LEVELS) * LEVEL_STEP)[:, None] / r + beta)
    log_a = np.log(c) - r * (t - beta) - r
    return np.unique(log_a, return_inverse=True)[1].reshape(-1).astype(np.uint32) << np.uint32(32 - _CODE_BITS)


def _feature(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - FEATURE_BITS)).astype(np.int64)


def elements(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element hashes, features, owners) of each text, sorted by owner."""
    value, copy, own = numbered(*shingles_of_words(words, offs))
    feature = _feature(value)
    again = copy > 0
    value[again] = mix(value[again] + copy[again].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return value, feature, own


def weight_levels(df: DataFrame) -> np.ndarray:
    """The weight level of each feature, from the document counts of all documents (id, text): 1 MB, whatever the corpus."""
    n = df.count()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << FEATURE_BITS, np.uint32)
        for b in batches:
            for i, j in chunks(b["text"]):
                value, copy, _ = numbered(*shingles_of_words(*word_hashes(b["text"][i:j])))
                total += np.bincount(_feature(value[copy == 0]), minlength=1 << FEATURE_BITS).astype(np.uint32)
        yield from _slices(total)

    def _slices(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        parts = total.reshape(-1, 1 << SLICE_BITS)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([zlib.compress(p.tobytes(), 1) for p in parts], pa.binary())], ["slice", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, raw in zip(b["slice"].to_pylist(), b["counts"], strict=True):
                part = np.frombuffer(zlib.decompress(raw.as_py()), np.uint32)
                sums[k] = sums[k] + part if k in sums else part.astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_levels(s, n).tobytes() for s in sums.values()], pa.binary())], ["slice", "counts"])

    schema = "slice int, counts binary"
    rows = df.select("text").mapInArrow(count, schema).repartition(1 << (FEATURE_BITS - SLICE_BITS), "slice").mapInArrow(add, schema).collect()  # 1 MB
    out = np.zeros((1 << (FEATURE_BITS - SLICE_BITS), 1 << SLICE_BITS), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["counts"], np.uint8)
    return out.reshape(-1)


def _levels(df: np.ndarray, n: int) -> np.ndarray:
    idf = 1 + np.log((1 + n) / (1 + np.minimum(df, n)))
    return np.clip(np.rint(0.5 * np.log(idf) / LEVEL_STEP), 0, LEVELS - 1).astype(np.uint8)


def samples(words: np.ndarray, offs: np.ndarray, levels: np.ndarray, first: int, count: int) -> Iterator[np.ndarray]:
    """``count`` samples of each text, from number ``first`` on."""
    value, feature, own = elements(words, offs)
    bounds = np.searchsorted(own, np.arange(len(offs)))
    base = levels[feature].astype(np.uint32) * np.uint32(_DRAWS)
    seed = (value >> np.uint64(32)).astype(np.uint32)
    low = (value & np.uint64((1 << (32 - _CODE_BITS)) - 1)).astype(np.uint32)
    table, at = _table(), np.empty_like(seed)
    for k in range(first, first + count):
        np.multiply(seed ^ _SALTS[k, 0], _SALTS[k, 1], out=at)
        np.right_shift(at, 16, out=at)
        np.add(at, base, out=at)
        yield segment_min(table.take(at) | low, bounds, _EMPTY)


def weighted(levels) -> near.Similarity:
    """The similarity by the broadcast weight levels."""

    def weigh(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        value, feature, own = elements(words, offs)
        return value, np.exp(levels.value[feature] * LEVEL_STEP), own

    return near.Similarity(lambda words, offs, first, count: samples(words, offs, levels.value, first, count), weigh)


def near_duplicate_classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", with_key: bool = False) -> DataFrame:
    """(doc_id, class_id, n_members, kept) of each row: the class is named by its least id, and the rows of one document of that id are kept.

    With ``with_key`` also ``key``, by which ``near.keyed`` tells documents of one id apart.
    """
    spark = df.sparkSession
    docs = near.keyed(documents(df, id_col, text_col).where(F.col("id") != F.lit(NO_ID)))
    classed = near.classes(docs, weighted(spark.sparkContext.broadcast(weight_levels(docs))), threshold)
    named = classed.groupBy("class").agg(F.count("*").alias("n_members"), F.min(F.struct("id", "key")).alias("first"))
    out = classed.join(named, "class").select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_members", (F.struct("id", "key") == F.col("first")).alias("kept"), "key")
    lost = near.keyed(documents(df, id_col, text_col).where(F.col("id") == F.lit(NO_ID)))
    lost = lost.select(public_id().alias(id_col), F.lit(None).cast("long").alias("class_id"), F.lit(1).cast("long").alias("n_members"), F.lit(True).alias("kept"), "key")
    out = out.unionByName(lost)
    return out if with_key else out.drop("key")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` without those of documents that aren't kept: one document of each class, and every row with a null id."""
    key = F.xxhash64(F.coalesce(df[id_col].cast("long"), F.lit(NO_ID)), F.coalesce(df[text_col].cast("string"), F.lit("")))
    gone = near_duplicate_classes(df, id_col=id_col, text_col=text_col, with_key=True).where("not kept").select(F.col("key").alias("_gone"))
    return df.join(gone, key == gone["_gone"], "left_anti")
