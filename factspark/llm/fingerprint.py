"""Document fingerprints by MinHash.

A fingerprint holds the least value of each of ``PERMUTATIONS`` universal hash permutations x -> a*x + b (mod 2**32, a odd) over the
text's five-word shingles, all in numpy; 16 bits of each are kept, as hexadecimal digits. The likeness of two fingerprints is
the share of places where they agree; two different minima agree by chance once in 65,536. For near texts (``near``), bands of
further minima are joined in Spark and the Jaccard similarity of the shingle sets is computed; the report names each document's class.

An empty or null text, or one without a word, has the fingerprint of ``ffff`` at every place. Equal texts have equal fingerprints. Other columns
of the table are never read, and an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm import near
from factspark.llm.frames import NO_ID, documents, public_id
from factspark.llm.near import THRESHOLD
from factspark.llm.packing import packed, unpacked
from factspark.llm.text import chunks, mix, numbered, segment_min, shingle_hashes, shingles_of_words
from factspark.session import partitions

PERMUTATIONS = 128

_RNG = np.random.Generator(np.random.PCG64(77003))
_A = _RNG.integers(1, 1 << 31, near.SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RNG.integers(0, 1 << 32, near.SAMPLES, dtype=np.uint32)


def signatures(texts: pa.Array) -> np.ndarray:
    """One row of ``PERMUTATIONS`` 32-bit minima for each text."""
    shingles, offs = shingle_hashes(texts)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offs) - 1, PERMUTATIONS), np.uint32)
    buffer = np.empty_like(x)
    for k in range(PERMUTATIONS):
        np.multiply(x, _A[k], out=buffer)
        np.add(buffer, _B[k], out=buffer)
        out[:, k] = segment_min(buffer, offs, 0xFFFFFFFF)
    return out


def short(signature: np.ndarray) -> np.ndarray:
    """Sixteen well spread bits of each minimum."""
    out = (mix(signature.astype(np.uint64)) >> np.uint64(48)).astype(np.uint16)
    out[signature == 0xFFFFFFFF] = 0xFFFF
    return out


def hexes(small: np.ndarray) -> list[str]:
    raw = small.astype(">u2").tobytes().hex()
    width = 4 * PERMUTATIONS
    return [raw[i : i + width] for i in range(0, len(raw), width)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=1)


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points give way to as many first ones of the next text, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint) of each row; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                yield pa.RecordBatch.from_arrays([b["id"][i:j], pa.array(hexes(short(signatures(b["text"][i:j]))), pa.string())], ["id", "fingerprint"])

    return documents(df, id_col, text_col).mapInArrow(run, "id long, fingerprint string").select(public_id().alias(id_col), "fingerprint")


def samples(words: np.ndarray, offs: np.ndarray, first: int, count: int) -> Iterator[np.ndarray]:
    """``count`` minima of each text's shingles, from permutation ``first`` on; 0xFFFFFFFF for a text without a word."""
    shingles, at = shingles_of_words(words, offs)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for k in range(first, first + count):
        yield segment_min(x * _A[k] + _B[k], at, 0xFFFFFFFF)


def _weigh(words: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's set of shingles, all of weight 1."""
    value, copy, own = numbered(*shingles_of_words(words, offs))
    once = copy == 0
    return value[once], np.ones(int(once.sum())), own[once]


JACCARD = near.Similarity(samples, _weigh)


def near_classes(df: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id) of each row but those of the null id: the least id of the class that equal texts and verified pairs make."""
    classed = near.classes(near.keyed(documents(df, id_col, text_col).where(F.col("id") != F.lit(NO_ID))), JACCARD, threshold)
    return classed.join(classed.groupBy("class").agg(F.min("id").alias("class_id")), "class").select("id", "key", "class_id")


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form, in order of (id, text); after the last document comes the first. Then the class of
    ``near_classes``; a null id has no class.

    Documents are dealt by ranges of id whose bounds come from quantiles of the ids alone, one range to a task; the first document of each range
    is sent to the range before as well, so one exchange of the texts, compressed one by one, brings each document beside its successor. Null ids
    come first; of rows with the same id the lesser text comes first.
    """
    spark = df.sparkSession
    docs = near.keyed(documents(df, id_col, text_col))
    n = partitions(spark)
    known = docs.where(F.col("id") != F.lit(NO_ID))
    bounds = np.array(sorted({int(x) for x in (known.approxQuantile("id", [k / n for k in range(1, n)], 0.25 / n) if n > 1 else [])}), np.int64)
    part = F.pandas_udf(lambda ids: pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right").astype(np.int32)), "int")
    placed = docs.withColumn("part", part("id"))
    heads = {r["part"]: r["head"] for r in placed.groupBy("part").agg(F.min("id").alias("head")).collect()}  # a number for each range
    order = sorted(heads)
    before = {heads[p]: order[k - 1] for k, p in enumerate(order)}  # the first range's head goes behind the last
    goes = spark.createDataFrame([(h, p) for h, p in before.items()], "head long, goes int")  # as many rows as ranges
    extra = placed.join(F.broadcast(goes), F.col("id") == F.col("head")).select("id", "text", "key", F.col("goes").alias("part"))
    dealt = packed(placed.withColumn("last", F.lit(False)).unionByName(extra.withColumn("last", F.lit(True))))
    # a document's class goes with it and comes before it, as its text is null
    classes = near_classes(df, THRESHOLD, id_col, text_col).select("id", "key", part("id").alias("part"), F.lit(False).alias("last"), "class_id")
    ordered = unpacked(dealt.unionByName(classes, allowMissingColumns=True).repartitionById(n, "part")).sortWithinPartitions("part", "last", "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        of, known = NO_ID, {}
        for b in batches:
            for i, j in chunks(b["text"]):
                rows = [] if held is None else [held]
                for part, last, key, t, doc, label in zip(*(b[c][i:j].to_pylist() for c in ("part", "last", "id", "text", "key", "class_id")), strict=True):
                    if key != of:
                        of, known = key, {}
                    if t is None:
                        known[doc] = label
                    else:
                        rows.append((part, last, key, t, known.get(doc)))
                held = rows[-1] if rows else None
                pairs = [(x, y) for x, y in zip(rows, rows[1:], strict=False) if not x[1] and x[0] == y[0]]
                if pairs:
                    yield _report(pairs, [r[3] for r in rows], rows)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, class_id long"
    return ordered.mapInArrow(run, schema).select(public_id().alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id")


def _report(pairs: list, texts: list[str], rows: list) -> pa.RecordBatch:
    own = short(signatures(pa.array(texts, pa.string())))
    at = [k for k, (x, y) in enumerate(zip(rows, rows[1:], strict=False)) if not x[1] and x[0] == y[0]]
    new = [edited(x[3], y[3]) for x, y in pairs]
    other = short(signatures(pa.array(new, pa.string())))
    mine, following = own[at], own[[k + 1 for k in at]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([x[2] for x, _ in pairs], pa.int64()),
            pa.array([len(x[3]) for x, _ in pairs], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in new], pa.string()),
            pa.array(hexes(mine), pa.string()),
            pa.array(hexes(other), pa.string()),
            pa.array(likeness(mine, other)),
            pa.array(likeness(mine, following)),
            pa.array([x[4] for x, _ in pairs], pa.int64()),
        ],
        ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "class_id"],
    )
