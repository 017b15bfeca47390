"""Classes of near texts, whatever the similarity: bands of samples joined in Spark, then verified pairs.

A document is an id with a text; rows equal in both are one document. Texts with the same words are one text, named by 64 bits of a digest of them, which
one of its documents stands for. In a band bucket every text is held against the one of least key. Texts that then share a bucket with a text of another class
are sampled again: ``SHARP_BANDS`` longer bands, and a sketch of ``SKETCH`` bits, one for each of as many samples. In the sharp buckets
every text is held against the least one once more, which joins what belongs together; then all texts of a bucket that still lie in different
classes are compared by their sketches within the join. Only pairs whose sketches differ no more than those of a pair at the threshold do
(``DEVIATIONS`` standard deviations on top) leave the join and are verified by their texts. So a bucket's pairs are compared, never listed: what
is listed are pairs that are about similar enough. A pair at the threshold is missed with 1e-4 by the first bands or 8e-4 by the sharp ones,
and with 2e-4 by its sketch.

A text without a word is one text with those of the same bytes and has no near one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.buckets import members
from factspark.llm.graph import components, tasks_for
from factspark.llm.sieve import passing
from factspark.llm.text import chunks, mix, word_hashes
from factspark.session import shared_dir

THRESHOLD = 0.8
BANDS, ROWS = 30, 6  # a pair at 0.8 is missed with a probability of 1e-4, one at 0.85 of 7e-7
SHARP_BANDS, SHARP_ROWS = 250, 16  # one at 0.8 is missed with 8e-4
SAMPLES = BANDS * ROWS + SHARP_BANDS * SHARP_ROWS
SKETCH, DEVIATIONS = 2048, 3.5
#: Names and keys of texts that may be broadcast, some 10 MB.
BROADCAST_KEYS = 250_000
_WORDS = [f"s{k}" for k in range(SKETCH // 64)]


@dataclass(frozen=True)
class Similarity:
    """``sample(words, offsets, first, count)`` yields samples of each text that agree with the chance of two texts' similarity;
    ``weigh(words, offsets)`` gives (values, weights, owners) of the elements whose weighted Jaccard similarity counts."""

    sample: Callable[[np.ndarray, np.ndarray, int, int], Iterator[np.ndarray]]
    weigh: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text) with a key of both."""
    return docs.withColumn("key", F.xxhash64("id", "text"))


def banded(samples: Iterator[np.ndarray], n: int, bands: int, rows: int, bits: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each band, the sketch) of n texts."""
    out, sketch = np.empty((n, bands), np.uint64), np.zeros((n, bits // 64), np.uint64)
    for band in range(bands):
        folded = np.full(n, band + 1, np.uint64)
        for k in range(band * rows, (band + 1) * rows):
            least = next(samples)
            folded = mix(folded * np.uint64(0x9E3779B97F4A7C15) + least)
            if k < bits:
                sketch[:, k >> 6] |= (mix(least) & np.uint64(1)) << np.uint64(k & 63)
        out[:, band] = folded | np.uint64(1)
    return out, sketch


def _lists(values: np.ndarray, null: np.ndarray | None = None) -> pa.ListArray:
    n, width = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(values.ravel().view(np.int64)), mask=None if null is None else pa.array(null))


def _signed(docs: DataFrame, like: Similarity) -> DataFrame:
    """(id, key, rep, bands) of each row; rep names the text by a digest of its words; a text without a word has null bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                words, offs = word_hashes(b["text"][i:j])
                bands, _ = banded(like.sample(words, offs, 0, BANDS * ROWS), j - i, BANDS, ROWS)
                raw, none = words.tobytes(), np.diff(offs) == 0
                digests = [hashlib.md5(raw[8 * x : 8 * y] if y > x else b"\0" + b["text"][i + k].as_py().encode()).digest()[:8] for k, (x, y) in enumerate(zip(offs[:-1], offs[1:], strict=True))]
                yield pa.RecordBatch.from_arrays([b["id"][i:j], b["key"][i:j], pa.array(np.frombuffer(b"".join(digests), np.int64)), _lists(bands, none)], ["id", "key", "rep", "bands"])

    return docs.select("id", "key", "text").mapInArrow(run, "id long, key long, rep long, bands array<long>")


def _sharp(texts: DataFrame, like: Similarity) -> DataFrame:
    """(rep, bands, sketch) of each text (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                words, offs = word_hashes(b["text"][i:j])
                bands, sketch = banded(like.sample(words, offs, BANDS * ROWS, SHARP_BANDS * SHARP_ROWS), j - i, SHARP_BANDS, SHARP_ROWS, SKETCH)
                yield pa.RecordBatch.from_arrays([b["rep"][i:j], _lists(bands), _lists(sketch)], ["rep", "bands", "sketch"])

    found = texts.select("rep", "text").mapInArrow(run, "rep long, bands array<long>, sketch array<long>")
    return found.groupBy("rep").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))


def _only(docs: DataFrame, standing: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, text) of the texts named, by the document that stands for each; a repeated row of it comes again.

    Few keys are broadcast. Else a Bloom filter of bounded size holds most other documents back from the join.
    """
    wanted = standing.join(reps.distinct(), "rep", "left_semi").checkpoint()
    count = wanted.count()
    if count <= BROADCAST_KEYS:
        return docs.join(F.broadcast(wanted), "key").select("rep", "text")
    return docs.where(passing(wanted.select("key"), count, F.col("key"))).join(wanted, "key").select("rep", "text")


def similarity(left: pa.Array, right: pa.Array, like: Similarity) -> np.ndarray:
    """Of each pair of texts; 0 where neither has a word."""
    sides = [like.weigh(*word_hashes(t)) for t in (left, right)]
    value, weight, own = (np.concatenate([s[k] for s in sides]) for k in range(3))
    order = np.lexsort((value, own))
    value, own, weight = value[order], own[order], weight[order]
    common = np.zeros(len(value), bool)
    common[1:] = (value[1:] == value[:-1]) & (own[1:] == own[:-1])
    n = len(left)
    both = np.bincount(own[common], weight[common], n)
    whole = np.bincount(own, weight, n) - both
    return np.divide(both, whole, out=np.zeros(n), where=whole > 0)


def _verified(pairs: DataFrame, docs: DataFrame, standing: DataFrame, like: Similarity, threshold: float) -> DataFrame:
    """Of the pairs (a, b) of texts those that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["tb"]):
                good = pa.array(similarity(b["ta"][i:j], b["tb"][i:j], like) >= threshold)
                yield pa.RecordBatch.from_arrays([b["a"][i:j].filter(good), b["b"][i:j].filter(good)], ["a", "b"])

    texts = _only(docs, standing, pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep")))).dropDuplicates(["rep"])
    left = pairs.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("tb")), "b")
    both = left.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("ta")), "a").select("a", "b", "ta", "tb")
    return both.mapInArrow(run, "a long, b long")


def _placed(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(band, rep, label) of all members; a text without an edge is labelled by itself."""
    return members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("band", "rep", F.coalesce("label", "rep").alias("label"))


def _mixed(placed: DataFrame) -> DataFrame:
    """(band, rep, label, least) in the buckets that hold texts of two classes or more; least is the bucket's least label."""
    mixed = placed.groupBy("band").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("band", "least")
    return placed.join(mixed, "band")


def _star(placed: DataFrame) -> DataFrame:
    """Pairs of each text with the least one of its bucket, unless they have one label."""
    head = placed.groupBy("band").agg(F.min_by(F.struct("rep", "label"), "rep").alias("h")).select("band", F.col("h.rep").alias("least"), F.col("h.label").alias("its"))
    return placed.join(head, (placed["band"] == head["band"]) & (F.col("rep") != F.col("least")) & (F.col("label") != F.col("its"))).select(F.col("least").alias("a"), F.col("rep").alias("b")).distinct()


def _likely(mixed: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs of texts of one bucket and two classes whose sketches are near enough; the others never leave the join.

    A pair is looked for from its text of the greater label. A label is the least name in its class, so that of a large class is mostly the
    bucket's least, and the many texts of such a class are on one side only.
    """
    mean = SKETCH * (1 - threshold) / 2
    most = int(mean + DEVIATIONS * (mean * (1 + threshold) / 2) ** 0.5)
    one = mixed.where("label <> least").join(sketches, "rep")
    other = mixed.join(sketches, "rep").select(F.col("band").alias("at"), F.col("rep").alias("b"), F.col("label").alias("other"), *[F.col(w).alias(f"o{w}") for w in _WORDS])
    differ = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"o{w}"))) for w in _WORDS), F.lit(0))
    found = one.join(other, (F.col("band") == F.col("at")) & (F.col("other") < F.col("label")) & (differ <= most))
    return found.select(F.least("rep", "b").alias("a"), F.greatest("rep", "b").alias("b")).distinct()


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """The labels (id, label) after further edges (a, b); only the edges between labels are searched for components."""
    at = [labels.select(F.col("id").alias(c), F.col("label").alias(f"l{c}")) for c in "ab"]
    between = edges.join(at[0], "a", "left").join(at[1], "b", "left").select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))
    more = components(between)
    moved = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(more.join(labels.select("id"), "id", "left_anti")).checkpoint()


def classes(docs: DataFrame, like: Similarity, threshold: float = THRESHOLD) -> DataFrame:
    """(id, key, class) of each row of docs (id, text, key), in which no id is null; the class is the name of one of its texts."""
    shared_dir(docs.sparkSession)
    signed = _signed(docs, like).checkpoint()
    count = signed.count()
    tasks = tasks_for(count)  # of tables with a few rows for each text that has a near copy
    standing = signed.groupBy("rep").agg(F.min("key").alias("key")).checkpoint()
    shared = members(signed, count * BANDS).distinct().checkpoint()  # equal texts of several tasks come again
    tested = _star(shared.withColumn("label", F.col("rep"))).coalesce(tasks).checkpoint()
    labels = components(_verified(tested, docs, standing, like, threshold).coalesce(2 * tasks).checkpoint())

    unsure = _mixed(_placed(shared, labels)).select("rep").distinct().coalesce(tasks).checkpoint()
    sharp = _sharp(_only(docs, standing, unsure), like).checkpoint()
    shared = members(sharp, unsure.count() * SHARP_BANDS).checkpoint()
    sketches = sharp.select("rep", *[F.col("sketch")[k].alias(w) for k, w in enumerate(_WORDS)])
    for choose in (_star, lambda placed: _likely(_mixed(placed).coalesce(2 * tasks).checkpoint(), sketches, threshold)):
        pairs = choose(_placed(shared, labels)).join(tested, ["a", "b"], "left_anti").coalesce(tasks).checkpoint()
        tested = tested.unionByName(pairs)
        labels = _joined(labels, _verified(pairs, docs, standing, like, threshold).coalesce(2 * tasks).checkpoint())

    return signed.select("id", "key", "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("id", "key", F.coalesce("label", "rep").alias("class"))
