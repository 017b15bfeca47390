"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document. Spark counts the patterns of votes over all documents
(at most 3**labellers rows), and expectation-maximisation over the counts estimates how often each labeller is right. The posteriors
are the labels of a linear scorer over hashed byte trigrams, fitted on a bounded sample of ``FIT_ROWS`` documents chosen by hash.
Every document is then scored over its whole text.

A null or empty text has no trigram and gets the score of the odds. Repeated rows get the same score; an empty table
gives an empty result; further columns are left out by ``score`` and kept by ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.frames import documents, public_id
from factspark.llm.text import byte_blob, chunks

#: Documents on which the scorer is fitted; the sample doesn't grow with the corpus.
FIT_ROWS = 4000
DIMENSIONS = 1 << 16
#: Trigrams that a text is taken to have besides its own, each with the sample's odds of good: what little a short text says doesn't outweigh them.
PRIOR_TRIGRAMS = 40.0
ROUNDS, STEP, DECAY = 150, 0.5, 1e-5
KEEP_AT = 0.5
LABELLERS = ("symbols", "capitals", "tables", "function_words", "sentences", "repetition", "word_length", "marks", "echo")
_SPACE, _UPPER, _LOWER, _HIGH, _DIGIT, _STOP, _COMMON = (np.zeros(256, bool) for _ in range(7))
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_UPPER[65:91] = True
_LOWER[97:123] = True
_HIGH[128:] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".!?:;"]] = True
_COMMON[[ord(c) for c in ".,;:!?'\"()-/"]] = True
_SYMBOL = ~(_SPACE | _UPPER | _LOWER | _HIGH | _DIGIT | _COMMON)


def _sums(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def _word_codes(data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each word, from its length and first bytes."""
    code = np.zeros(len(starts), np.uint64)
    padded = np.concatenate((data, np.zeros(6, np.uint8)))
    for k in range(6):
        code = code * np.uint64(256) + padded[starts + k]
    return code * np.uint64(64) + np.minimum(length, 63).astype(np.uint64)


def echoes(texts: pa.Array) -> np.ndarray:
    """For each text the share of its words that repeat one of the two words before them."""
    data, offs = byte_blob(texts, "\n")
    space = _SPACE[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    length = np.flatnonzero(~space & np.concatenate((space[1:], [True]))) - starts + 1
    return _echoes(_word_codes(data, starts, length), np.searchsorted(starts, offs))


def _echoes(code: np.ndarray, offs: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    same = np.zeros(len(code), bool)
    for k in (1, 2):
        same[k:] |= (code[k:] == code[:-k]) & (own[k:] == own[:-k])
    return np.bincount(own[same], minlength=len(offs) - 1) / np.maximum(np.diff(offs), 1)


def votes(texts: pa.Array) -> np.ndarray:
    """One row for each text, one column for each labeller: 0 bad, 1 nothing, 2 good."""
    data, offs = byte_blob(texts, "\n")
    n = np.diff(offs) - 1
    space = _SPACE[data]
    start = ~space & np.concatenate(([True], space[:-1]))
    last = ~space & np.concatenate((space[1:], [True]))
    starts = np.flatnonzero(start)
    word_offs = np.searchsorted(starts, offs)
    words = np.diff(word_offs)
    length = np.flatnonzero(last) - starts + 1
    per_word = np.maximum(words, 1)
    letters = _sums(_UPPER[data] | _LOWER[data] | _HIGH[data], offs)
    solid = np.maximum(_sums(~space, offs), 1)
    lone = np.zeros(len(data), bool)
    lone[starts[length == 1]] = _SYMBOL[data[starts[length == 1]]]
    short = np.zeros(len(data), bool)
    short[starts[(length <= 3)]] = True
    marks = np.zeros(len(data), bool)
    marks[1:] = (data[1:] == data[:-1]) & (_SYMBOL[data[1:]] | (data[1:] == 33))
    code = _word_codes(data, starts, length)
    own = np.repeat(np.arange(len(words)), words)
    order = np.lexsort((code, own))
    new = np.ones(len(order), bool)
    new[1:] = (code[order][1:] != code[order][:-1]) | (own[order][1:] != own[order][:-1])
    distinct = np.bincount(own[order][new], minlength=len(words)) / per_word
    ends = _sums(_STOP[data], offs)

    def vote(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 2, 1)).astype(np.int8)

    symbols = _sums(_SYMBOL[data], offs) / solid
    capitals = _sums(_UPPER[data], offs) / np.maximum(letters, 1)
    tables = _sums(lone, offs) / per_word
    stops = _sums(short, offs) / per_word
    marked = _sums(marks, offs) / per_word
    mean = np.bincount(own, length, len(words)) / per_word
    echo = _echoes(code, word_offs)
    enough = words >= 20
    out = np.stack(
        [
            vote(symbols > 0.08, symbols < 0.03),
            vote((capitals > 0.5) & (letters > 20), (capitals < 0.3) & (letters > 20)),
            vote((tables > 0.15) & (words > 4), (tables < 0.05) & (words > 4)),
            vote(enough & (stops < 0.05), enough & (stops > 0.12)),
            vote(enough & (ends * 80 < words), enough & (ends * 40 > words)),
            vote(enough & (distinct < 0.08 + 5 / per_word), enough & (distinct > 0.2)),
            vote((mean > 20) & (words > 2), (mean > 2) & (mean < 12) & (words > 2)),
            vote(marked > 0.5, marked < 0.1),
            vote((echo > 0.15) & (words > 4), (echo < 0.08) & (words > 4)),
        ],
        axis=1,
    )
    out[n == 0] = 1
    return out


def pattern(v: np.ndarray) -> np.ndarray:
    return v.astype(np.int32) @ (3 ** np.arange(v.shape[1], dtype=np.int32))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[dict[int, float], np.ndarray]:
    """(chance that a document with the pattern is good, accuracy of each labeller where it votes)."""
    k = len(LABELLERS)
    v = (patterns[:, None] // 3 ** np.arange(k)) % 3
    bad, good = (v == 0).sum(axis=1), (v == 2).sum(axis=1)
    p = (good + 1.0) / (good + 3.0 * bad + 2.0)  # to begin with, a bad vote weighs more: labellers name faults that are rare
    for _ in range(rounds):
        weight = np.stack([counts * (1 - p), counts * p])
        prior = (weight.sum(axis=1) + 1) / (counts.sum() + 2)
        odds = np.log(prior)[:, None] + np.zeros((2, len(patterns)))
        rates = np.empty((k, 2, 3))
        for j in range(k):
            for c in range(2):
                rates[j, c] = (np.bincount(v[:, j], weight[c], 3) + 0.5) / (weight[c].sum() + 1.5)
            odds += np.log(rates[j][:, v[:, j]])
        new = 1 / (1 + np.exp(np.clip(odds[0] - odds[1], -50, 50)))
        moved = np.abs(new - p).max() if len(p) else 0
        p = new
        if moved < 1e-6:
            break
    voted = np.maximum(rates[:, 0, 0] + rates[:, 0, 2], 1e-9)
    accuracy = prior[0] * rates[:, 0, 0] / voted + prior[1] * rates[:, 1, 2] / np.maximum(rates[:, 1, 0] + rates[:, 1, 2], 1e-9)
    return dict(zip(patterns.tolist(), p.tolist(), strict=True)), accuracy


def _trigrams(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that begins at each byte but the last two."""
    d = data.astype(np.uint32)
    x = (d[:-2] << np.uint32(16)) | (d[1:-1] << np.uint32(8)) | d[2:]
    return (x * np.uint32(2654435761)) >> np.uint32(16)


def _features(text: bytes) -> tuple[bytes, bytes]:
    if len(text) < 3:
        return b"", b""
    ids, n = np.unique(_trigrams(np.frombuffer(text, np.uint8)), return_counts=True)
    return ids.astype(np.uint16).tobytes(), (n / (len(text) - 2 + PRIOR_TRIGRAMS)).astype(np.float32).tobytes()


def fit_linear(rows: list[tuple[bytes, bytes, float, float]]) -> tuple[np.ndarray, float, float]:
    """Rows of (ids, shares, echo, chance of good). Weights, the last for the echo, and bias of a logistic scorer, by full gradient steps with a
    diagonal scale, both classes weighing the same; then the logarithm of the sample's own odds of good."""
    weights, bias = np.zeros(DIMENSIONS + 1), 0.0
    if not rows:
        return weights, 1.0, 0.0
    ids = np.concatenate([*(np.frombuffer(r[0], np.uint16) for r in rows), np.full(len(rows), DIMENSIONS)]).astype(np.int64)
    values = np.concatenate([*(np.frombuffer(r[1], np.float32) for r in rows), np.array([r[2] for r in rows])]).astype(np.float64)
    own = np.concatenate([np.repeat(np.arange(len(rows)), [len(r[0]) // 2 for r in rows]), np.arange(len(rows))])
    y = np.array([r[3] for r in rows])
    share = np.clip(y.mean(), 0.02, 0.98)
    importance = (y * 0.5 / share + (1 - y) * 0.5 / (1 - share)) / len(y)
    squares, bias_square = np.full(DIMENSIONS + 1, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = bias + np.bincount(own, values * weights[ids], len(rows))
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * importance
        slope = np.bincount(ids, values * error[own], DIMENSIONS + 1) + DECAY * weights
        squares += slope**2
        bias_square += error.sum() ** 2
        weights -= STEP * 4 * slope / np.sqrt(squares)
        bias -= STEP * 0.2 * error.sum() / np.sqrt(bias_square)
    return weights, bias, float(np.log(share / (1 - share)))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, odds: float, accuracy: np.ndarray):
        self.weights, self.bias, self.odds, self.accuracy = weights.astype(np.float32), float(bias), odds, accuracy

    def score(self, texts: pa.Array) -> np.ndarray:
        data, offs = byte_blob(texts)
        total = np.zeros(len(data) + 1)
        if len(data) > 2:
            np.cumsum(self.weights[_trigrams(data)], out=total[1:-2])
            total[-2:] = total[-3]
        stop = np.maximum(offs[1:] - 2, offs[:-1])
        z = self.bias + (total[stop] - total[offs[:-1]] + PRIOR_TRIGRAMS * self.odds) / (stop - offs[:-1] + PRIOR_TRIGRAMS) + self.weights[DIMENSIONS] * echoes(texts)
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Counts the votes of all documents, then fits the scorer on about ``fit_rows`` of them (twice as many at most)."""
    docs = documents(df, id_col, text_col)

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[int, int] = {}
            for i, j in chunks(b["text"]):
                for p, n in zip(*np.unique(pattern(votes(b["text"][i:j])), return_counts=True), strict=True):
                    found[int(p)] = found.get(int(p), 0) + int(n)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())], ["pattern", "n"])

    counted = docs.select("text").mapInArrow(patterns, "pattern int, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3**9 rows at most
    counted = sorted((r["pattern"], r["n"]) for r in counted)
    if not counted:
        return Model(np.zeros(DIMENSIONS + 1), 1.0, 0.0, np.ones(len(LABELLERS)))
    chance, accuracy = expectation_maximisation(np.array([p for p, _ in counted]), np.array([n for _, n in counted], float))
    total = sum(n for _, n in counted)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [_features(t.encode()) for t in b["text"].to_pylist()]
            codes = [pattern(votes(b["text"][i:j])) for i, j in chunks(b["text"])]
            yield pa.RecordBatch.from_arrays([b["place"], pa.array([a for a, _ in rows], pa.binary()), pa.array([v for _, v in rows], pa.binary()), pa.array(np.concatenate(codes) if codes else np.zeros(0, np.int32), pa.int32()), pa.array(echoes(b["text"]), pa.float64())], ["place", "ids", "parts", "pattern", "echo"])

    place = F.xxhash64("id", "text")
    limit = min(1.0, fit_rows / total)
    chosen = docs.select(place.alias("place"), "text").where(F.col("place") < F.lit(int(-(1 << 63) + limit * ((1 << 64) - 1)) if limit < 1 else (1 << 63) - 1))
    sample = chosen.mapInArrow(features, "place long, ids binary, parts binary, pattern int, echo double").orderBy("place", "ids").limit(2 * fit_rows).collect()  # bounded by fit_rows
    weights, bias, odds = fit_linear([(bytes(r["ids"]), bytes(r["parts"]), r["echo"], chance[r["pattern"]]) for r in sorted(sample, key=lambda r: (r["place"], bytes(r["ids"])))])
    return Model(weights, bias, odds, accuracy)


def score(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) of each row; the model (256 KB) is a broadcast."""
    model = model or fit(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                s = shared.value.score(b["text"][i:j])
                yield pa.RecordBatch.from_arrays([b["id"][i:j], pa.array(s), pa.array(s >= KEEP_AT)], ["id", "score", "keep"])

    return documents(df, id_col, text_col).mapInArrow(run, "id long, score double, keep boolean").select(public_id().alias(id_col), "score", "keep")


def keep_good(df: DataFrame, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that the classifier keeps, with all their columns, in one pass and without a shuffle."""
    from pyspark.sql.functions import pandas_udf

    model = model or fit(df, id_col, text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("boolean")
    def good(text):
        import pandas as pd

        texts = pa.array(text.fillna(""), pa.string())
        parts = [shared.value.score(texts[i:j]) for i, j in chunks(texts)]
        return pd.Series(np.concatenate(parts) >= KEEP_AT if parts else np.zeros(0, bool))

    return df.where(good(F.coalesce(df[text_col].cast("string"), F.lit(""))))
