"""Byte-level BPE encoding and decoding.

A text is cut into pre-tokens by a pattern. A minimal perfect hash resolves every pre-token that is itself in the
vocabulary; the others are merged by a heap of pairs over a linked list of bytes. Each distinct pre-token of a batch is
resolved once. Decoding gathers the ids' bytes. Vocabulary tables go to executors as a broadcast; they are as large as the
vocabulary, whatever the corpus.

Null text: empty, no ids. Empty table: empty result. Repeated rows: one result row for each. Further columns of the input are left out.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factspark.llm.frames import documents, public_id
from factspark.llm.text import chunks, mix

#: Pre-tokens that miss the vocabulary and are remembered by one Python worker; the memo is emptied beyond it.
MEMO = 400_000
_LOAD = 4


def read_ranks(path: str) -> list[bytes]:
    """The tokens in order of rank, from a file of ``base64 rank`` lines; ranks are 0 to n-1."""
    tokens: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                tokens[int(rank)] = base64.b64decode(token)
    return [tokens[i] for i in range(len(tokens))]


def _key_hash(keys: list[bytes]) -> np.ndarray:
    """64-bit hashes of byte strings, vectorised over all of them."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    value = lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    data = np.frombuffer(b"".join(keys), np.uint8)
    starts = np.cumsum(lengths) - lengths
    alive = np.flatnonzero(lengths)
    at = 0
    while len(alive):
        value[alive] = (value[alive] ^ data[starts[alive] + at]) * np.uint64(0x100000001B3)
        at += 1
        alive = alive[lengths[alive] > at]
    return mix(value)


class PerfectHash:
    """A minimal perfect hash by displacement: n keys fill the slots 0 to n-1, one 32-bit displacement for a few keys."""

    def __init__(self, keys: list[bytes]):
        self.n = n = len(keys)
        self.buckets = max(1, n // _LOAD)
        h = _key_hash(keys)
        if len(np.unique(h)) != n:
            raise ValueError("two keys have one hash")
        group = self._group(h)
        order = np.argsort(group, kind="stable")
        bounds = np.searchsorted(group[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.uint64)
        self.key_at = np.full(n, -1, np.int64)
        free = np.ones(n, bool)
        for b in np.argsort(-np.diff(bounds), kind="stable"):
            own = order[bounds[b] : bounds[b + 1]]
            if not len(own):
                break
            d, step = 0, 64
            while True:
                tries = np.arange(d, d + step, dtype=np.uint64)
                slots = self._slot(h[own][None, :], tries[:, None])
                good = free[slots].all(axis=1)
                if len(own) > 1:
                    s = np.sort(slots, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    self.shift[b] = tries[k]
                    free[slots[k]] = False
                    self.key_at[slots[k]] = own
                    break
                d += step
                step = min(step * 2, 1 << 16)

    def _group(self, h: np.ndarray) -> np.ndarray:
        return ((h >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, h: np.ndarray, d: np.ndarray) -> np.ndarray:
        return (mix(h + d * np.uint64(0xD1342543DE82EF95)) % np.uint64(self.n)).astype(np.int64)

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The only key of the vocabulary that each string can be; the caller compares the bytes."""
        h = _key_hash(keys)
        return self.key_at[self._slot(h, self.shift[self._group(h)])]


class Codec:
    """Encoder and decoder of one vocabulary and one pre-token pattern."""

    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.hash = PerfectHash(tokens)
        self._ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "hash": self.hash, "_ready": False}

    def _prepare(self) -> None:
        import regex

        self.ranks = {t: i for i, t in enumerate(self.tokens)}
        self.split = regex.compile(self.pattern).findall
        self.lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.memo: dict[bytes, list[int]] = {}
        self._ready = True

    def merge(self, word: bytes) -> list[int]:
        """BPE of one pre-token: the pair of lowest rank, leftmost first, is merged until none is in the vocabulary."""
        if not self._ready:
            self._prepare()
        ranks, n = self.ranks, len(word)
        end = list(range(1, n + 1))  # where the part that begins at i ends; 0: i begins no part
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        pop, push, get = heapq.heappop, heapq.heappush, ranks.get
        while heap:
            _, i, stop = pop(heap)
            middle = end[i]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the parts was merged since
            end[i], end[middle] = stop, 0
            if stop < n:
                before[stop] = i
                if (r := get(word[i : end[stop]])) is not None:
                    push(heap, (r, i, end[stop]))
            if (p := before[i]) >= 0 and (r := get(word[p:stop])) is not None:
                push(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def resolve(self, words: list[bytes]) -> list[list[int]]:
        found = self.hash.find(words).tolist()
        tokens, memo, out = self.tokens, self.memo, []
        for word, k in zip(words, found, strict=True):
            if tokens[k] == word:
                out.append([k])
                continue
            if (ids := memo.get(word)) is None:
                ids = self.merge(word)
                if len(memo) >= MEMO:
                    memo.clear()
                memo[word] = ids
            out.append(ids)
        return out

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the offsets of each text's ids."""
        if not self._ready:
            self._prepare()
        parts: list[str] = []
        counts = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            parts += self.split(text)
            counts[i + 1] = len(parts)
        coded = pa.array(parts, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        ids = self.resolve([w.encode() for w in coded.dictionary.to_pylist()]) if len(parts) else []
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((x for w in ids for x in w), np.int64, int(lengths.sum()))
        out, ends = ragged_take(flat, np.cumsum(lengths) - lengths, lengths, codes)
        return out.astype(np.uint32), ends[counts]

    def decode_batch(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all id sequences, and their offsets."""
        if not self._ready:
            self._prepare()
        data, ends = ragged_take(self.blob, self.starts, self.lengths, ids.astype(np.int64))
        return data, ends[offs]

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_batch(np.asarray(ids, np.uint32), np.array([0, len(ids)]))[0].tobytes()


def ragged_take(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``rows`` one after another, and n+1 offsets."""
    n = lengths[rows] if len(rows) else np.zeros(0, np.int64)
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(n, out=ends[1:])
    if not ends[-1]:
        return values[:0], ends
    return values[np.arange(ends[-1]) + np.repeat(starts[rows] - ends[:-1], n)], ends


_CODECS: dict[str, Codec] = {}


def codec(path: str, pattern: str | None = None) -> Codec:
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    key = f"{path}\n{pattern}"
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(path), pattern)
    return _CODECS[key]


def _shared(spark: SparkSession, path: str, pattern: str | None):
    return spark.sparkContext.broadcast(codec(path, pattern))


def encode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of each row."""
    docs, shared = documents(df, id_col, text_col), _shared(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                ids, offs = shared.value.encode_batch(b["text"][i:j].to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b["id"][i:j], lists], ["id", "ids"])

    return docs.mapInArrow(run, "id long, ids array<int>").select(public_id().alias(id_col), "ids")


def decode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, data binary): the bytes that each row's ids stand for. A null list is empty; an id outside the vocabulary is an error."""
    from factspark.session import ship

    ship(df.sparkSession)
    shared = _shared(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [shared.value.decode(x) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(out, pa.binary())], ["id", "data"])

    return df.select(df[id_col].alias("id"), F.coalesce(df[ids_col], F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "id long, data binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes and decodes each text and returns digests of both: (doc_id, n_tokens, ids_sha256, decoded_sha256), with ``with_ids`` also ``ids``."""
    docs, shared = documents(df, id_col, text_col), _shared(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                c = shared.value
                ids, offs = c.encode_batch(b["text"][i:j].to_pylist())
                data, ends = c.decode_batch(ids, offs)
                raw = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        b["id"][i:j],
                        pa.array(np.diff(offs)),
                        pa.array([hashlib.sha256(raw[x:y]).hexdigest() for x, y in zip(offs[:-1], offs[1:], strict=True)], pa.string()),
                        pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.string()),
                        *([pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32)))] if with_ids else []),
                    ],
                    ["id", *names],
                )

    names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
    schema = "id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.mapInArrow(run, schema).select(public_id().alias(id_col), *names)
