"""Which pieces of a document stand in an earlier document: a global join of 64-bit piece hashes, packed.

Each task hashes its documents' pieces, resolves copies within a run of documents by itself, and sends the other hashes on, packed
into one row for each bucket of hashes: 8 bytes a piece and a few for each document and bucket. A bucket's task sorts its hashes and
sends each document the numbers of its pieces that an earlier document has. So a piece that stands everywhere costs one
row for each run of documents, no group of copies is ever listed in pairs, and memory is bounded by one bucket, whose
number grows with the shuffle partitions.

Documents are ordered by id; rows with equal id and equal text are the same document and get the same verdict. With ``by_row``, rows with
equal id and different texts are ordered by a hash of the text, and a piece's later copies within one document count as repeats too;
without it only a document with a smaller id counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.text import chunks
from factspark.session import partitions

#: Hashes that a task gathers before it sends them on.
RUN_KEYS = 3_000_000
REPEATED, VARIED = 1, 2
MARKS = "array<struct<run:long,bucket:int,payload:binary>>"

#: From texts to (offsets, hashes, second hashes or None): the pieces of each text in order.
Extract = Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray | None]]


def tagged(docs: DataFrame) -> DataFrame:
    return docs.withColumn("tag", F.hash("text"))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def _sender(extract: Extract, buckets: int, by_row: bool):
    columns = ["bucket", "run", "ids", "tags", "counts", "keys", "seconds"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        serial = TaskContext.get().partitionId() << 32
        held: list = []
        size = 0
        for b in batches:
            for i, j in chunks(b["text"]):
                part = b.slice(i, j - i)
                offs, keys, second = extract(part)
                held.append((part["id"].to_numpy(), part["tag"].to_numpy(), np.diff(offs), keys, second))
                size += len(keys)
                if size >= RUN_KEYS:
                    yield from flush(held, serial)
                    held, size, serial = [], 0, serial + 1
        if held:
            yield from flush(held, serial)

    def flush(held: list, serial: int) -> Iterator[pa.RecordBatch]:
        ids, tags, counts, keys = (np.concatenate([h[k] for h in held]) for k in range(4))
        second = np.concatenate([h[4] for h in held]) if held[0][4] is not None else None
        order = np.lexsort((tags, ids))
        same = np.zeros(len(order), bool)
        same[1:] = (ids[order][1:] == ids[order][:-1]) & (tags[order][1:] == tags[order][:-1])
        order = order[~same]  # a row that is repeated
        starts = (np.cumsum(counts) - counts)[order]
        ids, tags, counts = ids[order], tags[order], counts[order]
        ends = np.cumsum(counts)
        number = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
        at = number + np.repeat(starts, counts)
        keys = keys[at]
        second = second[at] if second is not None else None
        own = np.repeat(np.arange(len(ids)), counts)
        rank = own if by_row else np.unique(ids, return_inverse=True)[1][own]
        copies = _later(keys, second, rank, by_row)
        rows: list[list] = [[] for _ in columns]

        def add(bucket: int, ids: bytes, tags: bytes, counts: bytes, keys: bytes, seconds: bytes | None) -> None:
            for column, value in zip(rows, (bucket, serial, ids, tags, counts, keys, seconds), strict=True):
                column.append(value)

        if copies.any():  # numbers of the pieces settled here, to be passed on to the documents
            who, n = np.unique(own[copies], return_counts=True)
            add(-1 - serial % buckets, ids[who].tobytes(), tags[who].tobytes(), n.astype(np.uint32).tobytes(), number[copies].astype(np.uint32).tobytes(), None)
        sent = np.flatnonzero(~copies)
        bucket = _bucket(keys[sent], buckets)
        order = np.argsort(bucket, kind="stable")
        sent, bucket = sent[order], bucket[order]
        bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(bounds)):
            mine = sent[bounds[k] : bounds[k + 1]]
            who, first = np.unique(own[mine], return_index=True)  # in order, as the pieces are
            n = np.diff(np.append(first, len(mine))).astype(np.uint32)
            add(int(k), ids[who].tobytes(), tags[who].tobytes(), n.tobytes(), keys[mine].tobytes(), second[mine].tobytes() if second is not None else None)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], columns)

    return run


def _later(keys: np.ndarray, second: np.ndarray | None, rank: np.ndarray, within: bool) -> np.ndarray:
    """Pieces with an equal one of a lesser rank; with ``within`` also those with an equal one before them. Ranks ascend."""
    order = np.argsort(keys, kind="stable") if second is None else np.lexsort((second, keys))
    new = _new(keys[order], None if second is None else second[order])
    first = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    out = np.zeros(len(keys), bool)
    out[order] = ~new if within else rank[order] > rank[order][first][group]
    return out


def _new(keys: np.ndarray, second: np.ndarray | None) -> np.ndarray:
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    if second is not None:
        new[1:] |= second[1:] != second[:-1]
    return new


def _judge(by_row: bool):
    columns = ["id", "tag", "run", "bucket", "payload"]
    schema = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        for b in batches:
            for row in b.to_pylist():
                if row["bucket"] < 0:
                    yield settled(row)
                    continue
                if held and row["bucket"] != bucket:
                    yield judged(bucket, held)
                    held = []
                bucket = row["bucket"]
                held.append(row)
        if held:
            yield judged(bucket, held)

    def out(ids, tags, runs, bucket, payloads) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, tags, runs, [bucket] * len(ids), payloads), schema, strict=True)], columns)

    def settled(row: dict) -> pa.RecordBatch:
        ends = np.cumsum(np.frombuffer(row["counts"], np.uint32).astype(np.int64)) * 4
        ids = np.frombuffer(row["ids"], np.int64)
        return out(ids, np.frombuffer(row["tags"], np.int32), [row["run"]] * len(ids), -1, [row["keys"][a:b] for a, b in zip(np.append(0, ends[:-1]), ends, strict=True)])

    def judged(bucket: int, held: list) -> pa.RecordBatch:
        ids = np.concatenate([np.frombuffer(r["ids"], np.int64) for r in held])
        tags = np.concatenate([np.frombuffer(r["tags"], np.int32) for r in held])
        runs = np.repeat([r["run"] for r in held], [len(r["ids"]) // 8 for r in held])
        counts = np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in held]).astype(np.int64)
        keys = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in held])
        second = np.concatenate([np.frombuffer(r["seconds"], np.uint32) for r in held]) if held[0]["seconds"] is not None else None
        held.clear()
        own = np.repeat(np.arange(len(ids)), counts)
        if by_row:
            order = np.lexsort((tags, ids))
            step = np.zeros(len(order), np.int64)
            step[1:] = (ids[order][1:] != ids[order][:-1]) | (tags[order][1:] != tags[order][:-1])
            place = np.empty(len(order), np.int64)
            place[order] = np.cumsum(step)
        else:
            place = np.unique(ids, return_inverse=True)[1]
        rank = place[own]
        order = np.lexsort((rank, keys)) if second is None else np.lexsort((rank, second, keys))
        k, s, r = keys[order], None if second is None else second[order], rank[order]
        new = _new(k, s)
        first = np.flatnonzero(new)
        repeated = r > r[first][np.cumsum(new) - 1]
        code = repeated.astype(np.uint32) * REPEATED
        if s is not None:
            top = _new(k, None)
            which = np.cumsum(top) - 1
            varied = (np.add.reduceat(new.astype(np.int64), np.flatnonzero(top)) > 1)[which]
            code |= (varied & ~repeated).astype(np.uint32) * VARIED
        codes = np.empty(len(keys), np.uint32)
        codes[order] = code
        number = np.arange(len(keys)) - np.repeat(np.cumsum(counts) - counts, counts)
        told = np.flatnonzero(codes)
        who, start = np.unique(own[told], return_index=True)
        packed = ((number[told].astype(np.uint32) << np.uint32(2)) | codes[told]).tobytes()
        ends = np.append(start, len(told))[1:] * 4
        return out(ids[who], tags[who], runs[who], bucket, [packed[a:b] for a, b in zip(start * 4, ends, strict=True)])

    return run


def with_marks(docs: DataFrame, extract: Extract, by_row: bool, source: DataFrame | None = None) -> DataFrame:
    """The documents (id, text, tag, ...) with a column ``marks`` of verdicts, for ``codes``; one exchange of the texts.

    ``source``: where the pieces are taken from, if not from the documents as they are; it has id, tag, text and what ``extract`` reads.
    """
    n = partitions(docs.sparkSession)
    buckets = bucket_count(docs)
    sent = (docs if source is None else source).mapInArrow(_sender(extract, buckets, by_row), "bucket int, run long, ids binary, tags binary, counts binary, keys binary, seconds binary")
    told = sent.repartitionById(n, F.when(F.col("bucket") < 0, -1 - F.col("bucket")).otherwise(F.col("bucket"))).mapInArrow(_judge(by_row), "id long, tag int, run long, bucket int, payload binary")
    marks = told.groupBy("id", "tag").agg(F.collect_list(F.struct("run", "bucket", "payload")).alias("marks"))
    return docs.join(marks, ["id", "tag"], "left")


def codes(marks: list | None, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The verdict on each of a document's pieces, from its marks and the same hashes as were sent."""
    out = np.zeros(len(keys), np.uint8)
    if not marks:
        return out
    run = min(m["run"] for m in marks)
    marks = [m for m in marks if m["run"] == run]
    for m in marks:
        if m["bucket"] < 0:
            out[np.frombuffer(m["payload"], np.uint32)] = REPEATED
    sent = np.flatnonzero(out == 0)
    bucket = _bucket(keys[sent], buckets)
    order = np.argsort(bucket, kind="stable")
    sent, bucket = sent[order], bucket[order]
    for m in marks:
        if m["bucket"] >= 0:
            told = np.frombuffer(m["payload"], np.uint32)
            start = np.searchsorted(bucket, m["bucket"])
            out[sent[start + (told >> np.uint32(2))]] = told & np.uint32(3)
    return out


def bucket_count(docs: DataFrame) -> int:
    """One for each shuffle partition, which is its task."""
    return partitions(docs.sparkSession)
