"""Which band buckets hold two texts or more: one packed exchange of 12 bytes a band, whatever the size of the table.

The space of band hashes is cut into ranges of about ``RANGE_BANDS`` bands each. Each task gathers the bands of a run of its texts and sends each
range the other 32 bits of its hashes, each with a text. Of the texts of one run that share a band only the least goes there, marked; the others
are known to share it and are passed on by tasks dealt by run. So a band that stands everywhere costs one entry for each run, and a task
holds one range at a time. Two bands of one range fall together by their 32 bits once in some 4,000 bands; a false meeting
adds a text to a bucket, where it is compared like the others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.session import partitions

#: Bands that a task gathers before it sends them on, and that a range has on average.
RUN_BANDS, RANGE_BANDS = 2_000_000, 1_000_000
#: Entries in a row of texts that are passed on.
ROW = 1 << 16
_LOW = np.uint64(0xFFFFFFFF)


def _sender(ranges: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        held: list = []
        size = 0
        for b in batches:
            b = b.filter(pc.is_valid(b["bands"]))
            bands = pc.list_flatten(b["bands"]).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append((bands, np.repeat(b["rep"].to_numpy(), pc.list_value_length(b["bands"]).to_numpy(zero_copy_only=False))))
            size += len(bands)
            if size >= RUN_BANDS:
                yield from flush(held, task)
                held, size, task = [], 0, task + 1
        if size:
            yield from flush(held, task)

    def flush(held: list, task: int) -> Iterator[pa.RecordBatch]:
        bands, reps = (np.concatenate([h[k] for h in held]) for k in range(2))
        place = ((bands & _LOW) * np.uint64(ranges) >> np.uint64(32) << np.uint64(32)) | (bands >> np.uint64(32))
        order = np.lexsort((reps, place))
        place, reps = place[order], reps[order]
        fresh = np.ones(len(place), bool)
        fresh[1:] = (place[1:] != place[:-1]) | (reps[1:] != reps[:-1])
        place, reps = place[fresh], reps[fresh]
        head = np.ones(len(place), bool)
        head[1:] = place[1:] != place[:-1]
        shared = np.diff(np.append(np.flatnonzero(head), len(place))) > 1
        others, texts = place[~head], reps[~head]
        for k in range(0, len(others), ROW):
            yield row(-1 - task, others[k : k + ROW].tobytes(), texts[k : k + ROW], b"")
        place, reps = place[head], reps[head]
        bounds = np.searchsorted(place >> np.uint64(32), np.arange(ranges + 1, dtype=np.uint64))
        for k in np.flatnonzero(np.diff(bounds)):
            x, y = bounds[k], bounds[k + 1]
            yield row(int(k), (place[x:y] & _LOW).astype(np.uint32).tobytes(), reps[x:y], np.packbits(shared[x:y]).tobytes())

    def row(k: int, keys: bytes, reps: np.ndarray, shared: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), *(pa.array([v], pa.binary()) for v in (keys, reps.tobytes(), shared))], ["range", "keys", "reps", "shared"])

    return run


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each range's shared buckets; rows come by range."""

    def out(place: np.ndarray, reps: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(place.view(np.int64)), pa.array(reps)], ["band", "rep"])

    def met(at: int, held: list) -> Iterator[pa.RecordBatch]:
        keys, reps, shared = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.lexsort((reps, keys))
        keys, reps, shared = keys[order], reps[order], shared[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        last = np.append(first[1:], len(keys)) - 1
        full = (reps[first] != reps[last]) | np.logical_or.reduceat(shared, first)
        use = np.repeat(full, last - first + 1)
        use[1:] &= (keys[1:] != keys[:-1]) | (reps[1:] != reps[:-1])
        if use.any():
            yield out((np.uint64(at) << np.uint64(32)) | keys[use].astype(np.uint64), reps[use])

    at, held = None, []
    for b in batches:
        for k, keys, reps, shared in zip(b["range"].to_pylist(), b["keys"], b["reps"], b["shared"], strict=True):
            texts = np.frombuffer(reps.as_py(), np.int64)
            if k < 0:
                yield out(np.frombuffer(keys.as_py(), np.uint64), texts)
                continue
            if held and k != at:
                yield from met(at, held)
                held = []
            at = k
            held.append((np.frombuffer(keys.as_py(), np.uint32), texts, np.unpackbits(np.frombuffer(shared.as_py(), np.uint8), count=len(texts)).astype(bool)))
    if held:
        yield from met(at, held)


def members(texts: DataFrame, bands: int) -> DataFrame:
    """(band, rep) of the buckets that hold two texts or more, from ``texts`` (rep, bands), about so many bands in all.

    A text whose list is null is in no bucket. Only a text of several rows may come several times in a bucket.
    """
    n = partitions(texts.sparkSession)
    ranges = n * (1 + bands // (n * RANGE_BANDS))
    sent = texts.select("rep", "bands").mapInArrow(_sender(ranges), "range long, keys binary, reps binary, shared binary")
    to = F.pmod(F.when(F.col("range") < 0, -1 - F.col("range")).otherwise(F.col("range")), F.lit(n)).cast("int")
    return sent.repartitionById(n, to).sortWithinPartitions("range").mapInArrow(_meet, "band long, rep long")
