"""Suffix dedup: bytes of every ``LENGTH``-byte string that also starts in a document with a smaller id are removed.

The suffixes are compared by their first ``LENGTH`` bytes. Instead of every suffix, a cover of sampled ones is named first: in each window
of ``LENGTH`` bytes the place with the least hash of ``GRAM`` bytes, which depends on the bytes alone, so equal windows have their sample at the
same place (a difference cover has the same use, but one with periods that fit here takes 28 % of all places, this one 8.5 %). All windows
around one sample are a segment. One exchange holds (name of the sample, hash of the segment's bytes) together: a segment that an earlier
document has is removed at once; one whose sample no other document shares is kept; where a sample's segments differ, the first of
each kind sends the hashes of its single windows in a second exchange, where equal prefixes meet and are compared with the least document.

A null text is empty. A null id is the least one; rows of equal ids don't count against each other. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.first_seen import REPEATED, VARIED, bucket_count, codes, tagged, with_marks
from factspark.llm.frames import documents, public_id
from factspark.llm.text import byte_blob, chunks, gram_hashes, mix, span_hashes

LENGTH, GRAM = 50, 28
_WINDOW = LENGTH - GRAM + 1


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each window, by doubling."""
    step, done = values, 1
    while done * 2 <= width:
        step = np.minimum(step[: len(step) - done], step[done:])
        done *= 2
    rest = width - done
    return np.minimum(step[: len(step) - rest], step[rest:]) if rest else step


def segments(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, text offsets, segment offsets of each text, first and end window of each segment, sample name, segment hash)."""
    data, offs = byte_blob(texts, "\n")
    last = offs[1:] - 1 - LENGTH  # the last window of each text starts here
    n = len(data)
    if n < LENGTH or (last < offs[:-1]).all():
        none = np.zeros(0, np.int64)
        return data, offs, np.zeros(len(offs), np.int64), none, none, none.astype(np.uint64), none.astype(np.uint32)
    name = gram_hashes(data, GRAM)
    # place in the text in the low bits: the leftmost of equal hashes is the sample, whatever stands around the text
    place = (np.arange(len(name)) - np.repeat(offs[:-1], np.diff(offs))[: len(name)]) & 0xFFFF
    marked = (name & np.uint64(0xFFFFFFFFFFFF0000)) | place.astype(np.uint64)
    least = _least(marked, _WINDOW)
    window = np.arange(len(least))
    sample = window + ((least & np.uint64(0xFFFF)).astype(np.int64) - place[: len(least)]) % 65536
    valid = np.zeros(len(least) + 1, np.int64)
    has = last >= offs[:-1]
    np.add.at(valid, offs[:-1][has], 1)
    np.add.at(valid, last[has] + 1, -1)
    window = np.flatnonzero(np.cumsum(valid)[:-1] > 0)
    s = sample[window]
    new = np.ones(len(window), bool)
    new[1:] = (s[1:] != s[:-1]) | (window[1:] != window[:-1] + 1)
    first = np.flatnonzero(new)
    begin = window[first]
    end = window[np.append(first[1:], len(window)) - 1] + 1
    anchor = s[first]
    whole = mix(span_hashes(data, begin, end - 1 + LENGTH) + (anchor - begin).astype(np.uint64))
    return data, offs, np.searchsorted(begin, offs), begin, end, name[anchor], (whole >> np.uint64(32)).astype(np.uint32)


def _of_segments(batch: pa.RecordBatch):
    _, _, at, _, _, name, whole = segments(batch["text"])
    return at, name, whole


def _open_windows(batch: pa.RecordBatch, buckets: int):
    """The single windows of segments whose sample stands in segments of several kinds: (bytes, text offsets, first and end window of each segment, verdicts, windows, their offsets)."""
    data, offs, at, begin, end, name, whole = segments(batch["text"])
    told = np.zeros(len(begin), np.uint8)
    for k, marks in enumerate(batch["marks"].to_pylist()):
        if marks:
            told[at[k] : at[k + 1]] = codes(marks, name[at[k] : at[k + 1]], buckets)
    opened = np.flatnonzero(told == VARIED)
    n = (end - begin)[opened]
    windows = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin[opened], n)
    return data, offs, begin, end, told, windows, np.searchsorted(windows, offs)


def remove_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row, with ``with_text`` also ``kept`` (binary)."""
    docs = tagged(documents(df, id_col, text_col))
    buckets = bucket_count(docs)
    first = with_marks(docs, _of_segments, by_row=False)

    def windows_of(batch: pa.RecordBatch):
        data, _, _, _, _, windows, at = _open_windows(batch, buckets)
        return at, span_hashes(data, windows, windows + LENGTH), None

    second = with_marks(first.withColumnRenamed("marks", "before"), windows_of, by_row=False, source=first.where("marks is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                part = b.slice(i, j - i)
                told = part["before"].is_valid()
                for some in (part.filter(told), part.filter(pc.invert(told))):  # a text without a verdict stays as it is
                    if len(some):
                        yield cleaned(some)

    def cleaned(part: pa.RecordBatch) -> pa.RecordBatch:
        if part["before"].null_count:
            data, offs = byte_blob(part["text"], "\n")
            drop = None
        else:
            plain = pa.RecordBatch.from_arrays([part["text"], part["before"]], ["text", "marks"])
            data, offs, begin, end, told, windows, at = _open_windows(plain, buckets)
            cover = np.zeros(len(data) + 1, np.int32)
            gone = np.flatnonzero(told == REPEATED)
            np.add.at(cover, begin[gone], 1)
            np.add.at(cover, end[gone] - 1 + LENGTH, -1)
            if len(windows):
                keys = span_hashes(data, windows, windows + LENGTH)
                for k, marks in enumerate(part["marks"].to_pylist()):
                    if marks:
                        w = windows[at[k] : at[k + 1]][codes(marks, keys[at[k] : at[k + 1]], buckets) > 0]
                        np.add.at(cover, w, 1)
                        np.add.at(cover, w + LENGTH, -1)
            drop = np.cumsum(cover)[:-1] > 0
        rows = []
        for x, y in zip(offs[:-1].tolist(), (offs[1:] - 1).tolist(), strict=True):
            d = drop[x:y] if drop is not None else None
            removed = int(d.sum()) if d is not None else 0
            kept = (data[x:y][~d] if removed else data[x:y]).tobytes()
            spans = int(d[:1].sum() + (d[1:] & ~d[:-1]).sum()) if removed else 0
            rows.append((y - x, removed, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([part["id"], *(pa.array([r[n] for r in rows], t) for n, t in enumerate(kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    out = second.select("id", "text", "before", "marks").mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(public_id().alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
