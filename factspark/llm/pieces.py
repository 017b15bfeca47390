"""Removal of repeated runs of sentences by a global join of their hashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.first_seen import bucket_count, codes, tagged, with_marks
from factspark.llm.frames import documents, public_id
from factspark.llm.text import byte_blob, chunks, keep_pieces

#: From bytes and text offsets to (starts, hash, words) of all pieces, and the offsets of each text's pieces.
Cut = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
#: From (hash, words, offsets of texts) to a list of (first piece, number of pieces, hash): the runs that count.
Runs = Callable[[np.ndarray, np.ndarray, np.ndarray], list[tuple[np.ndarray, int, np.ndarray]]]


def _keys(cut: Cut, runs: Runs, texts: pa.Array):
    data, offs = byte_blob(texts, "\n")
    starts, value, words, at = cut(data, offs)
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = runs(value, words, at)
    first = np.concatenate([f for f, _, _ in found])
    width = np.concatenate([np.full(len(f), n) for f, n, _ in found])
    keys = np.concatenate([k for _, _, k in found])
    order = np.argsort(own[first], kind="stable") if len(first) else np.zeros(0, np.int64)
    first, width, keys = first[order], width[order], keys[order]
    return data, offs, starts, at, first, width, keys, np.searchsorted(own[first], np.arange(len(at)))


def remove_repeats(df: DataFrame, cut: Cut, runs: Runs, id_col: str, text_col: str, names: tuple[str, str], carry: bool = False) -> DataFrame:
    """(id, pieces, pieces removed, runs removed, text) of each row; of equal runs the first in (id, place) stays.

    With ``carry`` the result has the columns of ``df`` instead, with the new text.
    """
    docs = tagged(documents(df, id_col, text_col, carry))
    rest = [f for f in docs.columns if f == "rest"]
    buckets = bucket_count(docs)

    def extract(batch: pa.RecordBatch):
        *_, keys, offs = _keys(cut, runs, batch["text"])
        return offs, keys, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                data, offs, starts, at, first, width, keys, where = _keys(cut, runs, b["text"][i:j])
                counts, texts = [], []
                for k, marks in enumerate(b["marks"][i:j].to_pylist()):
                    begin, end, lo, hi = offs[k], offs[k + 1] - 1, at[k], at[k + 1]
                    drop = np.zeros(hi - lo + 1, np.int64)
                    if marks:
                        x, y = where[k], where[k + 1]
                        bad = np.flatnonzero(codes(marks, keys[x:y], buckets)) + x
                        np.add.at(drop, first[bad] - lo, 1)
                        np.add.at(drop, first[bad] + width[bad] - lo, -1)
                    drop = np.cumsum(drop)[:-1] > 0
                    counts.append((hi - lo, int(drop.sum()), int(np.diff(drop.astype(np.int8), prepend=0).clip(0).sum())))
                    texts.append(keep_pieces(data, starts[lo:hi], drop, begin, end).decode() if hi > lo else data[begin:end].tobytes().decode())
                columns = [pa.array([c[n] for c in counts], pa.int64()) for n in range(3)]
                yield pa.RecordBatch.from_arrays([b["id"][i:j], *columns, pa.array(texts, pa.string()), *(b[c][i:j] for c in rest)], ["id", "pieces", "removed", "runs", "text", *rest])

    marked = with_marks(docs, extract, by_row=True).select("id", "text", "marks", *rest)
    out = marked.mapInArrow(run, "id long, pieces long, removed long, runs long, text string" + "".join(f", rest {dict(docs.dtypes)[c]}" for c in rest))
    if carry:
        return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])
    return out.select(public_id().alias(id_col), F.col("pieces").alias(names[0]), F.col("removed").alias(names[1]), F.col("runs").alias("n_runs"), F.col("text").alias(text_col))
