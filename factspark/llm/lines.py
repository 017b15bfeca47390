"""Line dedup: a suffix array over sequences of line ids by distributed prefix doubling.

Every line that isn't blank has an id, the hash of its trimmed bytes. A line whose id stands nowhere else is a symbol of its own, so only suffixes
that begin with a repeated line are ranked. A round sorts the suffixes that still tie on ``w`` lines by (rank, rank of the suffix ``w`` lines on) over
ranges of all executors; a suffix's new rank is its group's first place in that order, and groups of one suffix or of suffixes that have ended
leave. What ties after a round is an interval of the suffix array with a common prefix of 2 w lines at least (or of all that is left): all
of it but the first in order of (doc_id, line) are later copies, and so many lines from there on are covered by a repeated run. A maximal repeated run
of m lines is covered by the two intervals of 2**floor(log2 m) lines at its ends. Covered lines are deleted.

A run of one line counts from ``least_words`` words on (none by default), longer ones always. A blank line belongs to the line before it. A null
text is empty and stays so; rows with equal id and text are one document, texts of one id are ordered by their hash; a null id is the least one.
Other columns are kept by ``carry`` only, whatever their names. An empty table gives an empty one. Lines and texts go by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factspark.llm.frames import documents, public_id
from factspark.llm.text import byte_blob, chunks, owners, segment_min, span_hashes, word_bounds
from factspark.session import shared_dir

LEAST_WORDS = 0


def cut_lines(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines that aren't blank: where each begins, where what is left of it without the blanks around it starts and stops, and the offsets of each text's lines."""
    solid = np.zeros(len(data) + 2, bool)
    np.logical_and(data != 32, data - np.uint8(9) > 4, out=solid[1:-1])  # the others are tab, line feed, vertical tab, form feed, return and space
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    starts, stops = edge[::2], edge[1::2]
    ends = np.append(np.flatnonzero(data == 10), len(data))
    after = np.searchsorted(starts, ends)  # a stretch without blanks lies within a line
    before = np.append(0, after[:-1])
    has = np.flatnonzero(after > before)
    begins = np.append(0, ends[:-1] + 1)[has]  # with the blanks before the line
    return begins, starts[before[has]], stops[after[has] - 1], np.searchsorted(begins, offs)


def without_lines(data: np.ndarray, offs: np.ndarray, begins: np.ndarray, at: np.ndarray, gone: np.ndarray) -> tuple[list[np.ndarray], pa.Array]:
    """(lines, lines that go, stretches that go, lines of the longest one) of each text, and the texts without the lines that are ``gone``; each text
    ends in a line feed of its own. A line goes up to the next one's begin, a text's first line with all that stands before it."""
    n_gone = np.append(0, np.cumsum(gone))
    head, tail = (np.zeros(len(gone) + 1, bool) for _ in range(2))
    head[at[:-1]] = tail[at[1:]] = True  # a text's first line; what follows its last one
    run = np.flatnonzero(gone & (head[:-1] | ~np.append(False, gone)[:-1]))
    last = np.flatnonzero(gone & (tail[1:] | ~np.append(gone, False)[1:])) + 1
    size = n_gone[last] - n_gone[run]
    runs = np.searchsorted(run, at)
    longest = -segment_min(-size, runs, 0)
    own = owners(runs)
    lo = np.where(head[run], offs[own], begins[run])
    hi = np.where(tail[last], offs[own + 1] - 1, np.append(begins, 0)[last])
    kept = zip(np.sort(np.append(offs[:-1], hi)).tolist(), np.sort(np.append(lo, offs[1:] - 1)).tolist(), strict=True)
    raw = memoryview(np.ascontiguousarray(data))
    sizes = np.diff(offs) - 1 - np.diff(np.append(0, np.cumsum(hi - lo))[runs])
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    texts = pa.Array.from_buffers(pa.string(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(b"".join([raw[i:j] for i, j in kept]))])
    return [np.diff(at), np.diff(n_gone[at]), np.diff(runs), longest], texts


_STATE = "doc long, place int, left int, id long, tag int, rank long, sub long, ties long, cover int"
_ORDER = ["rank", "sub", "next", "next_sub", "id", "tag", "place"]
_END = -(1 << 63)


def _lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, place, left, id, tag, rank, words) of each line that isn't blank; left counts the lines from here on. Words are counted if some are asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                data, offs = byte_blob(b["text"][i:j], "\n")
                _, starts, stops, at = cut_lines(data, offs)
                value, n = span_hashes(data, starts, stops), np.diff(at)
                begun = word_bounds(data)[0] if least_words > 0 else np.zeros(0, np.int64)
                words = np.searchsorted(begun, stops) - np.searchsorted(begun, starts)
                own = np.repeat(np.arange(j - i), n)
                place = np.arange(len(value)) - np.repeat(at[:-1], n)
                doc, key, tag = (b[c][i:j].take(pa.array(own)) for c in ("doc", "id", "tag"))
                columns = [doc, pa.array(place, pa.int32()), pa.array(n[own] - place, pa.int32()), key, tag, pa.array(value.view(np.int64)), pa.array(words, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "place", "left", "id", "tag", "rank", "words"])

    return docs.select("doc", "id", "tag", "text").mapInArrow(run, "doc long, place int, left int, id long, tag int, rank long, words int")


def _repeated(lines: DataFrame, least_words: int) -> DataFrame:
    """The first round: lines that stand more than once, their number, and a cover of one line for those that aren't the first."""
    holder = F.struct("id", "tag", "place")
    groups = lines.groupBy("rank").agg(F.count("*").alias("ties"), F.min(holder).alias("first")).where("ties > 1")
    found = lines.join(groups, "rank").groupBy("doc", "place").agg(*[F.first(c).alias(c) for c in ("left", "id", "tag", "rank", "ties", "words", "first")])
    later = (holder > F.col("first")) & (F.col("words") >= least_words)
    return found.select("doc", "place", "left", "id", "tag", "rank", F.lit(0).cast("long").alias("sub"), "ties", F.when(later, 1).otherwise(0).alias("cover"))


def _sorted(state: DataFrame, width: int) -> DataFrame:
    """The suffixes that tie on ``width`` lines, in order of what follows these; equal ones in order of (id, tag, place)."""
    open_ = state.where((F.col("ties") > 1) & (F.col("left") >= width)).withColumn("at", F.col("place") + width)
    known = state.select(F.col("doc").alias("of"), F.col("place").alias("at_place"), F.col("rank").alias("next"), F.col("sub").alias("next_sub"))
    met = open_.join(known, (open_["doc"] == known["of"]) & (open_["at"] == known["at_place"]), "left")
    ended = F.col("left") == width
    alone = F.xxhash64("doc", "at")  # the symbol of a line that stands nowhere else
    keyed = met.select("doc", "place", "left", "id", "tag", "rank", "sub", "cover", F.when(ended, _END).otherwise(F.coalesce("next", alone)).alias("next"), F.when(ended, -1).otherwise(F.coalesce("next_sub", F.lit(0))).alias("next_sub"))
    return keyed.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).withColumn("part", F.spark_partition_id()).checkpoint()


def _table(batches: Iterator[pa.RecordBatch]) -> tuple[pa.Table | None, np.ndarray, np.ndarray]:
    """(rows of a range, where a group begins, where a key begins)."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return None, np.zeros(0, np.int64), np.zeros(0, np.int64)
    table = pa.Table.from_batches(held)
    new = np.ones(table.num_rows, bool)
    starts = []
    for names in (("rank", "sub"), ("next", "next_sub")):
        if starts:
            new = new.copy()
        else:
            new[1:] = False
        for c in names:
            v = table[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        starts.append(np.flatnonzero(new))
    return table, *starts


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for a range: its number and size, its first and last key, and where the last group, the last key and the second key begin."""
    table, group, key = _table(batches)
    if table is not None:
        n = table.num_rows
        ends = [[table[c][k].as_py() for c in _ORDER[:4]] for k in (0, n - 1)]
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (table["part"][0].as_py(), n, *ends, int(group[-1]), int(key[-1]), int(key[1]) if len(key) > 1 else n)], ["part", "n", "head", "tail", "last_group", "last_key", "second_key"])


def _carried(edges: list) -> dict[int, tuple[int, int, int, int]]:
    """For each range the global places of its first row, of the first rows of the group and of the key that it begins in, and of the end of its last key."""
    out, base, group, key, before = {}, 0, 0, 0, None
    for e in edges:
        g = group if before and before[:2] == e["head"][:2] else base
        k = key if before and before == e["head"] else base
        out[e["part"]] = [base, g, k, base + e["n"]]
        group, key = (base + e["last_group"] if e["last_group"] else g), (base + e["last_key"] if e["last_key"] else k)
        before, base = e["tail"], base + e["n"]
    end, head = 0, None
    for e in reversed(edges):
        mine = out[e["part"]]
        if head == e["tail"]:
            mine[3] = end
        head = e["head"]
        end = mine[0] + e["second_key"] if e["second_key"] < e["n"] else mine[3]
    return {p: tuple(x) for p, x in out.items()}


def _ranked(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """(the sorted suffixes with their new ranks, ties and covers, their number). A row for each range is with the driver."""
    edges = sorted(rows.mapInArrow(_edges, "part long, n long, head array<long>, tail array<long>, last_group long, last_key long, second_key long").collect(), key=lambda e: e["part"])
    places = _carried(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, group, key = _table(batches)
        if table is None:
            return
        base, g0, k0, end = places[table["part"][0].as_py()]
        n, at = table.num_rows, np.arange(table.num_rows)
        starts, groups, stops = key + base, group + base, np.append(key[1:], n) + base
        starts[0], groups[0], stops[-1] = k0, g0, end
        mine = np.searchsorted(key, at, side="right") - 1
        first = starts[mine]
        left = table["left"].to_numpy()
        common = np.minimum(2 * width, left)
        later = (base + at > first) & (common > 1)  # the first round has decided on single lines
        cover = np.where(later, np.maximum(table["cover"].to_numpy(), common), table["cover"].to_numpy())
        sub = table["sub"].to_numpy() + first - groups[np.searchsorted(group, at, side="right") - 1]
        given = [table[c].combine_chunks() for c in ("doc", "place", "left", "id", "tag", "rank")]
        yield pa.RecordBatch.from_arrays([*given, pa.array(sub), pa.array(stops[mine] - first), pa.array(cover.astype(np.int32))], ["doc", "place", "left", "id", "tag", "rank", "sub", "ties", "cover"])

    return rows.mapInArrow(run, _STATE), sum(e["n"] for e in edges)


def suffix_ranks(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, place, left, id, tag, rank, sub, ties, cover) of each suffix that begins with a repeated line: (rank, sub) is its order, cover how many
    lines from here on an earlier place has too, as a power of two or all that is left. Rounds grow with the logarithm of the longest repeated run."""
    state, width = _repeated(lines, least_words).checkpoint(), 1
    while True:
        ranked, n = _ranked(_sorted(state, width), width)
        if not n:
            return state
        closed = state.where((F.col("ties") <= 1) | (F.col("left") < width))
        state, width = closed.unionByName(ranked).checkpoint(), 2 * width


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, n_runs, longest_run, text) of each row, or the columns of ``df`` with ``carry``; lines that aren't blank are
    counted, n_runs are the stretches that go and longest_run the lines of the longest one."""
    shared_dir(df.sparkSession)
    docs = documents(df, id_col, text_col, carry).withColumn("tag", F.hash("text")).withColumn("doc", F.xxhash64("id", "text"))
    rest = [c for c in docs.columns if c == "rest"]
    covers = suffix_ranks(_lines(docs, least_words), least_words).where("cover > 0").groupBy("doc").agg(F.collect_list(F.struct("place", "cover")).alias("marks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in chunks(b["text"]):
                data, offs = byte_blob(b["text"][i:j], "\n")
                begins, _, _, at = cut_lines(data, offs)
                marks = b["marks"][i:j]
                pieces = marks.flatten()
                first = np.repeat(at[:-1], pc.fill_null(pc.list_value_length(marks), 0).to_numpy()) + pieces.field("place").to_numpy()
                stop = first + pieces.field("cover").to_numpy()
                drop = np.bincount(first, minlength=len(begins) + 1) - np.bincount(stop, minlength=len(begins) + 1)
                counts, texts = without_lines(data, offs, begins, at, np.cumsum(drop)[:-1] > 0)
                yield pa.RecordBatch.from_arrays([b["id"][i:j], *(pa.array(c, pa.int64()) for c in counts), texts, *(b[c][i:j] for c in rest)], ["id", "lines", "removed", "runs", "longest", "text", *rest])

    marked = docs.join(covers, "doc", "left").select("id", "text", "marks", *rest)
    out = marked.mapInArrow(run, "id long, lines long, removed long, runs long, longest long, text string" + "".join(f", rest {dict(docs.dtypes)[c]}" for c in rest))
    if carry:
        return out.select(*[F.col("text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in df.columns])
    return out.select(public_id().alias(id_col), F.col("lines").alias("n_lines"), F.col("removed").alias("n_removed"), F.col("runs").alias("n_runs"), F.col("longest").alias("longest_run"), F.col("text").alias(text_col))
