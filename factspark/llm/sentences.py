"""Substring dedup by sliding sentence spans.

Every run of ``SPAN`` consecutive sentences is hashed, however short, and beyond these every run of two that has ``PAIR_WORDS`` words; the hashes are joined
globally (``first_seen``), and each sentence that is covered by a run which is not the first of its kind, in order of (doc_id, place),
is removed. Sentences end at ``.``, ``!`` or ``?`` before white space and at line ends; they are compared by their words, without case and
punctuation. A piece without a word belongs to the sentence before it.

A null text is empty and stays so; rows with equal id and text are one document; texts of one id are ordered by their hash; a null id is the least one.
Other columns are kept by ``carry`` only, whatever their names. An empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from factspark.llm.pieces import remove_repeats
from factspark.llm.text import raw_words, sequence_hashes

SPAN, PAIR_WORDS = 3, 20
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def cut_sentences(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pieces that have a word: where each starts, the hash of its words and their number, and the offsets of each text's pieces."""
    word_at, value = raw_words(data)
    brk = np.zeros(len(data), bool)
    if len(data) > 1:
        brk[:-1] = _STOP[data[:-1]] & _SPACE[data[1:]]
        brk |= data == 10
    edges = np.flatnonzero(brk)
    if not len(word_at):
        return np.zeros(0, np.int64), value, np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    piece = np.searchsorted(edges, word_at)  # how many ends stand before each word
    new = np.ones(len(piece), bool)
    new[1:] = piece[1:] != piece[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(word_at))
    starts = word_at[first]
    return starts, sequence_hashes(value, first, last), last - first, np.searchsorted(starts, offs)


def sentence_runs(value: np.ndarray, words: np.ndarray, offs: np.ndarray) -> list[tuple[np.ndarray, int, np.ndarray]]:
    out = []
    total = np.concatenate(([0], np.cumsum(words)))
    left = np.repeat(offs[1:], np.diff(offs)) - np.arange(len(value))  # pieces from here to the end of the text
    for width, least in ((SPAN, 0), (2, PAIR_WORDS)):
        first = np.flatnonzero(left >= width)
        first = first[total[first + width] - total[first] >= least]
        out.append((first, width, sequence_hashes(value, first, first + width)))
    return out


def remove_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """(doc_id, n_sentences, n_removed, n_runs, text) of each row, or the columns of ``df`` with ``carry``."""
    return remove_repeats(df, cut_sentences, sentence_runs, id_col, text_col, ("n_sentences", "n_removed"), carry)
