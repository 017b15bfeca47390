"""Lines are cut and dropped by whole arrays: against plain Python, and in a bounded multiple of the time that hashing takes."""

import random
import re
import time

import numpy as np
import pyarrow as pa

from factspark.llm import lines
from factspark.llm.text import byte_blob, span_hashes

BLANK = "\t\n\x0b\x0c\r "


def plain(text, gone):
    """(lines, lines that go, stretches, longest, text left): a blank line belongs to the line before it, those before the first to the first."""
    pieces, lead = [], ""
    for line in re.findall(r"[^\n]*\n|[^\n]+", text):
        if line.strip(BLANK):
            pieces.append(lead + line)
            lead = ""
        elif pieces:
            pieces[-1] += line
        else:
            lead += line
    flags = [next(gone) for _ in pieces]
    stretches = [len(x) for x in "".join("x" if f else " " for f in flags).split()]
    kept = "".join(p for p, f in zip(pieces, flags, strict=True) if not f) if pieces else text
    return len(pieces), sum(flags), len(stretches), max(stretches, default=0), kept


def test_cut_and_dropped_lines():
    rng = random.Random(5)
    for _ in range(500):
        texts = ["".join(rng.choices(["a", "b c", "é", "\n", "\n", " ", *BLANK, "\x85", "\x08", "\x0e"], k=rng.randint(0, 14))) for _ in range(rng.randint(1, 6))]
        data, offs = byte_blob(pa.array(texts), "\n")
        begins, starts, stops, at = lines.cut_lines(data, offs)
        assert [data[i:j].tobytes().decode() for i, j in zip(starts, stops, strict=True)] == [x.strip(BLANK) for t in texts for x in t.split("\n") if x.strip(BLANK)]
        share = rng.choice([0, 0.2, 0.5, 0.9, 1])
        gone = np.array([rng.random() < share for _ in begins], bool)
        counts, left = lines.without_lines(data, offs, begins, at, gone)
        left.validate(full=True)
        flags = iter(gone.tolist())
        want = [plain(t, flags) for t in texts]
        assert list(zip(*(c.tolist() for c in counts), left.to_pylist(), strict=True)) == want


def test_cutting_takes_less_than_hashing_several_times():
    """A search and a word hash for each byte took some ten times the line hash."""
    rng = random.Random(6)
    texts = pa.array(["\n".join(" ".join(rng.choices(["some", "words", "of", "a", "line"], k=12)) for _ in range(12)) for _ in range(1500)])
    data, offs = byte_blob(texts, "\n")

    def least(f):
        took = []
        for _ in range(5):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    at = np.arange(len(data))[:1000]
    assert least(lambda: lines.cut_lines(data, offs)) < 4 * least(lambda: span_hashes(data, at, at + 1))
