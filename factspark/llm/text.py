"""Vectorised text hashing on Arrow string batches.

Words are maximal runs of ASCII letters, digits and bytes of non-ASCII characters in the lower-cased text;
a shingle is five consecutive words, or all words of a text that has one to four. An empty text has no shingle.
All hashes are 64-bit and the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SHINGLE = 5
#: Bytes of text that are hashed at once; a longer document is hashed alone.
CHUNK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INV = pow(_BASE, -1, 1 << 64)
_RNG = np.random.Generator(np.random.PCG64(20240229))
_BYTE_CODE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_PLACE = _RNG.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) * U64(2) + U64(1)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x80:] = True
for _low, _high in ((48, 57), (65, 90), (97, 122)):
    _IS_WORD[_low : _high + 1] = True
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, modulo 2**64."""
    if len(_POWERS.get("up", ())) >= n:
        return _POWERS["up"][:n], _POWERS["down"][:n]
    size = max(n, CHUNK_BYTES + (CHUNK_BYTES >> 2))
    both = []
    for factor in (_BASE, _BASE_INV):
        p = np.full(size, U64(factor))
        p[0] = 1
        both.append(np.cumprod(p, dtype=np.uint64))
    if size <= 8 * CHUNK_BYTES:
        _POWERS["up"], _POWERS["down"] = both
    return both[0][:n], both[1][:n]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each byte span data[starts:ends]; equal bytes have equal hashes wherever they stand."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """The hash of the ``width`` bytes at each place that has as many; only a multiplication deep, and not that of ``span_hashes``."""
    up, down = _powers(len(data) + 1)
    total = np.empty(len(data) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
    x = total[width:] - total[: len(total) - width]
    x *= down[: len(x)]
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``limit`` bytes together, one row at least."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin, n, done = 0, len(sizes), 0
    while begin < n:
        end = max(begin + 1, int(np.searchsorted(sizes, done + limit, side="right")))
        yield begin, end
        begin, done = end, int(sizes[end - 1])


def byte_blob(texts: pa.Array, after: str = "") -> tuple[np.ndarray, np.ndarray]:
    """All texts' UTF-8 bytes in one array, each followed by ``after``, and the n+1 offsets; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if after:
        texts = pc.binary_join_element_wise(texts, pa.scalar("", pa.large_string()), pa.scalar(after, pa.large_string()))
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the offsets of each text's words."""
    data, offs = byte_blob(pc.utf8_lower(pc.fill_null(texts, "")), "\n")
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = _IS_WORD[data]
    edge = np.diff(inside, prepend=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(data, starts, ends), np.searchsorted(starts, offs)


def shingles_of_words(words: np.ndarray, offs: np.ndarray, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's shingles in order of place, and their offsets."""
    counts = np.diff(offs)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    out = np.zeros(len(offs), np.int64)
    np.cumsum(n, out=out[1:])
    at = np.arange(out[-1]) - np.repeat(out[:-1], n) + np.repeat(offs[:-1], n)
    short = np.repeat(counts, n)
    value = np.zeros(out[-1], np.uint64)
    for j in range(width):
        if (use := short > j).all():
            value += words[at + j] * _PLACE[j]
        else:
            value[use] += words[at[use] + j] * _PLACE[j]
    return mix(value + np.minimum(short, width).astype(np.uint64)), out


def shingle_hashes(texts: pa.Array, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    return shingles_of_words(*word_hashes(texts), width)


def owners(offs: np.ndarray) -> np.ndarray:
    """For each element, the text that it belongs to."""
    return np.repeat(np.arange(len(offs) - 1), np.diff(offs))


def numbered(values: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's values sorted, with the number of the copy among equal ones: (values, copy number, owner)."""
    own = owners(offs)
    order = np.lexsort((values, own))
    v, own = values[order], own[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (own[1:] != own[:-1])
    first = np.flatnonzero(new)
    return v, np.arange(len(v)) - np.repeat(first, np.diff(np.append(first, len(v)))), own


def segment_min(values: np.ndarray, offs: np.ndarray, empty: int) -> np.ndarray:
    """The least value of each text; ``empty`` where a text has none."""
    out = np.full(len(offs) - 1, empty, values.dtype)
    has = np.diff(offs) > 0
    if has.any():
        out[has] = np.minimum.reduceat(values, offs[:-1][has])
    return out


def sequence_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The hash of each run values[starts:ends] of 64-bit hashes; equal runs have equal hashes."""
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of raw bytes start and end."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = _IS_WORD[data]
    edge = np.diff(inside, prepend=0)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def raw_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of raw bytes, ASCII letters in lower case; positions stay those of ``data``."""
    lowered = data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)
    starts, ends = word_bounds(data)
    return starts, span_hashes(lowered, starts, ends)


def keep_pieces(data: np.ndarray, starts: np.ndarray, drop: np.ndarray, begin: int, end: int) -> bytes:
    """data[begin:end] without the dropped pieces, each from its start to the next one's."""
    if not drop.any():
        return data[begin:end].tobytes()
    edges = np.append(starts, end)
    edges[0] = begin
    return data[begin:end][np.repeat(~drop, np.diff(edges))].tobytes()
