"""Vectorised word and shingle hashes over Arrow text columns.

A word is a maximal run of bytes other than space and \\t..\\r, with A-Z lower-cased; every function
works on concatenated UTF-8 bytes, so no Python object is made per word. Hashes are 64-bit and
depend only on the word's bytes, never on the process, so they can be joined across executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _byte_tables():
    rng = np.random.Generator(np.random.PCG64(20240917))
    value = rng.integers(1, 1 << 63, 256, dtype=np.uint64)
    value[65:91] = value[97:123]
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    steps = rng.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
    return value, space, steps


BYTE_VALUE, IS_SPACE, STEP = _byte_tables()
#: For term features: every ASCII byte but letters and digits ends a word, and the case of Latin-1 letters doesn't count.
IS_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
FOLDED_VALUE = BYTE_VALUE.copy()
FOLDED_VALUE[0x80:0x9F] = FOLDED_VALUE[0xA0:0xBF]
_INVERSE = np.uint64(pow(int(_ODD), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        np.multiply.accumulate(out, out=out)
        _powers[name] = have = out
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends - ends[0]


def utf8_bytes(column) -> np.ndarray:
    """All bytes of a binary or string column, one value after another."""
    wide = np.int64 if pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type) else np.int32
    if not len(column) or column.buffers()[2] is None:
        return np.zeros(0, np.uint8)
    ends = np.frombuffer(column.buffers()[1], wide)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES):
    """Ranges of documents of at most `limit` bytes; a longer document is a range of its own."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def words(data: np.ndarray, offsets: np.ndarray, spans: bool = False, gaps=IS_SPACE, value=BYTE_VALUE, prefixes=()):
    """(hashes, bounds) or (hashes, bounds, starts, ends): document i has the words bounds[i]:bounds[i + 1].

    With prefixes, hashes has a row for each of these lengths in bytes before the row of the whole words (a
    shorter word's is that of the word). Starts and ends are byte positions in `data`. Long input is hashed in pieces that end at a
    word's end, so the memory besides the words stays near CHUNK_BYTES times 24.
    """
    gap = gaps[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = ~gap
    begin[1:] &= gap[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    finish = ~gap
    finish[:-1] &= gap[1:] | first[1:-1]
    ends = np.flatnonzero(finish) + 1
    out = np.empty((len(prefixes) + 1, len(starts)), np.uint64)
    lo = 0
    while lo < len(starts):
        at = starts[lo]
        hi = max(lo + 1, int(np.searchsorted(ends, at + CHUNK_BYTES, "right")))
        part = value[data[at : ends[hi - 1]]]
        part *= _power(_ODD, "up", len(part))
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        s, e = starts[lo:hi] - at, ends[lo:hi] - at
        back = _power(_INVERSE, "down", len(part) + 1)[s]
        for i, most in enumerate((*prefixes, None)):
            size = e - s if most is None else np.minimum(e - s, most)
            out[i, lo:hi] = (total[s + size] - total[s]) * back + size.astype(np.uint64)
        lo = hi
    bounds = np.searchsorted(starts, offsets)
    out = mix(out if prefixes else out[0])
    return (out, bounds, starts, ends) if spans else (out, bounds)


def shingles(hashes: np.ndarray, bounds: np.ndarray, k: int = 5):
    """(hashes, bounds) of the runs of k words; fewer words than k make one shingle, no word none."""
    n = np.diff(bounds)
    total = np.zeros(len(hashes), np.uint64)
    for j in range(min(k, len(hashes))):
        total[: len(hashes) - j] += hashes[j:] * STEP[j]
    made = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)]).astype(np.int64)
    picked = np.repeat(bounds[:-1] - out_bounds[:-1], made) + np.arange(out_bounds[-1])
    out = total[picked]
    for i in np.flatnonzero((n > 0) & (n < k)):
        own = hashes[bounds[i] : bounds[i + 1]]
        out[out_bounds[i]] = np.append(own * STEP[: len(own)], STEP[k + len(own)]).sum(dtype=np.uint64)
    return mix(out), out_bounds


def shingle_sets(column, k: int = 5):
    """For each text of a string column, in order, the sorted distinct shingle hashes."""
    data, offsets = utf8(column)
    for lo, hi in chunks(offsets):
        part, bounds = shingles(*words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), k)
        for i in range(hi - lo):
            yield np.unique(part[bounds[i] : bounds[i + 1]])
