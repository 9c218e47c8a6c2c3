"""Words and word shingles of whole texts as 64-bit hashes, vectorised over the UTF-8 bytes of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK = 1 << 21
#: The same where texts are only read: the arrays over their bytes are several times as long, and two workers share an executor with its JVM.
SLICE = 1 << 19
U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n pseudo-random 64-bit values, the same everywhere."""
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed << 32)) * U64(0x9E3779B97F4A7C15))


def _class_table(blank) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[[b for b in range(256) if blank(b)]] = 32
    return table


#: Lower-cases A-Z; blanks 09-0D and 20 / everything in ASCII but letters and digits.
BLANKS = _class_table(lambda b: 9 <= b <= 13)
ALNUM = _class_table(lambda b: b <= 0x2F or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F)
_BYTE = stream(1, 256)
_BYTE[32] = 0
_STEP = 0x5851F42D4C957F2D
_POWERS = [np.ones(1, U64), np.ones(1, U64)]


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        size = n + (n >> 2)
        for k, base in enumerate((_STEP, pow(_STEP, -1, 1 << 64))):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps)
    return _POWERS


class Words(NamedTuple):
    hashes: np.ndarray
    starts: np.ndarray  # byte offsets in the joined texts
    ends: np.ndarray
    bounds: np.ndarray  # text i has the words bounds[i]:bounds[i + 1]


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """The joined UTF-8 bytes of a text column and the offsets of each text; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of batches in parts of about ``limit`` bytes of text, at least one row each."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = BLANKS, cut: tuple[np.ndarray, np.ndarray] | None = None) -> Words:
    """Words of joined texts.  cut: two sets of bytes (256 flags each); a word also ends between one of the first and one of the second."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, U64), none, none, np.zeros(len(offsets), np.int64))
    low = table[raw]
    solid = low != 32
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    if cut is not None:
        between = cut[0][low[:-1]] & cut[1][low[1:]]
        first[1:] |= between
        last[:-1] |= between
    inner = offsets[(offsets > 0) & (offsets < n)]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers(n)
    total = np.cumsum(_BYTE[low] * up[:n])
    before = np.where(starts > 0, total[starts - 1], U64(0)) if len(starts) else np.zeros(0, U64)
    return Words(mix((total[ends - 1] - before) * down[starts]), starts, ends, np.searchsorted(starts, offsets))


_GRAM = stream(2, 64) | U64(1)


def grams(values: np.ndarray, bounds: np.ndarray, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k consecutive values inside each text, their positions, and the bounds of each text's.

    short: a text of fewer values than k, but not none, has one gram, all its values.
    """
    size = np.diff(bounds)
    count = np.where(size >= k, size - k + 1, (size > 0) if short else 0).astype(np.int64)
    own = np.concatenate([[0], np.cumsum(count)])
    pos = np.arange(own[-1]) + np.repeat(bounds[:-1] - own[:-1], count)
    if not len(pos):
        return np.zeros(0, U64), pos, own
    out = values[pos] * _GRAM[0]
    end = np.repeat(bounds[1:], count) if short else None
    for j in range(1, k):
        if short:
            inside = pos + j < end
            out += np.where(inside, values[np.minimum(pos + j, len(values) - 1)] * _GRAM[j], U64(0))
        else:
            out += values[pos + j] * _GRAM[j]
    return mix(out), pos, own


def sliding_min(values: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (by doubling)."""
    out, have = values, 1
    while have < w:
        step = min(have, w - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


class Lookup:
    """Positions of 64-bit values in a sorted array by their top bits; -1 for absent ones.  Values should be hashes."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.append(keys, ~U64(0))
        self.n, bits = len(keys), max(1, len(keys).bit_length())
        self.shift = U64(64 - bits)
        self.first = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << self.shift).astype(np.int32 if self.n < 1 << 31 else np.int64)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        at = self.first[values >> self.shift].astype(np.int64)
        found = self.keys[at]
        out = np.where((found == values) & (at < self.n), at, -1)
        open_ = np.flatnonzero(found < values)  # the keys ascend: a larger one ends the search
        at, values = at[open_], values[open_]
        while len(open_):
            at += 1
            found = self.keys[at]
            hit = (found == values) & (at < self.n)
            out[open_[hit]] = at[hit]
            on = found < values
            open_, at, values = open_[on], at[on], values[on]
        return out
