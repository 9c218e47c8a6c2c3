"""Wavelet matrix of a token sequence, and its file.

One bit-plane for each bit of the ids, highest first; after a plane the tokens are split, zeros before ones, keeping their order.
The planes are cut into blocks, each compressed by itself, with the number of ones before each, so rank needs one block of a plane:
``access``, ``count`` and ``find`` read a few blocks, ``tokens`` all.

File: MAGIC, u32 planes, u64 tokens, u64 documents; for each plane u64 zeros; document table (i64 id or the null mark, u64 end);
for each plane and block u64 ones before, u64 offset in the data, u32 stored bytes; the data.  Little-endian throughout.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

MAGIC = b"PWWM0001"
#: Bits of a block.
BLOCK = 1 << 16
NULL_ID = -(1 << 63)
_ENTRY = np.dtype([("ones", "<u8"), ("at", "<u8"), ("size", "<u4")])


def encode(tokens: np.ndarray, doc_ids: np.ndarray, ends: np.ndarray, planes: int) -> bytes:
    """The file of a token sequence; document i is tokens[ends[i - 1]:ends[i]]."""
    n = len(tokens)
    blocks = -(-n // BLOCK)
    table, zeros, data, at = np.zeros((planes, blocks), _ENTRY), np.zeros(planes, "<u8"), io.BytesIO(), 0
    row = tokens.astype(np.uint16 if planes <= 16 else np.uint32)
    for p in range(planes):
        bit = (row >> row.dtype.type(planes - 1 - p)) & row.dtype.type(1) != 0
        ones = 0
        packed = np.packbits(bit)
        for b in range(blocks):
            piece = zlib.compress(packed[b * BLOCK // 8 : (b + 1) * BLOCK // 8].tobytes(), 1)
            table[p, b] = (ones, at, len(piece))
            data.write(piece)
            at += len(piece)
            ones += int(np.count_nonzero(bit[b * BLOCK : (b + 1) * BLOCK]))
        zeros[p] = n - ones
        row = np.concatenate([row[~bit], row[bit]])
    docs = np.zeros(len(doc_ids), np.dtype([("id", "<i8"), ("end", "<u8")]))
    docs["id"], docs["end"] = doc_ids, ends
    return b"".join([MAGIC, struct.pack("<IQQ", planes, n, len(doc_ids)), zeros.tobytes(), docs.tobytes(), table.tobytes(), data.getvalue()])


class WaveletFile:
    """Reads what ``encode`` wrote, from bytes or a memory map."""

    def __init__(self, data):
        self.data = memoryview(data)
        if bytes(self.data[:8]) != MAGIC:
            raise ValueError("not a wavelet file")
        self.planes, self.n, docs = struct.unpack_from("<IQQ", self.data, 8)
        at, self.blocks = 28, -(-self.n // BLOCK)
        self.zeros = np.frombuffer(self.data, "<u8", self.planes, at).astype(np.int64)
        at += 8 * self.planes
        table = np.frombuffer(self.data, np.dtype([("id", "<i8"), ("end", "<u8")]), docs, at)
        self.doc_ids, self.ends = table["id"], table["end"].astype(np.int64)
        at += 16 * docs
        self.table = np.frombuffer(self.data, _ENTRY, self.planes * self.blocks, at).reshape(self.planes, self.blocks)
        self.start = at + _ENTRY.itemsize * self.planes * self.blocks
        self._last: dict[int, tuple[int, np.ndarray]] = {}

    def _bits(self, p: int, b: int) -> np.ndarray:
        if self._last.get(p, (None,))[0] != b:
            e = self.table[p, b]
            at = self.start + int(e["at"])
            raw = np.frombuffer(zlib.decompress(self.data[at : at + int(e["size"])]), np.uint8)
            self._last[p] = (b, np.unpackbits(raw)[: min(BLOCK, self.n - b * BLOCK)])
        return self._last[p][1]

    def rank1(self, p: int, i: int) -> int:
        """Ones of plane p before position i."""
        if i >= self.n:
            return self.n - int(self.zeros[p])
        b = i // BLOCK
        return int(self.table[p, b]["ones"]) + int(np.count_nonzero(self._bits(p, b)[: i - b * BLOCK]))

    def access(self, i: int) -> int:
        value = 0
        for p in range(self.planes):
            bit = int(self._bits(p, i // BLOCK)[i % BLOCK])
            ones = self.rank1(p, i)
            i = int(self.zeros[p]) + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        for p in range(self.planes):
            a, b = self.rank1(p, start), self.rank1(p, end)
            start, end = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.planes - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def _select(self, p: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of plane p."""
        ones = self.table[p]["ones"].astype(np.int64)
        before = ones if bit else np.arange(self.blocks) * BLOCK - ones
        b = int(np.searchsorted(before, k, "right")) - 1
        return b * BLOCK + int(np.flatnonzero(self._bits(p, b) == bit)[k - int(before[b])])

    def find(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of a token."""
        a, b = self._range(token, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        i = a + k
        for p in reversed(range(self.planes)):
            bit = token >> (self.planes - 1 - p) & 1
            i = self._select(p, bit, i - int(self.zeros[p]) if bit else i)
        return i

    def tokens(self) -> np.ndarray:
        """The whole sequence: the planes are undone from the lowest up."""
        kind = np.uint16 if self.planes <= 16 else np.uint32
        row = np.zeros(self.n, kind)
        for p in reversed(range(self.planes)):
            bit = np.concatenate([self._bits(p, b) for b in range(self.blocks)] or [np.zeros(0, np.uint8)]).astype(bool)
            out = np.empty(self.n, kind)
            z = int(self.zeros[p])
            out[~bit] = row[:z]
            out[bit] = row[z:] | kind(1 << (self.planes - 1 - p))
            row = out
        return row
