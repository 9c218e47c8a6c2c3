"""AVI files of motion JPEG that carry bytes without loss, and readers of both formats.

A JPEG keeps its quantised coefficients exactly, so the coefficient is the unit of storage: byte b is the coefficient of size class 8
whose extra bits are b (b - 255 below 128, b from 128 on), 64 of them an 8 x 8 block in zigzag order.  Both Huffman tables have one
code of eight zero bits for that class, and a restart marker follows each block, so DC differences start anew and blocks stand alone.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np

BLOCKS_WIDE = 4
SIDE = 8 * BLOCKS_WIDE
FRAME_BLOCKS = BLOCKS_WIDE * BLOCKS_WIDE
FPS = 25


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient: diagonals in turn, odd ones downwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_SCALE = 1 << 12


def _basis() -> np.ndarray:
    """Cosine basis as whole numbers: products and sums stay exact in doubles, so equal frames give equal pixels on any machine."""
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    basis = np.cos((2 * x + 1) * k * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return np.rint(basis * _SCALE)


_BASIS = _basis()


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_header() -> bytes:
    one_code = bytes([0] * 7 + [1] + [0] * 8)
    return b"".join([
        b"\xff\xd8", _segment(0xDB, b"\0" + b"\1" * 64), _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0"),
        _segment(0xC4, b"\x00" + one_code + b"\x08"), _segment(0xC4, b"\x10" + one_code + b"\x08"), _segment(0xDD, b"\0\1"),
        _segment(0xDA, b"\1\1\0\0\x3f\0"),
    ])


_HEADER = _jpeg_header()


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """JPEG frames of a payload (uint8, a multiple of 64); the last frame is filled up with zero blocks."""
    count = max(1, -(-len(payload) // (64 * FRAME_BLOCKS)))
    blocks = np.zeros((count * FRAME_BLOCKS, 64), np.uint8)
    blocks.ravel()[: len(payload)] = payload
    scan = np.zeros((count, FRAME_BLOCKS, 130), np.uint8)
    scan[:, :, 1:128:2] = blocks.reshape(count, FRAME_BLOCKS, 64)
    scan[:, :, 128] = 0xFF
    scan[:, :, 129] = 0xD0 + np.arange(FRAME_BLOCKS) % 8
    rows = scan.reshape(count, -1)[:, :-2]
    if (blocks == 0xFF).any():
        stuffed = []
        for k, row in enumerate(rows):
            at = np.flatnonzero(scan[k, :, 1:128:2].ravel() == 0xFF)
            stuffed.append(np.insert(row, at // 64 * 130 + at % 64 * 2 + 2, 0).tobytes())
    else:
        stuffed = [row.tobytes() for row in np.ascontiguousarray(rows)]
    return [_HEADER + x + b"\xff\xd9" for x in stuffed]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode_avi(payload: np.ndarray) -> bytes:
    """An AVI 1.0 file of the payload; its length is in the comment of the INFO list, frames are listed in idx1."""
    frames = encode_frames(payload)
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4h", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    size = np.fromiter(map(len, frames), np.int64, len(frames))
    at = 4 + np.cumsum(size + size % 2 + 8) - (size + size % 2 + 8)
    index = np.zeros(len(frames), np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    index["id"], index["flags"], index["at"], index["size"] = b"00dc", 0x10, at, size
    body = b"".join([b"AVI ", hdrl, info, _chunk(b"LIST", b"movi" + b"".join(chunks)), _chunk(b"idx1", index.tobytes())])
    return _chunk(b"RIFF", body)


def _walk(data: bytes, at: int, end: int):
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield name, at + 8, min(at + 8 + size, end)
        at += 8 + size + size % 2


def parse_avi(data: bytes) -> dict:
    """Frames (by the index, or in file order without one), microseconds a frame, width, height and the comment of a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    out = {"frames": [], "us": 1_000_000 // FPS, "width": 0, "height": 0, "comment": b""}
    movi, listed, index = None, [], None
    todo = [(12, len(data))]
    while todo:
        for name, a, b in _walk(data, *todo.pop()):
            if name == b"LIST" and data[a : a + 4] == b"movi":
                movi = a
                listed = [(x, y) for n, x, y in _walk(data, a + 4, b) if n[2:] in (b"dc", b"db")]
            elif name == b"LIST":
                todo.append((a + 4, b))
            elif name == b"avih":
                out["us"], out["width"], out["height"] = (struct.unpack_from("<I", data, a + k)[0] for k in (0, 32, 36))
            elif name == b"ICMT":
                out["comment"] = data[a:b].rstrip(b"\0")
            elif name == b"idx1":
                index = np.frombuffer(data, np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]), (b - a) // 16, a)
    if index is not None and movi is not None:
        listed = [(movi + int(e["at"]) + 8, movi + int(e["at"]) + 8 + int(e["size"])) for e in index if e["id"][2:] in (b"dc", b"db")]
    out["frames"] = [data[a:b] for a, b in listed]
    return out


def _codes(counts, symbols) -> dict:
    """{(bits, code): symbol} of a Huffman table told by how many codes each length has."""
    code, out, given = 0, {}, iter(symbols)
    for bits, n in enumerate(counts, 1):
        for _ in range(n):
            out[bits, code] = next(given)
            code += 1
        code <<= 1
    return out


def _standard_ac(first: str) -> list[int]:
    """The symbols of a standard table of run lengths: those listed, then all others of the 162 in ascending order."""
    head = list(bytes.fromhex(first))
    every = [0x00, 0xF0, *(run << 4 | size for run in range(16) for size in range(1, 11))]
    return head + sorted(set(every) - set(head))


#: The standard's Huffman tables {class, id}, which files of motion JPEG leave out: luma and chroma.
STANDARD = {
    (0, 0): _codes((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), range(12)),
    (0, 1): _codes((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), range(12)),
    (1, 0): _codes((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), _standard_ac("01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282")),
    (1, 1): _codes((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), _standard_ac("0001020311040521310612415107617113223281081442" + "91a1b1c109233352f0156272d10a162434e125f1")),
}


@lru_cache(maxsize=64)
def _parse_header(head: bytes) -> tuple:
    """Of a JPEG's segments: height, width, restart interval, and of each component (quantiser, sampling across and down, Huffman tables)."""
    at, quant, tables, frame, interval = 2, {}, dict(STANDARD), None, 0
    while at < len(head):
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else "u1", 64, k + 1)
                quant[body[k] & 15] = values.astype(np.int64)
                k += 1 + 64 * (1 + wide)
        elif marker in (0xC0, 0xC1):
            _, height, width, parts = struct.unpack_from(">BHHB", body)
            frame = (height, width, [tuple(body[6 + 3 * i : 9 + 3 * i]) for i in range(parts)])
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                tables[body[k] >> 4, body[k] & 15] = _codes(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
            if frame is None or len(scan) != len(frame[2]):
                raise ValueError("only frames of one scan are read")
            parts = [(quant[q], hv >> 4, hv & 15, tables[0, scan[name][0]], tables[1, scan[name][1]]) for name, hv, q in frame[2]]
            return frame[0], frame[1], interval, parts
        at += 2 + size
    raise ValueError("no scan")


def _huffman_blocks(data: bytes, units: list[tuple[int, dict, dict]], n: int) -> list[np.ndarray]:
    """Coefficients in zigzag order of n interleaved units (blocks, their tables) of each component, bit by bit: for tables other than the writer's."""
    bits, at, last = int.from_bytes(data, "big"), 8 * len(data), [0] * len(units)
    out = [np.zeros((n * size, 64), np.int64) for size, _, _ in units]

    def take(count: int) -> int:
        nonlocal at
        at -= count
        if at < 0:
            raise ValueError("the scan ends early")
        return bits >> at & ((1 << count) - 1)

    def symbol(table: dict) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | take(1)
            if (length, code) in table:
                return table[length, code]
        raise ValueError("unknown code")

    def amplitude(size: int) -> int:
        value = take(size) if size else 0
        return value if not size or value >> (size - 1) else value - (1 << size) + 1

    for unit in range(n):
        for c, (blocks, dc, ac) in enumerate(units):
            for row in out[c][unit * blocks : (unit + 1) * blocks]:
                last[c] += amplitude(symbol(dc))
                row[0], k = last[c], 1
                while k < 64:
                    run, size = divmod(symbol(ac), 16)
                    if not size and run != 15:
                        break
                    k += run
                    if k > 63:
                        raise ValueError("a block is too long")
                    if size:
                        row[k] = amplitude(size)
                    k += 1
    return out


_WRITER_TABLE = {(8, 0): 8}


def decode_frames(frames: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, int, int]]:
    """For each JPEG: coefficients of its first component, the luma (blocks x 64, zigzag), its quantiser, height and width."""
    out = []
    for jpeg in frames:
        start = jpeg.find(b"\xff\xda")
        if start < 0:
            raise ValueError("no scan")
        start += 2 + struct.unpack_from(">H", jpeg, start + 2)[0]
        height, width, interval, parts = _parse_header(jpeg[:start])
        quant, across, down, dc, ac = parts[0]
        scan = np.frombuffer(jpeg, np.uint8, len(jpeg) - start, start)
        mark = np.flatnonzero(scan[:-1] == 0xFF)
        after = scan[mark + 1]
        end = int(mark[after == 0xD9][0]) if (after == 0xD9).any() else len(scan)
        restarts = mark[(after >= 0xD0) & (after <= 0xD7)]
        gone = np.zeros(len(scan), bool)
        gone[mark[after == 0] + 1] = True
        gone[restarts] = gone[restarts + 1] = gone[end:] = True
        if len(parts) == 1:  # blocks follow each other, whatever the sampling says
            n, units = -(-height // 8) * -(-width // 8), [(1, dc, ac)]
        else:
            most_across, most_down = max(p[1] for p in parts), max(p[2] for p in parts)
            n, units = -(-height // (8 * most_down)) * -(-width // (8 * most_across)), [(h * v, d, a) for _, h, v, d, a in parts]
        if len(parts) == 1 and dc == ac == _WRITER_TABLE and interval == 1:
            pairs = scan[~gone]
            if len(pairs) != n * 128 or pairs[0::2].any():
                raise ValueError("damaged scan")
            extra = pairs[1::2].reshape(n, 64).astype(np.int64)
            out.append((np.where(extra < 128, extra - 255, extra), quant, height, width))
        else:
            cuts = [0, *restarts[restarts < end].tolist(), end]
            left, rows = n, []
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                now = min(left, interval or n)
                rows.append(_huffman_blocks(scan[a:b][~gone[a:b]].tobytes(), units, now)[0])
                left -= now
            if left:
                raise ValueError("the scan ends early")
            out.append((np.concatenate(rows), quant, height, width))
    return out


def stored_bytes(coefficients: np.ndarray) -> np.ndarray:
    """The bytes that ``encode_frames`` put into coefficients."""
    return np.where(coefficients < 0, coefficients + 255, coefficients).astype(np.uint8)


def histograms(decoded: list[tuple[np.ndarray, np.ndarray, int, int]], bins: int = 16) -> np.ndarray:
    """Histogram of the pixels of each frame."""
    size = [len(c) for c, *_ in decoded]
    values = np.zeros((sum(size), 64))
    values[:, ZIGZAG] = np.concatenate([c * q for c, q, *_ in decoded])
    cells = values.reshape(-1, 8, 8)
    pixels = np.matmul(np.matmul(_BASIS.T, cells), _BASIS)
    level = np.clip(np.floor((pixels + _SCALE * _SCALE / 2) / (_SCALE * _SCALE)) + 128, 0, 255).astype(np.int64) * bins // 256
    frame = np.repeat(np.arange(len(decoded)), np.array(size) * 64)
    return np.bincount(frame * bins + level.ravel(), minlength=len(decoded) * bins).reshape(-1, bins)


def shots(hist: np.ndarray, window: int = 8, k: float = 2.0, floor: float = 0.08) -> list[tuple[int, int]]:
    """First and last + 1 frame of each shot.

    A frame starts a shot if its histogram differs from the one before (share of pixels moved) by over ``floor`` and by over the mean
    plus k deviations of the differences around it, itself left out; with none around, the floor decides.
    """
    moved = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * np.maximum(hist[1:].sum(1), 1))
    cuts = [0]
    for i, d in enumerate(moved):
        near = np.concatenate([moved[max(0, i - window) : i], moved[i + 1 : i + 1 + window]])
        if d > floor and (not len(near) or d > near.mean() + k * near.std()):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], len(hist)], strict=True))
