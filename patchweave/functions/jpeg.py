"""Baseline JPEG files from pixels, block by block in NumPy.

Y, Cb and Cr of the JFIF conversion, colour at half the resolution unless ``full``; cosine transform, division by scaled
tables and zigzag order for all blocks at once.  Huffman codes are made for the image itself, so that no table of codes
is stored here.  Working memory follows the pixels of one image.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: The example quantisation tables of the standard, of brightness and of colour, row by row.
LUMINANCE = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""
#: Y, Cb and Cr of red, green and blue.
YCC = np.array([[0.299, 0.587, 0.114], [-0.168735892, -0.331264108, 0.5], [0.5, -0.418687589, -0.081312411]])
#: Places of a block along its diagonals, every other one upwards.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)))
COSINES = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos(np.outer(np.arange(8), 2 * np.arange(8) + 1) * np.pi / 16)
#: Symbols that are packed at a time, and the longest code.
SLICE, LONGEST = 1 << 16, 16


def steps(table: str, quality: int) -> np.ndarray:
    """The 64 divisors for a quality from 1 to 100."""
    quality = max(1, min(100, int(quality)))
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((np.array(table.split(), np.int64) * scale + 50) // 100, 1, 255)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of a best prefix code of at most 16 bits over the symbols that occur; none is all ones.

    Packages are merged level by level.  A symbol that never occurs takes the code of ones, and is left out.
    """
    leaves = sorted((int(n), (s,)) for s, n in enumerate(counts) if n) + [(0, (-1,))]
    leaves.sort()
    if len(leaves) == 2:
        return {max(leaves)[1][0]: 1}
    level = leaves
    for _ in range(LONGEST - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])]
        level = list(heapq.merge(leaves, pairs))
    lengths: dict[int, int] = {}
    for _, symbols in level[: 2 * (len(leaves) - 1)]:
        for s in symbols:
            lengths[s] = lengths.get(s, 0) + 1
    # the spare symbol is among the rarest: it ends up with the longest code, whose last place is the code of ones
    lengths.pop(-1)
    return lengths


def code_table(counts: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(segment: 16 counts and the symbols by length, codes, lengths) of a canonical code."""
    lengths = code_lengths(counts)
    ordered = sorted(lengths, key=lambda s: (lengths[s], s))
    per = [sum(n == k for n in lengths.values()) for k in range(1, LONGEST + 1)]
    codes, sizes, code, last = np.zeros(256, np.int64), np.zeros(256, np.int64), 0, 0
    for s in ordered:
        code <<= lengths[s] - last
        codes[s], sizes[s], last = code, lengths[s], lengths[s]
        code += 1
    return bytes(per) + bytes(ordered), codes, sizes


def planes(rgb: np.ndarray, full: bool) -> list[np.ndarray]:
    """Y, Cb, Cr about 0, their last rows and columns repeated up to whole units."""
    unit = 8 if full else 16
    h, w = rgb.shape[:2]
    ycc = np.pad(rgb.astype(np.float64), ((0, -h % unit), (0, -w % unit), (0, 0)), mode="edge") @ YCC.T
    y, colours = ycc[..., 0] - 128, [ycc[..., 1], ycc[..., 2]]
    if not full:
        colours = [c.reshape(c.shape[0] // 2, 2, c.shape[1] // 2, 2).mean((1, 3)) for c in colours]
    return [y, *colours]


def blocks(plane: np.ndarray, divisors: np.ndarray, square: int) -> np.ndarray:
    """Quantised coefficients in zigzag order: (units, square**2, 64), a unit's blocks row by row."""
    h, w = plane.shape
    cut = plane.reshape(h // (8 * square), square, 8, w // (8 * square), square, 8).transpose(0, 3, 1, 4, 2, 5).reshape(-1, square**2, 8, 8)
    found = np.rint((COSINES @ cut @ COSINES.T).reshape(-1, square**2, 64) / divisors).astype(np.int64)
    return found[..., ZIGZAG]


def symbols(block: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, ...]:
    """(table, symbol, value, bits of the value) in the order of the stream; blocks (n, 64) of components ``part``.

    Tables 0 and 1 are for the first coefficient of brightness and colour, 2 and 3 for the others.
    """
    size_of = lambda v: np.frexp(np.abs(v).astype(np.float64))[1]
    n = len(block)
    first = block[:, 0].copy()
    for c in range(3):
        at = np.flatnonzero(part == c)
        first[at] = np.diff(block[at, 0], prepend=0)
    row, place = np.nonzero(block[:, 1:])
    place += 1
    new = np.diff(row, prepend=-1) != 0
    run = place - np.where(new, 0, np.roll(place, 1)) - 1
    value, skips = block[row, place], run // 16
    last = np.zeros(n, np.int64)
    last[row] = place  # the last assignment stands: places ascend
    short = np.flatnonzero(last < 63)
    size = size_of(value)
    skip_at = np.repeat(np.arange(len(row)), skips)
    none = lambda k: np.zeros(k, np.int64)
    groups = [
        (np.arange(n) * 256, none(n), size_of(first), first, size_of(first)),
        (row[skip_at] * 256 + place[skip_at] * 2, np.ones(len(skip_at), np.int64), np.full(len(skip_at), 0xF0), none(len(skip_at)), none(len(skip_at))),
        (row * 256 + place * 2 + 1, np.ones(len(row), np.int64), run % 16 * 16 + size, value, size),
        (short * 256 + 200, np.ones(len(short), np.int64), none(len(short)), none(len(short)), none(len(short))),
    ]
    key, kind, symbol, value, size = (np.concatenate(c).astype(np.int64) for c in zip(*groups))
    order = np.argsort(key, kind="stable")
    table = 2 * kind + (part[key // 256] > 0)
    value = np.where(value < 0, value + (1 << size) - 1, value)
    return table[order], symbol[order], value[order], size[order]


def packed(codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """Codes one behind the other, ones up to a whole byte, a zero behind every byte of ones."""
    bits = []
    for lo in range(0, len(codes), SLICE):
        c, n = codes[lo : lo + SLICE], lengths[lo : lo + SLICE]
        at = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
        bits.append((np.repeat(c, n) >> at & 1).astype(np.uint8))
    stream = np.concatenate(bits) if bits else np.zeros(0, np.uint8)
    data = np.packbits(np.concatenate([stream, np.ones(-len(stream) % 8, np.uint8)]))
    return np.insert(data, np.flatnonzero(data == 255) + 1, 0).tobytes()


def jpeg(rgb: np.ndarray, quality: int = 95, full: bool = False) -> bytes:
    """A JPEG file of height x width x 3 bytes; ``full`` keeps the resolution of colours."""
    h, w = rgb.shape[:2]
    if not 0 < h < 65536 or not 0 < w < 65536:
        raise ValueError(f"no JPEG of {h} x {w} pixels")
    square = 1 if full else 2
    tables = [steps(LUMINANCE, quality), steps(CHROMINANCE, quality)]
    units = [blocks(p, tables[c > 0], square if c == 0 else 1) for c, p in enumerate(planes(rgb, full))]
    block = np.concatenate(units, 1)
    part = np.tile(np.repeat([0, 1, 2], [square**2, 1, 1]), len(block))
    table, symbol, value, size = symbols(block.reshape(-1, 64), part)
    segment = lambda mark, body: b"\xff" + bytes([mark]) + struct.pack(">H", len(body) + 2) + body
    out = b"\xff\xd8" + segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0")
    out += b"".join(segment(0xDB, bytes([k]) + t[ZIGZAG].astype(np.uint8).tobytes()) for k, t in enumerate(tables))
    shape = struct.pack(">BHHB", 8, h, w, 3) + b"".join(bytes([c + 1, (square << 4 | square) if c == 0 else 0x11, c > 0]) for c in range(3))
    out += segment(0xC0, shape)
    code, length = np.zeros(len(table), np.int64), np.zeros(len(table), np.int64)
    for k, head in enumerate((0x00, 0x01, 0x10, 0x11)):
        at = np.flatnonzero(table == k)
        body, codes, sizes = code_table(np.bincount(symbol[at], minlength=256))
        out += segment(0xC4, bytes([head]) + body)
        code[at], length[at] = codes[symbol[at]], sizes[symbol[at]]
    out += segment(0xDA, b"\x03\x01\x00\x02\x11\x03\x11\x00\x3f\x00")
    return out + packed(code << size | value, length + size) + b"\xff\xd9"
