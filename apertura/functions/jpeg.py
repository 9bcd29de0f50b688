"""A baseline JPEG encoder over Arrow batches: eight-by-eight cosine transform, quantization, optimal Huffman codes.

Written from the published standard (ITU-T T.81) in numpy. The Huffman tables are made for each image from
its own symbol counts, so none are stated here. A picture is worked on in bands of rows, which restart
markers part: besides its pixels, its quantized coefficients and its file, only one band is held. Chrominance
may be halved in both directions.
"""

from __future__ import annotations

import heapq
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

# The standard's example quantization tables (luminance, chrominance), row by row.
LUMINANCE = [
    16, 11, 10, 16, 24, 40, 51, 61,
    12, 12, 14, 19, 26, 58, 60, 55,
    14, 13, 16, 24, 40, 57, 69, 56,
    14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77,
    24, 35, 55, 64, 81, 104, 113, 92,
    49, 64, 78, 87, 103, 121, 120, 101,
    72, 92, 95, 98, 112, 100, 103, 99,
]
CHROMINANCE = [
    17, 18, 24, 47, 99, 99, 99, 99,
    18, 21, 26, 66, 99, 99, 99, 99,
    24, 26, 56, 99, 99, 99, 99, 99,
    47, 66, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
    99, 99, 99, 99, 99, 99, 99, 99,
]
#: The order of coefficients: along the antidiagonals, in turns up and down.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, (k // 8 if (k // 8 + k % 8) % 2 else k % 8))))
_K, _N = np.arange(8)[:, None], np.arange(8)[None]
#: Blocks of a band at least, if the picture has as many.
BAND = 4096
COSINES = np.where(_K == 0, 8**-0.5, 0.5 * np.cos((2 * _N + 1) * _K * np.pi / 16))


def quantization(table: list[int], quality: float) -> np.ndarray:
    """The table at a quality from 0 to 1, by the customary scale."""
    q = min(100, max(1, round(quality * 100)))
    scale = 5000 / q if q < 50 else 200 - 2 * q
    return np.clip(np.floor((np.array(table) * scale + 50) / 100), 1, 255).astype(np.int64)


def code_lengths(counts: np.ndarray) -> dict[int, int]:
    """Lengths of Huffman codes, 16 at most, for the symbols that occur; one code more stays free, as the standard asks."""
    heap = [(int(n), s, (s,)) for s, n in enumerate(counts) if n] + [(0, 256, (256,))]
    length = dict.fromkeys((s for _, s, _ in heap), 0)
    heapq.heapify(heap)
    while len(heap) > 1:
        (n, _, a), (m, tie, b) = heapq.heappop(heap), heapq.heappop(heap)
        for s in a + b:
            length[s] += 1
        heapq.heappush(heap, (n + m, tie, a + b))
    # Too long codes: two of them make room below a shorter one.
    per = np.bincount(list(length.values()), minlength=64)
    for k in range(len(per) - 1, 16, -1):
        while per[k] > 0:
            j = k - 2
            while per[j] == 0:
                j -= 1
            per[k] -= 2
            per[k - 1] += 1
            per[j + 1] += 2
            per[j] -= 1
    order = sorted(length, key=lambda s: (length[s], s == 256, -int(counts[s]) if s < 256 else 0))
    order.remove(256)
    order.append(256)
    lengths = np.repeat(np.arange(len(per)), per)
    return {s: int(k) for s, k in zip(order, lengths, strict=True) if s != 256}


def codes(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """Code and length by symbol, and the table's bytes: how many codes of each length, then the symbols."""
    code, size = np.zeros(256, np.int64), np.zeros(256, np.int64)
    value, last = 0, 0
    symbols = sorted(lengths, key=lambda s: (lengths[s], s))
    for s in symbols:
        value <<= lengths[s] - last
        last = lengths[s]
        code[s], size[s] = value, last
        value += 1
    per = np.bincount(list(lengths.values()), minlength=17)[1:17]
    return code, size, bytes(per.tolist()) + bytes(symbols)


def planes(pixels: np.ndarray) -> list[np.ndarray]:
    """Luminance and, of coloured pixels (blue, green, red and maybe more), the two chrominances, about 0."""
    if pixels.shape[2] < 3:
        return [pixels[..., 0].astype(np.float64) - 128]
    b, g, r = (pixels[..., k].astype(np.float64) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    return [y - 128, (b - y) / 1.772, (r - y) / 1.402]


def coefficients(plane: np.ndarray, table: np.ndarray, side: int = 1) -> np.ndarray:
    """Quantized coefficients in zigzag order, a row for each block, squares of ``side`` x ``side`` blocks after each other."""
    height, width = plane.shape
    blocks = plane.reshape(height // 8, 8, width // 8, 8).transpose(0, 2, 1, 3)
    turned = COSINES @ blocks @ COSINES.T
    quantized = np.rint(turned.reshape(height // 8, width // 8, 64) / table).astype(np.int16)[..., ZIGZAG]
    return quantized.reshape(height // 8 // side, side, width // 8 // side, side, 64).transpose(0, 2, 1, 3, 4).reshape(-1, 64)


def bands(pixels: np.ndarray, tables: list[np.ndarray], side: int) -> tuple[list[list[np.ndarray]], int]:
    """Coefficients of each band's components, in the order of the stream, and the units (squares of ``side`` blocks) of a full band."""
    height, width = pixels.shape[:2]
    across = -(-width // (8 * side))
    rows = min(max(1, -(-BAND // (across * side * side))), 65535 // across)
    out = []
    for top in range(0, height, rows * 8 * side):
        part = pixels[top : top + rows * 8 * side]
        part = np.pad(part, ((0, -part.shape[0] % (8 * side)), (0, -width % (8 * side)), (0, 0)), mode="edge")
        luminance, *others = planes(part)
        others = [x.reshape(x.shape[0] // side, side, x.shape[1] // side, side).mean(axis=(1, 3)) for x in others]
        out.append([coefficients(luminance, tables[0], side), *[coefficients(x, tables[1]) for x in others]])
    return out, rows * across


def bit_size(x: np.ndarray) -> np.ndarray:
    """Bits of a number's magnitude."""
    return np.ceil(np.log2(np.abs(x) + 1)).astype(np.int64)


def symbols(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place in the stream, whether it begins a block, symbol, and the further bits with their number, of one component's blocks of a band."""
    rows = rows.astype(np.int64)
    n = len(rows)
    steps = np.diff(rows[:, 0], prepend=0)
    block, at = np.nonzero(rows[:, 1:])
    value = rows[:, 1:][block, at]
    first = np.append(True, block[1:] != block[:-1]) if len(block) else np.zeros(0, bool)
    run = at - np.where(first, -1, np.append(-1, at[:-1])) - 1 if len(block) else at
    far = run // 16
    last = np.full(n, -1)
    last[block] = at
    ended = np.flatnonzero(last < 62)
    zeros = np.repeat(np.arange(len(block)), far)
    place = [np.arange(n) * 128, block[zeros] * 128 + 1 + at[zeros], block * 128 + 1 + at, ended * 128 + 127]
    number = [steps, np.zeros(len(zeros), np.int64), value, np.zeros(len(ended), np.int64)]
    size = [bit_size(x) for x in number]
    symbol = [size[0], np.full(len(zeros), 0xF0), (run % 16) * 16 + size[2], np.zeros(len(ended), np.int64)]
    place, number, size, symbol = (np.concatenate(x) for x in (place, number, size, symbol))
    order = np.argsort(place, kind="stable")
    place, number, size, symbol = place[order], number[order], size[order], symbol[order]
    return place, place % 128 == 0, symbol, np.where(number < 0, number + (1 << size) - 1, number), size


def packed(parts: list[tuple[np.ndarray, ...]], side: int, made: dict) -> bytes:
    """The bits of a band, its components' blocks in turn, filled with ones to whole bytes."""
    per = [side * side, *[1] * (len(parts) - 1)]
    place, value, bits = [], [], []
    for c, (at, begins, symbol, more, size) in enumerate(parts):
        code, length = (np.stack([made[min(c, 1), b][k] for b in (False, True)]) for k in range(2))
        which, block = begins.astype(np.int64), at // 128
        place.append((block // per[c] * sum(per) + sum(per[:c]) + block % per[c]) * 128 + at % 128)
        value.append((code[which, symbol] << size) | more)
        bits.append(length[which, symbol] + size)
    place, value, bits = (np.concatenate(x) for x in (place, value, bits))
    order = np.argsort(place, kind="stable")
    value, bits = value[order], bits[order]
    ends = np.cumsum(bits)
    shift = np.repeat(ends, bits) - 1 - np.arange(ends[-1])
    stream = ((np.repeat(value, bits) >> shift) & 1).astype(np.uint8)
    stream = np.append(stream, np.ones(-len(stream) % 8, np.uint8))
    return np.packbits(stream).tobytes().replace(b"\xff", b"\xff\0")


def encoded(pixels: np.ndarray, quality: float, halved: bool = False) -> bytes:
    """The pixels (height, width, channels: grey, or blue, green, red) as a JPEG file, chrominance ``halved`` or as it is."""
    height, width = pixels.shape[:2]
    if not 0 < height < 65536 or not 0 < width < 65536:
        raise ValueError("picture size out of range")
    tables = [quantization(t, quality) for t in (LUMINANCE, CHROMINANCE)]
    n = 1 if pixels.shape[2] < 3 else 3
    side, kinds = 2 if halved and n == 3 else 1, min(n, 2)
    parts, units = bands(pixels, tables, side)
    counts = np.zeros((kinds, 2, 256), np.int64)
    for part in parts:
        found = [symbols(rows) for rows in part]
        for c, (_, begins, symbol, _, _) in enumerate(found):
            for k in (0, 1):
                counts[min(c, 1), k] += np.bincount(symbol[begins == bool(k)], minlength=256)
    made = {(kind, begins): codes(code_lengths(counts[kind, int(begins)])) for kind in range(kinds) for begins in (True, False)}
    segment = lambda marker, body: bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body
    out = [b"\xff\xd8", segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist())) for k in range(kinds)]
    out.append(segment(0xC0, struct.pack(">BHHB", 8, height, width, n) + b"".join(bytes([c + 1, 0x11 * (side if c == 0 else 1), min(c, 1)]) for c in range(n))))
    out += [segment(0xC4, bytes([(0 if begins else 0x10) + kind]) + table) for (kind, begins), (_, _, table) in made.items()]
    if len(parts) > 1:
        out.append(segment(0xDD, struct.pack(">H", units)))
    out.append(segment(0xDA, bytes([n]) + b"".join(bytes([c + 1, min(c, 1) * 0x11]) for c in range(n)) + b"\0\x3f\0"))
    for k, part in enumerate(parts):
        out += [bytes([0xFF, 0xD0 + (k - 1) % 8])] if k else []
        # The symbols of a picture of one band are still there.
        out.append(packed(found if len(parts) == 1 else [symbols(rows) for rows in part], side, made))
    return b"".join(out) + b"\xff\xd9"


def _encode(data: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array, quality: pa.Array, halved: bool) -> pa.Array:
    out = []
    for k in range(len(data)):
        raw, (w, h, c, q) = data[k], (x[k].as_py() for x in (width, height, channels, quality))
        raw = raw.as_buffer() if raw.is_valid else b""
        fits = len(raw) and w and h and c in (1, 3, 4) and len(raw) == w * h * c and w < 65536 and h < 65536
        out.append(encoded(np.frombuffer(raw, np.uint8).reshape(h, w, c), q, halved) if fits else None)
    return pa.array(out, pa.binary())


@arrow_udf(T.BinaryType())
def encode_jpeg(data: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array, quality: pa.Array) -> pa.Array:
    """Rows of pixel bytes as JPEG files; null where the bytes don't fit the size."""
    return _encode(data, width, height, channels, quality, False)


@arrow_udf(T.BinaryType())
def encode_jpeg_halved(data: pa.Array, width: pa.Array, height: pa.Array, channels: pa.Array, quality: pa.Array) -> pa.Array:
    """As encode_jpeg(), with chrominance halved in both directions."""
    return _encode(data, width, height, channels, quality, True)
