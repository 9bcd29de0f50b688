"""A JPEG decoder over Arrow batches, for bytes that are in a column already: baseline and progressive, Huffman codes.

Written from the published standard (ITU-T T.81). The bits are walked in Python with one table look-up a
symbol, the transform and colours are numpy. Arithmetic codes, lossless and hierarchical files, samples of
other than 8 bits and pictures of two or four components aren't read.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from apertura.functions.jpeg import COSINES, ZIGZAG

IMAGE = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("nChannels", T.IntegerType()), T.StructField("data", T.BinaryType())])
#: Rows of blocks that are transformed at a time.
ROWS = 16
#: Bytes of pixels that are handed on together: a batch of small files may decode to far more than it holds.
AT_ONCE = 1 << 24


class Broken(ValueError):
    """The bytes are no picture that can be read."""


@dataclass
class Part:
    """A component: sampling, quantization table, blocks of its own and with those that fill the last units, coefficients."""

    across: int
    down: int
    table: int
    own: tuple[int, int] = (0, 0)
    full: tuple[int, int] = (0, 0)
    values: array = field(default_factory=lambda: array("h"))


def lookup(lengths: bytes, symbols: bytes) -> array:
    """Length and symbol (length * 256 + symbol) of the code that any 16 bits begin with; 0 for none."""
    sizes = np.repeat(np.arange(1, len(lengths) + 1), list(lengths))
    if len(sizes) > len(symbols):
        raise Broken("codes don't fit")
    spans = 1 << (16 - sizes)
    if spans.sum() > 1 << 16:
        raise Broken("codes don't fit")
    found = np.zeros(1 << 16, np.uint16)
    found[: spans.sum()] = np.repeat(sizes * 256 + np.frombuffer(symbols, np.uint8, len(sizes)), spans)
    return array("H", found.tobytes())


class Bits:
    """The bits of the bytes between two markers."""

    def __init__(self, data: bytes) -> None:
        raw = np.frombuffer(data + b"\0" * 8, np.uint8).astype(np.int64)
        self.windows = ((raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]).tolist()
        self.at, self.end, self.run = 0, 8 * len(data), 0

    def peek(self) -> int:
        at = self.at
        if at > self.end:
            raise Broken("bytes end too early")
        return (self.windows[at >> 3] >> (16 - (at & 7))) & 0xFFFF

    def take(self, n: int) -> int:
        if not n:
            return 0
        value = self.peek() >> (16 - n)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1

    def symbol(self, table: array) -> int:
        found = table[self.peek()]
        if not found:
            raise Broken("no such code")
        self.at += found >> 8
        return found & 255


def baseline(data: bytes, parts: list[Part], tables: list[tuple], blocks: list[tuple[int, int]]) -> None:
    """All coefficients of blocks (which component, where its values begin) between two markers, in the stream's order."""
    bits = Bits(data)
    windows, end, at, last = bits.windows, bits.end, 0, [0] * len(parts)
    held = [(part.values, *codes) for part, codes in zip(parts, tables, strict=True)]
    for c, o in blocks:
        # Bits.symbol() and Bits.signed(), written out: this is where the time goes.
        v, dc, ac = held[c]
        if at > end:
            raise Broken("bytes end too early")
        found = dc[(windows[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
        if not found:
            raise Broken("no such code")
        at += found >> 8
        n = found & 15
        if n:
            if at > end:
                raise Broken("bytes end too early")
            value = ((windows[at >> 3] >> (16 - (at & 7))) & 0xFFFF) >> (16 - n)
            at += n
            last[c] += value if value >> (n - 1) else value - (1 << n) + 1
        v[o], k = last[c], 1
        while k < 64:
            if at > end:
                raise Broken("bytes end too early")
            found = ac[(windows[at >> 3] >> (16 - (at & 7))) & 0xFFFF]
            if not found:
                raise Broken("no such code")
            at += found >> 8
            n, k = found & 15, k + ((found >> 4) & 15)
            if not n:
                if found & 255 != 0xF0:
                    break
                k += 1
                continue
            if k > 63 or at > end:
                raise Broken("block too long")
            value = ((windows[at >> 3] >> (16 - (at & 7))) & 0xFFFF) >> (16 - n)
            at += n
            v[o + k] = value if value >> (n - 1) else value - (1 << n) + 1
            k += 1
    if at > end:
        raise Broken("bytes end too early")


def places(parts: list[Part], first: int, last: int, width: int) -> list[tuple[int, int]]:
    """Of the units ``first`` to below ``last``, ``width`` in a row: which component each block is of and where its values begin."""
    row, column = np.divmod(np.arange(first, last), width)
    which, begins = [], []
    for c, part in enumerate(parts):
        down, across = (1, 1) if len(parts) == 1 else (part.down, part.across)
        for y in range(down):
            for x in range(across):
                which.append(c)
                begins.append(((row * down + y) * part.full[1] + column * across + x) * 64)
    return list(zip(which * len(row), np.stack(begins, axis=1).ravel().tolist(), strict=True))


def first_pass(bits: Bits, v: array, o: int, ac: list[int], start: int, end: int, low: int) -> None:
    """Progressive: the upper bits of coefficients ``start`` to ``end``."""
    if bits.run:
        bits.run -= 1
        return
    k = start
    while k <= end:
        s = bits.symbol(ac)
        run, n = s >> 4, s & 15
        if n:
            k += run
            if k > end:
                raise Broken("block too long")
            v[o + k] = bits.signed(n) * (1 << low)
        elif run < 15:
            bits.run = (1 << run) - 1 + bits.take(run)
            return
        else:
            k += 15
        k += 1


def later_pass(bits: Bits, v: array, o: int, ac: list[int], start: int, end: int, low: int) -> None:
    """Progressive: one bit more of coefficients ``start`` to ``end``."""
    bit, k = 1 << low, start

    def corrected(place: int) -> None:
        if bits.take(1) and not abs(v[place]) & bit:
            v[place] += bit if v[place] > 0 else -bit

    if not bits.run:
        while k <= end:
            s = bits.symbol(ac)
            zeros, new = s >> 4, 0
            if s & 15:
                new = bit if bits.take(1) else -bit
            elif zeros < 15:
                bits.run = (1 << zeros) + bits.take(zeros)
                break
            while k <= end:
                if v[o + k]:
                    corrected(o + k)
                elif zeros:
                    zeros -= 1
                else:
                    v[o + k] = new
                    k += 1
                    break
                k += 1
    if bits.run:
        for place in range(o + k, o + end + 1):
            if v[place]:
                corrected(place)
        bits.run -= 1


def scan(data: bytes, parts: list[Part], tables: list[tuple], frame: dict, restart: int) -> None:
    """Reads one scan's bits into the components' coefficients."""
    start, end, high, low = frame["range"]
    if len(parts) == 1:
        units, width = parts[0].own[0] * parts[0].own[1], parts[0].own[1]
    else:
        units, width = frame["units"][0] * frame["units"][1], frame["units"][1]
    pieces = re.split(rb"\xff[\xd0-\xd7]", data)
    step = restart or units
    for k, piece in enumerate(pieces):
        if not frame["progressive"]:
            baseline(piece.replace(b"\xff\0", b"\xff"), parts, tables, places(parts, k * step, max(k * step, min(units, (k + 1) * step)), width))
            continue
        bits, last = Bits(piece.replace(b"\xff\0", b"\xff")), [0] * len(parts)
        for unit in range(k * step, min(units, (k + 1) * step)):
            row, column = divmod(unit, width)
            for c, part in enumerate(parts):
                down, across = (1, 1) if len(parts) == 1 else (part.down, part.across)
                dc, ac = tables[c]
                for y in range(row * down, row * down + down):
                    for x in range(column * across, column * across + across):
                        o = (y * part.full[1] + x) * 64
                        if start:
                            (later_pass if high else first_pass)(bits, part.values, o, ac, start, end, low)
                        elif high:
                            part.values[o] |= bits.take(1) << low
                        else:
                            last[c] += bits.signed(bits.symbol(dc) & 15)
                            part.values[o] = last[c] * (1 << low)
        if bits.at > bits.end:
            raise Broken("bytes end too early")
    if len(pieces) * step < units:
        raise Broken("units are missing")


def plane(part: Part, table: np.ndarray) -> np.ndarray:
    """A component's samples."""
    rows, columns = part.full
    values = np.frombuffer(part.values, np.int16).reshape(rows, columns, 64)
    out = np.empty((rows * 8, columns * 8), np.uint8)
    for top in range(0, rows, ROWS):
        blocks = np.zeros((*values[top : top + ROWS].shape[:2], 64))
        blocks[..., ZIGZAG] = values[top : top + ROWS] * table.astype(np.float64)
        samples = COSINES.T @ blocks.reshape(*blocks.shape[:2], 8, 8) @ COSINES + 128
        out[top * 8 : (top + ROWS) * 8] = np.clip(np.rint(samples), 0, 255).astype(np.uint8).transpose(0, 2, 1, 3).reshape(-1, columns * 8)
    return out


def pixels(planes: list[np.ndarray], colour: bool) -> np.ndarray:
    """Blue, green and red of full planes, which are luminance and chrominances if ``colour``."""
    if not colour:
        return np.stack(planes[::-1], axis=-1)
    out = np.empty((*planes[0].shape, 3), np.uint8)
    for top in range(0, len(out), 8 * ROWS):
        y, b, r = (p[top : top + 8 * ROWS].astype(np.float64) for p in planes)
        b, r = b - 128, r - 128
        for k, x in enumerate((y + 1.772 * b, y - 0.344136 * b - 0.714136 * r, y + 1.402 * r)):
            out[top : top + 8 * ROWS, :, k] = np.clip(np.rint(x), 0, 255)
    return out


def _frame(body: bytes, progressive: bool, size: int) -> tuple[dict, dict[int, Part]]:
    """What the frame says, of a file of ``size`` bytes: each block takes a bit at least, so a broken size isn't given room."""
    depth, height, width, n = struct.unpack_from(">BHHB", body)
    if depth != 8 or not height or not width or n not in (1, 3):
        raise Broken("a kind of picture that isn't read")
    found = {}
    for k in range(n):
        name, sampling, table = body[6 + 3 * k : 9 + 3 * k]
        found[name] = Part(sampling >> 4, sampling & 15, table)
    if len(found) != n or not all(1 <= x <= 4 for p in found.values() for x in (p.across, p.down)):
        raise Broken("components that don't fit")
    most_across, most_down = (max(getattr(p, x) for p in found.values()) for x in ("across", "down"))
    units = -(-height // (8 * most_down)), -(-width // (8 * most_across))
    for p in found.values():
        if most_across % p.across or most_down % p.down:
            raise Broken("sampling in no whole steps")
        p.own = tuple(-(-(-(-side * f // most)) // 8) for side, f, most in ((height, p.down, most_down), (width, p.across, most_across)))
        p.full = units[0] * p.down, units[1] * p.across
    if sum(p.own[0] * p.own[1] for p in found.values()) > 8 * size:
        raise Broken("fewer bytes than blocks")
    for p in found.values():
        p.values = array("h", bytes(2 * 64 * p.full[0] * p.full[1]))
    return {"progressive": progressive, "size": (height, width), "units": units, "most": (most_down, most_across)}, found


def decoded(data: bytes) -> np.ndarray:
    """The pixels (height, width, channels: grey, or blue, green, red) of a JPEG file; Broken if it can't be read whole."""
    if data[:2] != b"\xff\xd8":
        raise Broken("not a JPEG")
    at, quantizers, codes, restart, frame, parts, adobe, seen = 2, {}, {}, 0, {}, {}, None, False
    while True:
        found = re.compile(rb"\xff+([^\xff\0])").match(data, at)
        if not found:
            raise Broken("no marker")
        marker, at = found[1][0], found.end()
        if marker == 0xD9:
            break
        if marker == 0x01 or 0xD0 <= marker <= 0xD8:
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if len(body) < size - 2:
            raise Broken("segment cut off")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
                quantizers[body[k] & 15] = values.astype(np.int64)
                k += 1 + 64 * (2 if wide else 1)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                lengths = body[k + 1 : k + 17]
                codes[body[k]] = lookup(lengths, body[k + 17 : k + 17 + sum(lengths)])
                k += 17 + sum(lengths)
        elif marker in (0xC0, 0xC1, 0xC2):
            if frame:
                raise Broken("two pictures")
            frame, parts = _frame(body, marker == 0xC2, len(data))
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise Broken("a kind of picture that isn't read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            n = body[0]
            names, own = [body[1 + 2 * k] for k in range(n)], [body[2 + 2 * k] for k in range(n)]
            start, end, bits = body[1 + 2 * n : 4 + 2 * n]
            if not frame or end > 63 or start > end or not all(x in parts for x in names):
                raise Broken("scan that doesn't fit")
            stop = re.compile(rb"\xff+[^\xff\0\xd0-\xd7]").search(data, at)
            if not stop:
                raise Broken("scan cut off")
            frame["range"] = (start, end, bits >> 4, bits & 15)
            scan(data[at : stop.start()], [parts[x] for x in names], [(codes.get(x >> 4), codes.get(16 + (x & 15))) for x in own], frame, restart)
            at, seen = stop.start(), True
    if not seen:
        raise Broken("no scan")
    height, width = frame["size"]
    planes = []
    for p in parts.values():
        one = plane(p, quantizers[p.table])
        one = one.repeat(frame["most"][0] // p.down, axis=0).repeat(frame["most"][1] // p.across, axis=1)
        planes.append(one[:height, :width])
    return pixels(planes, adobe != 0 and list(parts) != list(b"RGB")) if len(planes) == 3 else planes[0][..., None]


def _images(found: list[np.ndarray | None]) -> pa.Array:
    column = lambda of, kind: pa.array([None if x is None else of(x) for x in found], kind)
    sizes = [column(lambda x, k=k: x.shape[k], pa.int32()) for k in (1, 0, 2)]
    return pa.StructArray.from_arrays([*sizes, column(np.ndarray.tobytes, pa.binary())], ["width", "height", "nChannels", "data"], mask=pa.array([x is None for x in found]))


@arrow_udf(IMAGE)
def decode_jpeg(content: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """JPEG bytes as ``width, height, nChannels, data`` (blue, green, red or grey), as Spark's image source gives; null for what can't be read whole."""
    for batch in content:
        out, held = [], 0
        for x in batch:
            try:
                out.append(decoded(x.as_py() or b""))
                held += out[-1].nbytes
            except (Broken, struct.error, IndexError, KeyError, TypeError, ValueError, OverflowError):
                out.append(None)
            if held >= AT_ONCE:
                yield _images(out)
                out, held = [], 0
        if out:
            yield _images(out)


@arrow_udf(T.IntegerType())
def largest_difference(one: pa.Array, other: pa.Array) -> pa.Array:
    """The largest difference of two byte strings, byte by byte; null if they aren't of one length or are empty."""
    out = []
    for a, b in zip(one, other, strict=True):
        x, y = (np.frombuffer(v.as_py() or b"", np.uint8).astype(np.int16) for v in (a, b))
        out.append(int(np.abs(x - y).max()) if len(x) == len(y) > 0 else None)
    return pa.array(out, pa.int32())
