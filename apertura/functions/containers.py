"""Metadata of PNG, WebP, HEIC, TIFF and JPEG bytes: walkers of their chunks and boxes, one reader column for all.

The layouts are those of the published formats: PNG's eXIf chunk, RIFF's EXIF chunk, the item tables of the
ISO base media format, and a bare TIFF block. Broken and truncated bytes give null and never fail the job.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from apertura.functions.exif_bytes import TAG_TYPE, block, block_records, jpeg_block, tiff_tags, with_tiff
from apertura.functions.exif_columns import blocks

KINDS = ("png", "webp", "heic", "tiff", "jpeg")
PNG_HEAD = b"\x89PNG\r\n\x1a\n"
#: Brands of the first box that HEIF files have.
BRANDS = {b"heic", b"heix", b"hevc", b"mif1", b"msf1", b"avif"}


def kind_of(data: bytes) -> str | None:
    """The container that the first bytes tell of."""
    if data.startswith(PNG_HEAD):
        return "png"
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    if data[4:8] == b"ftyp" and data[8:12] in BRANDS:
        return "heic"
    if data[:4] in (b"II*\0", b"MM\0*"):
        return "tiff"
    return "jpeg" if data[:2] == b"\xff\xd8" else None


def _taken(data: bytes, start: int, size: int) -> bytes:
    if size < 0 or start < 0 or start + size > len(data):
        raise ValueError("cut off")
    return data[start : start + size]


def png_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = len(PNG_HEAD)
    while at < len(data):
        size, kind = struct.unpack(">I4s", _taken(data, at, 8))
        yield kind, _taken(data, at + 8, size)
        at += 12 + size


def riff_chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 12
    while at < len(data):
        kind, size = struct.unpack("<4sI", _taken(data, at, 8))
        yield kind, _taken(data, at + 8, size)
        at += 8 + size + size % 2


def boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and end of the content of the boxes in ``data[at:end]``."""
    while at < end:
        size, kind = struct.unpack(">I4s", _taken(data, at, 8))
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", _taken(data, at + 8, 8)), 16
        size = size or end - at
        if size < head or at + size > end:
            raise ValueError("broken box")
        yield kind, at + head, at + size
        at += size


class _Numbers:
    """Big-endian numbers one after the other."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def __call__(self, size: int) -> int:
        raw = _taken(self.data, self.at, size)
        self.at += size
        return int.from_bytes(raw, "big")


def _exif_item(data: bytes, at: int, end: int) -> int | None:
    """The id of the item of type Exif in an item information box."""
    number = _Numbers(data, at)
    version = number(4) >> 24
    number(4 if version else 2)
    for kind, a, _ in boxes(data, number.at, end):
        entry = _Numbers(data, a)
        version = entry(4) >> 24
        if kind == b"infe" and version >= 2:
            item = entry(4 if version == 3 else 2)
            entry(2)
            if _taken(data, entry.at, 4) == b"Exif":
                return item
    return None


def _extents(data: bytes, at: int, wanted: int) -> tuple[int, list[tuple[int, int]]]:
    """How the wanted item is stored (0 in the file, 1 in the idat box), and its extents, from an item location box."""
    number = _Numbers(data, at)
    version = number(4) >> 24
    sizes = number(2)
    offset_size, length_size, base_size, index_size = (sizes >> shift & 15 for shift in (12, 8, 4, 0))
    for _ in range(number(4 if version == 2 else 2)):
        item = number(4 if version == 2 else 2)
        method = number(2) & 15 if version else 0
        number(2)
        base = number(base_size)
        found = []
        for _ in range(number(2)):
            if version:
                number(index_size)
            start = base + number(offset_size)
            found.append((start, number(length_size)))
        if item == wanted:
            return method, found
    raise ValueError("an item without a place")


def heic_block(data: bytes) -> bytes | None:
    for kind, a, b in boxes(data, 0, len(data)):
        if kind != b"meta":
            continue
        inner = {k: (x, y) for k, x, y in boxes(data, a + 4, b)}
        item = _exif_item(data, *inner[b"iinf"]) if b"iinf" in inner else None
        if item is None:
            return None
        if b"iloc" not in inner:
            raise ValueError("no item locations")
        method, extents = _extents(data, inner[b"iloc"][0], item)
        if method > 1 or (method == 1 and b"idat" not in inner):
            raise ValueError("items of other items aren't read")
        start = inner[b"idat"][0] if method else 0
        whole = b"".join(_taken(data, start + at, size or len(data) - start - at) for at, size in extents)
        (skipped,) = struct.unpack(">I", whole[:4])
        return whole[4 + skipped :]
    return None


def file_block(data: bytes) -> bytes | None:
    """The TIFF block in bytes of any known container."""
    kind = kind_of(data)
    tiff: bytes | None = None
    if kind == "jpeg":
        tiff = jpeg_block(data)
    elif kind == "png":
        tiff = next((body for name, body in png_chunks(data) if name == b"eXIf"), None)
    elif kind == "webp":
        tiff = next((body for name, body in riff_chunks(data) if name == b"EXIF"), None)
        tiff = tiff.removeprefix(b"Exif\0\0") if tiff else None
    elif kind == "heic":
        tiff = heic_block(data)
    elif kind == "tiff":
        tiff = data
    return tiff


def file_tags(data: bytes) -> dict:
    """The record of tags in bytes of any known container; empty without one."""
    tiff = file_block(data)
    return tiff_tags(tiff) if tiff or kind_of(data) == "jpeg" and tiff is not None else {}


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _heic(tiff: bytes) -> bytes:
    """The item tables of a file whose only item is the block, in two extents."""
    item = struct.pack(">I", 6) + b"Exif\0\0" + tiff
    cut = len(item) // 2
    infe = _box(b"infe", bytes([2, 0, 0, 0]) + struct.pack(">HH", 1, 0) + b"Exif\0")
    iinf = _box(b"iinf", bytes(4) + struct.pack(">H", 1) + infe)
    ftyp = _box(b"ftyp", b"heic" + bytes(4) + b"mif1heic")

    def meta(start: int) -> bytes:
        places = struct.pack(">HHHIIII", 1, 0, 2, start, cut, start + cut, len(item) - cut)
        return _box(b"meta", bytes(4) + iinf + _box(b"iloc", bytes(4) + b"\x44\x00" + struct.pack(">H", 1) + places))

    return ftyp + meta(len(ftyp) + len(meta(0)) + 8) + _box(b"mdat", item)


def built(kind: str, tags: dict) -> bytes:
    """The smallest file of a kind that carries the tags; it has no picture."""
    return wrapped(kind, block(tags))


def wrapped(kind: str, tiff: bytes) -> bytes:
    """The smallest file of a kind that carries the block."""
    if kind == "png":
        chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))
        return PNG_HEAD + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"eXIf", tiff) + chunk(b"IEND", b"")
    if kind == "webp":
        chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body + bytes(len(body) % 2)
        body = b"WEBP" + chunk(b"VP8X", b"\x08" + bytes(9)) + chunk(b"EXIF", tiff)
        return b"RIFF" + struct.pack("<I", len(body)) + body
    if kind == "heic":
        return _heic(tiff)
    if kind == "tiff":
        return tiff
    return with_tiff(b"\xff\xd8\xff\xd9", tiff)


@arrow_udf(TAG_TYPE)
def read_file_tags(content: pa.Array) -> pa.Array:
    """The tags of files of any known kind; null for bytes that are null, broken, of another kind or without tags."""
    return block_records(content, file_block)


@arrow_udf(T.StringType())
def file_kind(content: pa.Array) -> pa.Array:
    """png, webp, heic, tiff or jpeg by the first bytes; null for others."""
    return pa.array([kind_of(data) if data else None for data in content.to_pylist()], pa.string())


@arrow_udf(T.BinaryType())
def build_file(kind: pa.Array, tags: pa.Array) -> pa.Array:
    """Files of the given kinds that carry the tags; null where either is null."""
    out = []
    for n, (k, tiff) in enumerate(zip(kind.to_pylist(), blocks(tags).to_pylist(), strict=True)):
        given = tiff is None and k and tags[n].as_py()
        out.append(wrapped(k, tiff) if k and tiff is not None else built(k, given) if given else None)
    return pa.array(out, pa.binary())
