"""EXIF blocks in JPEG bytes: reading, writing and taking out, as Arrow UDFs over whole columns.

A row whose bytes can't be read gives nulls or an error text; it never fails the job. The blocks of a column
are written and read together (exif_columns); the functions for one record here do the rows that it leaves.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from apertura.functions.exif_columns import blocks, completed, fixed_bytes, records
from apertura.functions.exif_tags import ASCII, BYTE, EXIF_POINTER, GPS_POINTER, LONG, RATIONAL, RAW, SHORT, SRATIONAL, TAG_ARROW, TAG_TYPE, TAGS, TRIPLES, UNDEFINED, WIDTH, _struct

CONTENT_TYPE = _struct({"content": T.BinaryType(), "error": T.StringType()})
SIZE_TYPE = _struct({"width": T.IntegerType(), "height": T.IntegerType()})


def _encoded(name: str, kind: int, value: object) -> tuple[int, bytes]:
    """Count and little-endian bytes of a tag's value."""
    if kind == ASCII:
        data = str(value).encode("utf-8", "replace") + b"\0"
        return len(data), data
    if kind == UNDEFINED or name in RAW:
        return len(value), bytes(value)
    if kind in (RATIONAL, SRATIONAL):
        pairs = value if name in TRIPLES else [value]
        return len(pairs), b"".join(struct.pack("<II" if kind == RATIONAL else "<ii", p["num"], p["den"]) for p in pairs)
    return 1, struct.pack({BYTE: "<B", SHORT: "<H", LONG: "<I"}[kind], min(int(value), 65535) if kind == SHORT else int(value))


def _directory(entries: list[tuple[int, int, int, bytes]], at: int) -> bytes:
    """An image file directory that begins ``at`` bytes into the block, with its longer values behind it."""
    entries = sorted(entries)
    head, tail, place = struct.pack("<H", len(entries)), b"", at + 6 + 12 * len(entries)
    for tag, kind, count, data in entries:
        head += struct.pack("<HHI", tag, kind, count)
        if len(data) <= 4:
            head += data.ljust(4, b"\0")
        else:
            head += struct.pack("<I", place + len(tail))
            tail += data + b"\0" * (len(data) % 2)
    return head + b"\0\0\0\0" + tail


def block(tags: dict) -> bytes:
    """A record as a TIFF block: the main directory and those of Exif and GPS that it points to."""
    entries = {}
    for ifd, known in TAGS.items():
        given = tags.get(ifd) or {}
        entries[ifd] = [(known[n][0], known[n][1], *_encoded(n, known[n][1], v)) for n, v in given.items() if v is not None]
    zero = [(tag, LONG, 1, b"\0\0\0\0") for tag in (EXIF_POINTER, GPS_POINTER)]
    exif_at = 8 + len(_directory(entries["ifd0"] + zero, 8))
    exif = _directory(entries["exif"], exif_at)
    gps_at = exif_at + len(exif)
    pointers = [(EXIF_POINTER, LONG, 1, struct.pack("<I", exif_at)), (GPS_POINTER, LONG, 1, struct.pack("<I", gps_at))]
    return b"II*\0\x08\0\0\0" + _directory(entries["ifd0"] + pointers, 8) + exif + _directory(entries["gps"], gps_at)


def segments(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(marker, start, end) of a JPEG's segments before the picture data; the last one runs to the end."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at = 2
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("broken JPEG segment")
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xDA:
            yield marker, at, len(data)
            return
        end = at + 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
        if end > len(data) or end < at + 4:
            raise ValueError("broken JPEG segment")
        yield marker, at, end
        at = end
    yield 0xD9, at, len(data)


def stripped(data: bytes) -> bytes:
    """Without the segments that hold metadata: APP1 (Exif, XMP), APP13 and comments; the picture data stays as it is."""
    return b"\xff\xd8" + b"".join(data[a:b] for marker, a, b in segments(data) if marker not in (0xE1, 0xED, 0xFE))


def picture_size(data: bytes) -> tuple[int, int] | None:
    for marker, at, _ in segments(data):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
    return None


#: Bytes of a block at most, in a segment behind its mark.
LONGEST = 65527


def with_tiff(data: bytes, tiff: bytes) -> bytes:
    if len(tiff) > LONGEST:
        raise ValueError("EXIF block too long")
    return b"\xff\xd8\xff\xe1" + struct.pack(">H", len(tiff) + 8) + b"Exif\0\0" + tiff + stripped(data)[2:]


def with_block(data: bytes, tags: dict) -> bytes:
    return with_tiff(data, block(tags))


def _value(name: str, order: str, kind: int, count: int, raw: bytes) -> object:
    if kind == ASCII:
        return raw.decode("utf-8", "replace").rstrip("\0")
    if kind == UNDEFINED or name in RAW:
        return raw
    if kind in (RATIONAL, SRATIONAL):
        numbers = struct.unpack(f"{order}{2 * count}{'I' if kind == RATIONAL else 'i'}", raw)
        pairs = [{"num": n, "den": d} for n, d in zip(numbers[::2], numbers[1::2], strict=True)]
        if any(x >= 2**31 for x in numbers):
            return None
        return pairs if name in TRIPLES else pairs[0]
    number = struct.unpack(order + {BYTE: "B", SHORT: "H", LONG: "I", 9: "i"}[kind], raw[: WIDTH[kind]])[0]
    return number if number < 2**31 else None


def _read_directory(tiff: bytes, order: str, at: int, known: dict) -> tuple[dict, dict[int, int]]:
    names = {number: name for name, (number, _) in known.items()}
    found, pointers = {}, {}
    (count,) = struct.unpack(order + "H", tiff[at : at + 2])
    for k in range(count):
        entry = tiff[at + 2 + 12 * k : at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        size = WIDTH.get(kind, 0) * n
        start = struct.unpack(order + "I", entry[8:])[0] if size > 4 else at + 10 + 12 * k
        if tag in (EXIF_POINTER, GPS_POINTER) and size == 4:
            pointers[tag] = struct.unpack(order + "I", entry[8:])[0]
        elif tag in names and size and start + size <= len(tiff):
            expected = known[names[tag]][1]
            if (kind == ASCII) == (expected == ASCII) and (kind in (RATIONAL, SRATIONAL)) == (expected in (RATIONAL, SRATIONAL)):
                found[names[tag]] = _value(names[tag], order, kind, n, tiff[start : start + size])
    return found, pointers


def tiff_tags(tiff: bytes) -> dict:
    """The record of tags of a TIFF block, as all containers hold it. Raises ValueError or struct.error for broken bytes."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or struct.unpack(order + "H", tiff[2:4])[0] != 42:
        raise ValueError("broken TIFF header")
    ifd0, pointers = _read_directory(tiff, order, struct.unpack(order + "I", tiff[4:8])[0], TAGS["ifd0"])
    out = {"ifd0": ifd0}
    for name, tag in (("exif", EXIF_POINTER), ("gps", GPS_POINTER)):
        out[name] = _read_directory(tiff, order, pointers[tag], TAGS[name])[0] if tag in pointers else {}
    return out


def jpeg_block(data: bytes) -> bytes | None:
    """A JPEG's Exif block. Raises ValueError or struct.error for broken bytes."""
    for marker, a, b in segments(data):
        if marker == 0xE1 and data[a + 4 : a + 10] == b"Exif\0\0":
            return data[a + 10 : b]
    return None


def parsed(data: bytes) -> dict:
    """The record of tags of a JPEG's Exif block; empty without one. Raises ValueError or struct.error for broken bytes."""
    found = jpeg_block(data)
    return {} if found is None else tiff_tags(found)


def searched(data: bytes) -> dict:
    """The record of a block that is looked for anywhere in the bytes, whatever the segments around it say.

    A reader of its own beside parsed(): it trusts no lengths but those of the block's entries, and leaves
    out single entries that can't be read. Empty if nothing is found.
    """
    start = data.find(b"Exif\0\0")
    if start < 0:
        return {}
    tiff = memoryview(data)[start + 6 :]
    order = "little" if bytes(tiff[:2]) == b"II" else "big"
    number = lambda at, size, signed=False: int.from_bytes(tiff[at : at + size], order, signed=signed)
    names = {ifd: {tag: (name, kind) for name, (tag, kind) in known.items()} for ifd, known in TAGS.items()}
    out: dict = {ifd: {} for ifd in TAGS}
    waiting = [("ifd0", number(4, 4))] if number(2, 2) == 42 else []
    while waiting:
        ifd, at = waiting.pop()
        for entry in range(at + 2, min(at + 2 + 12 * number(at, 2), len(tiff) - 11), 12):
            tag, kind, count = number(entry, 2), number(entry + 2, 2), number(entry + 4, 4)
            if ifd == "ifd0" and tag in (EXIF_POINTER, GPS_POINTER):
                waiting.append(("exif" if tag == EXIF_POINTER else "gps", number(entry + 8, 4)))
                continue
            size = WIDTH.get(kind, 0) * count
            value_at = entry + 8 if size <= 4 else number(entry + 8, 4)
            if tag not in names[ifd] or not size or value_at + size > len(tiff):
                continue
            name, expected = names[ifd][tag]
            raw = bytes(tiff[value_at : value_at + size])
            if expected == ASCII and kind == ASCII:
                out[ifd][name] = raw.split(b"\0", 1)[0].decode("utf-8", "replace")
            elif expected == UNDEFINED or name in RAW:
                out[ifd][name] = raw
            elif expected in (RATIONAL, SRATIONAL) and kind in (RATIONAL, SRATIONAL):
                pairs = [{k: number(value_at + 8 * j + 4 * (k == "den"), 4, kind == SRATIONAL) for k in ("num", "den")} for j in range(count)]
                if all(max(p.values()) < 2**31 for p in pairs):
                    out[ifd][name] = pairs if name in TRIPLES else pairs[0]
            elif expected in (BYTE, SHORT, LONG) and kind in (BYTE, SHORT, LONG) and (found := number(value_at, WIDTH[kind])) < 2**31:
                out[ifd][name] = found
    return out if any(out.values()) else {}


# Numbers of the IPTC datasets (record 2) that are read.
IPTC = {"ObjectName": 5, "Keywords": 25, "DateCreated": 55, "Byline": 80, "City": 90, "Country": 101, "Headline": 105, "Copyright": 116, "Caption": 120}
IPTC_TYPE = T.StructType([T.StructField(n, T.ArrayType(T.StringType()) if n == "Keywords" else T.StringType()) for n in IPTC])


def iptc(data: bytes) -> dict:
    """The IPTC texts of a JPEG's APP13 segments; keywords are a list. Empty without any."""
    found: dict = {}
    names = {number: name for name, number in IPTC.items()}
    for marker, a, b in segments(data):
        body = data[a + 4 : b]
        if marker != 0xED or not body.startswith(b"Photoshop 3.0\0"):
            continue
        at = 14
        while body[at : at + 4] == b"8BIM":
            kind, title = struct.unpack(">HB", body[at + 4 : at + 7])
            at += 6 + (title + 2) // 2 * 2
            size = struct.unpack(">I", body[at : at + 4])[0]
            block, at = body[at + 4 : at + 4 + size], at + 4 + (size + 1) // 2 * 2
            place = 0
            while kind == 0x0404 and place + 5 <= len(block) and block[place] == 0x1C:
                record, dataset, n = struct.unpack(">BBH", block[place + 1 : place + 5])
                text = block[place + 5 : place + 5 + n].decode("utf-8", "replace")
                place += 5 + n
                if record == 2 and dataset in names:
                    name = names[dataset]
                    if name == "Keywords":
                        found.setdefault(name, []).append(text)
                    else:
                        found.setdefault(name, text)
    return found


def _full(tags: dict) -> dict:
    return {ifd: {name: (tags.get(ifd) or {}).get(name) for name in known} for ifd, known in TAGS.items()}


_CONTENT, _SIZE = (to_arrow_type(t) for t in (CONTENT_TYPE, SIZE_TYPE))


def _attempt(make, *args) -> dict:  # noqa: ANN001, ANN002
    try:
        return {"content": make(*args), "error": None}
    except (ValueError, struct.error, KeyError, TypeError) as e:
        return {"content": None, "error": str(e) or type(e).__name__}


def _contents(rows: list[dict]) -> pa.Array:
    """What _attempt() gave, made column by column."""
    return pa.StructArray.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in _CONTENT], fields=list(_CONTENT))


def _record(reader: Callable[[bytes], dict], data: bytes) -> dict | None:
    """All fields of what a reader finds; null for nothing and for broken bytes."""
    try:
        tags = reader(data) if data else {}
    except (ValueError, struct.error):
        return None
    return _full(tags) if any(tags.values()) else None


def block_records(content: pa.Array, located: Callable[[bytes], bytes | None]) -> pa.Array:
    """The records of the blocks that ``located`` finds in each row's bytes; null for bytes that are null, broken or without one."""
    found = []
    for data in content.to_pylist():
        try:
            found.append(located(data) if data else None)
        except (ValueError, struct.error):
            found.append(None)
    return records(pa.array(found, pa.binary()), lambda tiff: _record(tiff_tags, tiff))


@arrow_udf(TAG_TYPE)
def read_tags(content: pa.Array) -> pa.Array:
    """Null for bytes that are null, broken or without a block."""
    return block_records(content, jpeg_block)


@arrow_udf(TAG_TYPE)
def search_tags(content: pa.Array) -> pa.Array:
    """The same by the second reader, which finds a block in bytes whose segments are broken, too."""
    return pa.array([_record(searched, data) for data in content.to_pylist()], TAG_ARROW)


@arrow_udf(IPTC_TYPE)
def read_iptc(content: pa.Array) -> pa.Array:
    """Null for bytes that are null, broken or without IPTC texts."""
    out = []
    for data in content.to_pylist():
        try:
            found = iptc(data) if data else {}
        except (ValueError, struct.error):
            found = {}
        out.append({name: found.get(name) for name in IPTC} if found else None)
    return pa.array(out, to_arrow_type(IPTC_TYPE))


@arrow_udf(CONTENT_TYPE)
def write_tags(content: pa.Array, tags: pa.Array) -> pa.Array:
    """The JPEG with its metadata replaced by the tags, or an error."""
    made, data = blocks(tags), content.to_pylist()
    left = ~pc.fill_null(pc.less_equal(pc.binary_length(made), LONGEST), False).to_numpy(zero_copy_only=False)
    if left.any():
        made = made.filter(pa.array(~left))
    rest = [_attempt(stripped, data[k] or b"") for k in np.flatnonzero(~left)]
    size = pc.binary_length(made).to_numpy(zero_copy_only=False)
    head = np.empty((len(made), 12), np.uint8)
    head[:] = np.frombuffer(b"\xff\xd8\xff\xe1\0\0Exif\0\0", np.uint8)
    head[:, 4], head[:, 5] = (size + 8) >> 8, (size + 8) & 255
    pictures = pa.array([x["content"] and x["content"][2:] for x in rest], pa.binary())
    files = pc.binary_join_element_wise(fixed_bytes(head), made, pictures, b"")
    done = pa.StructArray.from_arrays([files, pa.array([x["error"] for x in rest], pa.string())], fields=list(_CONTENT))
    one = lambda k: _attempt(with_block, data[k] or b"", t) if (t := tags[k].as_py()) else {"content": None, "error": "no tags"}
    return completed(done, left, one)


@arrow_udf(CONTENT_TYPE)
def strip_tags(content: pa.Array) -> pa.Array:
    return _contents([_attempt(stripped, data or b"") for data in content.to_pylist()])


@arrow_udf(SIZE_TYPE)
def jpeg_size(content: pa.Array) -> pa.Array:
    """Null for bytes that are no JPEG."""
    out = []
    for data in content.to_pylist():
        try:
            out.append(picture_size(data or b""))
        except (ValueError, struct.error):
            out.append(None)
    sides = [pa.array([size and size[k] for size in out], pa.int32()) for k in (0, 1)]
    return pa.StructArray.from_arrays(sides, fields=list(_SIZE), mask=pa.array([size is None for size in out], pa.bool_()))
