"""Metadata of files of several kinds, whole, broken and cut off."""

import struct

import pytest

from apertura.functions import containers as C
from apertura.functions.exif_bytes import TAG_TYPE, tiff_tags

TAGS = {"ifd0": {"Make": "Maker", "Orientation": 1}, "exif": {"ISOSpeedRatings": 400, "DateTimeDigitized": "2024:05:06 07:08:09"}, "gps": {"GPSLatitudeRef": "N"}}


@pytest.mark.parametrize("kind", C.KINDS)
def test_every_kind_is_told_and_read(kind):
    data = C.built(kind, TAGS)
    assert C.kind_of(data) == kind
    assert C.file_tags(data) == TAGS


@pytest.mark.parametrize("kind", C.KINDS)
def test_files_cut_anywhere_never_fail_the_column(kind):
    data = C.built(kind, TAGS)
    for end in range(len(data)):
        try:
            found = C.file_tags(data[:end])
        except (ValueError, struct.error):
            continue
        assert not any(found.values()) or found["ifd0"].get("Make") in (None, "Maker")


def test_heic_items_beside_the_tables_and_with_long_ids():
    tiff = C.built("tiff", TAGS)
    item = struct.pack(">I", 0) + tiff
    infe = lambda k, kind, n: C._box(b"infe", bytes([3, 0, 0, 0]) + struct.pack(">IH", k, 0) + kind + b"\0" + bytes(n))
    iinf = C._box(b"iinf", bytes([1, 0, 0, 0]) + struct.pack(">I", 2) + infe(70_000, b"hvc1", 3) + infe(70_001, b"Exif", 0))
    place = lambda k, method, at, n: struct.pack(">IHHIHII", k, method, 0, 0, 1, at, n)
    iloc = C._box(b"iloc", bytes([2, 0, 0, 0]) + b"\x44\x40" + struct.pack(">I", 2) + place(70_000, 0, 5, 9) + place(70_001, 1, 0, len(item)))
    data = C._box(b"ftyp", b"mif1" + bytes(4)) + C._box(b"meta", bytes(4) + iinf + iloc + C._box(b"idat", item))
    assert C.file_tags(data) == TAGS


def test_webp_blocks_with_a_jpeg_head_and_other_chunks():
    body = b"Exif\0\0" + C.built("tiff", TAGS)
    chunks = b"VP8 " + struct.pack("<I", 3) + b"abc\0" + b"EXIF" + struct.pack("<I", len(body)) + body
    assert C.file_tags(b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WEBP" + chunks) == TAGS


def test_big_endian_block():
    entry = struct.pack(">HHIHH", 274, 3, 1, 6, 0)
    assert tiff_tags(b"MM\0*" + struct.pack(">IH", 8, 1) + entry + bytes(4))["ifd0"] == {"Orientation": 6}


def test_columns_with_nulls_empty_and_foreign_bytes(spark):
    rows = [("a", b""), ("b", None), ("c", b"GIF89a"), ("d", C.built("png", TAGS)), ("e", C.PNG_HEAD + b"\xff" * 40)]
    df = spark.createDataFrame(rows, "item_id string, content binary")
    got = {r.item_id: (r.kind, r.tags) for r in df.select("item_id", C.file_kind("content").alias("kind"), C.read_file_tags("content").alias("tags")).collect()}
    assert [got[k] for k in "abc"] == [(None, None)] * 3
    assert got["d"][1].ifd0.Make == "Maker"
    assert got["e"] == ("png", None)
    assert df.limit(0).select(C.read_file_tags("content").alias("t")).schema["t"].dataType == TAG_TYPE
