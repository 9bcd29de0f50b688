"""Blocks of whole columns against those of one record at a time, and how quick they are."""

import struct
import time

import numpy as np
import pyarrow as pa
import pytest

from apertura.functions import containers as C
from apertura.functions import exif_bytes as X
from apertura.functions import exif_columns as E
from apertura.functions.exif_tags import TAG_ARROW, TAGS
from apertura.plans.catalogue import TINY_JPEG


def value(name, kind, rng, odd):
    if odd and rng.random() < 0.2:
        return None
    if kind == X.ASCII:
        return str(rng.choice(["", "a", "abc", "abcd", "Zürich", "x" * 40, "Canon\0\0", "\0"])) if odd else "abcdefgh"[: int(rng.integers(1, 8))]
    if kind == X.UNDEFINED or name in X.RAW:
        return rng.bytes(int(rng.choice([0, 1, 4, 7] if odd else [1, 4])))
    if kind in (X.RATIONAL, X.SRATIONAL):
        pair = lambda: {"num": int(rng.choice([0, 7, 2**31 - 1, *([-3] if odd else [])])), "den": int(rng.choice([0, 10]))}
        return [pair() for _ in range(2 if odd and rng.random() < 0.1 else 3)] if name in X.TRIPLES else pair()
    return int(rng.choice([0, 255, *([300, 70_000, -1] if odd and rng.random() < 0.1 else [])]))


def record(rng, odd=False):
    return {ifd: {n: value(n, k, rng, odd) for n, (_, k) in known.items()} for ifd, known in TAGS.items()}


@pytest.mark.parametrize("few", [1, 4])
def test_columns_are_as_single_records(monkeypatch, few):
    """Whole and odd records, null ones, bytes that are no JPEG; files spoiled and cut off; both byte orders; slices."""
    monkeypatch.setattr(E, "FEW", few)
    rng = np.random.default_rng(1)
    rows = [record(rng, k % 2 == 1) for k in range(120)] + [None]
    tags, data = pa.array(rows, TAG_ARROW), [TINY_JPEG if k % 9 else [b"junk", None, b""][k % 3] for k in range(len(rows))]
    rows = tags.to_pylist()
    want = [X._attempt(X.with_block, d or b"", t) if t else {"content": None, "error": "no tags"} for d, t in zip(data, rows, strict=True)]
    content = pa.array(data, pa.binary())
    assert X.write_tags.func(content, tags).to_pylist() == want
    assert X.write_tags.func(content[5:50], tags[5:50]).to_pylist() == want[5:50]
    files = [w["content"] for w in want if w["content"]]
    some = pa.array([*files, None, b"", b"junk", TINY_JPEG, TINY_JPEG[:6], b"\xff\xd8\xff\xd9"], pa.binary())
    assert X.strip_tags.func(some).to_pylist() == [X._attempt(X.stripped, f or b"") for f in some.to_pylist()]
    assert X.jpeg_size.func(some).to_pylist() == [{"width": 8, "height": 16}] * len(files) + [None] * 3 + [{"width": 8, "height": 16}] + [None] * 2
    entry = struct.pack(">HHIHH", 274, 3, 1, 6, 0) + struct.pack(">HHII", 282, 5, 1, 38)
    big = b"MM\0*" + struct.pack(">IH", 8, 2) + entry + bytes(4) + struct.pack(">II", 72, 1)
    files += [X.with_tiff(TINY_JPEG, big), X.with_tiff(TINY_JPEG, big[:-1]), X.with_tiff(TINY_JPEG, big[:8] + b"\xff\xff" + big[10:])]
    files += [f[: int(rng.integers(len(f)))] for f in files] + [None, b"", TINY_JPEG]
    for f in files[:40]:
        at = int(rng.integers(60, len(f)))
        files.append(f[:at] + bytes([f[at] ^ 0x80]) + f[at + 1 :])
    one = [X._record(X.parsed, f) for f in files]
    got = X.read_tags.func(pa.array(files, pa.binary()))
    got.validate(full=True)
    assert got.type == TAG_ARROW and got.to_pylist() == one
    assert sum(x is not None for x in one) > 60 and None in one
    good = pa.array([t if w["error"] in (None, "not a JPEG") else None for t, w in zip(rows, want, strict=True)], TAG_ARROW)
    kinds = pa.array([[*C.KINDS, None][k % 6] for k in range(len(rows))])
    made = C.build_file.func(kinds, good)
    assert made.to_pylist() == [C.built(k, t) if k and t else None for k, t in zip(kinds.to_pylist(), good.to_pylist(), strict=True)]
    assert C.read_file_tags.func(made).to_pylist() == [X._record(C.file_tags, f) if f else None for f in made.to_pylist()]


def test_columns_of_records_are_quick():
    """One record at a time took above a second for this."""
    rng = np.random.default_rng(2)
    tags, content = pa.array([record(rng) for _ in range(200)] * 15, TAG_ARROW), pa.array([TINY_JPEG] * 3000, pa.binary())
    for write, read in ((X.write_tags.func, X.read_tags.func), (lambda c, t: pa.StructArray.from_arrays([C.build_file.func(pa.array(C.KINDS[:4] * 750), t)], ["content"]), C.read_file_tags.func)):
        began = time.process_time()
        assert read(write(content, tags).field("content")).null_count == 0
        assert time.process_time() - began < 0.8


def test_the_second_reader_works_only_where_the_first_finds_nothing(spark):
    from apertura.operators import workflow as W

    items = spark.createDataFrame([("a", TINY_JPEG)], "item_id string, content binary")
    plan = W.randomized(items)._jdf.queryExecution().optimizedPlan().toString()
    assert "search_tags(CASE WHEN isnull(" in plan
