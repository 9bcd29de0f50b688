"""TIFF blocks of whole columns at a time: records of tags written as blocks, and blocks read as records.

exif_bytes has the same for one record; what it does with rows that have something unusual about them (numbers
that don't fit, tags of other types than expected, repeated or cut off entries) is left to it, so such rows are
marked and nothing else is decided here.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from apertura.functions.exif_tags import ASCII, BYTE, EXIF_POINTER, GPS_POINTER, LONG, RATIONAL, RAW, SHORT, SRATIONAL, TAG_ARROW, TAGS, TRIPLES, UNDEFINED, WIDTH

#: Rows that are worked on at a time; below a few rows of a kind, one by one is quicker.
ROWS, FEW = 1 << 14, 4
WIDTHS = np.array([WIDTH.get(k, 0) for k in range(max(WIDTH) + 2)])
#: NULs at a text's end that are cut off here.
PADDING = 16


def merged(parts: list[tuple[np.ndarray, pa.Array]]) -> pa.Array:
    """One array of parts that say which rows they are."""
    if len(parts) == 1:
        return parts[0][1]
    order = np.argsort(np.concatenate([rows for rows, _ in parts]), kind="stable")
    return pa.concat_arrays([x for _, x in parts]).take(pa.array(order))


def completed(done: pa.Array, left: np.ndarray, one: Callable[[int], object]) -> pa.Array:
    """``done`` is of the rows that aren't ``left``; those are made one by one."""
    rows = np.flatnonzero(left)
    if not len(rows):
        return done
    return merged([(np.flatnonzero(~left), done), (rows, pa.array([one(int(k)) for k in rows], done.type))])


def _little(x: np.ndarray | int, n: int) -> np.ndarray:
    """Rows of four bytes."""
    return np.ascontiguousarray(np.broadcast_to(np.asarray(x), n).astype("<u4")).view(np.uint8).reshape(n, 4)


def _present(x: pa.Array) -> np.ndarray:
    return x.is_valid().to_numpy(zero_copy_only=False)


def fixed_bytes(matrix: np.ndarray) -> pa.Array:
    """A binary column of the rows of bytes."""
    n, width = matrix.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(np.ascontiguousarray(matrix))])


def _spans(x: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, eight more behind them, and the offsets of its rows."""
    offsets = np.frombuffer(x.buffers()[1], np.int32, len(x) + 1, 4 * x.offset).astype(np.int64) if len(x) else np.zeros(1, np.int64)
    data = x.buffers()[2]
    found = np.zeros(int(offsets[-1] - offsets[0]) + 8, np.uint8)
    if data is not None:
        found[:-8] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return found, offsets - offsets[0]


class _Field:
    """A tag's values of all rows: those that fit, their count, the four bytes within the entry, and what stands behind the directory."""

    def __init__(self, name: str, kind: int, x: pa.Array) -> None:
        n = len(x)
        self.fits, self.count, self.inline, self.tail, self.size = np.ones(n, bool), 1, None, None, np.zeros(n, np.int64)
        if kind == ASCII or kind == UNDEFINED or name in RAW:
            self._text(x.cast(pa.binary()).fill_null(b""), 1 if kind == ASCII else 0)
        elif kind in (RATIONAL, SRATIONAL):
            numbers = self._triples(x) if name in TRIPLES else self._pairs(x)
            least, most = (0, 2**32) if kind == RATIONAL else (-(2**31), 2**31)
            self.fits &= ((numbers >= least) & (numbers < most)).all(axis=1)
            self.tail = np.where(self.fits[:, None], numbers, 0).astype("<i8").astype("<u4" if kind == RATIONAL else "<i4").view(np.uint8).reshape(n, -1)
            self.size, self.count = np.full(n, self.tail.shape[1]), numbers.shape[1] // 2
        else:
            number = x.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            self.fits = (number >= 0) & (number < {BYTE: 2**8, SHORT: 2**63 - 1, LONG: 2**32}[kind])
            self.inline = _little(np.where(self.fits, np.minimum(number, 65535) if kind == SHORT else number, 0), n)

    def _text(self, x: pa.Array, ends: int) -> None:
        data, offsets = _spans(x)
        self.count = np.diff(offsets) + ends
        far = self.count > 4
        self.inline = np.zeros((len(x), 4), np.uint8)
        for k in range(4):
            some = ~far & (np.diff(offsets) > k)
            self.inline[some, k] = data[offsets[:-1][some] + k]
        if far.any():
            self.size = np.where(far, self.count + self.count % 2, 0)
            fill = pa.DictionaryArray.from_arrays(pa.array(ends + self.count % 2), pa.array([b"", b"\0", b"\0\0"])).cast(pa.binary())
            self.tail = pc.if_else(pa.array(far), pc.binary_join_element_wise(x, fill, b""), pa.scalar(b"", pa.binary()))

    def _pairs(self, x: pa.Array) -> np.ndarray:
        both = [x.flatten()[x.type.get_field_index(n)] for n in ("num", "den")]
        self.fits &= np.logical_and(*map(_present, both)) | ~_present(x)
        return np.stack([c.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in both], axis=1)

    def _triples(self, x: pa.Array) -> np.ndarray:
        out = np.zeros((len(x), 6), np.int64)
        three = pc.list_value_length(x).fill_null(0).to_numpy(zero_copy_only=False) == 3
        self.fits &= three
        inner = pc.list_flatten(x.filter(pa.array(three)))
        whole = _Pairs(inner)
        self.fits[three] &= whole.fits.reshape(-1, 3).all(axis=1)
        out[three] = whole.numbers.reshape(-1, 6)
        return out


class _Pairs(_Field):
    def __init__(self, x: pa.Array) -> None:
        self.fits = _present(x)
        self.numbers = self._pairs(x)


def _expected(name: str, kind: int, type_: pa.DataType) -> bool:
    """Whether a column's type is the one that a tag has."""
    pair = lambda t: pa.types.is_struct(t) and all(t.get_field_index(n) >= 0 and pa.types.is_integer(t.field(n).type) for n in ("num", "den"))
    if kind == ASCII:
        return pa.types.is_string(type_)
    if kind == UNDEFINED or name in RAW:
        return pa.types.is_binary(type_)
    if kind in (RATIONAL, SRATIONAL):
        return pa.types.is_list(type_) and pair(type_.value_type) if name in TRIPLES else pair(type_)
    return pa.types.is_integer(type_)


def _directory(fields: list[tuple[int, int, _Field]], at: np.ndarray) -> list[np.ndarray | pa.Array]:
    """The pieces of directories that begin ``at`` bytes into their blocks."""
    n = len(at)
    head = np.zeros((n, 6 + 12 * len(fields)), np.uint8)
    head[:, :2] = np.frombuffer(struct.pack("<H", len(fields)), np.uint8)
    place, pieces = at + head.shape[1], [head]
    for k, (tag, kind, field) in enumerate(sorted(fields, key=lambda f: f[0])):
        entry = head[:, 2 + 12 * k : 14 + 12 * k]
        entry[:, :4] = np.frombuffer(struct.pack("<HH", tag, kind), np.uint8)
        entry[:, 4:8] = _little(field.count, n)
        entry[:, 8:] = _little(place, n) if field.inline is None else np.where(field.size[:, None] > 0, _little(place, n), field.inline)
        if field.tail is not None:
            pieces.append(field.tail)
            place = place + field.size
    return pieces


def _blocks(columns: dict[str, list[tuple[str, pa.Array]]], n: int) -> tuple[pa.Array, np.ndarray]:
    """Blocks of rows that all have the same tags, and which of them fit."""
    fields = {ifd: [(*TAGS[ifd][name], _Field(name, TAGS[ifd][name][1], x)) for name, x in found] for ifd, found in columns.items()}
    size = lambda ifd, more=0: 6 + 12 * (len(fields[ifd]) + more) + sum((f.size for _, _, f in fields[ifd]), np.zeros(n, np.int64))
    exif_at = 8 + size("ifd0", 2)
    gps_at = exif_at + size("exif")
    for tag, at in ((EXIF_POINTER, exif_at), (GPS_POINTER, gps_at)):
        fields["ifd0"].append((tag, LONG, _Field("", LONG, pa.array(at))))
    fits = np.logical_and.reduce([f.fits for found in fields.values() for _, _, f in found])
    pieces: list[np.ndarray | pa.Array] = [np.broadcast_to(np.frombuffer(b"II*\0\x08\0\0\0", np.uint8), (n, 8))]
    for piece in [*_directory(fields["ifd0"], np.full(n, 8)), *_directory(fields["exif"], exif_at), *_directory(fields["gps"], gps_at)]:
        if isinstance(piece, np.ndarray) and isinstance(pieces[-1], np.ndarray):
            pieces[-1] = np.concatenate([pieces[-1], piece], axis=1)
        else:
            pieces.append(piece)
    return pc.binary_join_element_wise(*[fixed_bytes(x) if isinstance(x, np.ndarray) else x for x in pieces], b""), fits


def blocks(tags: pa.StructArray) -> pa.Array:
    """The records as exif_bytes.block() writes them; null for those that are null or are left to it."""
    if len(tags) > ROWS:
        return pa.concat_arrays([blocks(tags[at : at + ROWS]) for at in range(0, len(tags), ROWS)])
    n, given = len(tags), _present(tags)
    columns: list[tuple[str, str, pa.Array]] = []
    for ifd, own in zip([f.name for f in tags.type], tags.flatten(), strict=True):
        if ifd not in TAGS or own.null_count == n:
            continue
        if not pa.types.is_struct(own.type):
            return pa.nulls(n, pa.binary())
        columns += [(ifd, f.name, x) for f, x in zip(own.type, own.flatten(), strict=True) if x.null_count < n]
    if any(name not in TAGS[ifd] or not _expected(name, TAGS[ifd][name][1], x.type) for ifd, name, x in columns) or len({c[:2] for c in columns}) < len(columns):
        return pa.nulls(n, pa.binary())
    there = np.stack([given, *[_present(x) for _, _, x in columns]], axis=1)
    if (there == there[:1]).all():
        kinds, kind = there[:1], np.zeros(n, np.int64)
    else:
        kinds, kind = np.unique(np.packbits(there, axis=1), axis=0, return_inverse=True)
    parts = []
    for k in range(len(kinds)):
        rows = np.flatnonzero(kind.ravel() == k)
        if not given[rows[0]] or len(rows) < FEW < n:
            parts.append((rows, pa.nulls(len(rows), pa.binary())))
            continue
        own: dict[str, list[tuple[str, pa.Array]]] = {ifd: [] for ifd in TAGS}
        for has, (ifd, name, x) in zip(there[rows[0], 1:], columns, strict=True):
            if has:
                own[ifd].append((name, x if len(rows) == n else x.take(pa.array(rows))))
        made, fits = _blocks(own, len(rows))
        parts.append((rows, made if fits.all() else pc.if_else(pa.array(fits), made, pa.scalar(None, pa.binary()))))
    return merged(parts) if parts else pa.nulls(n, pa.binary())


class _Blocks:
    """The bytes of blocks of one byte order, and columns of values at places within them."""

    def __init__(self, data: np.ndarray, start: np.ndarray, size: np.ndarray, order: str) -> None:
        self.data, self.start, self.size = data, start, size
        self.two, self.four = (np.ndarray((len(data) - 3,), f"{order}u{w}", data, 0, (1,)) for w in (2, 4))
        self.usual, self.found = np.ones(len(start), bool), np.zeros(len(start), bool)

    def entries(self, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, tag, kind, count of values and place within the data of every entry of the ``rows``' directories, which are ``at``."""
        inside = (at >= 0) & (at + 2 <= self.size[rows])
        self.usual[rows[~inside]] = False
        rows, at = rows[inside], at[inside]
        count = self.two[self.start[rows] + at].astype(np.int64)
        inside = at + 2 + 12 * count <= self.size[rows]
        self.usual[rows[~inside]] = False
        rows, at, count = rows[inside], at[inside], count[inside]
        row = np.repeat(rows, count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        place = self.start[row] + np.repeat(at, count) + 2 + 12 * nth
        kind, n = self.two[place + 2].astype(np.int64), self.four[place + 4].astype(np.int64)
        far = WIDTHS[np.minimum(kind, len(WIDTHS) - 1)] * n > 4
        value = np.where(far, self.start[row] + self.four[place + 8], place + 8)
        return row, self.two[place].astype(np.int64), kind, n, value

    def of_tag(self, entries: tuple[np.ndarray, ...], tag: int, kinds: tuple[int, ...], count: int | None) -> tuple[np.ndarray, ...]:
        """Those of one tag, if it is there once, whole and of one of the ``kinds``; rows in which it isn't are unusual."""
        some = np.flatnonzero(entries[1] == tag)
        row, _, kind, n, value = (x[some] for x in entries)
        size = WIDTHS[np.minimum(kind, len(WIDTHS) - 1)] * n
        good = np.isin(kind, kinds) & (size > 0) & (value + size <= self.start[row] + self.size[row])
        if count is not None:
            good &= n == count
        again = np.flatnonzero(row[1:] == row[:-1])
        good[again] = False
        self.usual[row[~good]] = False
        self.found[row] = True
        return row[good], kind[good], n[good], value[good]

    def runs(self, row: np.ndarray, value: np.ndarray, n: np.ndarray, type_: pa.DataType) -> pa.Array:
        """Bytes of ``n`` each."""
        offsets = np.zeros(len(self.start) + 1, np.int64)
        offsets[row + 1] = n
        offsets = np.cumsum(offsets)
        at = np.repeat(value - offsets[row], n) + np.arange(offsets[-1])
        return pa.Array.from_buffers(type_, len(self.start), [self._there(row), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.data[at])])

    def _there(self, row: np.ndarray) -> pa.Buffer:
        mask = np.zeros(len(self.start), bool)
        mask[row] = True
        return pa.py_buffer(np.packbits(mask, bitorder="little"))

    def texts(self, entries: tuple[np.ndarray, ...], tag: int) -> pa.Array:
        row, _, n, value = self.of_tag(entries, tag, (ASCII,), None)
        n = n.copy()
        for _ in range(PADDING):
            ended = np.flatnonzero((n > 0) & (self.data[value + np.maximum(n, 1) - 1] == 0))
            if not len(ended):
                break
            n[ended] -= 1
        else:
            self.usual[row[(n > 0) & (self.data[value + np.maximum(n, 1) - 1] == 0)]] = False
        out = self.runs(row, value, n, pa.binary())
        try:
            return out.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([x if x is None else x.decode("utf-8", "replace") for x in out.to_pylist()], pa.string())

    def numbers(self, entries: tuple[np.ndarray, ...], tag: int) -> pa.Array:
        row, kind, _, value = self.of_tag(entries, tag, (BYTE, SHORT, LONG), None)
        got = np.where(kind == BYTE, self.data[value], np.where(kind == SHORT, self.two[value], self.four[value])).astype(np.int64)
        self.usual[row[got >= 2**31]] = False
        out = np.zeros(len(self.start), np.int32)
        out[row] = np.where(got < 2**31, got, 0)
        return pa.Array.from_buffers(pa.int32(), len(self.start), [self._there(row), pa.py_buffer(out)])

    def pairs(self, entries: tuple[np.ndarray, ...], tag: int, type_: pa.DataType, count: int) -> pa.Array:
        row, kind, _, value = self.of_tag(entries, tag, (RATIONAL, SRATIONAL), count)
        got = self.four[value[:, None] + 4 * np.arange(2 * count)].astype(np.int64)
        got = np.where((kind == SRATIONAL)[:, None] & (got >= 2**31), got - 2**32, got)
        n, fits = len(self.start), (got < 2**31).all(axis=1)
        self.usual[row[~fits]] = False
        got = np.where(fits[:, None], got, 0).astype(np.int32)
        if count == 1:
            both = np.zeros((n, 2), np.int32)
            both[row] = got
            return pa.Array.from_buffers(type_, n, [self._there(row)], children=[pa.array(np.ascontiguousarray(both[:, k])) for k in (0, 1)])
        inner = got.reshape(-1, 2)
        values = pa.Array.from_buffers(type_.value_type, len(inner), [None], children=[pa.array(np.ascontiguousarray(inner[:, k])) for k in (0, 1)])
        offsets = np.zeros(n + 1, np.int32)
        offsets[row + 1] = count
        return pa.Array.from_buffers(type_, n, [self._there(row), pa.py_buffer(np.cumsum(offsets, dtype=np.int32))], children=[values])

    def column(self, entries: tuple[np.ndarray, ...], name: str, tag: int, kind: int, type_: pa.DataType) -> pa.Array:
        if kind == ASCII:
            return self.texts(entries, tag)
        if kind == UNDEFINED or name in RAW:
            row, _, n, value = self.of_tag(entries, tag, (kind,), None)
            return self.runs(row, value, n, pa.binary())
        if kind in (RATIONAL, SRATIONAL):
            return self.pairs(entries, tag, type_, 3 if name in TRIPLES else 1)
        return self.numbers(entries, tag)

    def records(self) -> pa.Array:
        at = self.four[self.start + 4].astype(np.int64)
        entries = {"ifd0": self.entries(at, np.arange(len(self.start)))}
        for ifd, tag in (("exif", EXIF_POINTER), ("gps", GPS_POINTER)):
            row, tags, kind, n, value = entries["ifd0"]
            some = (tags == tag) & (WIDTHS[np.minimum(kind, len(WIDTHS) - 1)] * n == 4)
            row, value = row[some], value[some]
            self.usual[row[:-1][row[1:] == row[:-1]]] = False
            once = np.append(True, row[1:] != row[:-1])[: len(row)]
            entries[ifd] = self.entries(self.four[value[once]].astype(np.int64), row[once])
        whole = []
        for ifd in TAG_ARROW:
            columns = [self.column(entries[ifd.name], f.name, *TAGS[ifd.name][f.name], f.type) for f in ifd.type]
            whole.append(pa.StructArray.from_arrays(columns, fields=list(ifd.type)))
        return pa.StructArray.from_arrays(whole, fields=list(TAG_ARROW), mask=pa.array(~self.found))


def records(content: pa.Array, one: Callable[[bytes], dict | None]) -> pa.Array:
    """A binary column of blocks as records of tags; unusual ones by ``one``, null for those that are null."""
    if len(content) > ROWS:
        return pa.concat_arrays([records(content[at : at + ROWS], one) for at in range(0, len(content), ROWS)])
    data, offsets = _spans(content)
    start, size = offsets[:-1], np.diff(offsets)
    head = lambda k: data[start + np.minimum(k, size)]
    low, high = head(2), head(3)
    parts, left = [], _present(content)
    for order, mark, magic in (("<", ord("I"), (42, 0)), (">", ord("M"), (0, 42))):
        rows = np.flatnonzero(left & (size >= 8) & (head(0) == mark) & (head(1) == mark) & (low == magic[0]) & (high == magic[1]))
        if len(rows):
            some = _Blocks(data, start[rows], size[rows], order)
            found = some.records()
            parts.append((rows[some.usual], found if some.usual.all() else found.filter(pa.array(some.usual))))
    rest = np.ones(len(content), bool)
    for rows, _ in parts:
        rest[rows] = False
    rows = np.flatnonzero(rest)
    if len(rows) or not parts:
        parts.append((rows, pa.array([one(content[int(k)].as_py()) if left[k] else None for k in rows], TAG_ARROW)))
    return merged(parts)
