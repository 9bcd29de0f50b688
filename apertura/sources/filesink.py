"""A sink of files: each row one file, seen only once the whole write is committed; and heads of files.

Files are reached through pyarrow's file systems, by the folder's scheme (file, hdfs, viewfs, s3, gs, abfs),
on executors and driver alike; a path without a scheme is a folder that all of them share.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Longest file name, in bytes; longer ones end in a digest instead.
NAME_BYTES = 240
#: Bytes read of a file before more are asked for.
HEAD = 1 << 17


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def file_name(item_id: object, name: str | None) -> str:
    """The id, with all that could be read as a folder escaped, before the name; no two ids share a file."""
    full = quote(str(item_id), safe="") + "_" + quote(name or "", safe=" ()")
    if len(full) <= NAME_BYTES:
        return full
    return full[: NAME_BYTES - 65] + "-" + hashlib.sha256(full.encode()).hexdigest()


@dataclass
class Staged(WriterCommitMessage):
    """The folder that a task's attempt wrote, and its number of files."""

    folder: str
    files: int


class ItemFilesWriter(DataSourceArrowWriter):
    """Tasks write into a folder of their own attempt; the driver moves the folders of those that count, one move a task.

    What repeated, beaten or killed attempts left goes with the staging folder, after commit and abort alike.
    """

    def __init__(self, path: str) -> None:
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    @property
    def staging(self) -> str:
        return f"{self.path}/_staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Staged:
        files, folder = located(f"{self.staging}/{uuid.uuid4().hex}")
        n = 0
        for batch in iterator:
            ids, names, contents = (batch.column(batch.schema.get_field_index(c)) for c in ("item_id", "output_name", "content"))
            for k in range(batch.num_rows):
                if (data := contents[k].as_py()) is None:
                    continue
                if not n:
                    files.create_dir(folder, recursive=True)
                with files.open_output_stream(f"{folder}/{file_name(ids[k].as_py(), names[k].as_py())}") as out:
                    out.write(data)
                n += 1
        return Staged(folder if n else "", n)

    def commit(self, messages: list[Staged | None]) -> None:
        files, path = located(self.path)
        files.create_dir(path, recursive=True)
        for k, done in enumerate(messages):
            if done and done.files:
                files.move(done.folder, f"{path}/part-{k:06d}-{self.job}")
        self._clear(files)

    def abort(self, messages: list[Staged | None]) -> None:
        self._clear(located(self.path)[0])

    def _clear(self, files: fs.FileSystem) -> None:
        _, staging = located(self.staging)
        if files.get_file_info(staging).type == fs.FileType.Directory:
            files.delete_dir(staging)


class ItemFiles(DataSource):
    """The format ``item_files``: appends rows (item_id, output_name, content) as files under a folder."""

    @classmethod
    def name(cls) -> str:
        return "item_files"

    def writer(self, schema, overwrite: bool) -> ItemFilesWriter:  # noqa: ANN001
        if overwrite:
            raise ValueError("item_files only appends")
        if not {"item_id", "output_name", "content"} <= set(schema.names):
            raise ValueError("item_files takes item_id, output_name and content")
        return ItemFilesWriter(self.options["path"])


def save_files(items: DataFrame, folder: str) -> None:
    """Writes processed rows (those with ``output``) as files ``part-*/<id>_<name>`` under a folder: all of them, or none if the job fails.

    If the driver is lost while it moves the tasks' folders, some of them are there and others aren't.
    A row's id is part of the name, escaped, so names that repeat don't meet and need no shuffle. Equal ids
    with equal names are one file within a task. An empty table leaves an empty folder.
    """
    items.sparkSession.dataSource.register(ItemFiles)
    ready = items.where("output is not null").select(F.col("item_id").cast("string").alias("item_id"), "output_name", F.col("output").alias("content"))
    ready.write.format("item_files").mode("append").option("path", folder).save()


def head_is_whole(data: bytes) -> bool:
    """Whether the bytes hold all segments of a JPEG file before its picture data, which is where its metadata is."""
    if data[:2] != b"\xff\xd8":
        return False
    return any(marker == 0xDA and start + size <= len(data) for marker, start, size in _marked(data))


def _marked(data: bytes) -> Iterator[tuple[int, int, int]]:
    """Marker, start and size of the segments up to the picture data, as far as the bytes go."""
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        if data[at + 1] == 0xFF:
            at += 1
            continue
        size = 2 + int.from_bytes(data[at + 2 : at + 4], "big")
        yield data[at + 1], at, size
        if data[at + 1] == 0xDA:
            return
        at += size


def with_heads(items: DataFrame, head: int = HEAD) -> DataFrame:
    """Items (with ``path`` and ``size``, no content) with ``content``: of JPEG files as many bytes as hold their metadata, of others all.

    For tags, not for pictures. JPEG files are read ``head`` bytes at a time, twice as many each time, until their
    segments end. A file that is gone or can't be read has null content. ``bytes_read`` says what was read.
    """
    kept = [c for c in items.columns if c not in ("content", "bytes_read")]
    schema = items.select(*kept).schema.add("content", "binary").add("bytes_read", "long")
    path_at = kept.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                data, n = b"", head
                try:
                    files, path = located(batch.column(path_at)[k].as_py())
                    with files.open_input_file(path) as f:
                        while more := f.read(n - len(data)):
                            data += more
                            if data[:2] == b"\xff\xd8" and head_is_whole(data):
                                break
                            n = 2 * len(data)
                    got = [data, len(data)]
                except (OSError, pa.ArrowInvalid):
                    got = [None, 0]
                row = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array(got[:1], pa.binary()), pa.array(got[1:], pa.int64())], [*kept, "content", "bytes_read"])

    return items.select(*kept).mapInArrow(read, schema)
