"""Image files as rows, and processed rows as files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apertura.functions import scalars as S
from apertura.functions.exif_bytes import read_iptc, read_tags
from apertura.operators.records import display_from_tags

#: MIME types by file extension; anything else has none.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "heic": "image/heic", "tif": "image/tiff", "tiff": "image/tiff"}


def item_id(path: Column) -> Column:
    """The id of a file: a hash of its path, however many slashes the scheme is followed by."""
    return F.sha2(F.regexp_replace(path, "^file:/+", "file:/"), 256)


def as_items(files: DataFrame) -> DataFrame:
    """``item_id, path, name, mime, size, loaded_at, content`` of rows of the binaryFile source, images only."""
    name = F.element_at(F.split("path", "/"), -1)
    types = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    mime = F.try_element_at(types, F.lower(F.element_at(F.split(name, r"\."), -1)))
    items = files.select(item_id(F.col("path")).alias("item_id"), "path", name.alias("name"), mime.alias("mime"), F.col("length").alias("size"), F.col("modificationTime").alias("loaded_at"), "content")
    return items.where(S.image_type(F.col("mime")))


def load_items(spark: SparkSession, path: str) -> DataFrame:
    """The images under a folder, subfolders included. Bytes are read only where ``content`` is used."""
    return as_items(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path))


def stream_items(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    """The same as a stream of the files that arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return as_items(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(path))


def load_pixels(spark: SparkSession, path: str) -> DataFrame:
    """``item_id, image`` of decoded images, with the ids of load_items(); files that can't be decoded are left out."""
    found = spark.read.format("image").option("dropInvalid", "true").option("recursiveFileLookup", "true").load(path)
    return found.select(item_id(F.col("image.origin")).alias("item_id"), "image")


def hydrated(items: DataFrame) -> DataFrame:
    """Items with what their bytes say: ``tags``, the shown ``record`` and the ``iptc`` texts; null where there are none."""
    read = items.drop("tags", "record", "iptc").withColumns({"tags": read_tags("content"), "iptc": read_iptc("content")})
    return read.withColumn("record", display_from_tags(F.col("tags")))


def export(items: DataFrame, path: str) -> None:
    """Writes processed rows (those with ``output``) as a Parquet table of names and bytes."""
    items.where("output is not null").select("item_id", "output_name", F.col("output").alias("content")).write.parquet(path)


def export_files(items: DataFrame, folder: str) -> DataFrame:
    """Writes processed rows as files into a folder that all executors share; ``item_id, file, error`` for each.

    The row's id stands before the name, as names repeat, so no bytes are shuffled to find out which do. A
    file is written under another name first and then renamed, so that a repeated task leaves no half file.
    """
    ready = items.where("output is not null")
    named = ready.select("item_id", F.concat_ws("_", "item_id", "output_name").alias("file"), "output")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        import uuid

        for batch in batches:
            errors = []
            for name, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                target = os.path.join(folder, os.path.basename(name))
                part = f"{target}.{uuid.uuid4().hex}"
                try:
                    with open(part, "wb") as f:
                        f.write(data)
                    os.replace(part, target)
                    errors.append(None)
                except OSError as e:
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(errors, pa.string())], ["item_id", "file", "error"])

    return named.mapInArrow(write, f"item_id {items.schema['item_id'].dataType.simpleString()}, file string, error string")
