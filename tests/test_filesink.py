"""Files that appear once, whatever happens to tasks; heads of files instead of whole ones."""

import os

import pytest
from pyspark.sql import functions as F

from apertura.functions.containers import KINDS, built, read_file_tags
from apertura.functions.exif_bytes import with_block
from apertura.sources import filesink, images


def written(folder) -> dict[str, bytes]:
    return {p.name: p.read_bytes() for p in folder.rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_appear_once_with_names_that_do_not_meet(spark, tmp_path):
    rows = [("a/b", "x.jpg", b"1"), ("c/b", "x.jpg", b"2"), ("n", None, b""), ("none", "x.jpg", None), ("l" * 400, "y", b"3"), ("l" * 401, "y", b"4")]
    items = spark.createDataFrame(rows, "item_id string, output_name string, output binary").withColumn("content", F.lit("clash")).repartition(3)
    filesink.save_files(items, str(tmp_path / "out"))
    filesink.save_files(items.where("item_id = 'n'").withColumn("item_id", F.lit(7)), (tmp_path / "out").as_uri())
    got = written(tmp_path / "out")
    assert sorted(got.values()) == [b"", b"", b"1", b"2", b"3", b"4"]
    assert got["a%2Fb_x.jpg"] == b"1" and "7_" in got and all(len(n.encode()) <= filesink.NAME_BYTES for n in got)
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith("_staging")]
    filesink.save_files(items.limit(0), str(tmp_path / "empty"))
    assert written(tmp_path / "empty") == {}


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    items = spark.range(40).select(F.col("id").alias("item_id"), F.lit("x").alias("output_name"), F.when(F.col("id") < 40, F.lit(b"1")).alias("output"))
    broken = items.repartition(4).withColumn("output", F.when(F.col("item_id") == 33, F.raise_error("lost").cast("binary")).otherwise(F.col("output")))
    with pytest.raises(Exception):
        filesink.save_files(broken, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or written(tmp_path / "out") == {}


def test_attempts_that_do_not_count_leave_no_file(tmp_path):
    """A task is killed half way and run again, another runs twice: only the attempts of the commit are seen."""
    import pyarrow as pa

    writer = filesink.ItemFilesWriter(str(tmp_path / "out"))
    batch = lambda ids: pa.RecordBatch.from_pydict({"item_id": ids, "output_name": ["x"] * len(ids), "content": [b"1"] * len(ids)})

    def killed():
        yield batch(["a"])
        raise RuntimeError("killed")

    with pytest.raises(RuntimeError):
        writer.write(killed())
    first, again, other = writer.write(iter([batch(["a", "b"])])), writer.write(iter([batch(["c"])])), writer.write(iter([batch(["c"])]))
    assert again.folder != other.folder
    writer.commit([first, other, writer.write(iter([]))])
    names = [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()]
    assert sorted(names) == ["a_x", "b_x", "c_x"]
    gone = filesink.ItemFilesWriter(str(tmp_path / "out"))
    gone.abort([gone.write(iter([batch(["z"])]))])
    assert sorted(p.name for p in (tmp_path / "out").rglob("*") if p.is_file()) == sorted(names)


def test_heads_say_what_whole_files_say(spark, tmp_path):
    tags = {"ifd0": {"Make": "Canon"}, "exif": {"ISOSpeedRatings": 200}, "gps": {}}
    for kind in KINDS:
        (tmp_path / f"{kind}.{'jpg' if kind == 'jpeg' else kind}").write_bytes(built(kind, tags))
    tiny = bytes.fromhex("ffd8ffc0000b080010000801011100ffda0008010100003f00")
    large = with_block(tiny, tags) + os.urandom(3_000_000).replace(b"\xff", b"\0") + b"\xff\xd9"
    (tmp_path / "large.jpg").write_bytes(large)
    comment = b"\xff\xfe\xff\xff" + bytes(65533)
    (tmp_path / "far.jpg").write_bytes(large[:2] + comment * 3 + large[2:])
    (tmp_path / "empty.jpg").write_bytes(b"")
    (tmp_path / "cut.jpg").write_bytes(large[:9])
    whole = images.load_items(spark, str(tmp_path))
    heads = filesink.with_heads(whole.drop("content"))
    say = lambda df: {r["name"]: r["t"] for r in df.select("name", read_file_tags("content").alias("t")).collect()}
    assert say(heads) == say(whole) and say(whole)["far.jpg"]["ifd0"]["Make"] == "Canon"
    read = {r["name"]: r["bytes_read"] for r in heads.collect()}
    assert read["large.jpg"] == filesink.HEAD and read["far.jpg"] <= 4 * filesink.HEAD and read.get("empty.jpg", 0) == 0
    assert read["cut.jpg"] == 9 and filesink.with_heads(whole.drop("content").where("false")).count() == 0
    missing = spark.createDataFrame([("x", str(tmp_path / "none.jpg"), 5)], "item_id string, path string, size long")
    assert filesink.with_heads(missing).select("content", "bytes_read").first() == (None, 0)
