import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from apertura.functions import display as D
from apertura.functions import exif_bytes as X
from apertura.functions import jpeg as jpeg_codec
from apertura.functions.draws import pick, unit
from apertura.operators import generate as G
from apertura.operators import records as R
from apertura.operators import workflow as W
from apertura.operators.pixels import rendered, sampled, with_noise
from apertura.plans.catalogue import TINY_JPEG
from apertura.plans.render import render_plan
from apertura.sources import dims, images
from apertura.streaming.status import stream_states, windowed_operations


def test_dimensions(spark):
    cams = dims.cameras(spark)
    assert {r["make"]: r["count"] for r in cams.groupBy("make").count().collect()} == {"Apple": 4, "Samsung": 3, "Canon": 3, "Nikon": 3, "Google": 2, "Sony": 2, "FUJIFILM": 2}
    sums = cams.select(*[F.sum(F.size(c)) for c in ("apertures", "isos", "shutters", "focals")]).first()
    assert tuple(sums) == (101, 186, 174, 77)
    assert dims.locations(spark).count() == 58
    assert dims.exif_fields(spark).count() == 31
    assert dims.exif_codes(spark).count() == 43
    assert G.lens_matches(spark).count() == 135
    assert [tuple(r) for r in G.unmatched_focals(spark).select("model", "focal").collect()] == [("Canon EOS 90D", 18)]


@pytest.fixture(scope="module")
def records(spark):
    return G.synthetic_records(spark.range(3000).withColumnRenamed("id", "k"), "k").cache()


def test_records_are_consistent(records):
    bad = records.where(
        ~F.array_contains("cam.apertures", F.col("aperture")) | ~F.array_contains("cam.isos", F.col("iso")) | ~F.array_contains("cam.focals", F.col("focal"))
        | ~F.col("place.lat").between(18.8, 71.5) | ~F.col("place.lon").between(-171, -66) | (F.abs(F.col("place.lat") - F.col("loc.lat")) > 0.3001)
        | (F.length("sub_sec") != 3) | ~F.col("altitude").between(0, 400) | ((F.col("program") == 1) != (F.col("exposure_mode") == 1))
        | ((F.col("cam.type") == "phone") & ((F.col("metering") != 5) | (F.col("program") != 2) | (F.col("dpi") != 72)))
        | F.col("lens_model").isNull() | (F.col("taken_at") > F.lit(G.AS_OF).cast("timestamp")) | (F.col("taken_at") < F.lit("2023-01-01").cast("timestamp"))
    )
    assert bad.count() == 0
    assert records.count() == 3000
    manual = records.agg(F.avg("white_balance")).first()[0]
    assert 0.2 < manual < 0.3


def test_records_do_not_depend_on_partitions(spark, records):
    again = G.synthetic_records(spark.range(3000).withColumnRenamed("id", "k").repartition(7), "k")
    columns = ["k", "lens_model", "taken_at", "place", "iso", "bias"]
    assert again.select(*columns).exceptAll(records.select(*columns)).count() == 0


def test_null_key_gets_no_record(spark):
    assert G.synthetic_records(spark.sql("select cast(null as bigint) as k"), "k").count() == 0


def test_empty_array_is_no_pick(spark):
    assert spark.range(1).select(pick(F.col("id"), "x", F.array().cast("array<int>"))).first()[0] is None
    assert spark.range(1000).where((unit(F.col("id"), "x") < 0) | (unit(F.col("id"), "x") >= 1)).count() == 0


def jpeg(*extra: tuple[int, bytes]) -> bytes:
    return b"\xff\xd8" + b"".join(bytes([0xFF, m]) + struct.pack(">H", len(d) + 2) + d for m, d in extra) + TINY_JPEG[2:]


def test_strip_keeps_the_picture():
    data = jpeg((0xE0, b"JFIF"), (0xE1, b"Exif\0\0junk"), (0xED, b"8BIM"), (0xFE, b"hello"))
    assert X.stripped(data) == jpeg((0xE0, b"JFIF"))
    assert X.picture_size(data) == (8, 16)


def test_big_endian_block():
    entry = struct.pack(">HHI", 271, 2, 6) + struct.pack(">I", 38)
    orient = struct.pack(">HHIHH", 274, 3, 1, 6, 0)
    tiff = b"MM\0*\0\0\0\x08" + struct.pack(">H", 2) + entry + orient + b"\0\0\0\0" + b"Canon\0"
    assert X.parsed(jpeg((0xE1, b"Exif\0\0" + tiff)))["ifd0"] == {"Make": "Canon", "Orientation": 6}


@pytest.mark.parametrize("data", [None, b"", b"junk", b"\xff\xd8\xff\xe1\xff\xff", jpeg((0xE1, b"Exif\0\0II*\0\xff\xff\xff\xff")), jpeg()])
def test_broken_bytes_are_no_tags(spark, data):
    df = spark.createDataFrame([(data,)], "content binary")
    assert df.select(X.read_tags("content").alias("t")).first()["t"] is None


def test_randomize_strip_and_keep_date(spark, tmp_path):
    items = spark.createDataFrame([("a", TINY_JPEG), ("b", b"broken"), ("c", None)], "item_id string, content binary")
    out = {r["item_id"]: r for r in W.randomized(items).collect()}
    assert out["a"]["error"] is None and out["a"]["fake"]["PixelYDimension"] == 16 and out["a"]["is_synthetic"]
    assert all(out[k]["error"] and out[k]["output"] is None and out[k]["fake"] is None for k in "bc")
    done = spark.createDataFrame([("a", bytes(out["a"]["output"]))], items.schema)
    kept = W.randomized(done, keep_date=True, seed=7).first()
    assert kept["fake"]["DateTimeOriginal"].date() == out["a"]["fake"]["DateTimeOriginal"].date()
    clean = {r["item_id"]: r for r in W.stripped_items(done.unionByName(items.where("item_id = 'b'"))).collect()}
    assert bytes(clean["a"]["output"]) == TINY_JPEG and clean["b"]["error"] and clean["b"]["output_name"] is None
    same = W.randomized(items).withColumn("output_name", F.lit("x.jpg"))
    images.export(same, str(tmp_path / "table"))
    assert spark.read.parquet(str(tmp_path / "table")).count() == 1
    assert [r["error"] for r in images.export_files(same, str(tmp_path)).collect()] == [None]
    assert (tmp_path / "a_x.jpg").read_bytes() == bytes(out["a"]["output"])


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jpg").write_bytes(TINY_JPEG)
    (tmp_path / "in/b.txt").write_bytes(b"text")
    items = images.load_items(spark, str(tmp_path / "in"))
    assert [(r["name"], r["mime"], r["size"]) for r in items.collect()] == [("a.jpg", "image/jpeg", len(TINY_JPEG))]
    names = images.stream_items(spark, str(tmp_path / "in")).select("name")
    query = names.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [r["name"] for r in spark.table("arrived").collect()] == ["a.jpg"]


def test_verified(spark):
    df = spark.createDataFrame([(1, 2), (None, 2), (None, None)], "a int, b int")
    got = [(r["verified"], r["parser"], r["warning"] is None, r["error"] is None) for r in R.verified(df, "a", "b").collect()]
    assert got == [(1, "primary", True, True), (2, "fallback", False, True), (None, None, True, False)]
    record = spark.range(1).select(F.struct(F.lit(1).alias("x"), F.lit(None).cast("int").alias("y")).alias("r"))
    assert record.select(R.has_fields(F.col("r"), ["x", "y"]), R.n_fields(F.col("r"), ["x", "y"]), R.overridden(F.col("r"), y=F.lit(5))["y"]).first()[:] == (True, 1, 5)
    nothing = spark.sql("select double('NaN') as FNumber, double(28) as FocalLength").select(F.struct("*").alias("record"))
    assert [(r["field"], r["text"]) for r in D.display_fields(nothing, "record", []).collect()] == [("FocalLength", "28mm")]


def test_status_order(spark):
    rows = [(True, "e", True, True), (False, "e", True, True), (False, None, True, True), (False, "", True, False), (None, None, None, None)]
    df = spark.createDataFrame(rows, "p boolean, e string, o boolean, f boolean")
    got = [r[0] for r in df.select(W.item_status(*map(F.col, "peof"))).collect()]
    assert got == ["Processing", "Error", "Randomized", "Stripped", "Loaded"]
    one = W.batch_summary(spark.createDataFrame([("Stripped",)], "status string")).first()
    assert one["summary"] == "1 image queued | 1 processed"
    assert W.batch_summary(spark.createDataFrame([], "status string")).first()["n_items"] == 0


def test_render_plan_and_pixels(spark):
    rng = np.random.default_rng(0)
    big, small = rng.integers(0, 256, (150, 200, 3), dtype=np.uint8), rng.integers(0, 256, (90, 90, 3), dtype=np.uint8)
    rows = [(i, (x.shape[0], x.shape[1], 3, x.tobytes())) for i, x in enumerate((big, small))]
    df = spark.createDataFrame([*rows, (2, (5, 5, 3, b"short"))], "k int, image struct<height:int,width:int,nChannels:int,data:binary>")
    plan = render_plan(df.withColumns({"w": F.col("image.width"), "h": F.col("image.height")}), "k", "w", "h")
    out = {r["k"]: r for r in rendered(plan, "k").collect()}
    p = out[0]["plan"]
    assert not p["bypass"] and 188 <= p["src_width"] <= 198 and p["out_width"] == p["src_width"] and 0.8 <= p["quality"] < 0.88 and abs(p["angle"]) <= 0.3
    assert len(out[0]["rendered"]["data"]) == p["out_width"] * p["out_height"] * 3
    assert out[1]["plan"]["bypass"] and bytes(out[1]["rendered"]["data"]) == small.tobytes()
    assert out[2]["rendered"]["data"] is None


def test_encoded_pictures_decode_to_themselves(spark, tmp_path):
    """The JVM's own decoder reads what the encoder wrote, in grey and colour, at odd sizes."""
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:61, 0:83]
    smooth = np.stack([np.sin(x / 20) * 60 + 128, np.cos(y / 30) * 80 + 128, x + y], axis=-1).clip(0, 255).astype(np.uint8)
    noise = rng.integers(0, 256, (40, 33, 3), dtype=np.uint8)
    flat = np.full((16, 16, 1), 128, np.uint8)
    rows = {"smooth": (smooth, 0.95, 3), "noise": (noise, 1.0, 3), "grey": (smooth[..., :1], 0.9, 3), "flat": (flat, 0.8, 0), "one": (noise[:1, :1], 0.99, 4)}
    for name, (pixels, quality, _) in rows.items():
        data = jpeg_codec.encoded(pixels, quality)
        assert X.picture_size(data) == pixels.shape[1::-1]
        (tmp_path / f"{name}.jpg").write_bytes(data)
    images_read = {r["image"]["origin"].split("/")[-1][:-4]: r["image"] for r in images.load_pixels(spark, str(tmp_path)).collect()}
    for name, (pixels, _, most) in rows.items():
        i = images_read[name]
        got = np.frombuffer(i["data"], np.uint8).reshape(i["height"], i["width"], i["nChannels"])
        assert got.shape == pixels.shape and np.abs(got.astype(int) - pixels).mean() <= most
    bad = spark.createDataFrame([(b"abc", 2, 2, 3, 0.8), (None, 1, 1, 1, 0.8), (b"a", 1, 1, 1, 0.8)], "d binary, w int, h int, c int, q double")
    assert [r[0] is None for r in bad.select(jpeg_codec.encode_jpeg("d", "w", "h", "c", "q")).collect()] == [True, True, False]


def test_code_lengths_are_limited_and_prefix_free():
    counts = np.zeros(256, np.int64)
    counts[:40] = [int(1.7**k) + 1 for k in range(40)]
    lengths = jpeg_codec.code_lengths(counts)
    assert set(lengths) == set(range(40)) and max(lengths.values()) <= 16
    assert sum(2.0**-n for n in lengths.values()) < 1
    code, size, _ = jpeg_codec.codes(lengths)
    words = [format(code[s], f"0{size[s]}b") for s in lengths]
    assert not any(a != b and b.startswith(a) for a in words for b in words) and "1" * 16 not in words


def test_from_pixels_to_verified_files(spark, tmp_path):
    """Files are loaded, decoded, rendered, encoded, tagged and read back, and the day of the original is kept."""
    y, x = np.mgrid[0:140, 0:180]
    picture = jpeg_codec.encoded(np.stack([x, y, x + y], axis=-1).astype(np.uint8), 0.9)
    source = tmp_path / "in"
    source.mkdir()
    first = W.randomized(spark.createDataFrame([("k", picture)], "item_id string, content binary")).first()
    (source / "a.jpg").write_bytes(bytes(first["output"]))
    (source / "b.jpg").write_bytes(picture)
    items, pixels = images.load_items(spark, str(source)), images.load_pixels(spark, str(source))
    both = pixels.join(items.select("item_id", "content", "name"), "item_id")
    assert both.count() == 2
    out = {r["name"]: r for r in W.reencoded(both, keep_date=True, seed=5).collect()}
    for r in out.values():
        assert r["error"] is None and r["parser"] == "primary" and r["warning"] is None and r["message"].endswith(f" | {r['city']}")
        data = bytes(r["output"])
        assert X.picture_size(data) == (r["plan"]["out_width"], r["plan"]["out_height"]) == (r["fake"]["PixelXDimension"], r["fake"]["PixelYDimension"])
    assert out["a.jpg"]["fake"]["DateTimeOriginal"].date() == first["fake"]["DateTimeOriginal"].date()
    broken = both.withColumn("image", F.col("image").withField("data", F.lit(None).cast("binary")))
    assert all(r["error"] and r["output"] is None for r in W.reencoded(broken).collect())
    bare = W.stripped_images(both)
    assert bare.select(X.read_tags("output").isNull().alias("bare"), (F.col("error").isNull() & F.col("output_name").isNotNull()).alias("good")).distinct().collect() == [(True, True)]
    assert all(r["error"] and r["output"] is None and r["output_name"] is None for r in W.stripped_images(broken).collect())
    found = {r["name"]: r for r in images.hydrated(items).collect()}
    assert found["a.jpg"]["record"]["Make"] == first["fake"]["Make"] and found["b.jpg"]["record"] is None and found["b.jpg"]["iptc"] is None


def test_second_reader(spark):
    """It reads what the first one reads, and bytes whose segments are broken, which give a warning."""
    out = W.randomized(spark.createDataFrame([(str(k), TINY_JPEG) for k in range(40)], "item_id string, content binary"))
    assert out.select(X.read_tags("output").alias("a"), X.search_tags("output").alias("b")).where("a != b or a is null").count() == 0
    data = bytes(out.first()["output"])
    damaged = data[:2] + b"\0\0" + data[2:]
    df = spark.createDataFrame([(damaged,), (data,), (b"junk",), (None,), (b"Exif\0\0II*\0",)], "content binary")
    read = R.verified(df.select(X.read_tags("content").alias("a"), X.search_tags("content").alias("b")), "a", "b").collect()
    assert [r["parser"] for r in read] == ["fallback", "primary", None, None, None]
    assert read[0]["warning"] and read[1]["warning"] is None and read[2]["error"]
    assert read[0]["verified"] == read[1]["verified"]


def test_iptc(spark):
    dataset = lambda n, text: b"\x1c\x02" + bytes([n]) + struct.pack(">H", len(text)) + text
    body = dataset(80, b"A. Writer") + dataset(25, b"one") + dataset(25, b"two") + dataset(90, "Zürich".encode()) + b"\x1c\x01\x5a\0\x03\x1b%G"
    resource = b"8BIM" + struct.pack(">H", 0x0404) + b"\0\0" + struct.pack(">I", len(body)) + body + b"\0" * (len(body) % 2)
    other = b"8BIM" + struct.pack(">H", 0x03ED) + b"\x03abc" + struct.pack(">I", 3) + b"xyz\0"
    data = jpeg((0xED, b"Photoshop 3.0\0" + other + resource))
    df = spark.createDataFrame([(data,), (TINY_JPEG,), (None,), (b"junk",), (jpeg((0xED, b"Photoshop 3.0\x008BIM\4\4\0\0\0\0\xff\xff")),)], "content binary")
    got = [r[0] for r in df.select(X.read_iptc("content")).collect()]
    assert got[0]["Byline"] == "A. Writer" and got[0]["Keywords"] == ["one", "two"] and got[0]["City"] == "Zürich" and got[0]["Caption"] is None
    assert got[1:] == [None] * 4


def test_noise_and_sampling():
    flat = np.full((40, 60, 4), 100, np.uint8)
    noisy = with_noise(flat, np.random.default_rng(1))
    assert set(np.unique(noisy[..., :3])) == {99, 100, 101} and (noisy[..., 3] == 100).all()
    assert 0.45 < (noisy[..., :3] == 100).mean() < 0.55
    plan = {"out_width": 30, "out_height": 20, "angle": 0.2, "crop_left": 1, "crop_top": 1, "src_width": 58, "src_height": 38}
    assert (sampled(flat, plan) == 100).all() and sampled(flat, plan).shape == (20, 30, 4)


def test_streams(spark, tmp_path):
    rows = [(1, 1, "2024-01-01 00:00:00", "load", "Loaded"), (1, 2, "2024-01-01 00:01:00", "randomize", "Randomized"), (2, 3, "2024-01-01 00:02:00", "load", "Error"), (2, 4, "2024-01-02 00:00:00", "load", "Loaded")]
    ops = spark.createDataFrame(rows, "item_id int, op_id int, ts string, op string, status string").withColumn("ts", F.col("ts").cast("timestamp"))
    ops.write.parquet(str(tmp_path / "ops"))
    stream = spark.readStream.schema(ops.schema).parquet(str(tmp_path / "ops"))
    stream_states(stream).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in spark.table("states").collect()} == {(1, "Randomized"), (2, "Loaded")}
    windowed_operations(stream).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r["op"], r["n"], r["n_failed"]) for r in spark.table("windows").collect()} == {("load", 2, 1), ("randomize", 1, 0)}
