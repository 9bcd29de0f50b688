"""The queries over the tables of a folder; catalogue_sql has the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from apertura.functions import display as D
from apertura.functions import scalars as S
from apertura.functions.containers import KINDS, build_file, file_kind, read_file_tags
from apertura.functions.exif_bytes import read_tags
from apertura.functions.jpeg import encode_jpeg, encode_jpeg_halved
from apertura.functions.jpeg_read import decode_jpeg, largest_difference
from apertura.operators import generate as G
from apertura.operators import records as R
from apertura.operators import workflow as W
from apertura.operators.asof import asof_join
from apertura.operators.pixels import rendered
from apertura.operators.sequence import load_order
from apertura.operators.sequence import unique_names as unique_file_names
from apertura.plans.render import render_plan
from apertura.sources import dims
from apertura.sources.images import item_id

#: The smallest JPEG that has a picture size (8 x 16) and no metadata, for the byte round trip.
TINY_JPEG = bytes.fromhex("ffd8ffc0000b080010000801011100ffda0008010100003f00ffd9")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread_keys(spark: SparkSession, sf_dir: str, name: str, key: str, tasks: int = 1) -> DataFrame:
    """A table's keys, spread over ``tasks`` partitions for each core: what is made of a key is much work for eight bytes, and a small table is one partition.

    With a number, as adaptive execution would join so small partitions into one again.
    """
    return table(spark, sf_dir, name).select(key).repartition(tasks * spark.sparkContext.defaultParallelism, key)


def _order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spread_keys(spark, sf_dir, "orders", "o_orderkey")


def cameras_by_make(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dims.cameras(spark).groupBy("make", "type").agg(F.count("*").alias("n"), F.min(F.array_min("apertures")).alias("widest"))


def camera_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = dims.cameras(spark)
    seconds = F.transform("shutters", lambda s: s["num"] / s["den"])
    kinds = {"aperture": F.col("apertures"), "iso": F.col("isos"), "shutter": seconds, "focal": F.col("focals")}
    options = F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("array<double>").alias("options")) for k, v in kinds.items()])
    return cams.select("camera_id", F.inline(options)).select("camera_id", "kind", F.posexplode("options").alias("place", "option"))


def lens_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.lens_matches(spark)


def lens_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.unmatched_focals(spark)


def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").where(F.col("event_type").startswith("p")).select("event_id", "event_type")


def bytes_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("n_chars") * 97
    return table(spark, sf_dir, "documents").select("doc_id", size.alias("size"), S.bytes_text(size).alias("shown"))


def _degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 100).alias("deg")).withColumn("dms", S.to_dms(F.col("deg")))


def dms_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = lambda i: F.get("dms", F.lit(i))["num"]
    return _degrees(spark, sf_dir).select("c_custkey", part(0).alias("degrees"), part(1).alias("minutes"), part(2).alias("thousandths"))


def dms_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _degrees(spark, sf_dir).select("c_custkey", S.from_dms(F.col("dms"), F.when(F.col("deg") < 0, "S").otherwise("N")).alias("decoded"))


def rational_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = S.from_rational(S.rational(F.col("l_quantity"), F.col("l_linenumber") - 1))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", value.alias("decoded"))


def exif_datetimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, time = F.col("ts"), S.gps_time(F.col("ts"))
    return table(spark, sf_dir, "events").select(
        "event_id", S.exif_datetime(ts).alias("stamp"), S.gps_date(ts).alias("gps_date"), *[F.get(time, F.lit(i))["num"].alias(n) for i, n in enumerate(("h", "m", "s"))]
    )


def keep_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = S.exif_datetime(F.col("o_orderdate"))
    day = S.rolled_date(S.first_given(F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(text), text))
    return table(spark, sf_dir, "orders").select("o_orderkey", S.exif_datetime(G.same_day(day, F.col("o_orderkey"))).alias("stamp"))


def rolled_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_orderkey") + F.col("l_linenumber")
    text = F.concat_ws(":", (2000 + n % 30).cast("string"), S.pad(n % 14, 2), S.pad(n % 33, 2))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("given"), F.date_format(S.rolled_date(text), "yyyy-MM-dd").alias("day"))


def apex_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    cams = dims.cameras(spark)
    shutter = cams.select("camera_id", F.lit("shutter").alias("kind"), F.explode("shutters").alias("s")).select("camera_id", "kind", S.from_rational(F.col("s")).alias("option"))
    aperture = cams.select("camera_id", F.lit("aperture").alias("kind"), F.explode("apertures").alias("option"))
    both = shutter.unionByName(aperture)
    apex = F.when(F.col("kind") == "shutter", S.apex_shutter(F.col("option"))).otherwise(S.apex_aperture(F.col("option")))
    return both.withColumns({"apex": apex["num"], "number": S.f_number(F.col("option"))["num"]})


def export_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.floor("p_retailprice") * 3).cast("int").alias("h"))
    return render_plan(sized, "p_partkey", "w", "h").select("p_partkey", "w", "h", "plan.*")


def synthetic_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = G.synthetic_records(_order_keys(spark, sf_dir), "o_orderkey")
    return rec.select(
        "o_orderkey", "cam.make", "cam.model", "cam.software", "lens_model", S.exif_datetime(F.col("taken_at")).alias("stamp"), "sub_sec",
        F.col("shutter.num").alias("shutter_num"), F.col("shutter.den").alias("shutter_den"), "aperture", "iso", "focal", "flash", "metering", "program", "exposure_mode",
        "white_balance", "dpi", "loc.city", "place.lat", "place.lon", "altitude", "is_synthetic",
    )


def tag_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = G.synthetic_records(_order_keys(spark, sf_dir), "o_orderkey").select("o_orderkey", G.tag_record().alias("t"))
    num = lambda c, i: F.get(F.col(c), F.lit(i))["num"]
    return rec.select(
        "o_orderkey", F.col("t.exif.FNumber.num").alias("f_num"), F.col("t.exif.FocalLength.num").alias("focal_num"),
        F.col("t.exif.ExposureBiasValue.num").alias("bias_num"), F.col("t.exif.ExposureBiasValue.den").alias("bias_den"),
        F.col("t.exif.ShutterSpeedValue.num").alias("shutter_apex"), F.col("t.exif.ApertureValue.num").alias("aperture_apex"), F.col("t.exif.MaxApertureValue.num").alias("widest_apex"),
        *[num("t.gps.GPSLatitude", i).alias(f"lat_{i}") for i in range(3)], *[num("t.gps.GPSLongitude", i).alias(f"lon_{i}") for i in range(3)],
        F.col("t.gps.GPSAltitude.num").alias("altitude"), F.col("t.gps.GPSDateStamp").alias("gps_date"), *[num("t.gps.GPSTimeStamp", i).alias(f"time_{i}") for i in range(3)],
    )


def exif_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written into JPEG bytes and read back from them."""
    items = _order_keys(spark, sf_dir).select(F.col("o_orderkey").alias("item_id"), F.lit(TINY_JPEG).alias("content"))
    out = W.randomized(items)
    names = ("Make", "Model", "LensModel", "ISO", "FNumber", "FocalLength", "ExposureTime", "GPSLatitude", "GPSLongitude", "GPSAltitude", "PixelXDimension", "PixelYDimension")
    return out.select(F.col("item_id").alias("o_orderkey"), *[F.col(f"fake.{n}").alias(n) for n in names], S.exif_datetime(F.col("fake.DateTimeOriginal")).alias("stamp"), "output_name", "error")


def enforce_gps(spark: SparkSession, sf_dir: str) -> DataFrame:
    base, by = F.col("c_acctbal"), lambda x, y: x / F.lit(y)
    tags = G.gps_tags(by(base, 40.0), by(-base, 25.0), by(base, 7.0))
    num = lambda c, i: F.get(c, F.lit(i))["num"]
    return table(spark, sf_dir, "customer").select(
        "c_custkey", *[num(tags["GPSLatitude"], i).alias(f"lat_{i}") for i in range(3)], *[num(tags["GPSLongitude"], i).alias(f"lon_{i}") for i in range(3)],
        tags["GPSLatitudeRef"].alias("lat_ref"), tags["GPSLongitudeRef"].alias("lon_ref"), tags["GPSAltitude"]["num"].alias("altitude"),
    )


def code_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = (F.col("event_id") % 32).cast("int")
    fields = sorted({field for field, _, _ in dims.CODES})
    return table(spark, sf_dir, "events").select("event_id", *[D.code_label(f, code).alias(f) for f in fields])


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.synthetic_records(_order_keys(spark, sf_dir), "o_orderkey").withColumn("record", G.display_record())


def display_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.display_fields(_records(spark, sf_dir), "record", ["o_orderkey"])


def field_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.field_counts(_records(spark, sf_dir), "record", ["o_orderkey"])


def html_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh record is missing and every eleventh is empty, as files without metadata are."""
    k = F.col("o_orderkey")
    rec = _records(spark, sf_dir)
    kind = rec.schema["record"].dataType
    empty = F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in kind])
    return D.as_html(rec.withColumn("record", F.when(k % 7 == 0, F.lit(None).cast(kind)).when(k % 11 == 0, empty).otherwise(F.col("record"))), "record", ["o_orderkey"])


def pixel_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a picture size, replaced in every fifth, as they are shown."""
    size = F.col("p_size")
    record = F.struct((size * 100).alias("PixelXDimension"), (size * 75).alias("PixelYDimension"))
    record = F.when(F.col("p_partkey") % 5 == 0, R.overridden(record, PixelXDimension=size * 200)).otherwise(record)
    sized = table(spark, sf_dir, "part").select("p_partkey", record.alias("record"))
    return D.display_fields(sized, "record", ["p_partkey"]).select("p_partkey", "field", "label", "text")


def degree_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places given as degrees, minutes and seconds."""
    part = lambda x, k: F.array(*[(F.abs(x) % m).cast("double") for m in (90, 60, 50)][:k])
    record = F.struct(part(F.col("c_custkey"), 3).alias("GPSLatitude"), part(F.col("c_nationkey"), 3).alias("GPSLongitude"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", record.alias("record"))
    return rows.select("c_custkey", D.shown_degrees(F.col("record.GPSLatitude")).alias("lat"), D.shown_degrees(F.col("record.GPSLongitude")).alias("lon"))


def item_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", item_id(F.col("url")).alias("item_id"), S.image_type(F.concat(F.when(F.col("page_id") % 3 != 0, "image/").otherwise("text/"), F.lit("png"))).alias("is_image"))


def strip_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata is written into JPEG bytes and taken out again; every seventh row is no JPEG."""
    items = _order_keys(spark, sf_dir).select(F.col("o_orderkey").alias("item_id"), F.lit(TINY_JPEG).alias("content"))
    done = W.randomized(items).select("item_id", F.when(F.col("item_id") % 7 == 0, F.lit(b"none")).otherwise(F.col("output")).alias("content"))
    out = W.stripped_items(done)
    return out.select(F.col("item_id").alias("o_orderkey"), F.lower(F.hex("output")).alias("output"), read_tags("output").isNull().alias("bare"), "output_name", "error")


def _pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``item_id, image``: for each supplier a colour gradient of 130 by 90 to 129; every ninth has no pixels."""
    k = F.col("s_suppkey")
    side = (90 + k % 40).cast("int")
    hexed = lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")
    row = F.transform(F.sequence(F.lit(0), F.lit(129)), lambda x: F.concat(hexed(40 + x), hexed(200 - x), hexed(90 + k % 60)))
    data = F.unhex(F.repeat(F.array_join(row, ""), side))
    image = F.struct(F.lit(130).alias("width"), side.alias("height"), F.lit(3).alias("nChannels"), F.when(k % 9 != 0, data).alias("data"))
    return _spread_keys(spark, sf_dir, "supplier", "s_suppkey", 4).select(k.alias("item_id"), image.alias("image"))


def reencoded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures rendered, encoded, tagged and read back: the size by their tags and as decoded. Those under 100 after the crop aren't rendered."""
    out = W.reencoded(_pictures(spark, sf_dir)).withColumn("seen", decode_jpeg("output"))
    shown = {"seen_width": F.col("seen.width"), "seen_height": F.col("seen.height"), "channels": F.col("seen.nChannels"), "bypass": F.col("plan.bypass")}
    return out.select(
        F.col("item_id").alias("s_suppkey"), F.col("fake.PixelXDimension").alias("width"), F.col("fake.PixelYDimension").alias("height"), *[c.alias(n) for n, c in shown.items()], "parser", "warning", "message", "error"
    )


def decoded_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures cropped, turned and noised, encoded (chrominance halved in every second) and decoded: no byte is off by more than 16."""
    k = F.col("item_id")
    df = _pictures(spark, sf_dir).withColumns({"w": F.col("image.width"), "h": F.col("image.height")})
    df = rendered(render_plan(df, "item_id", "w", "h"), "item_id")
    given = [F.col(f"rendered.{n}") for n in ("data", "width", "height", "channels")]
    files = df.withColumn("file", F.when(k % 2 == 0, encode_jpeg_halved(*given, F.col("plan.quality"))).otherwise(encode_jpeg(*given, F.col("plan.quality"))))
    seen = files.withColumn("seen", decode_jpeg("file")).withColumn("off", largest_difference("seen.data", "rendered.data"))
    size = [F.col(f"seen.{n}").alias(m) for n, m in (("width", "width"), ("height", "height"), ("nChannels", "channels"))]
    return seen.select(k.alias("s_suppkey"), *size, (F.col("off") <= 16).alias("close"), (F.col("rendered.data") == F.col("image.data")).alias("untouched"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    ops = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", (kind == "click").alias("processing"), F.when(kind == "error", "failed").alias("error"), kind.isin("purchase", "signup").alias("has_output"), (kind == "purchase").alias("has_fake")
    )
    last = W.latest_state(ops, "user_id", ["ts", "event_id"], ["processing", "error", "has_output", "has_fake"])
    return last.select("user_id", W.item_status(F.col("processing"), F.col("error"), F.col("has_output"), F.col("has_fake")).alias("status"))


def item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.batch_summary(_states(spark, sf_dir))


def processed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir).where(F.col("status").isin("Randomized", "Stripped"))


def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rec = G.with_camera_and_city(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")
    make = F.when(F.col("o_orderkey") % 10 != 0, F.col("cam.make"))
    return rec.select("o_orderkey", G.output_name(F.coalesce(make, F.lit("")), F.col("o_orderkey")).alias("output_name"))


def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output names of orders, numbered where they repeat."""
    return unique_file_names(output_names(spark, sf_dir), "output_name", F.col("o_orderkey"))


def load_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events loaded in two batches, each in the order of its times; the second goes on after the first."""
    events = table(spark, sf_dir, "events").select("event_id", "ts")
    early = F.dayofmonth("ts") <= 15
    order = (F.col("ts").asc_nulls_first(), F.col("event_id"))
    first = load_order(events.where(early), *order)
    second = load_order(events.where(~early), *order, loaded=first)
    return first.unionByName(second).select("event_id", F.dayofmonth("ts").alias("day"), "load_seq")


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures (orders, a moment of January each) with the last event of their user up to then, at most two hours back."""
    k = F.col("o_orderkey")
    moment = F.timestamp_seconds(F.lit(1_704_067_200) + (k * 7919) % 2_592_000)
    pictures = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 150).alias("user_id"), moment.alias("ts"))
    points = table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    got = asof_join(pictures, points, "user_id", "ts", tolerance=7200)
    return got.select("o_orderkey", "user_id", F.col("matched.event_id").alias("event_id"))


def container_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as PNG, WebP, HEIC, TIFF and JPEG files in turn, and read back; every thirteenth file is cut off."""
    k = F.col("o_orderkey")
    rec = G.synthetic_records(_order_keys(spark, sf_dir), "o_orderkey").select("o_orderkey", G.tag_record().alias("tags"))
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (k % len(KINDS) + 1).cast("int"))
    files = rec.select("o_orderkey", kind.alias("kind"), build_file(kind, F.col("tags")).alias("content"))
    files = files.withColumn("content", F.when(k % 13 == 0, F.substring("content", 1, 30)).otherwise(F.col("content")))
    read = files.select("o_orderkey", "kind", file_kind("content").alias("found"), read_file_tags("content").alias("t"))
    return read.select("o_orderkey", "kind", "found", F.col("t.ifd0.Make").alias("make"), F.col("t.exif.ISOSpeedRatings").alias("iso"), F.get("t.gps.GPSLatitude", F.lit(0))["num"].alias("lat_0"))


def split_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.split("url", "/"), -1)
    return table(spark, sf_dir, "pages").select("page_id", S.split_name(name)["base"].alias("base"), S.split_name(name)["ext"].alias("ext"))


def escape_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", S.escaped_html(F.col("html")).alias("escaped"))


def data_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, kind = F.col("text"), F.col("turn") % 4
    url = (
        F.when(kind == 0, S.data_url(F.lit("text/plain"), text.cast("binary")))
        .when(kind == 1, F.concat(F.lit("data:;base64,"), S.base64_text(text.cast("binary"))))
        .when(kind == 2, F.concat(F.lit("data:text/x,a%20b+"), F.col("conv_id").cast("string")))
        .otherwise("nope")
    )
    parts = S.data_url_parts(url)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", parts["mime"].alias("mime"), parts["content"].cast("string").alias("content"), parts["error"].alias("error"))


def verify_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 5 != 0, -F.col("value")).alias("b"))
    return R.verified(read, "a", "b").select("event_id", "verified", "parser", "warning", "error")


def map_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (F.col("c_acctbal").cast("int") % 90).cast("double"), (F.col("c_custkey") % 180).cast("double")
    ref = lambda by, to: F.when(F.col("c_custkey") % by == 0, to)
    return table(spark, sf_dir, "customer").select("c_custkey", S.map_url(lat, lon, ref(3, "S"), ref(4, "E")).alias("map_url"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        synthetic_metadata, cameras_by_make, camera_options, lens_range_join, lens_unmatched, prefix_filter, bytes_texts, dms_encode, dms_round_trip, rational_decode, exif_datetimes,
        keep_date, rolled_dates, apex_values, export_plans, tag_values, exif_round_trip, enforce_gps, code_labels, display_fields, field_counts, html_records, item_status,
        batch_summary, processed_items, output_names, split_names, escape_html, data_urls, verify_fallback, map_links,
        pixel_sizes, degree_arrays, item_ids, strip_round_trip, reencoded_images, decoded_pixels, unique_names, load_sequence, container_tags, track_points,
    ]
    return {f.__name__: f for f in found}
