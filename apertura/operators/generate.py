"""Synthetic photographic metadata for any keyed table: one consistent record a row, marked as synthetic.

Everything is a chain of projections over three broadcast dimension tables; draws hang on the key, so a
record doesn't change with the partitioning and no shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from apertura.functions import scalars as S
from apertura.functions.draws import SEED, draw, pick, rand_int, unit
from apertura.sources import dims

AS_OF = "2025-01-01 00:00:00"
#: Days before ``AS_OF`` that dates are drawn from.
DAYS = 730
#: Choices of the drawn codes.
FLASH, METERING, PROGRAM, WHITE_BALANCE, DPI = (0, 16, 24), (2, 3, 5), (1, 2, 3, 4), (0, 0, 0, 1), (240, 300)
BIAS = ((0, 1), (0, 1), (0, 1), (1, 3), (-1, 3), (2, 3), (-2, 3), (1, 1), (-1, 1))


def lens_matches(spark: SparkSession) -> DataFrame:
    """``camera_id, model, focal, lens_id, lens_model``: every lens of a camera's make that covers one of its focal lengths (a range join)."""
    wanted = dims.cameras(spark).where("type = 'dslr'").select("camera_id", "make", "model", F.explode("focals").alias("focal"))
    lens = dims.lenses(spark).select("lens_id", F.col("make").alias("lens_make"), F.col("model").alias("lens_model"), "focal_lo", "focal_hi")
    fits = (F.col("make") == F.col("lens_make")) & F.col("focal").between(F.col("focal_lo"), F.col("focal_hi"))
    return wanted.join(F.broadcast(lens), fits).select("camera_id", "model", "focal", "lens_id", "lens_model")


def unmatched_focals(spark: SparkSession) -> DataFrame:
    """The focal lengths of cameras that no lens covers."""
    wanted = dims.cameras(spark).where("type = 'dslr'").select("camera_id", "model", F.explode("focals").alias("focal"))
    return wanted.join(F.broadcast(lens_matches(spark).select("camera_id", "focal").distinct()), ["camera_id", "focal"], "left_anti").select("camera_id", "model", "focal")


def lens_pools(spark: SparkSession) -> DataFrame:
    """``camera_id, focal, pool``: the lens names to draw from, in order; all of the make's where none covers the focal length."""
    ordered = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("lens_id", name))), lambda x: x[name]).alias("pool")
    fitting = lens_matches(spark).groupBy("camera_id", "focal").agg(ordered("lens_model"))
    of_make = dims.lenses(spark).groupBy("make").agg(ordered("model").alias("make_pool"))
    wanted = dims.cameras(spark).where("type = 'dslr'").select("camera_id", "make", F.explode("focals").alias("focal"))
    both = wanted.join(F.broadcast(fitting), ["camera_id", "focal"], "left").join(F.broadcast(of_make), "make", "left")
    return both.select("camera_id", "focal", F.coalesce("pool", "make_pool").alias("pool"))


def with_camera_and_city(df: DataFrame, key: str, seed: int = SEED) -> DataFrame:
    """``df`` with a drawn camera row ``cam`` and location row ``loc``."""
    spark, k = df.sparkSession, F.col(key)
    cam = dims.cameras(spark).select(F.col("camera_id").alias("__cam"), F.struct("*").alias("cam"))
    loc = dims.locations(spark).select(F.col("location_id").alias("__loc"), F.struct("*").alias("loc"))
    drawn = df.withColumns({"__cam": rand_int(k, "camera", 0, len(dims.CAMERAS) - 1, seed), "__loc": rand_int(k, "location", 0, len(dims.LOCATIONS) - 1, seed)})
    return drawn.join(F.broadcast(cam), "__cam").join(F.broadcast(loc), "__loc").drop("__cam", "__loc")


def random_date(key: Column, as_of: str = AS_OF, seed: int = SEED) -> Column:
    """A time in the ``DAYS`` days before ``as_of``, to the second."""
    return F.timestamp_seconds(F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.floor(unit(key, "date", seed) * DAYS * 86400))


def same_day(day: Column, key: Column, seed: int = SEED) -> Column:
    """A drawn time of day on the calendar day of ``day``."""
    seconds = rand_int(key, "hour", 0, 23, seed) * 3600 + rand_int(key, "minute", 0, 59, seed) * 60 + rand_int(key, "second", 0, 59, seed)
    return F.timestamp_seconds(F.unix_timestamp(F.date_trunc("day", day.cast("timestamp"))) + seconds)


def jittered(base: Column, key: Column, seed: int = SEED) -> Column:
    """``lat, lon`` up to 0.3 degrees from a place, six decimals, within bounds; latitudes lose their sign."""
    six = lambda x: F.floor(x * 1e6 + 0.5) / 1e6
    lat = F.abs(base["lat"] + (unit(key, "lat", seed) - 0.5) * 0.6)
    lon = base["lon"] + (unit(key, "lon", seed) - 0.5) * 0.6
    return F.struct(six(S.clamp(lat, *S.LAT_BOUNDS)).alias("lat"), six(S.clamp(lon, *S.LON_BOUNDS)).alias("lon"))


def synthetic_records(df: DataFrame, key: str, original_date: str | None = None, as_of: str = AS_OF, seed: int = SEED) -> DataFrame:
    """``df`` with the fields of a synthetic record.

    With ``original_date`` (a column) the calendar day of rows that have one is kept and only the time is
    drawn. Rows with a null key get no record. ``is_synthetic`` is true for all.
    """
    spark, k = df.sparkSession, F.col(key)
    df = with_camera_and_city(df.where(k.isNotNull()), key, seed)
    phone = F.col("cam.type") == "phone"
    date = random_date(k, as_of, seed)
    if original_date:
        date = F.coalesce(same_day(F.col(original_date), k, seed), date)
    df = df.withColumns(
        {
            "shutter": pick(k, "shutter", F.col("cam.shutters"), seed),
            "aperture": pick(k, "aperture", F.col("cam.apertures"), seed),
            "iso": pick(k, "iso", F.col("cam.isos"), seed),
            "focal": pick(k, "focal", F.col("cam.focals"), seed),
            "taken_at": date,
            "flash": pick(k, "flash", FLASH, seed),
            "metering": F.when(phone, 5).otherwise(pick(k, "metering", METERING, seed)),
            "program": F.when(phone, 2).otherwise(pick(k, "program", PROGRAM, seed)),
            "white_balance": pick(k, "white_balance", WHITE_BALANCE, seed),
            "place": jittered(F.col("loc"), k, seed),
            "dpi": F.when(phone, 72).otherwise(pick(k, "dpi", DPI, seed)),
            "sub_sec": S.pad(rand_int(k, "sub_sec", 10, 999, seed), 3),
            "altitude": rand_int(k, "altitude", 0, 400, seed),
            "bias": pick(k, "bias", F.array(*[S.rational(F.lit(n), d) for n, d in BIAS]), seed),
        }
    )
    pools = lens_pools(spark).select(F.col("camera_id").alias("__c"), F.col("focal").alias("__f"), "pool")
    df = df.join(F.broadcast(pools), (F.col("cam.camera_id") == F.col("__c")) & (F.col("focal") == F.col("__f")), "left").drop("__c", "__f")
    focal = F.concat(F.col("focal").cast("string"), F.lit("mm"))
    of_phone = F.concat(F.col("cam.model"), F.lit(" back camera "), focal, F.lit(" f/"), S.plain_number(F.col("aperture")))
    lens = F.when(phone, of_phone).otherwise(F.coalesce(F.get("pool", (draw(k, "lens", seed) % F.size("pool")).cast("int")), focal))
    return df.withColumns({"lens_model": lens, "exposure_mode": F.when(F.col("program") == 1, 1).otherwise(0), "is_synthetic": F.lit(True), "seed": F.lit(seed)}).drop("pool")


def display_record(width: Column | None = None, height: Column | None = None) -> Column:
    """The record of synthetic_records() as one struct under the names that are shown."""
    none = F.lit(None).cast("int")
    fields = {
        "Make": F.col("cam.make"), "Model": F.col("cam.model"), "Software": F.col("cam.software"), "LensMake": F.col("cam.make"), "LensModel": F.col("lens_model"),
        "DateTimeOriginal": F.col("taken_at"), "DateTime": F.col("taken_at"), "SubSecTimeOriginal": F.col("sub_sec"),
        "ExposureTime": S.from_rational(F.col("shutter")), "FNumber": F.col("aperture"), "ISO": F.col("iso"),
        "FocalLength": F.col("focal").cast("double"), "FocalLengthIn35mmFormat": F.col("focal"),
        "Flash": F.col("flash"), "MeteringMode": F.col("metering"), "ExposureProgram": F.col("program"), "ExposureMode": F.col("exposure_mode"),
        "WhiteBalance": F.col("white_balance"), "SceneCaptureType": F.lit(0), "SensingMethod": F.lit(2), "Orientation": F.lit(1), "ColorSpace": F.lit(1),
        "XResolution": F.col("dpi").cast("double"), "YResolution": F.col("dpi").cast("double"),
        "GPSLatitude": F.col("place.lat"), "GPSLongitude": F.col("place.lon"), "GPSAltitude": F.col("altitude").cast("double"),
        "PixelXDimension": none if width is None else width, "PixelYDimension": none if height is None else height,
        "ImageWidth": none, "ImageHeight": none,
    }
    return F.struct(*[c.alias(name) for name, c in fields.items()])


def tag_record(width: Column | None = None, height: Column | None = None) -> Column:
    """The record as ``ifd0, exif, gps`` structs of tag values, as they are written: rationals, codes, texts, bytes."""
    none = F.lit(None).cast("int")
    stamp, seconds, widest = S.exif_datetime(F.col("taken_at")), S.from_rational(F.col("shutter")), F.array_min("cam.apertures")
    lit, dpi, sub = F.lit, S.rational(F.col("dpi"), 1), F.col("sub_sec")
    ifd0 = {
        "Make": F.col("cam.make"), "Model": F.col("cam.model"), "Software": F.col("cam.software"), "DateTime": stamp,
        "XResolution": dpi, "YResolution": dpi, "ResolutionUnit": lit(2), "Orientation": lit(1),
    }
    exif = {
        "ExposureTime": F.col("shutter"), "FNumber": S.f_number(F.col("aperture")), "ISOSpeedRatings": F.col("iso"), "DateTimeOriginal": stamp, "DateTimeDigitized": stamp,
        "FocalLength": S.rational(F.col("focal") * 10, 10), "FocalLengthIn35mmFilm": F.col("focal"), "Flash": F.col("flash"), "MeteringMode": F.col("metering"),
        "ExposureProgram": F.col("program"), "WhiteBalance": F.col("white_balance"), "ColorSpace": lit(1), "ExposureBiasValue": F.col("bias"),
        "ShutterSpeedValue": S.apex_shutter(seconds), "ApertureValue": S.apex_aperture(F.col("aperture")), "MaxApertureValue": S.apex_aperture(widest),
        "ExifVersion": lit(b"0232"), "FlashpixVersion": lit(b"0100"), "ComponentsConfiguration": lit(b"\x01\x02\x03\x00"), "FileSource": lit(b"\x03"), "SceneType": lit(b"\x01"),
        "CustomRendered": lit(0), "ExposureMode": F.col("exposure_mode"), "SceneCaptureType": lit(0), "SensingMethod": lit(2),
        "SubSecTime": sub, "SubSecTimeOriginal": sub, "SubSecTimeDigitized": sub, "DigitalZoomRatio": S.rational(lit(100), 100),
        "Contrast": lit(0), "Saturation": lit(0), "Sharpness": lit(0), "LensMake": F.col("cam.make"), "LensModel": F.col("lens_model"),
        "PixelXDimension": none if width is None else width, "PixelYDimension": none if height is None else height,
    }
    gps = gps_tags(F.col("place.lat"), F.col("place.lon"), F.col("altitude"))
    gps |= {"GPSDateStamp": S.gps_date(F.col("taken_at")), "GPSTimeStamp": S.gps_time(F.col("taken_at")), "GPSMapDatum": lit("WGS-84")}
    struct = lambda tags: F.struct(*[c.alias(name) for name, c in tags.items()])
    return F.struct(struct(ifd0).alias("ifd0"), struct(exif).alias("exif"), struct(gps).alias("gps"))


def gps_tags(lat: Column, lon: Column, altitude: Column) -> dict[str, Column]:
    """GPS tags of a place held within the bounds: always north and west, altitude a whole number not below 0."""
    safe_lat = S.clamp(F.abs(lat), *S.LAT_BOUNDS)
    safe_lon = S.clamp(F.abs(lon), -S.LON_BOUNDS[1], -S.LON_BOUNDS[0])
    up = F.greatest(F.lit(0), S.half_up(F.coalesce(F.nanvl(altitude.cast("double"), F.lit(0.0)), F.lit(0.0)))).cast("int")
    return {
        "GPSVersionID": F.lit(bytes([2, 3, 0, 0])), "GPSLatitudeRef": F.lit("N"), "GPSLatitude": S.to_dms(safe_lat),
        "GPSLongitudeRef": F.lit("W"), "GPSLongitude": S.to_dms(safe_lon), "GPSAltitudeRef": F.lit(0), "GPSAltitude": S.rational(up, 1),
    }


def output_name(make: Column, key: Column, day: str = AS_OF, seed: int = SEED) -> Column:
    """A file name as the camera's make gives them; the day is a parameter, time and number are drawn, names may repeat."""
    seq = rand_int(key, "seq", 1000, 9999, seed).cast("string")
    two = lambda name, high: S.pad(rand_int(key, name, 0, high, seed), 2)
    stamp = F.concat(F.date_format(F.lit(day).cast("timestamp"), "yyyyMMdd"), F.lit("_"), two("name_hour", 23), two("name_minute", 59), two("name_second", 59))
    named = lambda prefix: F.concat(F.lit(prefix), seq, F.lit(".JPG"))
    return (
        F.when(make.isin("Apple", "Canon"), named("IMG_"))
        .when(make == "Samsung", F.concat(stamp, F.lit(".jpg")))
        .when(make == "Google", F.concat(F.lit("PXL_"), stamp, S.pad(rand_int(key, "name_ms", 0, 999, seed), 3), F.lit(".jpg")))
        .when(make == "Nikon", named("DSC_"))
        .when(make == "Sony", named("DSC0"))
        .when(make == "FUJIFILM", named("DSCF"))
        .otherwise(F.concat(F.lit("IMG_"), stamp, F.lit(".jpg")))
    )
