"""Records of tags: flattening for display, overriding, and the check of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from apertura.functions import scalars as S


def display_fields_of(tags: Column) -> dict[str, Column]:
    """The fields that are shown of a record of tags (``ifd0, exif, gps``): texts without padding, rationals as numbers, degrees signed."""
    z, e, g = (lambda n: tags["ifd0"][n]), (lambda n: tags["exif"][n]), (lambda n: tags["gps"][n])
    text, number = S.clean_text, S.from_rational
    up = number(g("GPSAltitude"))
    none = F.lit(None).cast("int")
    return {
        "Make": text(z("Make")), "Model": text(z("Model")), "Software": text(z("Software")), "LensMake": text(e("LensMake")), "LensModel": text(e("LensModel")),
        "DateTimeOriginal": text(e("DateTimeOriginal")), "DateTime": text(z("DateTime")), "SubSecTimeOriginal": text(e("SubSecTimeOriginal")),
        "ExposureTime": number(e("ExposureTime")), "FNumber": number(e("FNumber")), "ISO": e("ISOSpeedRatings"),
        "FocalLength": number(e("FocalLength")), "FocalLengthIn35mmFormat": e("FocalLengthIn35mmFilm"),
        "Flash": e("Flash"), "MeteringMode": e("MeteringMode"), "ExposureProgram": e("ExposureProgram"), "ExposureMode": e("ExposureMode"),
        "WhiteBalance": e("WhiteBalance"), "SceneCaptureType": e("SceneCaptureType"), "SensingMethod": e("SensingMethod"), "Orientation": z("Orientation"), "ColorSpace": e("ColorSpace"),
        "XResolution": number(z("XResolution")), "YResolution": number(z("YResolution")),
        "GPSLatitude": S.from_dms(g("GPSLatitude"), text(g("GPSLatitudeRef"))), "GPSLongitude": S.from_dms(g("GPSLongitude"), text(g("GPSLongitudeRef"))),
        "GPSAltitude": F.when(g("GPSAltitudeRef") == 1, -up).otherwise(up),
        "PixelXDimension": e("PixelXDimension"), "PixelYDimension": e("PixelYDimension"), "ImageWidth": none, "ImageHeight": none,
    }


def display_from_tags(tags: Column, dates: bool = False, **instead: Column) -> Column:
    """A record of tags as one struct of shown fields, null for a null record.

    With ``dates`` the EXIF date texts become timestamps (null if they are none); ``instead`` replaces fields.
    """
    fields = display_fields_of(tags)
    if dates:
        fields |= {n: F.try_to_timestamp(fields[n], F.lit("yyyy:MM:dd HH:mm:ss")) for n in ("DateTimeOriginal", "DateTime")}
    return F.when(tags.isNotNull(), F.struct(*[c.alias(name) for name, c in (fields | instead).items()]))


def overridden(record: Column, **values: Column) -> Column:
    """The record with some fields replaced; a null record stays null."""
    for name, value in values.items():
        record = record.withField(name, value)
    return record


def verified(df: DataFrame, primary: str, fallback: str, primary_error: Column | None = None) -> DataFrame:
    """``df`` with ``verified`` (what the first reader found, else the second), ``parser``, ``warning`` and ``error``."""
    reason = F.lit("no fields") if primary_error is None else F.coalesce(primary_error, F.lit("no fields"))
    first, second = F.col(primary).isNotNull(), F.col(fallback).isNotNull()
    return df.withColumns(
        {
            "verified": F.coalesce(primary, fallback),
            "parser": F.when(first, "primary").when(second, "fallback"),
            "warning": F.when(~first & second, F.concat(F.lit("read back by the fallback only: "), reason)),
            "error": F.when(~first & ~second, F.concat(F.lit("metadata verification failed: "), reason)),
        }
    )


def n_fields(record: Column, names: list[str]) -> Column:
    """How many of the record's fields are there; none of a null record's are."""
    return sum((F.coalesce(record[n].isNotNull().cast("int"), F.lit(0)) for n in names), F.lit(0))


def has_fields(record: Column, names: list[str]) -> Column:
    """Whether any of the record's fields is there."""
    return n_fields(record, names) > 0
