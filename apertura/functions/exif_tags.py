"""Numbers, types and columns of the tags that are read and written: those of the published EXIF 2.3 specification."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BYTE, ASCII, SHORT, LONG, RATIONAL, UNDEFINED, SRATIONAL = 1, 2, 3, 4, 5, 7, 10
WIDTH = {BYTE: 1, ASCII: 1, SHORT: 2, LONG: 4, RATIONAL: 8, UNDEFINED: 1, 9: 4, SRATIONAL: 8}
EXIF_POINTER, GPS_POINTER = 34665, 34853

# Tag numbers and types.
TAGS = {
    "ifd0": {
        "Make": (271, ASCII), "Model": (272, ASCII), "Orientation": (274, SHORT), "XResolution": (282, RATIONAL), "YResolution": (283, RATIONAL),
        "ResolutionUnit": (296, SHORT), "Software": (305, ASCII), "DateTime": (306, ASCII),
    },
    "exif": {
        "ExposureTime": (33434, RATIONAL), "FNumber": (33437, RATIONAL), "ExposureProgram": (34850, SHORT), "ISOSpeedRatings": (34855, SHORT),
        "ExifVersion": (36864, UNDEFINED), "DateTimeOriginal": (36867, ASCII), "DateTimeDigitized": (36868, ASCII), "ComponentsConfiguration": (37121, UNDEFINED),
        "ShutterSpeedValue": (37377, SRATIONAL), "ApertureValue": (37378, RATIONAL), "ExposureBiasValue": (37380, SRATIONAL), "MaxApertureValue": (37381, RATIONAL),
        "MeteringMode": (37383, SHORT), "Flash": (37385, SHORT), "FocalLength": (37386, RATIONAL),
        "SubSecTime": (37520, ASCII), "SubSecTimeOriginal": (37521, ASCII), "SubSecTimeDigitized": (37522, ASCII),
        "FlashpixVersion": (40960, UNDEFINED), "ColorSpace": (40961, SHORT), "PixelXDimension": (40962, LONG), "PixelYDimension": (40963, LONG),
        "SensingMethod": (41495, SHORT), "FileSource": (41728, UNDEFINED), "SceneType": (41729, UNDEFINED), "CustomRendered": (41985, SHORT),
        "ExposureMode": (41986, SHORT), "WhiteBalance": (41987, SHORT), "DigitalZoomRatio": (41988, RATIONAL), "FocalLengthIn35mmFilm": (41989, SHORT),
        "SceneCaptureType": (41990, SHORT), "Contrast": (41992, SHORT), "Saturation": (41993, SHORT), "Sharpness": (41994, SHORT),
        "LensMake": (42035, ASCII), "LensModel": (42036, ASCII),
    },
    "gps": {
        "GPSVersionID": (0, BYTE), "GPSLatitudeRef": (1, ASCII), "GPSLatitude": (2, RATIONAL), "GPSLongitudeRef": (3, ASCII), "GPSLongitude": (4, RATIONAL),
        "GPSAltitudeRef": (5, BYTE), "GPSAltitude": (6, RATIONAL), "GPSTimeStamp": (7, RATIONAL), "GPSMapDatum": (18, ASCII), "GPSDateStamp": (29, ASCII),
    },
}
TRIPLES = {"GPSLatitude", "GPSLongitude", "GPSTimeStamp"}
#: Tags that hold bytes, not a number.
RAW = {"GPSVersionID"}


PAIR = T.StructType([T.StructField("num", T.IntegerType()), T.StructField("den", T.IntegerType())])


def _type(name: str, kind: int) -> T.DataType:
    if kind == ASCII:
        return T.StringType()
    if kind == UNDEFINED or name in RAW:
        return T.BinaryType()
    if kind in (RATIONAL, SRATIONAL):
        return T.ArrayType(PAIR) if name in TRIPLES else PAIR
    return T.IntegerType()


def _struct(fields: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


#: The type of a record of tags.
TAG_TYPE = _struct({ifd: _struct({n: _type(n, k) for n, (_, k) in tags.items()}) for ifd, tags in TAGS.items()})
TAG_ARROW = to_arrow_type(TAG_TYPE)
