import datetime as dt

import pytest
from pyspark.sql import functions as F

from apertura.functions import scalars as S
from apertura.functions.display import code_label, shown


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def triple(rows):
    return rows and [(r["num"], r["den"]) for r in rows]


@pytest.mark.parametrize(
    ("deg", "want"),
    [
        (40.7128, (40, 42, 46080)), (-74.006, (74, 0, 21600)), (21.3069, (21, 18, 24840)), (61.2181, (61, 13, 5160)), (-157.8583, (157, 51, 29880)),
        (33.749, (33, 44, 56400)), (0.0, (0, 0, 0)), (40.05, (40, 2, 60000)),
    ],
)
def test_degrees_to_parts(spark, deg, want):
    assert triple(value(spark, S.to_dms(F.lit(deg)))) == list(zip(want, (1, 1, 1000), strict=True))


def test_parts_to_degrees(spark):
    dms = lambda *parts: F.array(*[S.rational(F.lit(n), d) for n, d in parts])
    assert value(spark, S.from_dms(dms((40, 1), (2, 1), (60000, 1000)), F.lit("N"))) == pytest.approx(40.05)
    assert value(spark, S.from_dms(dms((74, 1), (0, 1), (21600, 1000)), F.lit("W"))) == pytest.approx(-74.006)
    assert value(spark, S.from_dms(dms((74, 1), (0, 1)), F.lit("W"))) is None
    assert value(spark, S.from_dms(dms((74, 1), (0, 0), (1, 1)), F.lit("W"))) is None
    assert value(spark, S.to_dms(F.lit(None).cast("double"))) is None
    assert value(spark, S.to_dms(F.lit(float("nan")))) is None


def test_rationals(spark):
    assert value(spark, S.from_rational(S.rational(F.lit(1), 0))) is None
    assert value(spark, S.from_rational(S.rational(F.lit(1), 4))) == 0.25
    assert [value(spark, S.f_number(F.lit(f))["num"]) for f in (1.78, 2.2, 11.0)] == [178, 220, 1100]


@pytest.mark.parametrize(("n", "want"), [(0, "0 B"), (1023, "1023 B"), (1024, "1.0 KB"), (1280, "1.3 KB"), (1536, "1.5 KB"), (1048575, "1024.0 KB"), (1048576, "1.00 MB"), (5242880, "5.00 MB"), (None, None)])
def test_bytes(spark, n, want):
    assert value(spark, S.bytes_text(F.lit(n).cast("bigint"))) == want


@pytest.mark.parametrize(("w", "h", "edge", "want"), [(4032, 3024, 2048, (2048, 1536)), (3000, 2000, 2400, (2400, 1600)), (100, 50, 2048, (100, 50)), (10000, 1, 2048, (2048, 1)), (10, 20, None, (10, 20))])
def test_export_size(spark, w, h, edge, want):
    assert tuple(value(spark, S.export_size(F.lit(w), F.lit(h), F.lit(edge).cast("int")))) == want


def test_apex(spark):
    shutters = [1 / 8000, 1 / 4000, 1 / 60, 1 / 15, 1.0, 4.0]
    assert [value(spark, S.apex_shutter(F.lit(s))["num"]) for s in shutters] == [1297, 1197, 591, 391, 0, -200]
    apertures = [1.2, 1.4, 1.5, 1.68, 1.78, 1.8, 2.2, 2.8, 5.6, 11.0, 16.0]
    assert [value(spark, S.apex_aperture(F.lit(a))["num"]) for a in apertures] == [53, 97, 117, 150, 166, 170, 228, 297, 497, 692, 800]
    assert value(spark, S.apex_shutter(F.lit(0.0))) is None


@pytest.mark.parametrize(
    ("field", "given", "want"),
    [
        ("ExposureTime", 1 / 8000, "1/8000s"), ("ExposureTime", 1 / 15, "1/15s"), ("ExposureTime", 1.0, "1s"), ("ExposureTime", 4.0, "4s"),
        ("FNumber", 1.78, "f/1.8"), ("FNumber", 1.68, "f/1.7"), ("FNumber", 2.2, "f/2.2"), ("FNumber", 11.0, "f/11.0"), ("FocalLength", 50.0, "50mm"),
        ("GPSLatitude", 40.05, "40.050000 deg"), ("GPSAltitude", 12.0, "12.0 m"), ("XResolution", 72.0, "72 DPI"), ("PixelXDimension", 8, "8 px"), ("Make", "Canon", "Canon"),
        ("Flash", 16, "Flash off"), ("Flash", 99, "Code 99"), ("MeteringMode", 5, "Multi-segment"), ("MeteringMode", 99, "Mode 99"), ("WhiteBalance", 0, "Auto"), ("WhiteBalance", 7, "7"),
    ],
)
def test_shown(spark, field, given, want):
    assert value(spark, shown(field, F.lit(given))) == want


def test_no_code_no_label(spark):
    assert value(spark, code_label("Flash", F.lit(None).cast("int"))) is None


@pytest.mark.parametrize(
    ("text", "want"),
    [("2024:02:31", dt.date(2024, 3, 2)), ("taken 2024:01:05 10:00:00", dt.date(2024, 1, 5)), ("2023:13:01", dt.date(2024, 1, 1)), ("0050:01:01", dt.date(1950, 1, 1)), ("no date", None), (None, None)],
)
def test_rolled_date(spark, text, want):
    assert value(spark, S.rolled_date(F.lit(text).cast("string"))) == want


def test_texts(spark):
    assert value(spark, S.escaped_html(F.lit("a<b>&\"'"))) == "a&lt;b&gt;&amp;&quot;&#39;"
    assert value(spark, S.escaped_html(F.lit(None).cast("string"))) == ""
    assert value(spark, S.clean_text(F.lit("Canon\0\0"))) == "Canon"
    assert value(spark, S.pad(F.lit(1234), 3)) == "1234"
    assert value(spark, S.pad(F.lit(7), 3)) == "007"
    assert value(spark, S.first_given(F.lit(""), F.lit(None).cast("string"), F.lit("x"))) == "x"


@pytest.mark.parametrize(
    ("name", "want"), [("a.jpg", ("a", ".jpg")), ("a.b.jpg", ("a.b", ".jpg")), (".jpg", (".jpg", ".jpg")), ("", ("image", ".jpg")), (None, ("image", ".jpg")), ("noext", ("noext", ""))]
)
def test_split_name(spark, name, want):
    assert tuple(value(spark, S.split_name(F.lit(name).cast("string")))) == want


@pytest.mark.parametrize(
    ("url", "want"),
    [
        ("data:image/jpeg;base64,AQID", ("image/jpeg", b"\x01\x02\x03", None)), ("data:,a%20b+c", ("application/octet-stream", b"a b+c", None)),
        ("nope", (None, None, "Invalid output image data")), (None, (None, None, "Invalid output image data")), ("data:x;base64,@@@", ("x", None, "Invalid output image data")),
    ],
)
def test_data_url(spark, url, want):
    got = value(spark, S.data_url_parts(F.lit(url).cast("string")))
    assert (got["mime"], got["content"] and bytes(got["content"]), got["error"]) == want


def test_data_url_round_trip(spark):
    content = bytes(range(256)) * 2
    url = S.data_url(F.lit("image/png"), F.lit(content))
    assert bytes(value(spark, S.data_url_parts(url))["content"]) == content


def test_map_url(spark):
    none, link = F.lit(None).cast("string"), "https://maps.google.com/?q="
    assert value(spark, S.map_url(F.lit(1.5), F.lit(2.0), none, none)) == link + "1.5,-2"
    assert value(spark, S.map_url(F.lit(1.5), F.lit(2.0), F.lit("S"), F.lit("E"))) == link + "-1.5,2"
    assert value(spark, S.map_url(F.lit(None).cast("double"), F.lit(2.0), F.lit("S"), none)) is None


def test_clamp_keeps_null(spark):
    assert value(spark, S.clamp(F.lit(None).cast("double"), 1.0, 2.0)) is None
    assert value(spark, S.clamp(F.lit(9.0), 5.0, 2.0)) == 2.0
