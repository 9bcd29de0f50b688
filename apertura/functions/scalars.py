"""Conversions of photographic metadata as column expressions: rationals, degrees, APEX, dates, names, sizes.

Rounding is half up (``floor(x + 0.5)``) throughout, whatever the sign; null in, null out unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bounds of latitude and longitude.
LAT_BOUNDS, LON_BOUNDS = (18.8, 71.5), (-171.0, -66.0)
#: Longest edges of exported images.
MAX_EDGES = (2048, 2160, 2400, 2560, 2880, 3200)


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def clamp(x: Column, low: Column | float, high: Column | float) -> Column:
    """The upper bound wins where the bounds cross."""
    low, high = (b if isinstance(b, Column) else F.lit(b) for b in (low, high))
    return F.when(x.isNotNull(), F.least(high, F.greatest(low, x)))


def fixed(x: Column, digits: int) -> Column:
    """Text with so many decimals, ties away from zero."""
    return x.cast(f"decimal(30,{digits})").cast("string")


def plain_number(x: Column) -> Column:
    """A double's text without a trailing ``.0``."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


def pad(x: Column, width: int) -> Column:
    """Zeros in front, up to ``width``; longer texts stay as they are."""
    text = x.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def rational(num: Column, den: Column | int) -> Column:
    den = den if isinstance(den, Column) else F.lit(den)
    return F.struct(num.cast("int").alias("num"), den.cast("int").alias("den"))


def from_rational(r: Column) -> Column:
    """Null where the denominator is 0 or a part is missing."""
    return F.when(r["den"] != 0, r["num"] / r["den"])


def to_dms(deg: Column) -> Column:
    """Degrees, minutes and thousandths of seconds as rationals; seconds may round up to 60, there is no carry."""
    size = F.abs(deg)
    minutes = (size - F.floor(size)) * 60
    seconds = half_up((minutes - F.floor(minutes)) * 60 * 1000)
    return F.when(deg.isNotNull() & ~F.isnan(deg), F.array(rational(F.floor(size), 1), rational(F.floor(minutes), 1), rational(seconds, 1000)))


def from_dms(dms: Column, ref: Column) -> Column:
    """Decimal degrees, negative for S and W; null for fewer than three parts or one that is no number."""
    part = lambda i: from_rational(F.get(dms, i))
    value = part(0) + part(1) / 60 + part(2) / 3600
    return F.when(F.size(dms) >= 3, F.when(F.coalesce(ref, F.lit("")).isin("S", "W"), -value).otherwise(value))


def apex_shutter(seconds: Column) -> Column:
    return F.when(seconds > 0, rational(half_up(-F.log2(seconds) * 100), 100))


def apex_aperture(f: Column) -> Column:
    return F.when(f > 0, rational(half_up(2 * F.log2(f) * 100), 100))


def f_number(f: Column) -> Column:
    return F.when(f.isNotNull(), rational(half_up(f * 100), 100))


def exif_datetime(ts: Column) -> Column:
    return F.date_format(ts, "yyyy:MM:dd HH:mm:ss")


def gps_date(ts: Column) -> Column:
    return F.date_format(ts, "yyyy:MM:dd")


def gps_time(ts: Column) -> Column:
    return F.when(ts.isNotNull(), F.array(rational(F.hour(ts), 1), rational(F.minute(ts), 1), rational(F.second(ts), 1)))


def rolled_date(text: Column) -> Column:
    """The first ``YYYY:MM:DD`` in a text as a date; months and days beyond their range roll over; years under 100 count from 1900."""
    part = lambda i: F.try_to_number(F.regexp_extract(text, r"(\d{4}):(\d{2}):(\d{2})", i), F.lit("9999")).cast("int")
    found = F.regexp_like(text, F.lit(r"\d{4}:\d{2}:\d{2}"))
    year = F.when(part(1) < 100, part(1) + 1900).otherwise(part(1))
    return F.when(found, F.date_add(F.add_months(F.make_date(year, F.lit(1), F.lit(1)), part(2) - 1), part(3) - 1))


def first_given(*texts: Column) -> Column:
    """The first of the texts that is neither null nor empty."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts])


def clean_text(x: Column) -> Column:
    """Without the zero bytes that pad EXIF texts at the end."""
    return F.regexp_replace(x, r"\x00+$", "")


def bytes_text(n: Column) -> Column:
    """``12 B``, ``1.3 KB``, ``5.00 MB``."""
    n = n.cast("bigint")
    tenths = F.floor((n * 10 + 512) / 1024).cast("bigint")
    hundredths = F.floor((n * 100 + 524288) / 1048576).cast("bigint")
    parted = lambda x, by, width: F.concat(F.floor(x / by).cast("bigint").cast("string"), F.lit("."), F.lpad((x % by).cast("string"), width, "0"))
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1048576, F.concat(parted(tenths, 10, 1), F.lit(" KB")))
        .otherwise(F.concat(parted(hundredths, 100, 2), F.lit(" MB")))
    )


def escaped_html(x: Column) -> Column:
    """With the five markup characters as references; null becomes the empty text."""
    out = F.coalesce(x, F.lit(""))
    for char, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(to))
    return out


def data_url(mime: Column, content: Column) -> Column:
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), base64_text(content))


def base64_text(content: Column) -> Column:
    """Base64 on one line."""
    return F.translate(F.base64(content), "\r\n", "")


def data_url_parts(url: Column) -> Column:
    """``mime, content, error`` of a data URL; a body that can't be decoded is an error as well."""
    shape = r"^data:([^;,]+)?(;base64)?,(.*)$"
    valid = F.coalesce(F.regexp_like(url, F.lit(shape)), F.lit(False))
    body = F.regexp_extract(url, shape, 3)
    plain = F.try_url_decode(F.replace(body, F.lit("+"), F.lit("%2B"))).cast("binary")
    decoded = F.when(F.regexp_extract(url, shape, 2) != "", F.try_to_binary(body, F.lit("base64"))).otherwise(plain)
    mime = F.when(valid, F.coalesce(F.nullif(F.regexp_extract(url, shape, 1), F.lit("")), F.lit("application/octet-stream")))
    content = F.when(valid, decoded)
    return F.struct(mime.alias("mime"), content.alias("content"), F.when(content.isNull(), F.lit("Invalid output image data")).alias("error"))


def split_name(name: Column) -> Column:
    """``base, ext`` of a file name; nothing counts as ``image.jpg``, a name that is all extension is its own base."""
    safe = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.lit("image.jpg"))
    shape = r"^(.*?)(\.[^.]+)?$"
    base = F.coalesce(F.nullif(F.regexp_extract(safe, shape, 1), F.lit("")), safe)
    base = F.coalesce(F.nullif(F.trim(base), F.lit("")), F.lit("image"))
    return F.struct(base.alias("base"), F.trim(F.regexp_extract(safe, shape, 2)).alias("ext"))


def export_size(width: Column, height: Column, max_edge: Column) -> Column:
    """``width, height`` fitted into the longest edge, never enlarged, at least 1; no edge leaves them as they are."""
    longest = F.greatest(width, height)
    scaled = lambda side: F.greatest(F.lit(1), half_up(side * (max_edge / longest))).cast("int")
    small = F.coalesce(longest <= max_edge, F.lit(True)) | (longest == 0) | (max_edge == 0)
    return F.struct(F.when(small, width).otherwise(scaled(width)).cast("int").alias("width"), F.when(small, height).otherwise(scaled(height)).cast("int").alias("height"))


def map_url(lat: Column, lon: Column, lat_ref: Column, lon_ref: Column) -> Column:
    """A link to the place; a positive longitude without a reference counts as west, a null stays null."""
    lat = F.when(F.coalesce(lat_ref, F.lit("")) == "S", -F.abs(lat)).otherwise(lat)
    west = (F.coalesce(lon_ref, F.lit("")) == "W") | ((F.coalesce(lon_ref, F.lit("")) == "") & (lon > 0))
    lon = F.when(west, -F.abs(lon)).otherwise(lon)
    return F.concat(F.lit("https://maps.google.com/?q="), plain_number(lat), F.lit(","), plain_number(lon))


def image_type(mime: Column) -> Column:
    """Whether a MIME type is an image's; a prefix test that reaches the Parquet scan."""
    return mime.startswith("image/")
