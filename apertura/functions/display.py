"""Display texts of a record: one expression a field, and the record unpivoted into labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from apertura.functions import scalars as S
from apertura.sources import dims

#: What stands before a code that has no label.
UNKNOWN = {"Flash": "Code ", "MeteringMode": "Mode "}


def code_label(field: str, code: Column) -> Column:
    """The label of a numeric code, or the code itself."""
    labels = F.create_map(*[x for f, c, label in dims.CODES if f == field for x in (F.lit(c), F.lit(label))])
    plain = F.concat(F.lit(UNKNOWN.get(field, "")), code.cast("string"))
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(labels, code.cast("int")), plain))


def shown(field: str, value: Column) -> Column:
    """The text a field is shown as; null for null."""
    number = S.plain_number(value)
    if any(f == field for f, _, _ in dims.CODES):
        return code_label(field, value)
    if field == "ExposureTime":
        return F.when(value >= 1, F.concat(number, F.lit("s"))).when(value > 0, F.concat(F.lit("1/"), S.half_up(1 / value).cast("string"), F.lit("s")))
    if field == "FNumber":
        return F.concat(F.lit("f/"), S.fixed(value, 1))
    if field in ("FocalLength", "FocalLengthIn35mmFormat"):
        return F.concat(number, F.lit("mm"))
    if field == "GPSAltitude":
        return F.concat(S.fixed(value, 1), F.lit(" m"))
    if field in ("GPSLatitude", "GPSLongitude"):
        return F.concat(S.fixed(value, 6), F.lit(" deg"))
    if field in ("DateTimeOriginal", "DateTime"):
        return F.date_format(value, "yyyy-MM-dd HH:mm:ss")
    if field in ("PixelXDimension", "PixelYDimension"):
        return F.concat(number, F.lit(" px"))
    if field in ("XResolution", "YResolution"):
        return F.concat(number, F.lit(" DPI"))
    return value.cast("string")


def shown_degrees(dms: Column) -> Column:
    """The text of degrees, minutes and seconds as an array of numbers; null with fewer than three."""
    part = lambda k: S.plain_number(F.get(dms, F.lit(k)).cast("double"))
    return F.concat(part(0), F.lit(" deg "), part(1), F.lit("'"), part(2), F.lit('"'))


def _shown_of(df: DataFrame, record: str, field: str) -> Column:
    """The text of a record's field, by its type where that matters."""
    kind, value = df.schema[record].dataType[field].dataType, F.col(f"{record}.{field}")
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        value = F.when(~F.isnan(value), value)
    return shown_degrees(value) if isinstance(kind, T.ArrayType) else shown(field, value)


def display_fields(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """A row for each shown field of each record: the keys, section, field, label and text; empty fields are left out.

    The record is unpivoted in place, without a join or shuffle. The latitude's row has a ``map_url``.
    """
    have = set(df.schema[record].dataType.names)
    value = lambda f: F.col(f"{record}.{f}")
    link = S.map_url(value("GPSLatitude"), value("GPSLongitude"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    rows = [
        F.struct(
            F.lit(s).alias("section_ord"), F.lit(title).alias("section"), F.lit(f).alias("field_ord"), F.lit(field).alias("field"), F.lit(label).alias("label"),
            _shown_of(df, record, field).alias("text"), (link if field == "GPSLatitude" else F.lit(None).cast("string")).alias("map_url"),
        )
        for s, _, title, f, field, label in dims.FIELDS
        if field in have
    ]
    return df.select(*keys, F.inline(F.array(*rows))).where("text != ''")


#: What is said of a record that is missing, and of one without a field that is shown.
NO_RECORD, NO_FIELDS = "No EXIF metadata found in this image.", "No recognized EXIF fields found."


def _sections(df: DataFrame, record: str) -> list[tuple[int, str, list[tuple[str, str, Column]]]]:
    """The sections with their place, title and fields: name, label and text."""
    have = set(df.schema[record].dataType.names)
    out: list[tuple[int, str, list]] = []
    for s, _, title, _, field, label in dims.FIELDS:
        if not out or out[-1][0] != s:
            out.append((s, title, []))
        if field in have:
            out[-1][2].append((field, label, _shown_of(df, record, field)))
    return out


def field_counts(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """How many fields each section of each record shows, sections without any left out: counted within the row."""
    there = lambda text: F.coalesce((text != "").cast("int"), F.lit(0))
    rows = [F.struct(F.lit(s).alias("section_ord"), F.lit(title).alias("section"), sum((there(t) for _, _, t in fields), F.lit(0)).cast("long").alias("n_fields")) for s, title, fields in _sections(df, record)]
    return df.select(*keys, F.inline(F.array(*rows))).where("n_fields > 0")


def as_html(df: DataFrame, record: str, keys: list[str]) -> DataFrame:
    """Each record as escaped HTML, ``html`` and ``n_fields``: titled sections of labelled texts, made within the row.

    The latitude has a link to a map. A record that is null or shows nothing says so and counts 0.
    """
    value = lambda f: F.col(f"{record}.{f}")
    link = S.map_url(value("GPSLatitude"), value("GPSLongitude"), F.lit(None).cast("string"), F.lit(None).cast("string"))
    parts, count = [], F.lit(0)
    for _, title, fields in _sections(df, record):
        rows = []
        for field, label, text in fields:
            more = F.coalesce(F.concat(F.lit(' <a href="'), S.escaped_html(link), F.lit('">Map</a>')), F.lit("")) if field == "GPSLatitude" else F.lit("")
            rows.append(F.when(text != "", F.concat(F.lit("<dt>"), S.escaped_html(F.lit(label)), F.lit("</dt><dd>"), S.escaped_html(text), more, F.lit("</dd>"))))
            count = count + F.coalesce((text != "").cast("int"), F.lit(0))
        body = F.concat_ws("", *rows)
        parts.append(F.when(body != "", F.concat(F.lit("<section><h3>"), S.escaped_html(F.lit(title)), F.lit("</h3><dl>"), body, F.lit("</dl></section>"))))
    whole = F.concat_ws("", *parts)
    none = lambda text: F.lit(f"<p>{text}</p>")
    html = F.when(F.col(record).isNull(), none(NO_RECORD)).when(whole == "", none(NO_FIELDS)).otherwise(whole)
    return df.select(*keys, html.alias("html"), count.cast("long").alias("n_fields"))
