"""SQL for DuckDB that gives the same rows as the queries of the catalogue, written apart from them."""

from __future__ import annotations

from apertura.functions.draws import PLACES, SEED
from apertura.operators.generate import AS_OF
from apertura.plans.dimension_sql import ROWS_SQL

DUCK_TYPES = {
    "cameras": {"apertures": "double[]", "isos": "int[]", "shutters": "struct(num int, den int)[]", "focals": "int[]"},
    "locations": {"lat": "double", "lon": "double"},
}
COLUMNS = {
    "cameras": ["camera_id", "make", "model", "software", "type", "apertures", "isos", "shutters", "focals"],
    "lenses": ["lens_id", "make", "model", "focal_lo", "focal_hi"],
    "locations": ["location_id", "city", "lat", "lon"],
    "exif_fields": ["section_ord", "section_key", "section_title", "field_ord", "field", "label"],
    "exif_codes": ["field", "code", "label"],
}


def _dim(name: str) -> str:
    """A common table expression with the rows of a dimension."""
    kinds = DUCK_TYPES.get(name, {})
    picked = ", ".join(f"cast({c} as {kinds[c]}) as {c}" if c in kinds else c for c in COLUMNS[name])
    return f"{name} as (select {picked} from (values {ROWS_SQL[name]}) as t({', '.join(COLUMNS[name])}))"


def _draw(key: str, name: str) -> str:
    group, at = PLACES.get(name, (name, 1))
    return f"cast(('0x' || substr(md5('{SEED}:' || cast({key} as varchar) || ':{group}'), {at}, 8)) as bigint)"


def _unit(key: str, name: str) -> str:
    return f"({_draw(key, name)} / cast(4294967296 as double))"


def _int(key: str, name: str, low: int, high: int) -> str:
    return f"cast({low} + {_draw(key, name)} % {high - low + 1} as int)"


def _pick(key: str, name: str, array: str) -> str:
    return f"({array})[{_draw(key, name)} % len({array}) + 1]"


def _pad(x: str, width: int) -> str:
    return f"lpad(cast({x} as varchar), cast(greatest(length(cast({x} as varchar)), {width}) as int), '0')"


def _fixed(x: str, digits: int) -> str:
    whole = f"cast(floor(abs({x}) * {10**digits} + 0.5) as bigint)"
    sign = f"case when {x} < 0 and {whole} > 0 then '-' else '' end"
    return f"({sign} || cast({whole} // {10**digits} as varchar) || '.' || lpad(cast({whole} % {10**digits} as varchar), {digits}, '0'))"


def _plain(x: str) -> str:
    return f"regexp_replace(cast({x} as varchar), '\\.0$', '')"


def _dms(x: str) -> list[str]:
    """Whole degrees, minutes and thousandths of seconds."""
    size = f"abs({x})"
    minutes = f"(({size} - floor({size})) * 60)"
    return [f"cast(floor({size}) as int)", f"cast(floor({minutes}) as int)", f"cast(floor(({minutes} - floor({minutes})) * 60 * 1000 + 0.5) as int)"]


STAMP = "'%Y:%m:%d %H:%M:%S'"
_K = "o_orderkey"
#: The drawn records of all orders.
RECORDS = f"""
{_dim("cameras")},
{_dim("lenses")},
{_dim("locations")},
drawn as (
  select {_K}, {_int(_K, "camera", 0, 18)} as cam_id, {_int(_K, "location", 0, 57)} as loc_id from orders),
base as (
  select d.{_K}, c.*, l.city, l.lat as base_lat, l.lon as base_lon,
    {_pick("d." + _K, "shutter", "c.shutters")} as shutter, {_pick("d." + _K, "aperture", "c.apertures")} as aperture,
    {_pick("d." + _K, "iso", "c.isos")} as iso, {_pick("d." + _K, "focal", "c.focals")} as focal
  from drawn d join cameras c on d.cam_id = c.camera_id join locations l on d.loc_id = l.location_id),
pools as (
  select c.camera_id, c.focal,
    coalesce((select list(l.model order by l.lens_id) from lenses l where l.make = c.make and c.focal between l.focal_lo and l.focal_hi),
             (select list(l.model order by l.lens_id) from lenses l where l.make = c.make)) as pool
  from (select camera_id, make, unnest(focals) as focal from cameras where type = 'dslr') c),
rec as (
  select b.*, timestamp '{AS_OF}' - to_seconds(cast(floor({_unit(_K, "date")} * 730 * 86400) as bigint)) as taken_at,
    {_pick(_K, "flash", "[0, 16, 24]")} as flash,
    case when type = 'phone' then 5 else {_pick(_K, "metering", "[2, 3, 5]")} end as metering,
    case when type = 'phone' then 2 else {_pick(_K, "program", "[1, 2, 3, 4]")} end as program,
    {_pick(_K, "white_balance", "[0, 0, 0, 1]")} as white_balance,
    floor(least(71.5, greatest(18.8, abs(base_lat + ({_unit(_K, "lat")} - 0.5) * 0.6))) * 1e6 + 0.5) / 1e6 as lat,
    floor(least(-66.0, greatest(-171.0, base_lon + ({_unit(_K, "lon")} - 0.5) * 0.6)) * 1e6 + 0.5) / 1e6 as lon,
    case when type = 'phone' then 72 else {_pick(_K, "dpi", "[240, 300]")} end as dpi,
    {_pad(_int(_K, "sub_sec", 10, 999), 3)} as sub_sec, {_int(_K, "altitude", 0, 400)} as altitude,
    {_draw(_K, "bias")} % 9 + 1 as bias_at,
    case when type = 'phone' then model || ' back camera ' || focal || 'mm f/' || {_plain("aperture")}
         else coalesce(p.pool[{_draw(_K, "lens")} % len(p.pool) + 1], focal || 'mm') end as lens_model
  from base b left join pools p using (camera_id, focal))
"""
_SECONDS = "(cast(shutter.num as double) / shutter.den)"


def _label(field: str, code: str) -> str:
    known = f"(select c.label from (values {ROWS_SQL['exif_codes']}) as c(field, code, label) where c.field = '{field}' and c.code = {code})"
    other = {"Flash": "'Code ' || ", "MeteringMode": "'Mode ' || "}.get(field, "")
    return f"coalesce({known}, {other}cast({code} as varchar))"


def _name(key: str, make: str) -> str:
    day, seq = AS_OF[:10].replace("-", ""), f"cast({_int(key, 'seq', 1000, 9999)} as varchar)"
    stamp = f"'{day}_' || {_pad(_int(key, 'name_hour', 0, 23), 2)} || {_pad(_int(key, 'name_minute', 0, 59), 2)} || {_pad(_int(key, 'name_second', 0, 59), 2)}"
    return f"""case when {make} in ('Apple', 'Canon') then 'IMG_' || {seq} || '.JPG' when {make} = 'Samsung' then {stamp} || '.jpg'
      when {make} = 'Google' then 'PXL_' || {stamp} || {_pad(_int(key, 'name_ms', 0, 999), 3)} || '.jpg'
      when {make} = 'Nikon' then 'DSC_' || {seq} || '.JPG' when {make} = 'Sony' then 'DSC0' || {seq} || '.JPG'
      when {make} = 'FUJIFILM' then 'DSCF' || {seq} || '.JPG' else 'IMG_' || {stamp} || '.jpg' end"""


#: The text of each field as the records' display has it.
_TEXTS = {
    "Make": "make", "Model": "model", "Software": "software", "LensMake": "make", "LensModel": "lens_model",
    "DateTimeOriginal": "strftime(taken_at, '%Y-%m-%d %H:%M:%S')", "DateTime": "strftime(taken_at, '%Y-%m-%d %H:%M:%S')", "SubSecTimeOriginal": "sub_sec",
    "ExposureTime": f"case when {_SECONDS} >= 1 then {_plain(_SECONDS)} || 's' else '1/' || cast(floor(1 / {_SECONDS} + 0.5) as bigint) || 's' end",
    "FNumber": f"'f/' || {_fixed('aperture', 1)}", "ISO": "cast(iso as varchar)", "FocalLength": "focal || 'mm'", "FocalLengthIn35mmFormat": "focal || 'mm'",
    "Flash": _label("Flash", "flash"), "MeteringMode": _label("MeteringMode", "metering"), "ExposureProgram": _label("ExposureProgram", "program"),
    "ExposureMode": _label("ExposureMode", "(case when program = 1 then 1 else 0 end)"), "WhiteBalance": _label("WhiteBalance", "white_balance"),
    "SceneCaptureType": "'Standard'", "SensingMethod": "'One-chip color area'", "Orientation": "'Normal (0 deg)'", "ColorSpace": "'sRGB'",
    "XResolution": "dpi || ' DPI'", "YResolution": "dpi || ' DPI'",
    "GPSLatitude": f"{_fixed('lat', 6)} || ' deg'", "GPSLongitude": f"{_fixed('lon', 6)} || ' deg'", "GPSAltitude": "altitude || '.0 m'",
}
_LINK = f"'https://maps.google.com/?q=' || {_plain('lat')} || ',' || {_plain('case when lon > 0 then -abs(lon) else lon end')}"
SHOWN = f"""
{RECORDS},
{_dim("exif_fields")},
texts as (
  select {_K}, unnest([{", ".join(f"{{'field': '{f}', 'text': {t}, 'map_url': {_LINK if f == 'GPSLatitude' else 'null'}}}" for f, t in _TEXTS.items())}], recursive := true) from rec),
shown as (
  select {_K}, section_ord, section_title as section, field_ord, field, label, text, map_url from texts join exif_fields using (field) where text != '')
"""
STATES = """
ops as (
  select user_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from events),
states as (
  select user_id, case event_type when 'click' then 'Processing' when 'error' then 'Error' when 'purchase' then 'Randomized' when 'signup' then 'Stripped' else 'Loaded' end as status
  from ops where n = 1)
"""
_P = "p_partkey"
_CROPS = {side: _int(_P, f"crop_{side}", 1, 6) for side in ("top", "bottom", "left", "right")}


def _escaped(x: str) -> str:
    for char, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#39;")):
        x = f"replace({x}, '{char}', '{to}')"
    return x


_LEFT, _RIGHT, _TOP, _BOTTOM = (_int("s_suppkey", f"crop_{side}", 1, 6) for side in ("left", "right", "top", "bottom"))
#: Pictures of suppliers with the size that they are rendered to, or their own where the crop leaves less than 100.
_PICTURES = f"""pictures as (
  select s_suppkey, s_suppkey % 9 != 0 as good, bypass, case when bypass then 130 else w end as out_width, case when bypass then side else h end as out_height
  from (select *, w < 100 or h < 100 as bypass from (
    select s_suppkey, cast(90 + s_suppkey % 40 as int) as side, cast(130 - {_LEFT} - {_RIGHT} as int) as w, cast(90 + s_suppkey % 40 - {_TOP} - {_BOTTOM} as int) as h from supplier)))"""


def oracle_sql() -> dict[str, str]:
    deg = "(c_acctbal / 100)"
    lat, lon = "(case when c_acctbal is null then null else least(71.5, greatest(18.8, abs(c_acctbal / 40.0::double))) end)", "least(171.0, greatest(66.0, abs(-c_acctbal / 25.0::double)))"
    three = lambda name, x: ", ".join(f"{part} as {name}_{i}" for i, part in enumerate(_dms(x)))
    order_day = "date_trunc('day', o_orderdate)"
    n = "(l_orderkey + l_linenumber)"
    ref = "case when c_custkey % 3 = 0 then 'S' end", "case when c_custkey % 4 = 0 then 'E' end"
    link_lat, link_lon = "cast(cast(trunc(c_acctbal) as int) % 90 as double)", "cast(c_custkey % 180 as double)"
    fields = "ColorSpace ExposureMode ExposureProgram Flash MeteringMode Orientation SceneCaptureType SensingMethod WhiteBalance".split()
    return {
        "synthetic_metadata": f"""with {RECORDS}
            select {_K}, make, model, software, lens_model, strftime(taken_at, {STAMP}) as stamp, sub_sec, shutter.num as shutter_num, shutter.den as shutter_den, aperture, iso, focal,
              flash, metering, program, case when program = 1 then 1 else 0 end as exposure_mode, white_balance, dpi, city, lat, lon, altitude, true as is_synthetic from rec""",
        "cameras_by_make": f"with {_dim('cameras')} select make, type, count(*) as n, min(list_min(apertures)) as widest from cameras group by make, type",
        "camera_options": f"""with {_dim("cameras")}, o as (
              select camera_id, 'aperture' as kind, apertures as options from cameras union all select camera_id, 'iso', cast(isos as double[]) from cameras
              union all select camera_id, 'shutter', list_transform(shutters, lambda s: cast(s.num as double) / s.den) from cameras union all select camera_id, 'focal', cast(focals as double[]) from cameras)
            select camera_id, kind, cast(place - 1 as int) as place, options[place] as option from (select *, unnest(range(1, len(options) + 1)) as place from o)""",
        "lens_range_join": f"""with {_dim("cameras")}, {_dim("lenses")}
            select c.camera_id, c.model, c.focal, l.lens_id, l.model as lens_model
            from (select camera_id, make, model, unnest(focals) as focal from cameras where type = 'dslr') c join lenses l on c.make = l.make and c.focal between l.focal_lo and l.focal_hi""",
        "lens_unmatched": f"""with {_dim("cameras")}, {_dim("lenses")}
            select c.camera_id, c.model, c.focal from (select camera_id, make, model, unnest(focals) as focal from cameras where type = 'dslr') c
            where not exists (select 1 from lenses l where c.make = l.make and c.focal between l.focal_lo and l.focal_hi)""",
        "prefix_filter": "select event_id, event_type from events where event_type like 'p%'",
        "bytes_texts": """select doc_id, n_chars * 97 as size, case when n_chars * 97 < 1024 then n_chars * 97 || ' B'
            when n_chars * 97 < 1048576 then ((n_chars * 970 + 512) // 1024) // 10 || '.' || ((n_chars * 970 + 512) // 1024) % 10 || ' KB'
            else ((n_chars * 9700 + 524288) // 1048576) // 100 || '.' || lpad(cast(((n_chars * 9700 + 524288) // 1048576) % 100 as varchar), 2, '0') || ' MB' end as shown from documents""",
        "dms_encode": "select c_custkey, {} as degrees, {} as minutes, {} as thousandths from customer".format(*_dms(deg)),
        "dms_round_trip": "select c_custkey, case when {3} < 0 then -1 else 1 end * (cast({0} as double) + cast({1} as double) / 60 + (cast({2} as double) / 1000) / 3600) as decoded from customer".format(*_dms(deg), deg),
        "rational_decode": "select l_orderkey, l_linenumber, case when l_linenumber != 1 then cast(cast(l_quantity as int) as double) / (l_linenumber - 1) end as decoded from lineitem",
        "exif_datetimes": f"select event_id, strftime(ts, {STAMP}) as stamp, strftime(ts, '%Y:%m:%d') as gps_date, cast(hour(ts) as int) as h, cast(minute(ts) as int) as m, cast(second(ts) as int) as s from events",
        "keep_date": f"""select {_K}, strftime({order_day} + to_seconds(cast({_int(_K, "hour", 0, 23)} * 3600 + {_int(_K, "minute", 0, 59)} * 60 + {_int(_K, "second", 0, 59)} as bigint)), {STAMP}) as stamp from orders""",
        "rolled_dates": f"""select l_orderkey, l_linenumber, (2000 + {n} % 30) || ':' || lpad(cast({n} % 14 as varchar), 2, '0') || ':' || lpad(cast({n} % 33 as varchar), 2, '0') as given,
            strftime(make_date(2000 + {n} % 30, 1, 1) + to_months(cast({n} % 14 - 1 as int)) + to_days(cast({n} % 33 - 1 as int)), '%Y-%m-%d') as day from lineitem""",
        "apex_values": f"""with {_dim("cameras")}, o as (
              select camera_id, 'shutter' as kind, unnest(list_transform(shutters, lambda s: cast(s.num as double) / s.den)) as option from cameras
              union all select camera_id, 'aperture', unnest(apertures) from cameras)
            select camera_id, kind, option, cast(floor(case when kind = 'shutter' then -log2(option) * 100 else 2 * log2(option) * 100 end + 0.5) as int) as apex,
              cast(floor(option * 100 + 0.5) as int) as number from o""",
        "export_plans": f"""with s as (select {_P}, p_size * 100 as w, cast(floor(p_retailprice) as int) * 3 as h from part),
            c as (select *, {_CROPS["left"]} as cl, {_CROPS["top"]} as ct, cast(w - {_CROPS["left"]} - {_CROPS["right"]} as int) as sw, cast(h - {_CROPS["top"]} - {_CROPS["bottom"]} as int) as sh,
              {_pick(_P, "max_edge", "[2048, 2160, 2400, 2560, 2880, 3200]")} as edge from s),
            b as (select *, sw < 100 or sh < 100 as bypass, greatest(sw, sh) as longest from c)
            select {_P}, w, h, bypass, case when bypass then 0 else cl end as crop_left, case when bypass then 0 else ct end as crop_top,
              case when bypass then w else sw end as src_width, case when bypass then h else sh end as src_height, case when not bypass then edge end as max_edge,
              case when bypass then w when longest <= edge then sw else cast(greatest(1, floor(sw * (cast(edge as double) / longest) + 0.5)) as int) end as out_width,
              case when bypass then h when longest <= edge then sh else cast(greatest(1, floor(sh * (cast(edge as double) / longest) + 0.5)) as int) end as out_height,
              case when bypass then cast(0 as double) else ({_unit(_P, "angle")} - 0.5) * 0.6 end as angle, cast(0.80 as double) + {_unit(_P, "quality")} * 0.08 as quality from b""",
        "tag_values": f"""with {RECORDS}
            select {_K}, cast(floor(aperture * 100 + 0.5) as int) as f_num, focal * 10 as focal_num, [0, 0, 0, 1, -1, 2, -2, 1, -1][bias_at] as bias_num, [1, 1, 1, 3, 3, 3, 3, 1, 1][bias_at] as bias_den,
              cast(floor(-log2({_SECONDS}) * 100 + 0.5) as int) as shutter_apex, cast(floor(2 * log2(aperture) * 100 + 0.5) as int) as aperture_apex,
              cast(floor(2 * log2(list_min(apertures)) * 100 + 0.5) as int) as widest_apex, {three("lat", "lat")}, {three("lon", "lon")}, altitude, strftime(taken_at, '%Y:%m:%d') as gps_date,
              cast(hour(taken_at) as int) as time_0, cast(minute(taken_at) as int) as time_1, cast(second(taken_at) as int) as time_2 from rec""",
        "exif_round_trip": f"""with {RECORDS}
            select {_K}, make as "Make", model as "Model", lens_model as "LensModel", least(iso, 65535) as "ISO", floor(aperture * 100 + 0.5) / 100 as "FNumber", cast(focal as double) as "FocalLength",
              {_SECONDS} as "ExposureTime", lat as "GPSLatitude", -abs(lon) as "GPSLongitude", cast(altitude as double) as "GPSAltitude", 8 as "PixelXDimension", 16 as "PixelYDimension",
              strftime(taken_at, {STAMP}) as stamp, {_name(_K, "make")} as output_name, cast(null as varchar) as error from rec""",
        "enforce_gps": f"""select c_custkey, {three("lat", lat)}, {three("lon", lon)}, 'N' as lat_ref, 'W' as lon_ref, cast(greatest(0, floor(c_acctbal / 7.0::double + 0.5)) as int) as altitude from customer""",
        "code_labels": "select event_id, " + ", ".join(f'{_label(f, "cast(event_id % 32 as int)")} as "{f}"' for f in fields) + " from events",
        "display_fields": f"with {SHOWN} select * from shown",
        "field_counts": f"with {SHOWN} select {_K}, section_ord, section, count(*) as n_fields from shown group by all",
        "html_records": f"""with {SHOWN}, r as (
              select {_K}, section_ord, field_ord, section, '<dt>' || {_escaped("label")} || '</dt><dd>' || {_escaped("text")} || case when map_url is not null then ' <a href="' || {_escaped("map_url")} || '">Map</a>' else '' end || '</dd>' as html from shown),
            p as (select {_K}, section_ord, '<section><h3>' || section || '</h3><dl>' || string_agg(html, '' order by field_ord) || '</dl></section>' as html, count(*) as n from r group by {_K}, section_ord, section),
            w as (select {_K}, string_agg(html, '' order by section_ord) as html, cast(sum(n) as bigint) as n from p group by {_K})
            select {_K}, case when {_K} % 7 = 0 then '<p>No EXIF metadata found in this image.</p>' when {_K} % 11 = 0 then '<p>No recognized EXIF fields found.</p>' else html end as html,
              case when {_K} % 7 = 0 or {_K} % 11 = 0 then 0 else n end as n_fields from w""",
        "pixel_sizes": """with s as (select p_partkey, case when p_partkey % 5 = 0 then p_size * 200 else p_size * 100 end as w, p_size * 75 as h from part)
            select p_partkey, 'PixelXDimension' as field, 'Pixel Width' as label, w || ' px' as text from s union all select p_partkey, 'PixelYDimension', 'Pixel Height', h || ' px' from s""",
        "degree_arrays": """select c_custkey, (c_custkey % 90) || ' deg ' || (c_custkey % 60) || chr(39) || (c_custkey % 50) || '"' as lat, (c_nationkey % 90) || ' deg ' || (c_nationkey % 60) || chr(39) || (c_nationkey % 50) || '"' as lon from customer""",
        "item_ids": "select page_id, sha256(url) as item_id, page_id % 3 != 0 as is_image from pages",
        "strip_round_trip": f"""select {_K}, case when {_K} % 7 != 0 then 'ffd8ffc0000b080010000801011100ffda0008010100003f00ffd9' end as output, true as bare,
            case when {_K} % 7 != 0 then {_name(_K, "''")} end as output_name, case when {_K} % 7 = 0 then 'not a JPEG' end as error from orders""",
        "reencoded_images": f"""with {_dim("cameras")}, {_dim("locations")}, {_PICTURES}
            select s_suppkey, case when good then out_width end as width, case when good then out_height end as height, case when good then out_width end as seen_width, case when good then out_height end as seen_height,
              case when good then 3 end as channels, bypass, case when good then 'primary' end as parser, cast(null as varchar) as warning,
              case when good then 'Randomized ' || {_name("s_suppkey", "make")} || ' | ' || city end as message, case when not good then 'not a JPEG' end as error
            from pictures join cameras on camera_id = {_int("s_suppkey", "camera", 0, 18)} join locations on location_id = {_int("s_suppkey", "location", 0, 57)}""",
        "decoded_pixels": f"""with {_PICTURES} select s_suppkey, case when good then out_width end as width, case when good then out_height end as height, case when good then 3 end as channels,
              case when good then true end as close, case when good then bypass end as untouched from pictures""",
        "item_status": f"with {STATES} select user_id, status from states",
        "batch_summary": f"""with {STATES} select count(*) as n_items, count(*) filter (status in ('Randomized', 'Stripped')) as n_processed, count(*) filter (status = 'Error') as n_failed,
            coalesce(bool_or(status = 'Processing'), false) as any_processing,
            count(*) || case when count(*) = 1 then ' image' else ' images' end || ' queued | ' || count(*) filter (status in ('Randomized', 'Stripped')) || ' processed' as summary from states""",
        "processed_items": f"with {STATES} select user_id, status from states where status in ('Randomized', 'Stripped')",
        "output_names": f"""with {_dim("cameras")}, m as (
              select o.{_K}, case when o.{_K} % 10 != 0 then c.make else '' end as make from orders o join cameras c on c.camera_id = {_int("o." + _K, "camera", 0, 18)})
            select {_K}, {_name(_K, "make")} as output_name from m""",
        "unique_names": f"""with {_dim("cameras")}, m as (
              select o.{_K}, case when o.{_K} % 10 != 0 then c.make else '' end as make from orders o join cameras c on c.camera_id = {_int("o." + _K, "camera", 0, 18)}),
            n as (select {_K}, {_name(_K, "make")} as output_name from m),
            r as (select *, row_number() over (partition by output_name order by {_K}) as nth, regexp_extract(output_name, '(\\.[^.]*)$', 1) as ending from n)
            select {_K}, output_name, case when nth = 1 then output_name else left(output_name, length(output_name) - length(ending)) || ' (' || nth || ')' || ending end as unique_name from r""",
        "load_sequence": """select event_id, cast(day(ts) as int) as day, row_number() over (order by day(ts) > 15, ts nulls first, event_id) as load_seq from events""",
        "track_points": """with p as (select o_orderkey, o_custkey % 150 as user_id, timestamp '2024-01-01' + to_seconds(cast((o_orderkey * 7919) % 2592000 as bigint)) as ts from orders)
            select p.o_orderkey, p.user_id, case when epoch_us(p.ts) - epoch_us(e.ts) <= 7200000000 then e.event_id end as event_id
            from p asof left join events e on p.user_id = e.user_id and p.ts >= e.ts""",
        "container_tags": f"""with {RECORDS}, k as (select *, ['png', 'webp', 'heic', 'tiff', 'jpeg'][cast({_K} % 5 + 1 as int)] as kind, {_K} % 13 != 0 as whole from rec)
            select {_K}, kind, kind as found, case when whole then make end as make, case when whole then least(iso, 65535) end as iso,
              case when whole then cast(floor(abs(lat)) as int) end as lat_0 from k""",
        "split_names": """with n as (select page_id, coalesce(nullif(trim(string_split(url, '/')[-1]), ''), 'image.jpg') as name from pages),
            e as (select *, coalesce(nullif(regexp_extract(name, '(\\.[^.]+)$', 1), ''), '') as ext from n)
            select page_id, coalesce(nullif(trim(coalesce(nullif(left(name, length(name) - length(ext)), ''), name)), ''), 'image') as base, trim(ext) as ext from e""",
        "escape_html": f"select page_id, {_escaped("coalesce(html, '')")} as escaped from pages",
        "data_urls": """select conv_id, turn, case turn % 4 when 0 then 'text/plain' when 1 then 'application/octet-stream' when 2 then 'text/x' end as mime,
            case turn % 4 when 0 then text when 1 then text when 2 then 'a b+' || conv_id end as content, case when turn % 4 = 3 then 'Invalid output image data' end as error from conversations""",
        "verify_fallback": """select event_id, case when event_id % 3 != 0 then value when event_id % 5 != 0 then -value end as verified,
            case when event_id % 3 != 0 then 'primary' when event_id % 5 != 0 then 'fallback' end as parser,
            case when event_id % 3 = 0 and event_id % 5 != 0 then 'read back by the fallback only: no fields' end as warning,
            case when event_id % 15 = 0 then 'metadata verification failed: no fields' end as error from events""",
        "map_links": f"""with p as (select c_custkey, {link_lat} as la, {link_lon} as lo, {ref[0]} as lar, {ref[1]} as lor from customer),
            q as (select c_custkey, case when lar = 'S' then -abs(la) else la end as la, case when lor is null and lo > 0 then -abs(lo) else lo end as lo from p)
            select c_custkey, 'https://maps.google.com/?q=' || {_plain("la")} || ',' || {_plain("lo")} as map_url from q""",
    }
