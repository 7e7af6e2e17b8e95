"""Names, keys, links and texts derived from object keys."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rastertables import params as P

# Patterns that decide names and dates.
GEOTIFF_PATTERN = r"\.tiff?$"
EXTENSION_PATTERN = r"^(\.*[^.].*)\.[^.]*$"
UNSAFE_PATTERN = r"[^A-Za-z0-9_-]+"
DATE_PATTERN = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
HEX_COLOR_PATTERN = r"^[0-9a-fA-F]{6}$"


def source_label(key: Column) -> Column:
    """Last path part of an object key."""
    return F.substring_index(key, "/", -1)


def stem(key: Column) -> Column:
    """Last path part without its extension; leading dots are part of the name."""
    return F.regexp_replace(source_label(key), EXTENSION_PATTERN, "$1")


def safe_source_name(key: Column) -> Column:
    """Stem limited to letters, digits, '_' and '-'; 'source' when nothing is left."""
    cleaned = F.regexp_replace(stem(key), UNSAFE_PATTERN, "_")
    return F.coalesce(F.nullif(F.trim(cleaned, F.lit("_")), F.lit("")), F.lit("source"))


def is_geotiff(key: Column) -> Column:
    return F.lower(key).rlike(GEOTIFF_PATTERN)


def extract_date(key: Column) -> Column:
    """First yyyy-mm-dd looking run of digits in the key as text, or NULL."""
    part = lambda n: F.regexp_extract(key, DATE_PATTERN, n)
    return F.when(key.rlike(DATE_PATTERN), F.concat_ws("-", part(1), part(2), part(3)))


def tile_filename(key: Column, ordinal: Column, partial: Column) -> Column:
    return F.format_string(
        "tile_%s_%04d%s", stem(key), ordinal, F.when(partial, ".png").otherwise(".jpg")
    )


def mask_filename(key: Column, ordinal: Column) -> Column:
    return F.format_string("mask_%s_%04d.png", stem(key), ordinal)


def tile_object_key(filename: Column) -> Column:
    return F.concat(F.lit(P.TILE_PREFIX), filename)


def mask_object_key(mask_name: Column) -> Column:
    return F.concat(F.lit(P.MASK_PREFIX), mask_name)


def export_prefix(key: Column) -> Column:
    """Folder that holds all exports of one scene."""
    return F.concat(F.lit(P.EXPORT_PREFIX), safe_source_name(key), F.lit("/"))


def marker_key(key: Column) -> Column:
    return F.concat(F.lit(P.STATUS_PREFIX), safe_source_name(key), F.lit(".json"))


def percent_encode(text: Column) -> Column:
    """RFC 3986 encoding with no reserved character left as is."""
    encoded = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _link(path: str, key: Column) -> Column:
    return F.concat(F.lit(path), percent_encode(key))


def tiles_url(key: Column) -> Column:
    return _link("/api/tiles-geojson?source=", key)


def outline_url(key: Column) -> Column:
    return _link("/api/image-outline-geojson?source=", key)


def download_url(key: Column) -> Column:
    return _link("/api/download-shapefile?source=", key)


def object_url(key: Column) -> Column:
    return _link("/api/object?key=", key)


def mask_url(key: Column, color: Column) -> Column:
    return F.concat(_link("/api/mask-object?key=", key), F.lit("&color="), color)


def sanitize_hex_color(color: Column) -> Column:
    """Six lower-case hex digits; three digits are doubled, anything else is the default."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(color, F.lit("")), r"^\s+|\s+$", ""), "^#+", "")
    wide = F.when(F.length(bare) == 3, F.regexp_replace(bare, "^(.)(.)(.)$", "$1$1$2$2$3$3")).otherwise(bare)
    return F.lower(F.when(wide.rlike(HEX_COLOR_PATTERN), wide).otherwise(F.lit(P.DEFAULT_MASK_COLOR)))


def iso_timestamp(ts: Column) -> Column:
    """ISO 8601 text; the fraction is printed only when it is not zero."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(ts, ".SSSSSS")
    return F.when(fraction == ".000000", whole).otherwise(F.concat(whole, fraction))


def json_safe(value: Column, dtype: str) -> Column:
    """A value JSON can hold: NaN becomes NULL, timestamps become ISO text."""
    if dtype in ("float", "double"):
        return F.when(~F.isnan(value), value)
    if dtype.startswith("timestamp"):
        return iso_timestamp(value)
    return value


def status_label(status: Column, stage: Column, current: Column, total: Column) -> Column:
    """'status / stage (current/total)'; empty parts are left out."""
    text = lambda c: F.coalesce(c, F.lit(""))
    progress = F.when(
        F.coalesce(total, F.lit(0)) != 0,
        F.concat(F.lit(" ("), F.coalesce(current, F.lit(0)).cast("string"), F.lit("/"),
                 total.cast("string"), F.lit(")")),
    ).otherwise("")
    staged = F.when(text(stage) != "", F.concat(F.lit(" / "), stage)).otherwise("")
    name = F.coalesce(F.nullif(status, F.lit("")), F.lit(P.UNKNOWN_STATUS))
    return F.concat(name, staged, progress)
