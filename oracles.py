"""SQL that DuckDB runs on the same tables to check the registered queries."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
CHECKS: dict[str, str] = {}


def cte(name: str, sql: str) -> None:
    CTES[name] = sql


def check(name: str, sql: str) -> None:
    CHECKS[name] = sql


def _needed(sql: str) -> list[str]:
    """Names of the CTEs a statement uses, directly or not, in definition order."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        words = set(re.findall(r"[a-z_0-9]+", todo.pop()))
        fresh = [n for n in CTES if n in words and n not in found]
        found.update(fresh)
        todo.extend(CTES[n] for n in fresh)
    return [n for n in CTES if n in found]


def statement(sql: str) -> str:
    parts = [f"{n} AS ({CTES[n]})" for n in _needed(sql)]
    return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + sql


def statements() -> dict[str, str]:
    return {name: statement(sql) for name, sql in CHECKS.items()}


def scene_key(number: str) -> str:
    return f"concat('raw/S1_IW_202401', lpad(CAST({number} AS VARCHAR), 2, '0'), '.tif')"


def stem(key: str) -> str:
    return rf"regexp_replace(string_split({key}, '/')[-1], '^(\.*[^.].*)\.[^.]*$', '\1')"


def safe(key: str) -> str:
    return f"coalesce(nullif(trim(regexp_replace({stem(key)}, '[^A-Za-z0-9_-]+', '_', 'g'), '_'), ''), 'source')"


def iso(ts: str) -> str:
    return (f"CASE WHEN {ts} IS NULL THEN NULL WHEN microsecond({ts}) % 1000000 = 0 THEN strftime({ts}, '%Y-%m-%dT%H:%M:%S') "
            f"ELSE strftime({ts}, '%Y-%m-%dT%H:%M:%S.%f') END")


def date_of(key: str) -> str:
    pattern = r"(20\d{2})[-_]?(\d{2})[-_]?(\d{2})"
    part = lambda n: f"regexp_extract({key}, '{pattern}', {n})"
    return (f"CASE WHEN regexp_matches({key}, '{pattern}') "
            f"THEN concat({part(1)}, '-', {part(2)}, '-', {part(3)}) END")


# --- derived input tables -------------------------------------------------------------

cte("ranked", "SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS k FROM embeddings")
cte("cells", "SELECT label, vec_id, k, CAST(r.i AS INT) AS i, CAST(embedding[r.i + 1] AS DOUBLE) AS v FROM ranked, range(64) r(i)")
cte("pixels", f"""
SELECT {scene_key('label + 1')} AS scene_key,
  CAST((k % 10) * 8 + i % 8 AS INT) AS px, CAST((k // 10) * 8 + i // 8 AS INT) AS py,
  CASE WHEN vec_id % 11 = 0 THEN 0.0 WHEN vec_id % 5 = 0 AND i % 8 >= 3 THEN 0.0
       WHEN vec_id % 13 = 0 THEN (CASE WHEN i < 4 THEN v ELSE 0.0 END) ELSE v END AS value
FROM cells""")
cte("scenes", f"""
SELECT {scene_key('label + 1')} AS scene_key, 80 AS width, CAST(8 * ceil(count(*) / 10.0) AS INT) AS height,
  CASE WHEN label = 9 THEN NULL WHEN label % 3 = 1 THEN 3857 WHEN label = 2 THEN 32642 ELSE 4326 END AS epsg,
  CASE WHEN label % 3 = 1 THEN 100e0 WHEN label = 2 THEN 10e0 ELSE 0.001e0 END AS a,
  CASE WHEN label % 3 = 1 THEN 10e0 WHEN label = 2 THEN 1e0 ELSE 0.0001e0 END AS b,
  CASE WHEN label % 3 = 1 THEN 7800000e0 + 50000e0 * label WHEN label = 2 THEN 500000e0 ELSE 70e0 + 0.5e0 * label END AS c,
  CASE WHEN label % 3 = 1 THEN 5e0 WHEN label = 2 THEN 0.5e0 ELSE 0.00005e0 END AS d,
  CASE WHEN label % 3 = 1 THEN -100e0 WHEN label = 2 THEN -10e0 ELSE -0.001e0 END AS e,
  CASE WHEN label % 3 = 1 THEN 12900000e0 - 30000e0 * label WHEN label = 2 THEN 8300000e0 ELSE 75e0 - 0.3e0 * label END AS f
FROM embeddings GROUP BY label""")
cte("valid", "SELECT * FROM pixels WHERE isfinite(value) AND abs(value) > 1e-12")


def grid_ctes(tag: str, size: int, ratio: str) -> None:
    """Statistics, kept tiles, contrast and numbering on one grid."""
    cte(f"stats{tag}", f"""
SELECT t.*, s.* EXCLUDE (scene_key) FROM (
  SELECT scene_key, px // {size} * {size} AS tile_x, py // {size} * {size} AS tile_y,
    CAST(count(*) AS INT) AS valid_count, min(value) AS value_min, max(value) AS value_max
  FROM valid GROUP BY ALL) s
JOIN (SELECT DISTINCT p.scene_key, px // {size} * {size} AS tile_x, py // {size} * {size} AS tile_y,
    CAST(least({size}, width - px // {size} * {size}) AS INT) AS tile_width,
    CAST(least({size}, height - py // {size} * {size}) AS INT) AS tile_height
  FROM pixels p JOIN scenes USING (scene_key)) t
ON s.scene_key = t.scene_key AND s.tile_x = t.tile_x AND s.tile_y = t.tile_y""".replace(
        "SELECT t.*, s.* EXCLUDE (scene_key)", "SELECT t.*, s.valid_count, t.tile_width * t.tile_height AS total_count, s.value_min, s.value_max"))
    cte(f"kept{tag}", f"""
SELECT * FROM stats{tag} WHERE valid_count / CAST(total_count AS DOUBLE) >= {ratio} AND value_max - value_min <> 0""")
    cte(f"ordered{tag}", f"""
SELECT k.scene_key, k.tile_x, k.tile_y, value,
  row_number() OVER w - 1 AS rn, greatest(1, k.valid_count // 16) AS step
FROM valid v JOIN kept{tag} k ON v.scene_key = k.scene_key AND v.px // {size} * {size} = k.tile_x AND v.py // {size} * {size} = k.tile_y
WINDOW w AS (PARTITION BY k.scene_key, k.tile_x, k.tile_y ORDER BY py, px)""")
    cte(f"sampled{tag}", f"SELECT scene_key, tile_x, tile_y, value FROM ordered{tag} WHERE rn % step = 0 AND rn // step < 16")
    cte(f"bounds{tag}", f"""
SELECT scene_key, quantile_cont(value, 0.02) AS low, quantile_cont(value, 0.98) AS high FROM ordered{tag}
GROUP BY scene_key HAVING quantile_cont(value, 0.98) - quantile_cont(value, 0.02) <> 0""")
    cte(f"grey{tag}", f"""
SELECT k.scene_key, k.tile_x, k.tile_y, k.tile_width, k.tile_height, v.px, v.py,
  CAST(trunc(least(greatest(255e0 * ((value - low) / (high - low)), 0e0), 255e0)) AS INT) AS grey
FROM kept{tag} k JOIN bounds{tag} USING (scene_key)
JOIN valid v ON v.scene_key = k.scene_key AND v.px // {size} * {size} = k.tile_x AND v.py // {size} * {size} = k.tile_y""")
    cte(f"bright{tag}", f"""
SELECT scene_key, tile_x, tile_y, tile_width, tile_height, max(grey) AS grey_max, count(*) AS valid_count
FROM grey{tag} GROUP BY ALL HAVING max(grey) > 0""")
    cte(f"numbered{tag}", f"""
SELECT *, valid_count < tile_width * tile_height AS partial,
  CAST(row_number() OVER (PARTITION BY scene_key ORDER BY tile_y, tile_x) - 1 AS INT) AS ordinal FROM bright{tag}""")
    cte(f"named{tag}", f"""
SELECT *, printf('tile_%s_%04d%s', {stem('scene_key')}, ordinal, CASE WHEN partial THEN '.png' ELSE '.jpg' END) AS filename,
  printf('mask_%s_%04d.png', {stem('scene_key')}, ordinal) AS mask_name FROM numbered{tag}""")


grid_ctes("", 8, "0.08")
grid_ctes("_first", 8, "0.5")
grid_ctes("_12", 12, "0.08")


# WGS84 ellipsoid and the Krueger series of the inverse transverse Mercator.
_N = (1 / 298.257223563) / (2 - 1 / 298.257223563)
_SCALE = 0.9996 * 6378137.0 / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64 + _N**6 / 256)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
         17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
          56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _utm(px: str, py: str) -> tuple[str, str]:
    xi, eta = f"((d*{px}+e*{py}+f) / {_SCALE!r})", f"((a*{px}+b*{py}+c - 500000e0) / {_SCALE!r})"
    terms = list(enumerate(_BETA, 1))
    u = f"({xi}" + "".join(f" - {b!r} * sin({2 * j} * {xi}) * cosh({2 * j} * {eta})" for j, b in terms) + ")"
    v = f"({eta}" + "".join(f" - {b!r} * cos({2 * j} * {xi}) * sinh({2 * j} * {eta})" for j, b in terms) + ")"
    chi = f"asin(sin({u}) / cosh({v}))"
    lat = f"degrees({chi}" + "".join(f" + {d!r} * sin({2 * j} * {chi})" for j, d in enumerate(_DELTA, 1)) + ")"
    return f"(epsg % 100 * 6 - 183 + degrees(atan2(sinh({v}), cos({u}))))", lat


def lon(px: str, py: str) -> str:
    return (f"round(CASE epsg WHEN 4326 THEN a*{px}+b*{py}+c WHEN 3857 THEN (a*{px}+b*{py}+c) / 6378137e0 * (180e0 / pi()) "
            f"ELSE {_utm(px, py)[0]} END, 9)")


def lat(px: str, py: str) -> str:
    return (f"round(CASE epsg WHEN 4326 THEN d*{px}+e*{py}+f WHEN 3857 THEN "
            f"(2e0 * atan(exp((d*{px}+e*{py}+f) / 6378137e0)) - pi() / 2) * (180e0 / pi()) ELSE {_utm(px, py)[1]} END, 9)")


def corner_sql(source: str) -> str:
    x0, y0, x1, y1 = "tile_x", "tile_y", "(tile_x + tile_width)", "(tile_y + tile_height)"
    nodes = {"top_left": (x0, y0), "top_right": (x1, y0), "bottom_right": (x1, y1), "bottom_left": (x0, y1)}
    columns = ", ".join(f"{lon(*n)} AS {c}_lon, {lat(*n)} AS {c}_lat" for c, n in nodes.items())
    return (f"SELECT filename, scene_key AS source_object_key, {columns}, tile_x, tile_y, tile_width, tile_height, "
            f"mask_name, ordinal, partial FROM {source} JOIN scenes USING (scene_key) WHERE epsg IS NOT NULL")


cte("tiles", corner_sql("named"))
cte("first_tiles", corner_sql("named_first"))
_NEWER = ("top_right_lon", "top_right_lat", "bottom_left_lon", "bottom_left_lat", "tile_x", "tile_y", "tile_width", "tile_height")
cte("old_tiles", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN ordinal % 7 <> 0 THEN {c} END AS {c}" for c in _NEWER) + ") FROM tiles")
cte("filled", """
SELECT filename, source_object_key, mask_name, ordinal, top_left_lon, top_left_lat, bottom_right_lon, bottom_right_lat,
  coalesce(top_right_lon, bottom_right_lon) AS top_right_lon, coalesce(top_right_lat, top_left_lat) AS top_right_lat,
  coalesce(bottom_left_lon, top_left_lon) AS bottom_left_lon, coalesce(bottom_left_lat, bottom_right_lat) AS bottom_left_lat
FROM old_tiles""")
cte("boxed", """
SELECT *, least(top_left_lon, top_right_lon, bottom_right_lon, bottom_left_lon) AS west,
  least(top_left_lat, top_right_lat, bottom_right_lat, bottom_left_lat) AS south,
  greatest(top_left_lon, top_right_lon, bottom_right_lon, bottom_left_lon) AS east,
  greatest(top_left_lat, top_right_lat, bottom_right_lat, bottom_left_lat) AS north FROM filled""")

cte("log_events", f"""
SELECT event_id, {scene_key('(user_id % 11) + 2')} AS object_key, concat('worker-', CAST(user_id % 3 AS VARCHAR)) AS worker_name,
  CASE event_type WHEN 'view' THEN 'slice_geotiff' WHEN 'click' THEN 'download_source' WHEN 'error' THEN 'failed' ELSE 'completed' END AS stage,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' WHEN 'view' THEN NULL ELSE 'INFO' END AS level,
  CASE event_type WHEN 'purchase' THEN 'processed' WHEN 'signup' THEN 'empty' WHEN 'error' THEN 'failed' ELSE 'processing' END AS status,
  props AS message, CAST(floor(value) AS INT) AS progress_current, 500 AS progress_total, ts AS created_at FROM events""")
cte("tasks", """
SELECT object_key, status, 'geotiff_processor' AS processor_name, stage, worker_name, progress_current, progress_total,
  CAST(NULL AS VARCHAR) AS result_path, message AS details, created_at AS updated_at, first_at AS created_at FROM (
  SELECT *, min(created_at) OVER (PARTITION BY object_key) AS first_at,
    row_number() OVER (PARTITION BY object_key ORDER BY created_at DESC, event_id DESC) AS newest FROM log_events)
WHERE newest = 1""")
cte("messages", f"""
SELECT event_id, CASE WHEN event_id % 50 = 0 THEN '{{bad' WHEN event_id % 50 = 1 THEN '{{"bucket":"b"}}'
  WHEN event_id % 50 = 2 THEN '{{"bucket":"b","object_key":""}}'
  WHEN user_id % 2 = 0 THEN concat('{{"bucket":"b","object_key":"', {scene_key('(user_id % 11) + 2')}, '"}}')
  ELSE concat('{{"bucket":"b","object_key":"raw/n_', CAST(user_id AS VARCHAR), '.tif","filename":"n_', CAST(user_id AS VARCHAR), '.tif"}}')
  END AS value FROM events""")
cte("parsed", """
SELECT event_id, json_extract_string(j, '$.bucket') AS bucket, json_extract_string(j, '$.object_key') AS object_key,
  json_extract_string(j, '$.filename') AS filename, value
FROM (SELECT *, CASE WHEN json_valid(value) THEN value END AS j FROM messages)""")
cte("listing", """
SELECT CASE o_orderkey % 5
  WHEN 0 THEN concat('raw/S1_', strftime(o_orderdate, '%Y%m%d'), '_', CAST(o_orderkey AS VARCHAR), '.tif')
  WHEN 1 THEN concat('raw/a/ice map (', CAST(o_orderkey AS VARCHAR), ').TIFF')
  WHEN 2 THEN concat('raw/notes_', CAST(o_orderkey AS VARCHAR), '.txt')
  WHEN 3 THEN concat('raw/dir_', CAST(o_orderkey AS VARCHAR), '/')
  ELSE concat('processed/x_', CAST(o_orderkey AS VARCHAR), '.tif') END AS object_key FROM orders""")
cte("raw_listing", "SELECT * FROM listing WHERE starts_with(object_key, 'raw/') AND NOT ends_with(object_key, '/')")
cte("all_keys", "SELECT object_key FROM listing UNION ALL SELECT url FROM pages")
cte("local_files", """
SELECT CASE p_partkey % 3 WHEN 0 THEN concat('a/ice map (', CAST(p_partkey AS VARCHAR), ').TIFF')
  WHEN 1 THEN concat('new_', CAST(p_partkey AS VARCHAR), '.tif') ELSE concat('doc_', CAST(p_partkey AS VARCHAR), '.pdf') END AS relative_path
FROM part""")
cte("exports", """
SELECT concat('processed/shapefiles/S1_IW_202401', n, '/S1_IW_202401', n, '_masks.', ext) AS export_key
FROM (SELECT regexp_extract(scene_key, '(\\d{2})\\.tif$', 1) AS n FROM scenes), (VALUES ('shp'), ('dbf')) x(ext)
WHERE CAST(n AS INT) % 2 = 0 OR (CAST(n AS INT) = 3 AND ext = 'dbf')""")
cte("scene_rows", """
SELECT o_orderkey AS scene_id, o_orderdate AS start_time,
  CASE o_orderstatus WHEN 'F' THEN 'IW' WHEN 'O' THEN 'EW' ELSE 'SM' END AS mode,
  CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN ['VV'] WHEN '2' THEN ['VV', 'VH'] ELSE ['HH'] END AS pols,
  (o_custkey % 360) - 180e0 AS west, ((o_custkey * 7) % 180) - 90e0 AS south,
  (o_custkey % 360) - 178.5e0 AS east, ((o_custkey * 7) % 180) - 88.5e0 AS north FROM orders""")
cte("viewports", """
SELECT s_suppkey AS view_id, round(70e0 + (s_suppkey % 10) * 0.5e0, 4) AS west, round(75e0 - (s_suppkey % 10) * 0.3e0 - 0.03e0, 4) AS south,
  round(70e0 + (s_suppkey % 10) * 0.5e0 + 0.03e0, 4) AS east, round(75e0 - (s_suppkey % 10) * 0.3e0, 4) AS north FROM supplier""")
cte("catalog", """
SELECT k.source_object_key, coalesce(t.tile_count, 0) AS tile_count, t.west, t.south, t.east, t.north,
  coalesce(p.status, 'unknown') AS status, p.updated_at, p.stage, p.progress_current, p.progress_total, p.details
FROM (SELECT object_key AS source_object_key FROM tasks UNION SELECT source_object_key FROM tiles) k
LEFT JOIN (SELECT source_object_key, count(*) AS tile_count, min(west) AS west, min(south) AS south, max(east) AS east, max(north) AS north
  FROM boxed GROUP BY 1) t USING (source_object_key)
LEFT JOIN tasks p ON p.object_key = k.source_object_key""")
cte("markers", f"""
SELECT concat('processed/status/', {safe('object_key')}, '.json') AS marker_key, object_key, status,
  concat('processed/shapefiles/', {safe('object_key')}, '/', {safe('object_key')}, '_masks.shp') AS shapefile_keys,
  concat({iso('updated_at')}, 'Z') AS processed_at
FROM tasks WHERE status IN ('processed', 'empty') OR object_key = 'raw/S1_IW_20240103.tif'""")

# --- listings, notifications, uploads -------------------------------------------------

check("list_raw_objects", "SELECT * FROM raw_listing")
check("filter_geotiff", r"SELECT object_key FROM listing WHERE regexp_matches(lower(object_key), '\.tiff?$')")
check("parse_notifications", "SELECT event_id, bucket, object_key, filename FROM parsed WHERE object_key <> ''")
check("rejected_notifications", "SELECT event_id, value FROM parsed WHERE coalesce(object_key, '') = ''")
check("encode_notifications", r"""
SELECT concat('{"bucket":"satellite-images","object_key":"', object_key, '","filename":"', string_split(object_key, '/')[-1], '"}') AS value
FROM raw_listing WHERE regexp_matches(lower(object_key), '\.tiff?$')""")
check("new_uploads", r"""
SELECT DISTINCT concat('raw/', relative_path) AS object_key, relative_path FROM local_files
WHERE regexp_matches(lower(relative_path), '\.tiff?$') AND concat('raw/', relative_path) NOT IN (SELECT object_key FROM listing)""")
check("upload_actions", r"""
SELECT DISTINCT concat('raw/', filename) AS object_key, filename,
  CASE WHEN concat('raw/', filename) IN (SELECT regexp_replace(object_key, '^raw/a/', 'raw/') FROM raw_listing) THEN 'notify_only' ELSE 'upload' END AS action
FROM (SELECT string_split(relative_path, '/')[-1] AS filename FROM local_files WHERE regexp_matches(lower(relative_path), '\.tiff?$'))""")
check("exports_by_source", f"""
SELECT scene_key AS source_object_key, export_key FROM scenes JOIN exports
ON starts_with(export_key, concat('processed/shapefiles/', {safe('scene_key')}, '/'))""")

# --- names, links, colours ------------------------------------------------------------

check("source_names", f"""
SELECT object_key, {safe('object_key')} AS safe_name, string_split(object_key, '/')[-1] AS label, {stem('object_key')} AS stem FROM all_keys""")
check("extract_date", f"SELECT object_key, {date_of('object_key')} AS date FROM all_keys")
check("percent_encode", "SELECT object_key, url_encode(object_key) AS encoded FROM all_keys")
check("api_urls", """
SELECT object_key, concat('/api/tiles-geojson?source=', url_encode(object_key)) AS tiles_url,
  concat('/api/image-outline-geojson?source=', url_encode(object_key)) AS outline_url,
  concat('/api/download-shapefile?source=', url_encode(object_key)) AS download_url,
  concat('/api/object?key=', url_encode(object_key)) AS object_url,
  concat('/api/mask-object?key=', url_encode(concat('processed/masks/', object_key)), '&color=2d6a4f') AS mask_url FROM listing""")
check("sanitize_hex_color", """
SELECT part, lower(CASE WHEN regexp_full_match(wide, '[0-9a-fA-F]{6}') THEN wide ELSE '2d6a4f' END) AS color FROM (
  SELECT part, CASE WHEN length(bare) = 3 THEN concat(bare[1], bare[1], bare[2], bare[2], bare[3], bare[3]) ELSE bare END AS wide FROM (
    SELECT part, ltrim(trim(coalesce(raw, '')), '#') AS bare FROM (
      SELECT p_partkey AS part, CASE p_partkey % 4 WHEN 0 THEN concat(' ##', six) WHEN 1 THEN concat('#', substr(six, 4, 3)) WHEN 2 THEN p_brand END AS raw
      FROM (SELECT *, lpad(upper(to_hex(p_partkey * 7919 % 16777216)), 6, '0') AS six FROM part))))""")
check("iso_timestamps", f"""
SELECT event_id, {iso('created_at')} AS created_text FROM log_events UNION ALL SELECT scene_id, {iso('start_time')} FROM scene_rows""")
check("json_safe", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_retailprice END AS price, p_name AS name FROM part")
check("status_label", """
SELECT event_id, concat(CASE WHEN level IS NOT NULL THEN status ELSE 'unknown' END,
  CASE WHEN status <> 'failed' THEN concat(' / ', stage) ELSE '' END,
  CASE WHEN progress_current % 3 <> 0 THEN concat(' (', CAST(progress_current AS VARCHAR), '/', CAST(progress_total AS VARCHAR), ')') ELSE '' END) AS label
FROM log_events""")

# --- boxes and features ---------------------------------------------------------------

check("normalize_bbox", "SELECT c_custkey, round(c_acctbal / 77, 4) AS degrees FROM customer")
_EIGHT = ", ".join(f"{c}_{a}" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
check("filled_corners", f"SELECT filename, {_EIGHT} FROM filled")
check("tile_bbox", "SELECT filename, west, south, east, north FROM boxed")
cte("full_boxes", """
SELECT *, least(top_left_lon, top_right_lon, bottom_right_lon, bottom_left_lon) AS west,
  least(top_left_lat, top_right_lat, bottom_right_lat, bottom_left_lat) AS south,
  greatest(top_left_lon, top_right_lon, bottom_right_lon, bottom_left_lon) AS east,
  greatest(top_left_lat, top_right_lat, bottom_right_lat, bottom_left_lat) AS north FROM tiles""")
check("padded_bounds", """
SELECT filename, round(west - (east - west) * 0.0015e0, 9) AS west, round(south - (north - south) * 0.0015e0, 9) AS south,
  round(east + (east - west) * 0.0015e0, 9) AS east, round(north + (north - south) * 0.0015e0, 9) AS north FROM full_boxes""")
check("corner_delta", """
SELECT filename, round(greatest(abs(top_left_lon - bottom_right_lon), abs(top_left_lat - bottom_right_lat)), 9) AS delta FROM tiles""")
check("bounds_polygon", """
SELECT filename, CAST(seq AS INT) AS seq, CASE WHEN seq IN (0, 3, 4) THEN west ELSE east END AS lon,
  CASE WHEN seq IN (0, 1, 4) THEN south ELSE north END AS lat FROM full_boxes, range(5) r(seq)""")
check("tile_feature", """
SELECT filename, concat('/api/object?key=', url_encode(concat('processed/tiles/', filename))) AS image_url,
  concat('/api/mask-object?key=', url_encode(concat('processed/masks/', mask_name)), '&color=2d6a4f') AS mask_image_url,
  top_right_lat, west, north, round(east + (east - west) * 0.0015e0, 9) AS padded_east,
  5 AS ring_points, bottom_right_lon AS third_lon, top_left_lat AS last_lat FROM boxed""")
check("feature_collection_pages", """
SELECT source_object_key, CAST(ordinal // 25 AS BIGINT) AS page, CAST(count(*) AS INT) AS features, 'FeatureCollection' AS type,
  source_object_key AS source, arg_min(filename, ordinal) AS first_file FROM tiles GROUP BY source_object_key, ordinal // 25""")

# --- raster ---------------------------------------------------------------------------

check("valid_pixels", "SELECT * FROM valid")
check("assign_tiles", """
SELECT scene_key, px, py, px // 12 * 12 AS tile_x, py // 12 * 12 AS tile_y, CAST(least(12, width - px // 12 * 12) AS INT) AS tile_width,
  CAST(least(12, height - py // 12 * 12) AS INT) AS tile_height FROM pixels JOIN scenes USING (scene_key)""")
cte("grid_12", """
SELECT DISTINCT scene_key, px // 12 * 12 AS tile_x, py // 12 * 12 AS tile_y, CAST(least(12, width - px // 12 * 12) AS INT) AS tile_width,
  CAST(least(12, height - py // 12 * 12) AS INT) AS tile_height FROM pixels JOIN scenes USING (scene_key)""")
_DENSE = """
SELECT g.*, CAST(r.n AS INT) AS "at", p.value FROM grid_12 g, range(144) r(n)
LEFT JOIN pixels p ON p.scene_key = g.scene_key AND p.px = g.tile_x + r.n % g.tile_width AND p.py = g.tile_y + r.n // g.tile_width
WHERE r.n < g.tile_width * g.tile_height"""
check("blocks_from_pixels", _DENSE)
check("tiles_from_chunks", _DENSE)
check("pixels_from_blocks", "SELECT * FROM pixels")
check("tile_stats", "SELECT * FROM stats_12")
check("valid_tiles", "SELECT * FROM kept")
check("valid_tiles_clipped_grid", "SELECT * FROM kept_12")
check("tile_summaries", "SELECT * FROM kept_12")
check("data_window", """
SELECT scene_key,
  CAST(coalesce(greatest(0, x0 - 1) // 12 * 12, 0) AS INT) AS x_start, CAST(coalesce(greatest(0, y0 - 1) // 12 * 12, 0) AS INT) AS y_start,
  CAST(coalesce(least(width, ceil(least(width, x1 + 2) / 12e0) * 12), width) AS INT) AS x_stop,
  CAST(coalesce(least(height, ceil(least(height, y1 + 2) / 12e0) * 12), height) AS INT) AS y_stop
FROM scenes LEFT JOIN (SELECT scene_key, min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM valid GROUP BY 1) USING (scene_key)""")
check("chunk_zones", """
SELECT scene_key, CAST(px // 8 * 8 AS INT) AS chunk_x, CAST(py // 8 * 8 AS INT) AS chunk_y, CAST(8 AS INT) AS chunk_width, CAST(8 AS INT) AS chunk_height,
  CAST(count(*) AS INT) AS valid_count, min(value) AS value_min, max(value) AS value_max,
  CAST(min(px % 8) AS INT) AS min_col, CAST(min(py % 8) AS INT) AS min_row, CAST(max(px % 8) AS INT) AS max_col, CAST(max(py % 8) AS INT) AS max_row
FROM valid GROUP BY scene_key, px // 8, py // 8""")
check("filled_chunks", """
SELECT * FROM pixels WHERE (scene_key, px // 8, py // 8) IN (SELECT (scene_key, px // 8, py // 8) FROM valid)""")
check("sample_contrast", "SELECT * FROM sampled")
check("contrast_bounds", "SELECT scene_key, round(low, 12) AS low, round(high, 12) AS high FROM bounds")
check("scene_bounds", "SELECT scene_key, round(low, 12) AS low, round(high, 12) AS high FROM bounds")
cte("grey_cells", """
SELECT k.scene_key, k.tile_x, k.tile_y, k.tile_width, k.tile_height, CAST(r.n AS INT) AS "at", coalesce(g.grey, 0) AS grey
FROM kept k JOIN bounds USING (scene_key), range(64) r(n)
LEFT JOIN grey g ON g.scene_key = k.scene_key AND g.px = k.tile_x + r.n % k.tile_width AND g.py = k.tile_y + r.n // k.tile_width
WHERE r.n < k.tile_width * k.tile_height""")
check("stretch", "SELECT * FROM grey_cells")
check("standardise_rgb", """
SELECT scene_key, tile_x, tile_y, "at", round((grey / 255e0 - 0.485e0) / 0.229e0, 9) AS red,
  round((grey / 255e0 - 0.456e0) / 0.224e0, 9) AS green, round((grey / 255e0 - 0.406e0) / 0.225e0, 9) AS blue FROM grey_cells""")
check("overlay_colours", """
SELECT scene_key, tile_x, tile_y, "at", CASE WHEN grey < 8 THEN 0 ELSE CAST(least(255, floor(grey * 0.72e0)) AS INT) END AS alpha,
  157 AS red, 78 AS green, 221 AS blue FROM grey_cells""")
check("drop_black_tiles", "SELECT scene_key, tile_x, tile_y, tile_width, tile_height, grey_max FROM bright")
check("number_tiles", "SELECT scene_key, tile_x, tile_y, ordinal FROM numbered")
check("tile_names", """
SELECT scene_key, tile_x, tile_y, filename, mask_name, concat('processed/tiles/', filename) AS tile_key,
  concat('processed/masks/', mask_name) AS mask_key FROM named""")
check("tile_kind", """
SELECT scene_key, tile_x, tile_y, tile_width, tile_height, valid_count < total_count AS partial,
  CASE WHEN valid_count < total_count THEN '.png' ELSE '.jpg' END AS extension, valid_count AS opaque_cells FROM kept""")
check("pixel_to_wgs84", f"""
SELECT scene_key, px, py, CASE WHEN epsg IS NOT NULL THEN {lon('px', 'py')} END AS lon, CASE WHEN epsg IS NOT NULL THEN {lat('px', 'py')} END AS lat
FROM pixels JOIN scenes USING (scene_key)""")
check("tile_corners", "SELECT * EXCLUDE (ordinal, partial) FROM tiles")

# --- keyed state ----------------------------------------------------------------------

_UPSERTED_TILES = """
SELECT * EXCLUDE (ordinal, partial),
  CASE WHEN filename IN (SELECT filename FROM first_tiles) THEN '2024-01-01T00:00:00' ELSE '2024-02-01T00:00:00' END AS created_at FROM tiles
UNION ALL SELECT * EXCLUDE (ordinal, partial), '2024-01-01T00:00:00' FROM first_tiles WHERE filename NOT IN (SELECT filename FROM tiles)"""
check("upsert_tiles", _UPSERTED_TILES)
check("tile_deltas", _UPSERTED_TILES)
_TASK_TEXT = f"SELECT * REPLACE ({iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at) FROM tasks"
check("reported_tasks", _TASK_TEXT)
check("upsert_tasks", _TASK_TEXT)
check("task_deltas", _TASK_TEXT)
check("prepare_log", f"""
SELECT object_key, worker_name, stage, coalesce(level, 'INFO') AS level, message, progress_current, progress_total,
  {iso('created_at')} AS created_at FROM log_events""")
check("build_markers", """
SELECT marker_key, concat('{"object_key":"', object_key, '","status":"', status, '","shapefile_keys":["', shapefile_keys,
  '"],"processed_at":"', processed_at, '"}') AS value FROM markers""")
check("parse_markers", "SELECT * FROM markers")
check("conform_schema", """
SELECT filename, source_object_key, top_left_lon, top_left_lat, bottom_right_lon, bottom_right_lat, mask_name,
  CAST(NULL AS DOUBLE) AS top_right_lon, CAST(NULL AS DOUBLE) AS top_right_lat, CAST(NULL AS DOUBLE) AS bottom_left_lon,
  CAST(NULL AS DOUBLE) AS bottom_left_lat, CAST(NULL AS INT) AS tile_x, CAST(NULL AS INT) AS tile_y,
  CAST(NULL AS INT) AS tile_width, CAST(NULL AS INT) AS tile_height FROM tiles""")

# --- catalog and viewport queries -----------------------------------------------------

check("image_catalog", f"SELECT * REPLACE ({iso('updated_at')} AS updated_at) FROM catalog")
check("order_catalog", f"""
SELECT * EXCLUDE (updated_at), {safe('source_object_key')} AS id, string_split(source_object_key, '/')[-1] AS source_label,
  {date_of('source_object_key')} AS acquisition_date, {iso('updated_at')} AS updated_text,
  concat('/api/tiles-geojson?source=', url_encode(source_object_key)) AS tiles_url,
  concat('/api/image-outline-geojson?source=', url_encode(source_object_key)) AS outline_url,
  concat('/api/download-shapefile?source=', url_encode(source_object_key)) AS download_url FROM catalog""")
check("completed_keys", "SELECT object_key FROM tasks WHERE status IN ('processed', 'empty', 'skipped')")
check("pending_keys", f"""
SELECT object_key, CAST(min(origin) AS INT) AS origin, CAST(arg_min(position, origin * 1000000000 + position) AS BIGINT) AS position FROM (
  SELECT object_key, 0 AS origin, event_id AS position FROM parsed WHERE object_key <> ''
  UNION ALL SELECT object_key, 1, 0 FROM raw_listing)
WHERE object_key NOT IN (SELECT object_key FROM tasks WHERE status IN ('processed', 'empty', 'skipped'))
  AND concat('processed/status/', {safe('object_key')}, '.json') NOT IN (SELECT marker_key FROM markers)
GROUP BY object_key""")
check("all_tiles", "SELECT * FROM tiles")
check("tiles_by_source", f"""
SELECT o.* EXCLUDE ({', '.join(f'{c}_{a}' for c in ('top_right', 'bottom_left') for a in ('lon', 'lat'))}),
  f.top_right_lon, f.top_right_lat, f.bottom_left_lon, f.bottom_left_lat
FROM old_tiles o JOIN filled f USING (filename) WHERE o.source_object_key = 'raw/S1_IW_20240104.tif'""")
check("sources_with_tiles", "SELECT DISTINCT source_object_key FROM tiles")
check("missing_exports", f"""
SELECT DISTINCT source_object_key FROM tiles WHERE NOT EXISTS (SELECT 1 FROM exports
  WHERE starts_with(export_key, concat('processed/shapefiles/', {safe('source_object_key')}, '/')) AND ends_with(export_key, '.shp'))""")
check("recent_tasks", f"""
SELECT * REPLACE ({iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at) FROM (
  SELECT * FROM tasks ORDER BY CASE WHEN status = 'processing' THEN 0 ELSE 1 END, updated_at DESC LIMIT 7)""")
check("recent_logs", f"""
SELECT object_key, stage, coalesce(level, 'INFO') AS level, {iso('created_at')} AS created_at FROM (
  SELECT * FROM log_events ORDER BY created_at DESC LIMIT 60)""")
check("processing_overview", f"""
SELECT 'task' AS kind, object_key, worker_name, stage, progress_current, progress_total, status AS state, details AS text, {iso('updated_at')} AS "at"
FROM (SELECT * FROM tasks ORDER BY CASE WHEN status = 'processing' THEN 0 ELSE 1 END, updated_at DESC LIMIT 50)
UNION ALL SELECT 'log', object_key, worker_name, stage, progress_current, progress_total, coalesce(level, 'INFO'), message, {iso('created_at')}
FROM (SELECT * FROM log_events ORDER BY created_at DESC LIMIT 1)""")
check("tiles_in_viewport", """
SELECT filename FROM boxed WHERE source_object_key = 'raw/S1_IW_20240104.tif' AND east >= 71.5 AND west <= 71.53 AND north >= 74.07 AND south <= 74.1""")
check("clustered_tiles_in_view", """
SELECT source_object_key, filename FROM boxed WHERE east >= 71.5 AND west <= 71.53 AND north >= 74.07 AND south <= 74.1""")
check("tiles_in_viewports", f"""
SELECT v.view_id, b.filename FROM (
  SELECT view_id, {scene_key('view_id % 10 + 1')} AS source_object_key, CASE WHEN view_id % 3 <> 0 THEN west END AS west, south, east, north FROM viewports) v
JOIN boxed b USING (source_object_key)
WHERE v.west IS NULL OR (b.east >= v.west AND b.west <= v.east AND b.north >= v.south AND b.south <= v.north)""")
_MEETS = "c.east >= v.west - pad * (v.east - v.west) AND c.west <= v.east + pad * (v.east - v.west) AND c.north >= v.south - pad * (v.north - v.south) AND c.south <= v.north + pad * (v.north - v.south)"
check("images_in_viewport", f"""
SELECT source_object_key, coalesce({_MEETS}, false) AS in_view FROM catalog c,
  (SELECT 71e0 AS west, 73.6e0 AS south, 71.53e0 AS east, 74.5e0 AS north, 0.15e0 AS pad) v""")
check("images_in_viewports", f"""
SELECT v.view_id, c.source_object_key FROM (SELECT *, 0.15e0 AS pad FROM viewports) v JOIN catalog c ON {_MEETS}""")
_SEARCH = """FROM scene_rows WHERE east >= 60 AND west <= 90 AND north >= 50 AND south <= 80 AND start_time >= TIMESTAMP '{0}'
AND start_time < TIMESTAMP '{1}' AND list_contains(pols, 'VV') AND mode = 'IW' ORDER BY start_time DESC, scene_id LIMIT 12"""
check("scene_search", f"""
SELECT scene_id, {iso('start_time')} AS start_time, west, south FROM (SELECT * {_SEARCH.format('1993-01-01', '1998-01-01')})""")
check("download_names", f"""
SELECT scene_id, CAST(rn AS INT) AS position, concat('sentinel1_', strftime(start_time, '%Y%m%d'), '_', CAST(rn AS VARCHAR), '.tif') AS filename FROM (
  SELECT *, row_number() OVER (ORDER BY start_time DESC, scene_id) - 1 AS rn FROM (SELECT * {_SEARCH.format('1990-01-01', '2000-01-01')}))""")
check("run_summary", "SELECT status, count(*) AS scenes, count(*) FILTER (tile_count > 0) AS with_tiles FROM catalog GROUP BY status")

# --- masks and land -------------------------------------------------------------------

cte("mask", """
SELECT g.scene_key, g.tile_x, g.tile_y, g.tile_width, g.tile_height, CAST(g.py - g.tile_y AS INT) AS "row", CAST(g.px - g.tile_x AS INT) AS col
FROM grey g JOIN bright b USING (scene_key, tile_x, tile_y) WHERE g.grey > 128""")
_CELL = 'scene_key, tile_x, tile_y, "row", col'
check("segment_tiles", f"SELECT {_CELL} FROM mask")
check("segment_with_model", f"""
SELECT g.scene_key, g.tile_x, g.tile_y, CAST(g.py - g.tile_y AS INT) AS "row", CAST(g.px - g.tile_x AS INT) AS col
FROM grey g JOIN grey_cells s ON s.scene_key = g.scene_key AND s.tile_x = g.tile_x AND s.tile_y = g.tile_y
  AND s."at" = ((g.py - g.tile_y) // 2 * 2) * 8 + (g.px - g.tile_x) // 2 * 2
WHERE s.grey > 128""")
cte("fill", """
SELECT scene_key, tile_x, tile_y, CAST(count(*) AS INT) AS filled, count(*) / CAST(any_value(tile_width * tile_height) AS DOUBLE) AS fill_ratio
FROM mask GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY scene_key, tile_x, tile_y"))
check("mask_fill", "SELECT scene_key, tile_x, tile_y, filled, round(fill_ratio, 9) AS fill_ratio FROM fill")
check("filled_masks", "SELECT scene_key, tile_x, tile_y, filled FROM fill WHERE fill_ratio >= 0.05")
check("mask_runs", """
SELECT scene_key, tile_x, tile_y, tile_width, tile_height, "row", CAST(min(col) AS INT) AS c0, CAST(max(col) AS INT) AS c1 FROM (
  SELECT *, col - row_number() OVER (PARTITION BY scene_key, tile_x, tile_y, "row" ORDER BY col) AS island FROM mask)
GROUP BY scene_key, tile_x, tile_y, tile_width, tile_height, "row", island""")
check("stored_masks", """
SELECT l_orderkey, l_linenumber, CAST(floor(least(greatest(l_discount * 10, 0e0), 1e0) * 255) AS INT) AS alpha,
  floor(least(greatest(l_discount * 10, 0e0), 1e0) * 255) > 127 AS "set" FROM lineitem""")
cte("land", """
SELECT s_suppkey AS poly_id, v AS seq,
  round(70e0 + (s_suppkey % 10) * 0.5e0 + ((s_suppkey * 37) % 100) * 0.0008e0
    + ((s_suppkey % 5) * 0.002e0 + 0.004e0) * cos(2e0 * pi() * (v % (3 + s_suppkey % 4)) / (3 + s_suppkey % 4) + s_suppkey), 9) AS lon,
  round(75e0 - (s_suppkey % 10) * 0.3e0 - ((s_suppkey * 61) % 100) * 0.0004e0
    + ((s_suppkey % 5) * 0.002e0 + 0.004e0) * sin(2e0 * pi() * (v % (3 + s_suppkey % 4)) / (3 + s_suppkey % 4) + s_suppkey), 9) AS lat
FROM supplier, (SELECT CAST(n_nationkey AS INT) AS v FROM nation WHERE n_nationkey < 7) r WHERE v <= 3 + s_suppkey % 4""")
cte("edges", """
SELECT a.poly_id, a.lon AS x1, a.lat AS y1, b.lon AS x2, b.lat AS y2 FROM land a JOIN land b ON a.poly_id = b.poly_id AND b.seq = a.seq + 1""")
check("land_edges", "SELECT * FROM edges")
cte("tile_boxes", """
SELECT source_object_key AS scene_key, tile_x, tile_y, tile_width, tile_height, west, south, east, north,
  top_left_lon, top_left_lat, top_right_lon, top_right_lat, bottom_left_lon, bottom_left_lat FROM full_boxes""")
_SIDES = "(x2 - x1) * ({y} - y1) - (y2 - y1) * ({x} - x1)"


def touches(w: str, s: str, e: str, n: str) -> str:
    sides = ", ".join(_SIDES.format(x=x, y=y) for x in (w, e) for y in (s, n))
    return (f"least(x1, x2) <= {e} AND greatest(x1, x2) >= {w} AND least(y1, y2) <= {n} AND greatest(y1, y2) >= {s} "
            f"AND least({sides}) <= 0 AND greatest({sides}) >= 0")


def crosses(x: str, y: str) -> str:
    return f"least(y1, y2) <= {y} AND {y} < greatest(y1, y2) AND x1 + ({y} - y1) * (x2 - x1) / (y2 - y1) > {x}"


check("land_candidates", f"""
SELECT scene_key, tile_x, tile_y, poly_id FROM tile_boxes t, edges
GROUP BY scene_key, tile_x, tile_y, poly_id
HAVING bool_or({touches('west', 'south', 'east', 'north')}) OR count(*) FILTER ({crosses('west', 'north')}) % 2 = 1""")
cte("close_pairs", """
SELECT t.*, e.poly_id FROM tile_boxes t JOIN (SELECT poly_id, min(least(x1, x2)) AS w, max(greatest(x1, x2)) AS e, min(least(y1, y2)) AS s,
  max(greatest(y1, y2)) AS n FROM edges GROUP BY 1) e ON t.west <= e.e AND t.east >= e.w AND t.south <= e.n AND t.north >= e.s""")
cte("near_cells", """
SELECT t.*, CAST(r.n AS INT) AS "row", CAST(c.n AS INT) AS col FROM close_pairs t, range(8) r(n), range(8) c(n)
WHERE r.n < tile_height AND c.n < tile_width""")
cte("grid_edges", """
SELECT n.scene_key, n.tile_x, n.tile_y, n."row", n.col, n.poly_id,
  (e.x1 - west) / (east - west) * tile_width AS x1, (north - e.y1) / (north - south) * tile_height AS y1,
  (e.x2 - west) / (east - west) * tile_width AS x2, (north - e.y2) / (north - south) * tile_height AS y2
FROM near_cells n JOIN edges e USING (poly_id)""")
cte("land_cells", f"""
SELECT DISTINCT {_CELL} FROM (SELECT {_CELL}, poly_id FROM grid_edges GROUP BY {_CELL}, poly_id
HAVING bool_or({touches('col', '"row"', 'col + 1', '"row" + 1')}) OR count(*) FILTER ({crosses('col + 0.5e0', '"row" + 0.5e0')}) % 2 = 1)""")
check("rasterize_land", "SELECT * FROM land_cells")
check("union_land", """
SELECT scene_key, tile_x, tile_y, count(DISTINCT ("row", island)) AS spans, count(*) AS cells FROM (
  SELECT *, col - row_number() OVER (PARTITION BY scene_key, tile_x, tile_y, "row" ORDER BY col) AS island FROM land_cells)
GROUP BY scene_key, tile_x, tile_y""")
check("clip_mask_to_water", f"SELECT {_CELL} FROM mask ANTI JOIN land_cells USING ({_CELL})")
cte("centres", """
SELECT *, top_left_lon + (top_right_lon - top_left_lon) / tile_width * (col + 0.5e0) + (bottom_left_lon - top_left_lon) / tile_height * ("row" + 0.5e0) AS cx,
  top_left_lat + (top_right_lat - top_left_lat) / tile_width * (col + 0.5e0) + (bottom_left_lat - top_left_lat) / tile_height * ("row" + 0.5e0) AS cy
FROM near_cells""")
cte("centre_cells", f"""
SELECT DISTINCT {_CELL} FROM (SELECT {_CELL}, poly_id FROM centres JOIN edges USING (poly_id) GROUP BY {_CELL}, poly_id
HAVING count(*) FILTER ({crosses('cx', 'cy')}) % 2 = 1)""")
check("centre_land", "SELECT * FROM centre_cells")
check("clip_polygons_to_water", f"SELECT {_CELL} FROM mask ANTI JOIN centre_cells USING ({_CELL})")

# --- components, polygons, outlines ---------------------------------------------------

_TILE = "scene_key, tile_x, tile_y"
cte("numbered_mask", 'SELECT *, "row" * 8 + col AS id FROM mask')
cte("linked", f"""
SELECT a.scene_key, a.tile_x, a.tile_y, a.id, b.id AS next FROM numbered_mask a JOIN numbered_mask b USING ({_TILE})
WHERE abs(a."row" - b."row") + abs(a.col - b.col) = 1""")
cte("reach", f"""
SELECT {_TILE}, id, id AS other FROM numbered_mask
UNION SELECT r.scene_key, r.tile_x, r.tile_y, r.id, l.next FROM reach r
JOIN linked l ON l.scene_key = r.scene_key AND l.tile_x = r.tile_x AND l.tile_y = r.tile_y AND l.id = r.other""")
cte("seeded", f"SELECT m.*, s.seed FROM numbered_mask m JOIN (SELECT {_TILE}, id, min(other) AS seed FROM reach GROUP BY ALL) s USING ({_TILE}, id)")
cte("components", f"""
SELECT {_TILE}, tile_width, tile_height, CAST(seed // 8 AS INT) AS seed_row, CAST(seed % 8 AS INT) AS seed_col, count(*) AS cells,
  CAST(min(col) AS INT) AS col_min, CAST(max(col) AS INT) AS col_max, CAST(min("row") AS INT) AS row_min, CAST(max("row") AS INT) AS row_max
FROM seeded GROUP BY {_TILE}, tile_width, tile_height, seed""")
check("polygonize", "SELECT * FROM components")
cte("areas", f"""
SELECT c.*, t.filename, t.mask_name, cells * abs((top_right_lon - top_left_lon) / c.tile_width * ((bottom_left_lat - top_left_lat) / c.tile_height)
  - (bottom_left_lon - top_left_lon) / c.tile_height * ((top_right_lat - top_left_lat) / c.tile_width)) AS area
FROM components c JOIN tiles t ON t.source_object_key = c.scene_key AND t.tile_x = c.tile_x AND t.tile_y = c.tile_y""")
check("polygon_area", f"SELECT {_TILE}, seed_row, seed_col, cells, round(area, 12) AS area FROM areas")
check("large_polygons", "SELECT filename, mask_name, seed_row, seed_col, cells FROM areas WHERE area >= 0.00001")
check("component_rings", f"""
SELECT {_TILE}, CAST(seed // 8 AS INT) AS seed_row, CAST(seed % 8 AS INT) AS seed_col,
  4 * count(*) - coalesce(sum(n.joins), 0)::BIGINT AS perimeter, count(*) AS cells, CAST(1 AS BIGINT) AS outer_rings
FROM seeded LEFT JOIN (SELECT {_TILE}, id, count(*) AS joins FROM linked GROUP BY ALL) n USING ({_TILE}, id) GROUP BY {_TILE}, seed""")
cte("scene_mask", """
SELECT m.scene_key, m.tile_x + m.col AS x, m.tile_y + m."row" AS y, CAST(m.tile_y + m."row" AS BIGINT) * s.width + m.tile_x + m.col AS id
FROM mask m JOIN scenes s USING (scene_key)""")
cte("scene_linked", """
SELECT a.scene_key, a.id, b.id AS next FROM scene_mask a JOIN scene_mask b ON a.scene_key = b.scene_key AND b.y = a.y AND b.x = a.x + 1
UNION ALL SELECT a.scene_key, b.id, a.id FROM scene_mask a JOIN scene_mask b ON a.scene_key = b.scene_key AND b.y = a.y AND b.x = a.x + 1
UNION ALL SELECT a.scene_key, a.id, b.id FROM scene_mask a JOIN scene_mask b ON a.scene_key = b.scene_key AND b.x = a.x AND b.y = a.y + 1
UNION ALL SELECT a.scene_key, b.id, a.id FROM scene_mask a JOIN scene_mask b ON a.scene_key = b.scene_key AND b.x = a.x AND b.y = a.y + 1""")
cte("scene_reach", """
SELECT scene_key, id, id AS other FROM scene_mask
UNION SELECT r.scene_key, r.id, l.next FROM scene_reach r JOIN scene_linked l ON l.scene_key = r.scene_key AND l.id = r.other""")
check("merge_masks", """
SELECT scene_key, component, count(*) AS cells, CAST(min(x) AS INT) AS x_min, CAST(max(x) AS INT) AS x_max,
  CAST(min(y) AS INT) AS y_min, CAST(max(y) AS INT) AS y_max
FROM scene_mask JOIN (SELECT scene_key, id, min(other) AS component FROM scene_reach GROUP BY ALL) USING (scene_key, id)
GROUP BY scene_key, component""")
check("scene_outlines", """
SELECT scene_key, component, count(*) AS cells, CAST(1 AS BIGINT) AS outer_rings
FROM scene_mask JOIN (SELECT scene_key, id, min(other) AS component FROM scene_reach GROUP BY ALL) USING (scene_key, id)
GROUP BY scene_key, component""")
cte("disc", "SELECT CAST(a.n AS INT) - 2 AS dx, CAST(b.n AS INT) - 2 AS dy FROM range(5) a(n), range(5) b(n) WHERE (a.n - 2) * (a.n - 2) + (b.n - 2) * (b.n - 2) <= 4")
cte("grown", "SELECT DISTINCT scene_key, x + dx AS x, y + dy AS y FROM scene_mask, disc")
check("close_gaps", """
SELECT scene_key, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (SELECT scene_key, x - dx AS x, y - dy AS y FROM grown, disc)
GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM disc)""")
cte("scene_radii", f"""
SELECT scene_key, 0.0021 / sqrt(pow({lon('(width // 2 + 1)', '(height // 2)')} - {lon('(width // 2)', '(height // 2)')}, 2)
    + pow({lat('(width // 2 + 1)', '(height // 2)')} - {lat('(width // 2)', '(height // 2)')}, 2)) AS gap_x,
  0.0021 / sqrt(pow({lon('(width // 2)', '(height // 2 + 1)')} - {lon('(width // 2)', '(height // 2)')}, 2)
    + pow({lat('(width // 2)', '(height // 2 + 1)')} - {lat('(width // 2)', '(height // 2)')}, 2)) AS gap_y
FROM scenes""")
cte("ellipses", """
SELECT scene_key, CAST(a.n AS INT) - 30 AS dx, CAST(b.n AS INT) - 30 AS dy
FROM (SELECT scene_key, coalesce(gap_x, 1e-9) AS gap_x, coalesce(gap_y, 1e-9) AS gap_y FROM scene_radii), range(61) a(n), range(61) b(n)
WHERE pow((a.n - 30) / gap_x, 2) + pow((b.n - 30) / gap_y, 2) <= 1""")
cte("wide", "SELECT DISTINCT scene_key, x + dx AS x, y + dy AS y FROM scene_mask JOIN ellipses USING (scene_key)")
check("close_gaps_by_degrees", """
SELECT scene_key, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM (
  SELECT scene_key, x - dx AS x, y - dy AS y, count(*) AS n FROM wide JOIN ellipses USING (scene_key) GROUP BY ALL)
JOIN (SELECT scene_key, count(*) AS n FROM ellipses GROUP BY 1) USING (scene_key, n)""")
cte("plus_cells", "SELECT * FROM (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS c(dx, dy)")
cte("crossed", "SELECT DISTINCT scene_key, x + dx AS x, y + dy AS y FROM scene_mask, plus_cells")
cte("closed_runs", """
SELECT scene_key, y, min(x) AS c0, max(x) AS c1, min(y * width + x) AS id FROM (
  SELECT *, x - row_number() OVER (PARTITION BY scene_key, y ORDER BY x) AS island FROM (
    SELECT scene_key, x - dx AS x, y - dy AS y FROM crossed, plus_cells GROUP BY ALL HAVING count(*) = 5))
JOIN scenes USING (scene_key) GROUP BY scene_key, y, island""")
cte("closed_links", """
SELECT a.scene_key, a.id, b.id AS next FROM closed_runs a JOIN closed_runs b
ON a.scene_key = b.scene_key AND abs(a.y - b.y) = 1 AND a.c0 <= b.c1 AND b.c0 <= a.c1""")
cte("closed_reach", """
SELECT scene_key, id, id AS other FROM closed_runs
UNION SELECT r.scene_key, r.id, l.next FROM closed_reach r JOIN closed_links l ON l.scene_key = r.scene_key AND l.id = r.other""")
check("merge_masks_closing_gaps", """
SELECT scene_key, CAST(component AS BIGINT) AS component, CAST(sum(c1 - c0 + 1) AS BIGINT) AS cells, CAST(min(c0) AS INT) AS x_min, CAST(max(c1) AS INT) AS x_max,
  CAST(min(y) AS INT) AS y_min, CAST(max(y) AS INT) AS y_max
FROM closed_runs JOIN (SELECT scene_key, id, min(other) AS component FROM closed_reach GROUP BY ALL) USING (scene_key, id)
GROUP BY scene_key, component""")
cte("seams", """
SELECT a.source_object_key, 'top' AS edge, a.filename, greatest(abs(a.top_right_lon - b.top_left_lon), abs(a.top_right_lat - b.top_left_lat)) AS delta,
  a.tile_y AS ay, b.tile_y AS yb
FROM tiles a JOIN tiles b ON a.source_object_key = b.source_object_key AND b.tile_x = a.tile_x + a.tile_width AND b.tile_y = a.tile_y
UNION ALL SELECT a.source_object_key, 'bottom', a.filename, greatest(abs(a.bottom_right_lon - b.bottom_left_lon), abs(a.bottom_right_lat - b.bottom_left_lat)), a.tile_y, b.tile_y
FROM tiles a JOIN tiles b ON a.source_object_key = b.source_object_key AND b.tile_x = a.tile_x + a.tile_width AND b.tile_y = a.tile_y
UNION ALL SELECT a.source_object_key, 'left', a.filename, greatest(abs(a.bottom_left_lon - b.top_left_lon), abs(a.bottom_left_lat - b.top_left_lat)), a.tile_y, b.tile_y
FROM tiles a JOIN tiles b ON a.source_object_key = b.source_object_key AND b.tile_x = a.tile_x AND b.tile_y = a.tile_y + a.tile_height
UNION ALL SELECT a.source_object_key, 'right', a.filename, greatest(abs(a.bottom_right_lon - b.top_right_lon), abs(a.bottom_right_lat - b.top_right_lat)), a.tile_y, b.tile_y
FROM tiles a JOIN tiles b ON a.source_object_key = b.source_object_key AND b.tile_x = a.tile_x AND b.tile_y = a.tile_y + a.tile_height""")
check("validate_corners", """
SELECT source_object_key, count(edge) AS checked, count(*) FILTER (delta > 1e-10) AS mismatches, count(*) FILTER (delta > 1e-10) = 0 AS consistent
FROM (SELECT DISTINCT source_object_key FROM tiles) LEFT JOIN seams USING (source_object_key) GROUP BY 1""")
cte("moved_seams", """
SELECT *, (edge IN ('bottom', 'left') AND ay % 16 = 0) AS off FROM seams""")
check("validate_corners_other_rows", """
SELECT source_object_key, count(edge) AS checked, count(*) FILTER (off) AS mismatches, count(*) FILTER (off) = 0 AS consistent
FROM (SELECT DISTINCT source_object_key FROM tiles) LEFT JOIN moved_seams USING (source_object_key) GROUP BY 1""")
cte("tile_sides", """
SELECT source_object_key, tile_x AS ax, tile_y AS ay, tile_x + tile_width AS bx, tile_y AS by, 0 AS direction FROM tiles
UNION ALL SELECT source_object_key, tile_x + tile_width, tile_y, tile_x + tile_width, tile_y + tile_height, 1 FROM tiles
UNION ALL SELECT source_object_key, tile_x + tile_width, tile_y + tile_height, tile_x, tile_y + tile_height, 2 FROM tiles
UNION ALL SELECT source_object_key, tile_x, tile_y + tile_height, tile_x, tile_y, 3 FROM tiles""")
cte("outer_sides", """
SELECT source_object_key, any_value(ax) AS ax, any_value(ay) AS ay, any_value(bx) AS bx, any_value("by") AS "by", any_value(direction) AS direction
FROM tile_sides GROUP BY source_object_key, least(ax, bx), least(ay, "by"), greatest(ax, bx), greatest(ay, "by") HAVING count(*) = 1""")
check("footprint_sides", "SELECT * FROM outer_sides")
cte("tile_reach", """
SELECT source_object_key, tile_x, tile_y, tile_width, tile_height, tile_x AS rx, tile_y AS ry FROM tiles
UNION SELECT r.source_object_key, t.tile_x, t.tile_y, t.tile_width, t.tile_height, r.rx, r.ry FROM tile_reach r JOIN tiles t
ON t.source_object_key = r.source_object_key AND (
  (t.tile_y = r.tile_y AND (t.tile_x = r.tile_x + r.tile_width OR r.tile_x = t.tile_x + t.tile_width))
  OR (t.tile_x = r.tile_x AND (t.tile_y = r.tile_y + r.tile_height OR r.tile_y = t.tile_y + t.tile_height)))""")
check("footprint_parts", """
SELECT source_object_key, parts, area FROM (
  SELECT source_object_key, count(DISTINCT root) AS parts FROM (
    SELECT source_object_key, tile_x, tile_y, min(ry * 100000 + rx) AS root FROM tile_reach GROUP BY ALL) GROUP BY 1)
JOIN (SELECT source_object_key, round(sum(abs(top_left_lon * top_right_lat - top_right_lon * top_left_lat + top_right_lon * bottom_right_lat
  - bottom_right_lon * top_right_lat + bottom_right_lon * bottom_left_lat - bottom_left_lon * bottom_right_lat + bottom_left_lon * top_left_lat
  - top_left_lon * bottom_left_lat)) / 2, 6) AS area FROM tiles GROUP BY 1) USING (source_object_key)""")
check("worker_name_events", "SELECT count(*) AS events, count(*) AS named FROM events")
check("footprint_area", """
SELECT source_object_key, round(sum(abs(top_left_lon * top_right_lat - top_right_lon * top_left_lat + top_right_lon * bottom_right_lat - bottom_right_lon * top_right_lat
  + bottom_right_lon * bottom_left_lat - bottom_left_lon * bottom_right_lat + bottom_left_lon * top_left_lat - top_left_lon * bottom_left_lat)) / 2, 9) AS area
FROM tiles GROUP BY 1""")
check("footprint_rings", """
SELECT source_object_key, sides, grid_area FROM (SELECT source_object_key, count(*) AS sides FROM outer_sides GROUP BY 1)
JOIN (SELECT source_object_key, CAST(sum(tile_width * tile_height) AS BIGINT) AS grid_area FROM tiles GROUP BY 1) USING (source_object_key)""")

# --- whole run and streams ------------------------------------------------------------

check("process_scenes", "SELECT * EXCLUDE (partial) FROM tiles")
cte("placed_mask", f"""
SELECT m.* FROM mask m JOIN tiles t ON t.source_object_key = m.scene_key AND t.tile_x = m.tile_x AND t.tile_y = m.tile_y
ANTI JOIN land_cells l ON l.scene_key = m.scene_key AND l.tile_x = m.tile_x AND l.tile_y = m.tile_y AND l."row" = m."row" AND l.col = m.col""")
check("processed_masks", f"SELECT {_CELL} FROM placed_mask")
cte("scanned", """
SELECT scene_key, CAST(ceil((x1 - x0) / 8e0) * ceil((y1 - y0) / 8e0) AS INT) AS windows FROM (
  SELECT scene_key, greatest(0, min(px) - 1) // 8 * 8 AS x0, greatest(0, min(py) - 1) // 8 * 8 AS y0,
    least(any_value(width), ceil(least(any_value(width), max(px) + 2) / 8e0) * 8) AS x1,
    least(any_value(height), ceil(least(any_value(height), max(py) + 2) / 8e0) * 8) AS y1
  FROM valid JOIN scenes USING (scene_key) GROUP BY scene_key)""")
check("scan_events", """
SELECT scene_key AS object_key, 'scan_tiles' AS stage, CAST(count(*) AS INT) AS progress_current, any_value(windows) AS progress_total
FROM kept JOIN scanned USING (scene_key) GROUP BY scene_key""")
cte("entries", """
SELECT k.scene_key, CAST(row_number() OVER (PARTITION BY k.scene_key ORDER BY k.tile_y, k.tile_x) AS INT) AS i,
  CAST(count(*) OVER (PARTITION BY k.scene_key) AS INT) AS n, b.grey_max
FROM kept k JOIN bounds USING (scene_key) LEFT JOIN bright b USING (scene_key, tile_x, tile_y)""")
check("progress_events", """
SELECT scene_key AS object_key, 'generate_tiles' AS stage, printf('Tiles prepared: %d of %d.', i, n) AS message, i AS progress_current, n AS progress_total
FROM entries WHERE grey_max IS NOT NULL AND (i = 1 OR i % 10 = 0 OR i = n)""")
cte("tile_counts", "SELECT source_object_key AS object_key, CAST(count(*) AS INT) AS n FROM tiles GROUP BY 1")
_STATUS = r"""
SELECT object_key, CASE WHEN NOT regexp_matches(lower(object_key), '\.tiff?$') THEN 'skipped' WHEN NOT known THEN 'failed' WHEN n IS NULL THEN 'empty' ELSE 'processed' END AS status,
  CASE WHEN NOT regexp_matches(lower(object_key), '\.tiff?$') THEN 'validate_input' WHEN NOT known THEN 'failed' ELSE 'completed' END AS stage,
  coalesce(n, 0) AS tile_count, CASE WHEN known THEN coalesce(n, 0) END AS progress_total
FROM (SELECT scene_key AS object_key, true AS known FROM scenes UNION SELECT object_key, false FROM raw_listing) LEFT JOIN tile_counts USING (object_key)"""
check("scene_status", _STATUS)
check("notification_stream", "SELECT bucket, object_key, filename FROM parsed WHERE object_key <> ''")
check("dedup_keys", "SELECT DISTINCT object_key FROM parsed WHERE object_key <> ''")
check("task_state_stream", _TASK_TEXT)
check("log_stream", f"""
SELECT object_key, worker_name, stage, coalesce(level, 'INFO') AS level, message, progress_current, progress_total,
  {iso('created_at')} AS created_at FROM log_events""")

cte("placed_fill", f"""
SELECT {_TILE}, count(*) / CAST(any_value(tile_width * tile_height) AS DOUBLE) AS fill_ratio FROM placed_mask GROUP BY {_TILE}
HAVING count(*) / CAST(any_value(tile_width * tile_height) AS DOUBLE) >= 0.05""")
cte("final_mask", f"""
SELECT m.*, f.fill_ratio, m."row" * 8 + m.col AS id FROM placed_mask m JOIN placed_fill f USING ({_TILE})
ANTI JOIN centre_cells l ON l.scene_key = m.scene_key AND l.tile_x = m.tile_x AND l.tile_y = m.tile_y AND l."row" = m."row" AND l.col = m.col""")
cte("final_linked", f"""
SELECT a.scene_key, a.tile_x, a.tile_y, a.id, b.id AS next FROM final_mask a JOIN final_mask b USING ({_TILE})
WHERE abs(a."row" - b."row") + abs(a.col - b.col) = 1""")
cte("final_reach", f"""
SELECT {_TILE}, id, id AS other FROM final_mask
UNION SELECT r.scene_key, r.tile_x, r.tile_y, r.id, l.next FROM final_reach r
JOIN final_linked l ON l.scene_key = r.scene_key AND l.tile_x = r.tile_x AND l.tile_y = r.tile_y AND l.id = r.other""")
cte("final_components", f"""
SELECT m.scene_key, m.tile_x, m.tile_y, s.seed, count(*) AS cells, any_value(m.fill_ratio) AS fill_ratio
FROM final_mask m JOIN (SELECT {_TILE}, id, min(other) AS seed FROM final_reach GROUP BY {_TILE}, id) s USING ({_TILE}, id)
GROUP BY m.scene_key, m.tile_x, m.tile_y, s.seed""")
cte("final_polygons", """
SELECT c.scene_key, t.filename, t.mask_name, CAST(seed // 8 AS INT) AS seed_row, CAST(seed % 8 AS INT) AS seed_col, cells, round(fill_ratio, 9) AS fill_ratio
FROM final_components c JOIN tiles t ON t.source_object_key = c.scene_key AND t.tile_x = c.tile_x AND t.tile_y = c.tile_y
WHERE cells * abs((top_right_lon - top_left_lon) / t.tile_width * ((bottom_left_lat - top_left_lat) / t.tile_height)
  - (bottom_left_lon - top_left_lon) / t.tile_height * ((top_right_lat - top_left_lat) / t.tile_width)) >= 0.00001""")
check("processed_polygons", "SELECT * EXCLUDE (scene_key) FROM final_polygons")
check("rebuild_exports", f"""
SELECT object_key, 'processed' AS status, 'mask_assembler' AS processor_name, 'rebuild_shapefile' AS stage,
  concat('processed/shapefiles/', {safe('object_key')}, '/', {safe('object_key')}, '_masks.geojson') AS result_path,
  'Export rebuilt from stored tiles and masks.' AS details
FROM (SELECT DISTINCT scene_key AS object_key FROM final_polygons) WHERE NOT EXISTS (SELECT 1 FROM exports
  WHERE starts_with(export_key, concat('processed/shapefiles/', {safe('object_key')}, '/')) AND ends_with(export_key, '.shp'))""")
check("ingest_stream", """
SELECT object_key, CASE WHEN s.scene_key IS NULL THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'processed' END AS status,
  CASE WHEN s.scene_key IS NULL THEN 'failed' ELSE 'completed' END AS stage,
  CASE WHEN s.scene_key IS NOT NULL THEN coalesce(n, 0) END AS progress_current
FROM (SELECT object_key FROM parsed WHERE object_key <> '' UNION SELECT scene_key FROM scenes) k
LEFT JOIN scenes s ON s.scene_key = k.object_key
LEFT JOIN (SELECT scene_key, CAST(count(*) AS INT) AS n FROM numbered JOIN scenes USING (scene_key) WHERE epsg IS NOT NULL GROUP BY 1) c ON c.scene_key = k.object_key""")

check("scene_status_with_failures", f"""
SELECT scene_key AS object_key, CASE WHEN epsg IN (3857, 32642) THEN 'failed' WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'processed' END AS status,
  CASE WHEN epsg IN (3857, 32642) THEN 'failed' ELSE 'completed' END AS stage, CASE WHEN epsg IN (3857, 32642) THEN 'ERROR' ELSE 'INFO' END AS level,
  CAST(CASE WHEN epsg IN (3857, 32642) THEN 0 ELSE coalesce(n, 0) END AS INT) AS tile_count,
  CASE WHEN epsg NOT IN (3857, 32642) AND n > 0 THEN scene_key = {scene_key('1')} END AS is_arctic
FROM scenes LEFT JOIN (SELECT scene_key, CAST(count(*) AS INT) AS n FROM numbered JOIN scenes USING (scene_key) WHERE epsg IS NOT NULL GROUP BY 1) USING (scene_key)""")
check("retry_failed", """
SELECT s.scene_key AS object_key, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' ELSE 'processed' END AS status, 'completed' AS stage,
  coalesce(n, 0) AS progress_current, CAST(coalesce(epsg = 3857, false) AS BIGINT) AS failures
FROM scenes s LEFT JOIN (SELECT scene_key, CAST(count(*) AS INT) AS n FROM numbered JOIN scenes USING (scene_key) WHERE epsg IS NOT NULL GROUP BY 1) c USING (scene_key)""")

cte("run_tiles", """
SELECT source_object_key AS object_key, CAST(row_number() OVER (PARTITION BY source_object_key ORDER BY tile_y, tile_x) AS INT) AS i,
  CAST(count(*) OVER (PARTITION BY source_object_key) AS INT) AS n FROM tiles""")
cte("run_steps", "SELECT * FROM run_tiles WHERE i = 1 OR i % 50 = 0 OR i = n")
check("run_events", """
SELECT object_key, 'generate_tiles' AS stage, 'INFO' AS level, printf('Tiles prepared: %d of %d.', i, n) AS message, i AS progress_current, n AS progress_total FROM run_steps
UNION ALL SELECT object_key, 'assemble_shapefile', 'INFO', printf('Masks processed: %d of %d.', i, n), i, n FROM run_steps
UNION ALL SELECT object_key, 'assemble_shapefile', 'INFO', printf('Assembly begun. Tiles: %d.', n), NULL, NULL FROM run_tiles WHERE i = 1
UNION ALL SELECT object_key, 'assemble_shapefile', 'WARNING', 'No suitable polygons, no export.', NULL, NULL FROM run_tiles
WHERE i = 1 AND object_key NOT IN (SELECT scene_key FROM final_polygons)
UNION ALL SELECT source_object_key, 'validate_tile_corners', 'INFO', printf('Corners of neighbouring tiles checked: %d.', count(edge)),
  CAST(count(edge) AS INT), CAST(count(edge) AS INT)
FROM (SELECT DISTINCT source_object_key FROM tiles) LEFT JOIN seams USING (source_object_key) GROUP BY 1""")
check("ingested_exports", f"""
SELECT concat('processed/shapefiles/', {safe('scene_key')}, '/', {safe('scene_key')}, '_masks.geojson') AS export_key, count(*) AS features
FROM final_polygons GROUP BY scene_key""")
check("ingested_masks", f"SELECT {_CELL} FROM placed_mask")
