import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rastertables import schemas
from rastertables.functions import geojson
from rastertables.functions.bbox import Box
from rastertables.plans import catalog
from rastertables.sources import deltas, exports, objects, state

REPORT = ("object_key string, status string, processor_name string, stage string, worker_name string, "
          "progress_current int, progress_total int, result_path string, details string, reported_at timestamp, n int")


def report(key, status, minute, n):
    return (key, status, "geotiff_processor", None, None, None, None, None, None, datetime(2024, 1, 1, 0, minute), n)


def test_task_state_does_not_depend_on_batches(spark, as_rows):
    events = [report("a", "processing", 1, 1), report("a", "failed", 5, 2), report("b", "processing", 2, 3),
              report("a", "processed", 9, 4), report("b", "empty", 2, 5)]
    frame = lambda some: spark.createDataFrame(some, REPORT)
    order = ["reported_at", "n"]
    empty = spark.createDataFrame([], schemas.TASKS)
    whole = state.upsert_tasks(empty, frame(events), order)
    forward = state.upsert_tasks(state.upsert_tasks(empty, frame(events[:2]), order), frame(events[2:]), order)
    backward = state.upsert_tasks(state.upsert_tasks(empty, frame(events[2:]), order), frame(events[:2]), order)
    assert as_rows(whole) == as_rows(forward) == as_rows(backward)
    final = {r["object_key"]: (r["status"], r["created_at"].minute, r["updated_at"].minute) for r in whole.collect()}
    assert final == {"a": ("processed", 1, 9), "b": ("empty", 2, 2)}


def test_upsert_is_idempotent_and_keeps_vanished_rows(spark, as_rows):
    layout = "id int, filename string, mask_name string, created_at int"
    current = spark.createDataFrame([(1, "a", "old", 1), (2, "b", "old", 1)], layout)
    updates = spark.createDataFrame([(7, "b", None, 2), (8, "c", "new", 2)], layout)
    once = state.upsert_tiles(current, updates)
    assert as_rows(once.select("id", "filename", "mask_name", "created_at")) == [
        (1, "a", "old", 1), (2, "b", None, 1), (8, "c", "new", 2)]
    assert as_rows(state.upsert_tiles(once, updates)) == as_rows(once)
    assert as_rows(state.upsert_tiles(current, updates.limit(0))) == as_rows(current)


def test_last_row_of_a_batch_wins(spark):
    layout = "filename string, mask_name string, created_at int, n int"
    updates = spark.createDataFrame([("a", "first", 1, 1), ("a", "last", 1, 2)], layout)
    merged = state.upsert_tiles(updates.limit(0), updates, ["n"]).collect()
    assert [r["mask_name"] for r in merged] == ["last"]


ROWS = "k string, v int, made int"


def written(path, suffix=".parquet"):
    return {f.relative_to(path): f.stat().st_size for f in path.rglob(f"*{suffix}")}


def keyed(tmp_path, spark, order=()):
    return deltas.KeyedTable(str(tmp_path / "table"), spark.createDataFrame([], ROWS).schema, "k", order, ("made",))


def test_a_batch_writes_its_own_rows_only(spark, tmp_path, as_rows):
    table, folder = keyed(tmp_path, spark), tmp_path / "table"
    deltas.write_delta(spark.range(50_000).selectExpr("concat('k', id) k", "1 v", "1 made"), table, 0)
    small = spark.createDataFrame([("k7", 2, 2), ("new", 2, 2)], ROWS)
    before = written(folder)
    deltas.write_delta(small, table, 1)
    added = {f: n for f, n in written(folder).items() if f not in before}
    assert written(folder).keys() >= before.keys() and sum(added.values()) < 4000 < sum(before.values()) / 20
    once = as_rows(deltas.read_state(spark, table))
    assert len(once) == 50_001 and ("k7", 2, 1) in once and ("new", 2, 2) in once
    deltas.write_delta(small, table, 1)  # the batch is repeated
    assert as_rows(deltas.read_state(spark, table)) == once
    assert ("k7", 1, 1) in as_rows(deltas.read_state(spark, table, before=1))


@pytest.mark.parametrize("order", [(), ("v",)])
def test_deltas_equal_a_plain_replay(spark, tmp_path, as_rows, order):
    rng = random.Random(5)
    table, expected = keyed(tmp_path, spark, order), {}
    for batch in range(14):
        rows = [(f"k{k}", rng.randint(0, 40), rng.randint(0, 9)) for k in rng.sample(range(30), 5)]
        for k, v, made in rows:
            old = expected.get(k)
            wins = old is None or not order or v >= old[0]
            expected[k] = (v if wins else old[0], made if old is None else min(made, old[1]))
        deltas.compact(spark, table, batch, waiting=3)
        deltas.write_delta(spark.createDataFrame(rows, ROWS), table, batch)
    assert as_rows(deltas.read_state(spark, table)) == sorted((k, *v) for k, v in expected.items())
    assert len(list((tmp_path / "table" / "deltas").iterdir())) <= 4


def test_compaction_touches_few_buckets_and_survives_a_crash(spark, tmp_path, as_rows, monkeypatch):
    table, folder = keyed(tmp_path, spark), tmp_path / "table"
    deltas.write_delta(spark.createDataFrame([(f"k{n}", 1, 1) for n in range(200)], ROWS), table, 0)
    assert deltas.compact(spark, table, 1, waiting=0)
    whole = {f for f in written(folder) if "base" in str(f)}
    deltas.write_delta(spark.createDataFrame([("k3", 5, 5)], ROWS), table, 1)
    expected = as_rows(deltas.read_state(spark, table))
    monkeypatch.setattr(deltas, "remove", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        deltas.compact(spark, table, 2, waiting=0)  # the new base is there, and so is all it replaces
    assert as_rows(deltas.read_state(spark, table)) == expected
    monkeypatch.undo()
    assert deltas.compact(spark, table, 2, waiting=0) and not deltas.compact(spark, table, 2, waiting=0)
    assert as_rows(deltas.read_state(spark, table)) == expected
    left = {f for f in written(folder)}
    assert len(whole - left) == 1 and len(left - whole) == 1


def test_an_unwritten_table_is_empty(spark, tmp_path):
    table = keyed(tmp_path, spark)
    assert deltas.read_state(spark, table).count() == 0 and not deltas.compact(spark, table, 5)
    deltas.write_delta(spark.createDataFrame([], ROWS), table, 0)
    assert deltas.read_state(spark, table).count() == 0


def test_markers_round_trip(spark, tmp_path):
    results = spark.createDataFrame(
        [("raw/x y.tif", "processed", ["k/a.shp"], datetime(2024, 1, 2, 3, 4, 5, 6))],
        "object_key string, status string, shapefile_keys array<string>, processed_at timestamp")
    markers = state.build_markers(results)
    row = markers.first()
    assert row["marker_key"] == "processed/status/x_y.json"
    assert json.loads(row["value"])["processed_at"] == "2024-01-02T03:04:05.000006Z"
    state.write_markers(markers, str(tmp_path / "m"))
    back = state.read_markers(spark, str(tmp_path / "m")).first()
    assert (back["object_key"], back["shapefile_keys"], back["marker_key"]) == ("raw/x y.tif", ["k/a.shp"], "processed/status/x_y.json")


def test_log_append(spark, tmp_path):
    layout = "object_key string, worker_name string, stage string, level string, message string"
    for n in range(2):
        state.append_log(spark.createDataFrame([("a", None, "s", None, str(n))], layout), str(tmp_path / "log"), "w1")
    got = spark.read.parquet(str(tmp_path / "log")).collect()
    assert sorted((r["worker_name"], r["level"], r["message"]) for r in got) == [("w1", "INFO", "0"), ("w1", "INFO", "1")]


def test_folder_listing(spark, tmp_path):
    (tmp_path / "raw" / "a").mkdir(parents=True)
    for name in ("raw/x.tif", "raw/a/y.TIFF", "raw/notes.txt"):
        (tmp_path / name).write_text("x")
    listing = objects.folder_listing(spark, str(tmp_path))
    assert {r[0] for r in objects.filter_geotiff(objects.list_raw_objects(listing)).collect()} == {"raw/x.tif", "raw/a/y.TIFF"}


def test_notifications(spark):
    values = ['{"object_key":"raw/é.tif","bucket":"b"}', "{bad", "", "[]", '{"object_key":null}', '{"object_key":""}', "null"]
    frame = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, value string")
    assert [(r["n"], r["object_key"]) for r in objects.parse_notifications(frame).collect()] == [(0, "raw/é.tif")]
    assert objects.rejected_notifications(frame).count() == len(values) - 1
    encoded = objects.encode_notifications(spark.createDataFrame([("raw/é.tif",)], "object_key string")).first()["value"]
    assert encoded == '{"bucket":"satellite-images","object_key":"raw/é.tif","filename":"é.tif"}'


def test_pending_order_and_exclusions(spark):
    keys = lambda *k: spark.createDataFrame([(x,) for x in k], "object_key string")
    notified = spark.createDataFrame([("raw/n2.tif", 1), ("raw/n1.tif", 2), ("raw/n2.tif", 3)], "object_key string, position int")
    tasks = spark.createDataFrame([("raw/done.tif", "skipped"), ("raw/bad.tif", "failed"), ("raw/run.tif", "processing")],
                                  "object_key string, status string")
    marked = spark.createDataFrame([("processed/status/marked.json",)], "marker_key string")
    pending = catalog.in_pending_order(catalog.pending_keys(
        notified, keys("raw/n1.tif", "raw/bad.tif", "raw/done.tif", "raw/run.tif", "raw/marked.tif"), tasks, marked))
    assert [r["object_key"] for r in pending.collect()] == ["raw/n2.tif", "raw/n1.tif", "raw/bad.tif", "raw/run.tif"]


def test_view_flags_without_bounds(spark):
    rows = [("a", 0.0, 0.0, 1.0, 1.0), ("b", None, None, None, None), ("c", 2.1, 0.0, 3.0, 1.0), ("d", 2.5, 0.0, 3.0, 1.0)]
    frame = spark.createDataFrame(rows, "source_object_key string, west double, south double, east double, north double")
    view = Box(*(F.lit(v) for v in (1.0, 0.0, 2.0, 1.0)))
    got = {r["source_object_key"]: r["in_view"] for r in catalog.images_in_viewport(frame, view).collect()}
    assert got == {"a": True, "b": False, "c": True, "d": False}


def test_empty_collection_and_null_geometry(spark):
    texts = spark.range(1).select(geojson.empty_collection().alias("a"), geojson.empty_collection("none yet").alias("b")).first()
    assert json.loads(texts["a"]) == {"type": "FeatureCollection", "features": []}
    assert json.loads(texts["b"])["properties"] == {"warning": "none yet"}
    frame = spark.createDataFrame([(float("nan"), "POINT"), (1.0, None)], "value double, geom string")
    features = [json.loads(r["feature"]) for r in geojson.frame_features(frame, "geom").collect()]
    assert features == [{"type": "Feature", "properties": {"value": None}, "geometry": "POINT"}]


def test_feature_collection_text(spark):
    names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
    tiles = spark.createDataFrame(
        [("t.jpg", "m.png", "s", 0, 1.0, 4.0, None, None, 3.0, 2.0, None, None)],
        "filename string, mask_name string, source_object_key string, ordinal int, " + names)
    body = json.loads(geojson.feature_collections(geojson.tile_features(tiles, "#FFF")).first()["geojson"])
    feature = body["features"][0]
    assert feature["geometry"]["coordinates"] == [[[1.0, 4.0], [3.0, 4.0], [3.0, 2.0], [1.0, 2.0], [1.0, 4.0]]]
    assert feature["properties"]["corners"]["bottom_left"] == [2.0, 1.0]
    assert feature["properties"]["mask_image_url"] == "/api/mask-object?key=processed%2Fmasks%2Fm.png&color=ffffff"
    assert body["meta"] == {"source": "s", "requested_bbox": {"west": None, "south": None, "east": None, "north": None}}


def test_export_folders(spark, tmp_path):
    polygons = spark.createDataFrame(
        [("raw/a b.tif", "t", "m", 0.5, [[(1.0, 2.0), (3.0, 2.0), (3.0, 4.0), (1.0, 2.0)]])],
        "scene_key string, filename string, mask_name string, fill_ratio double, rings array<array<struct<lon:double,lat:double>>>")
    for _ in range(2):  # a second run replaces the first
        exports.export_polygons(exports.polygon_features(polygons), str(tmp_path / "e"))
    assert exports.read_features(spark, str(tmp_path / "e")).count() == 1
    back = exports.read_features(spark, str(tmp_path / "e")).first()
    assert back["export_key"] == exports.export_keys(polygons).first()["export_key"]
    assert [r[0] for r in exports.stored_exports(spark, str(tmp_path / "e")).collect()] == [back["export_key"]]
    tiles = spark.createDataFrame([("raw/a b.tif",), ("raw/other.tif",)], "source_object_key string")
    missing = catalog.missing_exports(tiles, exports.stored_exports(spark, str(tmp_path / "e")), exports.EXPORT_SUFFIX)
    assert [r[0] for r in missing.select("source_object_key").collect()] == ["raw/other.tif"]
    feature = json.loads(back["feature"])
    assert feature["properties"] == {"tile_id": "t", "mask_name": "m", "fill_ratio": 0.5}
    assert feature["geometry"]["coordinates"][0][1] == [3.0, 2.0]
    assert exports.export_keys(polygons).first()["export_key"] == "processed/shapefiles/a_b/a_b_masks.geojson"


def test_one_collection_a_scene(spark, tmp_path):
    """A file is one FeatureCollection; a failing run leaves neither half a file nor its staged parts."""
    root = tmp_path / "e"
    key = lambda n: f"processed/shapefiles/s {n}é/s {n}é_masks.geojson"
    rows = [(key(n), json.dumps({"type": "Feature", "n": k, "text": ",]}"})) for n in range(4) for k in range(n * 5 + 1)]
    features = spark.createDataFrame(rows, "export_key string, feature string").repartition(5)
    exports.export_polygons(features, str(root))
    for n in range(4):
        body = json.loads((root / key(n)).read_text())
        assert body["type"] == "FeatureCollection" and sorted(f["n"] for f in body["features"]) == list(range(n * 5 + 1))
    assert sorted(map(tuple, exports.read_features(spark, str(root)).collect())) == sorted(rows)
    before = {f: f.read_bytes() for f in root.rglob("*.geojson")}
    broken = features.withColumn("feature", F.when(F.col("export_key") == key(2), F.raise_error(F.lit("lost"))).otherwise(F.lit("{}")))
    with pytest.raises(Exception, match="lost"):
        exports.export_polygons(broken, str(root))
    assert {f: f.read_bytes() for f in root.rglob("*.geojson")} == before and [f.name for f in root.iterdir()] == ["processed"]
    exports.export_polygons(features.where(F.col("export_key") == key(3)).limit(2), str(root))
    assert len(json.loads((root / key(3)).read_text())["features"]) == 2 and (root / key(1)).read_bytes() == before[root / key(1)]
    exports.export_polygons(features.limit(0), str(root))
    assert exports.stored_exports(spark, str(root)).count() == 4


@pytest.mark.parametrize("bounds,count", [((None, 0, 1, 1), 2), ((0, 0, 1, 1), 1), ((5, 5, 6, 6), 0)])
def test_open_viewport_gives_all_tiles(spark, bounds, count):
    names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
    rows = [("a", "s", 0.5, 1.5, 1.5, 1.5, 1.5, 0.5, 0.5, 0.5), ("b", "s", 2.5, 3.5, None, None, 3.5, 2.5, None, None)]
    tiles = spark.createDataFrame(rows, "filename string, source_object_key string, " + names)
    assert catalog.tiles_in_viewport(tiles, "s", *bounds).count() == count
    views = spark.createDataFrame([(1, "s", *(None if b is None else float(b) for b in bounds))],
                                  "view_id int, source_object_key string, west double, south double, east double, north double")
    assert catalog.tiles_in_viewports(tiles, views).count() == count


def test_equal_file_names_keep_one_row(spark, as_rows):
    rows = [("t.jpg", "raw/a/x.tif", 1), ("t.jpg", "raw/b/x.tif", 0), ("u.jpg", "raw/a/x.tif", 2)]
    updates = spark.createDataFrame(rows, "filename string, source_object_key string, ordinal int")
    current = updates.limit(0)
    for _ in range(3):
        current = state.upsert_tiles(current, updates)
    assert as_rows(current.select("filename", "source_object_key", "ordinal")) == [("t.jpg", "raw/b/x.tif", 0), ("u.jpg", "raw/a/x.tif", 2)]


def test_a_world_view_has_no_more_cells_than_its_scene(spark):
    names = ", ".join(f"{c}_{a} double" for c in ("top_left", "top_right", "bottom_right", "bottom_left") for a in ("lon", "lat"))
    rows = [("a", "s", 0.5, 1.5, 0.6, 1.5, 0.6, 1.4, 0.5, 1.4)]
    tiles = spark.createDataFrame(rows, "filename string, source_object_key string, " + names)
    views = spark.createDataFrame([(1, "s", -180.0, -90.0, 180.0, 90.0), (2, "s", 170.0, 0.0, 180.0, 90.0), (3, "s", 0.58, 1.0, 0.52, 2.0)],
                                  "view_id int, source_object_key string, west double, south double, east double, north double")
    assert sorted(r[0] for r in catalog.tiles_in_viewports(tiles, views, 1e-3).collect()) == [1, 3]
