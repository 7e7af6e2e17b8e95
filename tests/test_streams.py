import json
import os
import time
from dataclasses import replace
from datetime import datetime

from pyspark.sql import functions as F

from rastertables import schemas
from rastertables.fixtures import PARAMS, Inputs
from rastertables.operators import kernels
from rastertables.plans import scene_run
from rastertables.sources import deltas, exports, state
from rastertables.streaming import streams


def write_messages(folder, name, *keys):
    folder.mkdir(exist_ok=True)
    lines = [json.dumps({"bucket": "b", "object_key": k}) for k in keys] + ["{bad"]
    (folder / name).write_text("\n".join(lines) + "\n")


def test_failed_scenes_are_offered_again_and_finished_ones_are_not(spark, sf_dir, tmp_path):
    inputs = Inputs(spark, sf_dir)
    good, no_crs, missing, other = (
        "raw/S1_IW_20240102.tif", "raw/S1_IW_20240110.tif", "raw/late.tif", "raw/notes.txt")
    offered = []
    scenes = {"known": inputs.scenes.where(F.col("scene_key").isin(good, no_crs))}

    def process(keys):
        offered.append({r[0] for r in keys.collect()})
        return scene_run.process_scenes(
            keys, inputs.chunks, scenes["known"], None, kernels.threshold_model(PARAMS.mask_threshold), PARAMS)

    listing = spark.createDataFrame([(k,) for k in (good, missing, other)], "object_key string")
    store = streams.IngestStore(str(tmp_path / "store"))
    messages = tmp_path / "messages"
    for name in ("one.json", "two.json"):
        write_messages(messages, name, good, no_crs, good)
        stream = streams.notification_stream(spark, str(messages))
        streams.ingest_stream(stream, lambda: listing, process, store).awaitTermination()

    assert offered == [{good, no_crs, missing, other}, {missing}]
    final = {r["object_key"]: (r["status"], r["stage"]) for r in deltas.read_state(spark, streams.task_table(store.path("tasks"))).collect()}
    assert final == {
        good: ("processed", "completed"), no_crs: ("empty", "completed"),
        missing: ("failed", "failed"), other: ("skipped", "validate_input")}
    tiles = streams.tile_table(store.path("tiles"))
    assert deltas.read_state(spark, tiles).count() == deltas.read_state(spark, tiles, before=1).count() > 30
    logged = spark.read.schema(schemas.LOGS).parquet(store.path("logs"))
    assert {r["level"] for r in logged.where(F.col("object_key") == missing).collect()} == {"ERROR"}


def test_task_state_equals_batch(spark, tmp_path):
    layout = ("object_key string, status string, processor_name string, stage string, worker_name string, "
              "progress_current int, progress_total int, result_path string, details string, reported_at timestamp, n int")
    events = [(f"k{n % 3}", f"s{n}", "p", None, None, n, 9, None, None, datetime(2024, 1, 1, 0, (n * 7) % 20), n) for n in range(20)]
    frame = spark.createDataFrame(events, layout)
    frame.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "state")
    streams.task_state_stream(stream, root, root + "-checkpoint", ["reported_at", "n"]).awaitTermination()
    streamed = deltas.read_state(spark, streams.task_table(root))
    batch = state.reported_tasks(frame, ["reported_at", "n"]).select(streamed.columns)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, batch.collect()))


def test_whole_run_without_land_and_with_disagreeing_corners(spark, sf_dir):
    inputs = Inputs(spark, sf_dir)
    keys = inputs.scenes.select(F.col("scene_key").alias("object_key")).limit(3)
    run = scene_run.process_scenes(
        keys, inputs.chunks, inputs.scenes, None, kernels.threshold_model(PARAMS.mask_threshold), PARAMS)
    assert {r["status"] for r in run.results.collect()} <= {"processed", "empty"}
    tiles = run.tiles.withColumnRenamed("source_object_key", "scene_key")
    errors = spark.createDataFrame([(r["object_key"], "corners disagree") for r in keys.collect()], "scene_key string, error string")
    none = spark.createDataFrame([], "scene_key string")
    broken = scene_run.scene_status(keys, inputs.scenes, tiles, errors, run.exports, none)
    assert {(r["status"], r["stage"], r["level"]) for r in broken.collect()} == {("failed", "failed", "ERROR")}


def test_a_failing_scene_fails_alone(spark):
    """One sound scene among: an unknown code, a short band, a predictor that throws, no model."""
    def scene(name, epsg=4326):
        return (name, 8, 8, epsg, 0.001, 0.0, 70.0, 0.0, -0.001, 75.0)

    def chunk(name, band):
        return (name, 0, 0, 8, 8, band)

    band = [float(v + 1) for v in range(64)]
    names = ["raw/good.tif", "raw/code.tif", "raw/short.tif", "raw/throws.tif"]
    scenes = spark.createDataFrame(
        [scene(names[0]), scene(names[1], 9999), scene(names[2]), scene(names[3])],
        "scene_key string, width int, height int, epsg int, a double, b double, c double, d double, e double, f double")
    chunks = spark.createDataFrame(
        [chunk(names[0], band), chunk(names[1], band), chunk(names[2], band[:5]), chunk(names[3], band[::-1])],
        "scene_key string, chunk_x int, chunk_y int, chunk_width int, chunk_height int, band array<double>")
    keys = scenes.select(F.col("scene_key").alias("object_key"))

    def load():
        def predict(image):
            if image[0, 0] == 255:
                raise RuntimeError("out of memory")
            return image.astype(float) - 100
        return predict

    params = replace(PARAMS, min_area=0.0)
    run = scene_run.process_scenes(keys, chunks, scenes, None, load, params)
    got = {r["object_key"]: r for r in run.results.collect()}
    assert {k: r["status"] for k, r in got.items()} == dict(zip(names, ("processed", "failed", "failed", "failed")))
    assert "EPSG:9999" in got[names[1]]["details"] and "5 cells" in got[names[2]]["details"]
    assert "out of memory" in got[names[3]]["details"]
    assert {r[0] for r in run.tiles.select("source_object_key").collect()} == {names[0]}

    def missing():
        raise ImportError("no weights")

    bare = scene_run.process_scenes(keys.limit(1), chunks, scenes, None, missing, params).results.first()
    assert (bare["status"], bare["level"]) == ("processed", "WARNING") and "Model could not be loaded" in bare["details"]


def test_corner_failures_name_their_tiles(spark):
    from rastertables.operators import grid

    corner = {n: 0.0 for c in ("top_left", "top_right", "bottom_right", "bottom_left") for n in (f"{c}_lon", f"{c}_lat")}
    rows = [{"filename": f"t{i}", "source_object_key": "s", "tile_x": 8 * i, "tile_y": 0, "tile_width": 8, "tile_height": 8,
             **corner, "top_left_lon": 1.0 * i, "top_right_lon": 1.0 * i + 0.5} for i in range(20)]
    tiles = spark.createDataFrame(rows)
    row = grid.with_examples(grid.validate_corners(tiles), tiles).first()
    assert row["mismatches"] == 19 and len(row["examples"]) == 8 and row["examples"][0].startswith("t0 / t1 (top)")


def test_events_of_a_run(spark):
    tiles = spark.createDataFrame([("a", n) for n in range(7)] + [("b", 0)], "source_object_key string, ordinal int")
    checks = spark.createDataFrame([("a", 9, 0, True), ("b", 3, 1, False)], "source_object_key string, checked bigint, mismatches bigint, consistent boolean")
    polygons = spark.createDataFrame([("b",)], "scene_key string")
    got = scene_run.run_events(tiles, checks, polygons, step=3).collect()
    assert {(r["stage"], r["progress_current"], r["progress_total"]) for r in got if r["object_key"] == "a" and r["progress_current"]} == {
        *(("generate_tiles", n, 7) for n in (1, 3, 6, 7)), *(("assemble_shapefile", n, 7) for n in (1, 3, 6, 7)), ("validate_tile_corners", 9, 9)}
    assert sorted((r["stage"], r["level"], r["message"]) for r in got if r["progress_current"] is None) == [
        ("assemble_shapefile", "INFO", "Assembly begun. Tiles: 7."), ("assemble_shapefile", "WARNING", "No suitable polygons, no export.")]
    assert {(r["stage"], r["level"]) for r in got if r["object_key"] == "b"} == {("generate_tiles", "INFO"), ("validate_tile_corners", "ERROR")}


def test_ingest_keeps_and_repairs_its_results(spark, sf_dir, tmp_path):
    inputs = Inputs(spark, sf_dir)
    key = "raw/S1_IW_20240102.tif"
    listing = spark.createDataFrame([(key,)], "object_key string")
    store = streams.IngestStore(str(tmp_path / "store"))
    params = replace(PARAMS, min_area=0.0)

    def cycle(number):
        batch = spark.createDataFrame([(None,)], "value string")
        streams.ingest_batch(
            batch, number, listing,
            lambda keys: scene_run.process_scenes(keys, inputs.chunks, inputs.scenes, None, kernels.threshold_model(128), params), store,
            rebuild=lambda tiles, masked, stored: scene_run.rebuild_exports(tiles, masked, stored, None, params))

    def kept():
        features = sorted(tuple(r) for r in exports.read_features(spark, store.path("exports")).collect())
        masks = sorted(map(str, spark.read.parquet(store.path("masks")).collect()))
        tasks = sorted((r["object_key"], r["status"]) for r in deltas.read_state(spark, streams.task_table(store.path("tasks"))).collect())
        return features, masks, tasks

    cycle(0)
    first = kept()
    assert first[0] and first[1] and first[2] == [(key, "processed")]
    marker = state.read_markers(spark, store.path("markers")).first()
    assert marker["status"] == "processed" and len(marker["shapefile_keys"]) == 1
    cycle(0)  # the same batch again
    assert kept() == first
    os.rename(store.path("exports"), str(tmp_path / "lost"))
    cycle(1)  # nothing pending: the export comes back from the stored tiles and masks
    assert kept() == first
    cycle(2)
    assert state.stored_versions(spark, store.path("logs")) == [0, 1, 2]
    logged = spark.read.schema(schemas.LOGS).parquet(store.path("logs"))
    assert {r["stage"] for r in logged.where(F.col("object_key") == key).collect()} == {
        scene_run.STAGE_GENERATE, scene_run.STAGE_VALIDATE, scene_run.STAGE_ASSEMBLE, "completed"}
    tasks = streams.task_table(store.path("tasks"))
    stages = [{r["stage"] for r in deltas.read_state(spark, tasks, before=n).collect()} for n in (1, 2, 3)]
    assert stages == [{"completed"}, {scene_run.STAGE_REBUILD}, {scene_run.STAGE_REBUILD}]


def test_a_marker_stands_for_a_lost_task_row(spark, sf_dir, tmp_path):
    """The stored markers are asked for every key: without its task row a finished scene is not run again."""
    inputs = Inputs(spark, sf_dir)
    key, bare = "raw/S1_IW_20240102.tif", "raw/S1_IW_20240110.tif"
    listing = spark.createDataFrame([(key,), (bare,)], "object_key string")
    store = streams.IngestStore(str(tmp_path / "store"))
    offered = []

    def process(keys):
        offered.append(sorted(r[0] for r in keys.collect()))
        return scene_run.process_scenes(
            keys, inputs.chunks, inputs.scenes.where(F.col("scene_key").isin(key, bare)), None, kernels.threshold_model(128), replace(PARAMS, min_area=0.0))

    def kept():
        tasks = deltas.read_state(spark, streams.task_table(store.path("tasks"))).select("object_key", "status", "stage", "result_path").collect()
        tiles = deltas.read_state(spark, streams.tile_table(store.path("tiles"))).drop("created_at").collect()
        return sorted(map(tuple, tasks)), sorted(map(str, tiles))

    batch = spark.createDataFrame([(None,)], "value string")
    streams.ingest_batch(batch, 0, listing, process, store)
    first = kept()
    assert {r[:2] for r in first[0]} == {(key, "processed"), (bare, "empty")} and first[1]
    streams.ingest_batch(batch, 0, listing, process, store)  # repeated after everything was stored
    assert kept() == first
    os.rename(store.path("tasks"), str(tmp_path / "lost"))
    streams.ingest_batch(batch, 1, listing, process, store)
    assert offered == [[key, bare], [], []] and kept() == first


def test_forgotten_keys_keep_the_state_flat(spark, tmp_path):
    """A million keys over ten hours: the state holds the keys of the horizon only."""
    for hour in range(10):
        keys = spark.range(hour * 100_000, (hour + 1) * 100_000)
        seen = F.timestamp_seconds(F.lit(1_700_000_000 + hour * 3600) + F.col("id") % 3600).alias("seen_at")
        again = keys.select(F.concat(F.lit("raw/"), "id").alias("object_key"), seen)
        again.union(again.limit(1000)).coalesce(1).write.parquet(str(tmp_path / "in" / f"{hour:02}"))
    stream = spark.readStream.schema("object_key string, seen_at timestamp").option("maxFilesPerTrigger", 1).option(
        "pathGlobFilter", "*.parquet").parquet(str(tmp_path / "in" / "*"))
    out = streams.dedup_keys(stream, "seen_at", "1 hour").writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
        "checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    out.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in out.recentProgress if p["stateOperators"]]
    assert len(held) >= 10 and 100_000 <= max(held) <= 400_000
    assert spark.read.parquet(str(tmp_path / "out")).select("object_key").distinct().count() == 1_000_000
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1_000_000


def test_quiet_cycles_run(spark, tmp_path):
    """Without a single message the listing is offered again and again."""
    (tmp_path / "messages").mkdir()
    offered = []

    def process(keys):
        offered.append([r[0] for r in keys.collect()])
        return scene_run.process_scenes(keys, None, spark.createDataFrame([], "scene_key string"), None, None)

    listing = spark.createDataFrame([("raw/late.tif",)], "object_key string")
    query = streams.ingest_stream(
        streams.notification_stream(spark, str(tmp_path / "messages")), lambda: listing, process,
        streams.IngestStore(str(tmp_path / "store")), every="1 second")
    try:
        limit = time.time() + 120
        while len(offered) < 2 and time.time() < limit and query.isActive:
            time.sleep(0.5)
    finally:
        query.stop()
    assert len(offered) >= 2 and offered[0] == offered[1] == ["raw/late.tif"]
