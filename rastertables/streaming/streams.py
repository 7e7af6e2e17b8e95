"""Notification, task and log streams, and the ingest loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from rastertables import params as P, schemas
from rastertables.plans.catalog import completed_keys, pending_keys
from rastertables.plans import scene_run
from rastertables.plans.scene_run import SceneRun
from rastertables.sources import deltas, exports, objects, state
from rastertables.sources.deltas import KeyedTable
from rastertables.storage import materialize, path_exists, replace_groups


def notification_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Messages from a folder of text files, one JSON text per line."""
    return spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)


def kafka_notification_stream(
    spark: SparkSession, servers: str, topic: str = P.DEFAULT_TOPIC, group: str = P.DEFAULT_GROUP
) -> DataFrame:
    """Messages from a topic, from its first offset on; the checkpoint keeps the position."""
    return (
        spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic).option("kafka.group.id", group)
        .option("startingOffsets", "earliest").load().select(F.col("value").cast("string").alias("value"), "offset")
    )


def send_notifications(messages: DataFrame, servers: str, topic: str = P.DEFAULT_TOPIC) -> None:
    messages.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def dedup_keys(parsed: DataFrame, seen_at: str | None = None, horizon: str = "1 day") -> DataFrame:
    """Each key once.

    With the time column `seen_at` the state forgets a key once the newest time is more than `horizon` later than the
    key's own, so it holds the keys of that span; a key that comes back after it is let through again, and
    what is pending is decided by tasks and markers. Without a time column, keys are held for the life of the stream.
    """
    if seen_at is None:
        return parsed.select("object_key").dropDuplicates(["object_key"])
    return parsed.select("object_key", seen_at).withWatermark(seen_at, horizon).dropDuplicatesWithinWatermark(["object_key"])


def _start(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def task_table(root: str) -> KeyedTable:
    """Tasks by object_key: the newest report counts, the first one dates the row."""
    return KeyedTable(root, schemas.TASKS, "object_key", order=("updated_at",), oldest=("created_at",))


def tile_table(root: str) -> KeyedTable:
    """Tiles by file name: the last batch counts, the first one dates the row."""
    return KeyedTable(root, STORED_TILES, "filename", oldest=("created_at",))


def task_state_stream(reports: DataFrame, root: str, checkpoint: str, order: list[str], every: str | None = None) -> StreamingQuery:
    """Keep the newest report per key below `root`; a batch writes its own keys only."""
    table = task_table(root)

    def handle(batch: DataFrame, number: int) -> None:
        deltas.compact(batch.sparkSession, table, number)
        deltas.write_delta(state.reported_tasks(batch, order), table, number)

    return _start(reports, handle, checkpoint, every)


def log_stream(events: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Append log events as they come."""
    writer = (
        state.prepare_log(events).writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


@dataclass(frozen=True)
class IngestStore:
    """Folders the ingest loop keeps its tables in."""

    root: str

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"


STORED_TILES = T.StructType([*scene_run.STORED_TILES.fields, T.StructField("created_at", T.TimestampType())])


Rebuild = Callable[[DataFrame, DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _stored_masks(spark: SparkSession, store: IngestStore) -> DataFrame:
    path = store.path("masks")
    known = T._parse_datatype_string(scene_run.MASKS)
    return spark.read.schema(known).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], known)


def _task_reports(results: DataFrame, now: Column) -> DataFrame:
    missing = {c: F.lit(None).cast(t) for c, t in (
        ("worker_name", "string"), ("progress_current", "int"), ("progress_total", "int")) if c not in results.columns}
    return results.withColumns(missing).select(
        "object_key", "status", "processor_name", "stage", "worker_name",
        "progress_current", "progress_total", "result_path", "details", now.alias("reported_at"))


def _repaired(tiles: DataFrame, store: IngestStore, markers: DataFrame, rebuild: Rebuild) -> DataFrame:
    """Reports of exports made anew for scenes that have tiles and should have one, but don't.

    A scene whose marker names no export has no polygons and needs none.
    """
    spark = tiles.sparkSession
    bare = markers.where(F.size("shapefile_keys") == 0).select(F.col("object_key").alias("source_object_key"))
    wanted = tiles.join(bare, "source_object_key", "left_anti")
    polygons, reports = rebuild(wanted, _stored_masks(spark, store), exports.stored_exports(spark, store.path("exports")))
    exports.export_polygons(exports.polygon_features(polygons), store.path("exports"))
    return reports


def ingest_batch(
    batch: DataFrame, number: int, listing: DataFrame, process: Callable[[DataFrame], SceneRun], store: IngestStore,
    rebuild: Rebuild | None = None,
) -> None:
    """One cycle: new and unfinished keys are processed, and everything a run made is stored.

    Masks, exports and markers are kept by scene, tiles and tasks as deltas of the batches, logs as parts.
    With `rebuild`, lost exports are made anew in every cycle. Listed keys are offered again in every
    cycle, so failed scenes are retried and finished ones are not: those with a final task row or a stored
    marker. A marker is stored after all else of its scene but its task row; where that is missing, it is made from the
    marker. Repeating a batch adds nothing new.
    """
    spark = batch.sparkSession
    task_rows, tile_rows = task_table(store.path("tasks")), tile_table(store.path("tiles"))
    for table in (task_rows, tile_rows):
        deltas.compact(spark, table, number)
    tasks = deltas.read_state(spark, task_rows, before=number)
    known = materialize(state.read_markers(spark, store.path("markers")), "stored-markers")
    notified = objects.parse_notifications(batch.where(F.col("value").isNotNull())).withColumn("position", F.lit(0).cast("bigint"))
    pending = materialize(pending_keys(notified, listing, tasks, known), "pending-keys")

    run = process(pending.select("object_key"))
    now = F.current_timestamp()
    results = materialize(run.results, "run-results")
    replace_groups(run.masks, "scene_key").parquet(store.path("masks"))
    exports.export_polygons(exports.polygon_features(run.polygons), store.path("exports"))
    if run.merged is not None:
        exports.export_merged(exports.merged_rows(run.merged), store.path("outlines"))
    deltas.write_delta(state.newest_tiles(run.tiles.withColumn("created_at", now)), tile_rows, number)
    done = results.where(F.col("status").isin("processed", "empty")).withColumn("processed_at", now)
    state.write_markers(state.build_markers(done), store.path("markers"))

    lost = state.marked_tasks(known.join(completed_keys(tasks), "object_key", "left_anti"))
    reports = _task_reports(results, now).unionByName(lost)
    if rebuild is not None:
        kept = deltas.read_state(spark, tile_rows)
        markers = state.read_markers(spark, store.path("markers"))
        repaired = _repaired(kept, store, markers, rebuild)
        reports = reports.unionByName(_task_reports(repaired, now))
    deltas.write_delta(state.reported_tasks(reports, ["reported_at"]), task_rows, number)
    final = results.select("object_key", "stage", "level", F.col("details").alias("message"), "progress_current", "progress_total")
    log = run.events.unionByName(final).withColumns({"worker_name": F.lit(None).cast("string"), "created_at": now}).select(schemas.LOGS.names)
    state.write_part(state.prepare_log(log), store.path("logs"), number)


def ingest_stream(
    messages: DataFrame, listing: Callable[[], DataFrame], process: Callable[[DataFrame], SceneRun],
    store: IngestStore, every: str | None = None, rebuild: Rebuild | None = None,
) -> StreamingQuery:
    """Poll for notifications and process what is pending. Offsets advance after the batch.

    With an interval, a clock stream beside the messages makes a cycle of every interval, also of quiet
    ones, so that listed scenes are retried and exports repaired without a message.
    """
    if every:
        clock = messages.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        messages = messages.select("value").unionByName(clock.select(F.lit(None).cast("string").alias("value")))
    return _start(
        messages, lambda batch, number: ingest_batch(batch, number, listing(), process, store, rebuild),
        store.path("checkpoint"), every)
