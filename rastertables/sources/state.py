"""Keyed state, logs, markers and additive schema changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from rastertables import params as P
from rastertables.functions import names
from rastertables.schemas import MARKER
from rastertables.storage import child_names, path_exists, replace_groups


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row per key. The maximum combines map-side, so a hot key is no bottleneck."""
    values = [c for c in df.columns if c != key]
    ranked = F.struct(*order, F.struct(*values).alias("_row"))
    return df.groupBy(key).agg(F.max(ranked).alias("_newest")).select(key, "_newest._row.*")


def upsert(
    current: DataFrame, updates: DataFrame, key: str, kept: tuple[str, ...] = ("created_at",), newer: str | None = None
) -> DataFrame:
    """Current rows with the updates applied.

    Every column of a matched row is replaced except the `kept` ones; rows without an
    update stay. With `newer`, an update that is older by that column is ignored. `updates`
    holds one row per key.
    """
    stored = current.select(key, F.struct(*current.columns).alias("_old"))
    fresh = updates.select(key, F.struct(*updates.columns).alias("_new"))
    joined = stored.join(fresh, key, "full")

    applies = F.col("_new").isNotNull()
    if newer:
        applies = applies & (F.col("_old").isNull() | (F.col(f"_new.{newer}") >= F.col(f"_old.{newer}")))

    def merged(name: str) -> Column:
        old, new = F.col(f"_old.{name}"), F.col(f"_new.{name}") if name in updates.columns else F.lit(None)
        if name in kept:
            return F.coalesce(old, new) if newer is None else F.least(old, new)
        return F.when(applies, new).otherwise(old)

    return joined.select(*(F.col(c) if c == key else merged(c).alias(c) for c in current.columns))


def newest_tiles(updates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row a file name: the last by `order`, or by scene key and ordinal, as far as they are there."""
    known = order or [c for c in ("source_object_key", "ordinal") if c in updates.columns]
    return latest_per_key(updates, "filename", known or updates.columns[:1])


def upsert_tiles(current: DataFrame, updates: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Tiles keyed by filename; the last row of a file wins, vanished tiles stay.

    Without an order, of rows that share a file name the one with the largest scene key and ordinal is
    taken, so that the table keeps one row per key whatever a batch holds.
    """
    return upsert(current, newest_tiles(updates, order), "filename", kept=("id", "created_at"))


def reported_tasks(reports: DataFrame, order: list[str]) -> DataFrame:
    """Task rows of a batch of reports: last report wins, first report dates the row."""
    first = reports.groupBy("object_key").agg(F.min("reported_at").alias("created_at"))
    last = latest_per_key(reports, "object_key", order).withColumnRenamed("reported_at", "updated_at")
    return last.join(first, "object_key").drop(*(c for c in order if c != "reported_at"))


def upsert_tasks(current: DataFrame, reports: DataFrame, order: list[str]) -> DataFrame:
    """Tasks keyed by object_key; updated_at is the time of the newest report.

    Batches may arrive in any order: the state depends on the report times only.
    """
    return upsert(current, reported_tasks(reports, order), "object_key", newer="updated_at")


def prepare_log(events: DataFrame, worker: str | Column = "driver") -> DataFrame:
    """Log rows with the default level and worker filled in."""
    fallback = worker if isinstance(worker, Column) else F.lit(worker)
    return events.withColumns({
        "level": F.coalesce("level", F.lit(P.DEFAULT_LEVEL)),
        "worker_name": F.coalesce(F.nullif(F.col("worker_name"), F.lit("")), fallback),
    })


def append_log(events: DataFrame, path: str, worker: str | Column = "driver") -> None:
    prepare_log(events, worker).write.mode("append").parquet(path)


def build_markers(results: DataFrame) -> DataFrame:
    """One JSON marker per finished scene, with the key it is stored under."""
    payload = F.struct(
        "object_key", "status", "shapefile_keys",
        F.concat(names.iso_timestamp(F.col("processed_at")), F.lit("Z")).alias("processed_at"),
    )
    return results.select(
        names.marker_key(F.col("object_key")).alias("marker_key"), F.to_json(payload).alias("value")
    )


def write_markers(markers: DataFrame, path: str) -> None:
    """Store each marker under its key; one stored before is replaced."""
    replace_groups(markers.select("marker_key", "value"), "marker_key").text(path)


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    if not path_exists(spark, path):
        return spark.createDataFrame([], MARKER).withColumn("marker_key", F.lit(None).cast("string"))
    stored = spark.read.schema(MARKER).json(path)
    return stored.withColumn("marker_key", names.marker_key(F.col("object_key")))


def marked_tasks(markers: DataFrame) -> DataFrame:
    """Reports of finished scenes from their stored markers."""
    none = lambda kind: F.lit(None).cast(kind)
    return markers.select(
        "object_key", "status", none("string").alias("processor_name"), F.lit("completed").alias("stage"), none("string").alias("worker_name"),
        none("int").alias("progress_current"), none("int").alias("progress_total"),
        F.coalesce(F.nullif(F.array_join("shapefile_keys", ","), F.lit("")), F.lit(P.PROCESSED_PREFIX)).alias("result_path"), none("string").alias("details"),
        F.to_timestamp("processed_at").alias("reported_at"))


def parse_markers(markers: DataFrame) -> DataFrame:
    return markers.select("marker_key", F.from_json("value", MARKER).alias("m")).select("marker_key", "m.*")


def conform_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns missing from an older layout as typed NULLs; what is there stays."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema.fields if f.name not in df.columns}
    return df.withColumns(missing) if missing else df


def write_part(df: DataFrame, root: str, version: int) -> None:
    """Store what one batch adds to a table; a repeated batch adds what it does again."""
    df.write.mode("append").parquet(f"{root}/version={version}")


def stored_versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the stored versions, by the names of their folders."""
    return sorted(int(n.partition("=")[2]) for n in child_names(spark, root) if n.startswith("version="))
