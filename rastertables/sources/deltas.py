"""Keyed tables kept as deltas: a batch stores its own rows, a reader takes the newest row of each key.

Below the table's folder, deltas/batch=N/bucket=B holds what batch N said about the keys of a hash bucket, and
base/run=R/bucket=B the newest rows of a bucket from all batches before R. Folding rows is idempotent and does not depend
on their order, so a row that is found twice (a repeated batch, an unfinished compaction) changes nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rastertables.storage import child_names, path_exists, remove

BUCKETS = 16
#: Batches that may wait for a compaction.
WAITING_BATCHES = 8


@dataclass(frozen=True)
class KeyedTable:
    """One row a key: the largest by the `order` columns, then by batch; `oldest` columns keep their least value."""

    root: str
    schema: T.StructType
    key: str
    order: tuple[str, ...] = ()
    oldest: tuple[str, ...] = ()

    @property
    def deltas(self) -> str:
        return f"{self.root}/deltas"

    @property
    def base(self) -> str:
        return f"{self.root}/base"

    @property
    def stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField("version", T.LongType())])


def fold(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """Newest row of each key with its version; the maximum combines map-side, so a hot key is no bottleneck."""
    names = [c for c in table.schema.names if c != table.key]
    newest = F.max(F.struct(*table.order, "version", F.struct(*names).alias("_row"))).alias("_newest")
    least = [F.min(c).alias(f"_least_{c}") for c in table.oldest]
    folded = rows.groupBy(table.key).agg(newest, *least)
    value = lambda c: F.col(f"_least_{c}") if c in table.oldest else F.col(f"_newest._row.{c}")
    return folded.select(*(F.col(c) if c == table.key else value(c).alias(c) for c in table.schema.names), F.col("_newest.version").alias("version"))


def write_delta(rows: DataFrame, table: KeyedTable, batch: int) -> None:
    """Store what a batch says; it writes these rows and nothing else. A repeated batch adds the same rows again."""
    stamped = rows.select(*table.schema.names).withColumn("version", F.lit(batch).cast("long"))
    dealt = stamped.withColumn("bucket", F.pmod(F.xxhash64(table.key), F.lit(BUCKETS)).cast("int")).hint("rebalance", F.col("bucket"))
    dealt.write.mode("append").partitionBy("bucket").parquet(f"{table.deltas}/batch={batch}")


def _numbers(spark: SparkSession, path: str, name: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in child_names(spark, path) if n.startswith(f"{name}="))


def _read(spark: SparkSession, table: KeyedTable, path: str, name: str) -> DataFrame:
    if not _numbers(spark, path, name):
        return spark.createDataFrame([], T.StructType([*table.stored.fields, T.StructField(name, T.IntegerType()), T.StructField("bucket", T.IntegerType())]))
    known = T.StructType([*table.stored.fields, T.StructField(name, T.IntegerType()), T.StructField("bucket", T.IntegerType())])
    return spark.read.schema(known).parquet(path)


def read_state(spark: SparkSession, table: KeyedTable, before: int | None = None) -> DataFrame:
    """The table's rows, or those it had before a batch (which must not lie before the last compaction)."""
    deltas = _read(spark, table, table.deltas, "batch")
    if before is not None:
        deltas = deltas.where(F.col("batch") < before)
    rows = deltas.select(*table.stored.names).unionByName(_read(spark, table, table.base, "run").select(*table.stored.names))
    return fold(rows, table).drop("version")


def compact(spark: SparkSession, table: KeyedTable, batch: int, waiting: int = WAITING_BATCHES) -> bool:
    """Fold the batches before `batch` into the base of the buckets they touch, once more than `waiting` wait.

    Other buckets stay as they are. The new base is complete before what it replaces is removed.
    """
    older = [n for n in _numbers(spark, table.deltas, "batch") if n < batch]
    if len(older) <= waiting:
        return False
    touched = sorted({b for n in older for b in _numbers(spark, f"{table.deltas}/batch={n}", "bucket")})
    target = f"{table.base}/run={batch}"
    if not path_exists(spark, f"{target}/_SUCCESS"):
        deltas = _read(spark, table, table.deltas, "batch").where(F.col("batch") < batch)
        base = _read(spark, table, table.base, "run").where((F.col("run") < batch) & F.col("bucket").isin(touched))
        columns = [*table.stored.names, "bucket"]
        folded = fold(deltas.select(*columns).unionByName(base.select(*columns)), table)
        dealt = folded.withColumn("bucket", F.pmod(F.xxhash64(table.key), F.lit(BUCKETS)).cast("int")).hint("rebalance", F.col("bucket"))
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(target)
    for n in older:
        remove(spark, f"{table.deltas}/batch={n}")
    for run in _numbers(spark, table.base, "run"):
        if run < batch:
            for bucket in set(touched) & set(_numbers(spark, f"{table.base}/run={run}", "bucket")):
                remove(spark, f"{table.base}/run={run}/bucket={bucket}")
    return True
