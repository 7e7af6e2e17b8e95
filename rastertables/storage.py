"""Written intermediates and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_ROWS = 500_000


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediates that every executor can reach.

    It is the one named by spark.checkpoint.dir. Only a local session, where driver and
    executors are one process, may fall back to a fresh temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="rastertables-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write once to the shared folder and read back.

    Cuts the lineage, survives the loss of executors and gives later joins the true size. A stored frame
    that this one `replaces`, such as the former round of an iteration, is removed once this one is
    written; nothing else may still read it.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if replaces is not None:
        remove(spark, replaces._stored_at)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def remove(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def publish(spark: SparkSession, source: str, target: str) -> None:
    """Put a finished file in its place in one step; a file that is there is replaced."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs = jvm.org.apache.hadoop.fs
    old, new = fs.Path(source), fs.Path(target)
    conf = spark._jsc.hadoopConfiguration()
    new.getFileSystem(conf).mkdirs(new.getParent())
    overwrite = gateway.new_array(fs.Options.Rename, 1)
    overwrite[0] = fs.Options.Rename.OVERWRITE
    context = fs.FileContext.getFileContext(new.getFileSystem(conf).makeQualified(new).toUri(), conf)
    context.rename(new.getFileSystem(conf).makeQualified(old), new.getFileSystem(conf).makeQualified(new), overwrite)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder is there, in whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the files and folders in a folder; none if it is not there."""
    if not path_exists(spark, path):
        return []
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return [f.getPath().getName() for f in place.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(place)]


def replace_groups(df: DataFrame, *keys: str):
    """Writer that replaces the stored groups that occur in `df`, one folder each, and leaves the others."""
    dealt = df.repartition(*keys)
    return dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys)


def broadcast_if_small(side: DataFrame, counted: DataFrame | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only when the row count proves the side small.

    `counted` is a cheaper frame known to have at least as many rows as `side`. Beyond the
    limit the side is returned as it is and the join shuffles.
    """
    basis = side if counted is None else counted
    few = basis.limit(limit + 1).agg(F.count(F.lit(1)).alias("n")).first()["n"] <= limit
    return F.broadcast(side) if few else side
