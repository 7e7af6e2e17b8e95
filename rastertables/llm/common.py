"""What the corpus operators share: rows of documents, Arrow passes, sampled labels."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..shipping import ship_package
from ..storage import broadcast_if_small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of all rows, without other columns; a null text is empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def text_key() -> Column:
    """Tells apart rows that share an id; a null text is empty."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def free_name(docs: DataFrame, wanted: str) -> str:
    """A column name that docs does not have."""
    taken = {c.lower() for c in docs.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def drop_rows(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows whose id and text are those of `dropped` (doc_id, text_key); docs may have any further columns."""
    own_id, own_key = free_name(docs, "dropped_id"), free_name(docs, "dropped_key")
    gone = dropped.select(F.col("doc_id").alias(own_id), F.col("text_key").alias(own_key)).distinct()
    return docs.join(broadcast_if_small(gone), docs["doc_id"].eqNullSafe(F.col(own_id)) & (text_key() == F.col(own_key)), "left_anti")


_caches: dict[str, dict] = {}


def give_back() -> None:
    """Return freed memory to the system, of Arrow and where the C library can (glibc) of all else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def worker_cache(owner: str) -> dict:
    """What a Python worker remembers for one operator; what it held for others is forgotten."""
    others = [name for name in _caches if name != owner]
    for other in others:
        del _caches[other]
    if others:
        give_back()
    return _caches.setdefault(owner, {})


#: Bytes of a record batch that goes to a Python worker or comes from one; a longer row goes by itself.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded(batch: pa.RecordBatch, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows of at most `size` bytes; a longer row is a slice by itself."""
    if batch.nbytes <= size or batch.num_rows < 2:
        yield batch
        return
    middle = batch.num_rows // 2
    yield from bounded(batch.slice(0, middle), size)
    yield from bounded(batch.slice(middle), size)


def bound_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """From now on the session hands rows to Python in batches of about `size` bytes at most; a smaller setting stays.

    Spark's own bounds, 10000 rows and 64 MB, are held outside the heap by every running task, twice while a column grows.
    """
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_SETTING)) > size:
        spark.conf.set(_BATCH_SETTING, str(size))


def arrow_pass(
    df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str, owner: str = "",
) -> DataFrame:
    """mapInArrow with this package at hand on the executors; results leave in bounded batches, a task gives its freed memory back.

    `owner` names the cache that the pass goes on using.
    """
    ship_package(df.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(owner)
        for batch in batches(rows):
            yield from bounded(batch)
        give_back()

    return df.mapInArrow(run, schema)


def text_score(spark: SparkSession, run: Callable[[pa.Array], pa.Array]) -> Column:
    """`run` over the column text as doubles; only texts go to Python, other columns stay behind."""
    ship_package(spark)

    def score(text: pa.Array) -> pa.Array:
        worker_cache("")
        return run(text)

    score.__annotations__ = {"text": pa.Array, "return": pa.Array}
    # not deterministic for the optimiser: a filter on the score must not score again
    return F.arrow_udf(score, "double").asNondeterministic()("text")


def crc_bucket(id_col: str, buckets: int) -> Column:
    """Remainder of the CRC-32 of an id's decimal text; an id that is null counts as 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % buckets, F.lit(0))


#: Bytes of text that a model is fitted on at most.
SAMPLE_BYTES = 256 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, size: int = SAMPLE_BYTES) -> DataFrame:
    """(doc_id, text, y) of at most `rows` labelled documents with at most `size` bytes of text, chosen by a hash of the id.

    Both bound what a model is fitted on; the same documents come out at every run. Documents are taken whole,
    in the order of the hash, while they fit. An id that occurs more than once counts once, with the larger label and
    the least text.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & usable)
        .groupBy("doc_id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    )
    found = texts(docs).join(F.broadcast(marked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    sizes = found.select("doc_id", F.octet_length("text").alias("n"))  # at most `rows` rows
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sizes.withColumn("total", F.sum("n").over(before)).filter(F.col("total") <= size).select("doc_id")
    return found.join(F.broadcast(fits), "doc_id")
