"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, one of our own in local mode, as in tests; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")


def use_checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared checkpoint folder: lineage ends here, and a lost executor costs no recomputation."""
    use_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, each action's shuffle files go when it ends, not when the driver next collects garbage. For chains of actions that read checkpoints; what is run later must be built outside."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def release_memory() -> None:
    """Gives what a worker has freed back to the system, so that idle workers don't hold the peak of their last task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def label_hash(column: str = "doc_id") -> Column:
    """crc32 of the id as text, by which rows are dealt to folds."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def sampled_rows(labelled: DataFrame, docs: DataFrame, target: str, fold: Column, per_class: int, max_chars: int) -> list:
    """At most per_class rows of either class, by a fixed hash order, as (text, target) rows on the driver.

    This is the bounded training sample of the classifiers: never more than 2 * per_class rows,
    none longer than max_chars, so what reaches the driver has a fixed bound.
    Rows are chosen on the narrow labels table; the texts are fetched by a join with those few ids.
    """
    ids = labelled.where(fold & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).alias("_y"))
    known = docs.where(F.length("text").between(1, max_chars)).select("doc_id")
    order = F.xxhash64("doc_id", F.lit(17))
    ids = ids.join(known.distinct(), "doc_id", "left_semi")
    chosen = None
    for y in (0, 1):
        part = ids.where(F.col("_y") == y).orderBy(order, "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    few = [(r.doc_id, r._y) for r in chosen.collect()]
    if not few:
        return []
    picked = docs.sparkSession.createDataFrame(few, "doc_id long, _y int")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "_y").agg(F.min("text").alias("text")).collect()
    return sorted(((r.doc_id, r.text, r._y) for r in rows if r.text is not None and len(r.text) <= max_chars), key=lambda r: r[0])
