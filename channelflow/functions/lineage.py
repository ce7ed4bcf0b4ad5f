"""Where lineage ends: tables kept in the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the setting is missing, a temporary one in local mode; on a cluster that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return spark.sparkContext.getCheckpointDir() or tempfile.mkdtemp(prefix="checkpoints-")


def kept(df: DataFrame) -> DataFrame:
    """The same rows read back from a checkpoint: iterations start from it, and a lost executor costs no recomputation."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
