"""Reading of the parquet tables, and the places that a session gives for intermediate data."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of ``folder``; with ``columns``, only those (the scan reads no others)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; only in local mode, where it may be unset (tests), a folder of our own."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir", "")
    if shared:
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(shared)
        return shared
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(os.path.join(tempfile.gettempdir(), "coursegrain-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """``df`` read back from a reliable checkpoint in the shared folder: lineage ends here and survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as compressed parquet to the shared folder and read back: computed once, for several uses in one query."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stored-{uuid.uuid4().hex}"
    kept = spark._jvm.org.apache.hadoop.fs.Path(path)
    kept.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(kept)  # with the driver
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
