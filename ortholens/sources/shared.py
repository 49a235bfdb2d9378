"""The folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the configured checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is configured and all is one process."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-ortholens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def rewritten(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """df rewritten, and metrics (aggregates over its rows) that the same pass observes."""
    seen = Observation(name)
    out = rewritten(df.observe(seen, *(c.alias(k) for k, c in metrics.items())), name)
    return out, dict(seen.get)


def discard(df: DataFrame) -> None:
    """Deletes the files of a rewritten table that is read no more."""
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs
    for name in df.inputFiles()[:1]:
        at = hadoop.Path(name).getParent()
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
