"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to ``spark.checkpoint.dir`` and go on from there; in local mode without one, to a temporary folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spend(df: DataFrame) -> None:
    """Remove the files of a table that ``cut`` wrote and that nothing reads any more."""
    file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, for a table that a query writes and reads again."""
    return f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, set if it was not."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()
