"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the context's checkpoint folder. Where neither is set a session on
    one machine gets a temporary folder; on a cluster that is an error, since executors could not see it."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="strandlake-"))
    return sc._jsc.sc().getCheckpointDir().get()


def removed_at_exit(spark: SparkSession, path: str) -> str:
    """path, which is deleted when the process ends."""

    def remove() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before the process
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(remove)
    return path


def kept(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, for tables that are used more than once; it goes with the process."""
    spark = df.sparkSession
    path = removed_at_exit(spark, f"{shared_dir(spark)}/strandlake-files/{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
