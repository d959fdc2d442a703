"""Reading the Parquet tables that every query runs on, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder; the folder may lie in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Stage tables that this process has written; results may read from them until ``drop_stages``.
written: list[str] = []


def drop_stages(spark: SparkSession) -> int:
    """Removes the stage tables written so far, once the results that read from them are written; gives their number. Without it they last until the shared folder is cleaned."""
    conf, n = spark._jsc.hadoopConfiguration(), len(written)
    while written:
        path = spark._jvm.org.apache.hadoop.fs.Path(written.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def checkpointed(df: DataFrame) -> DataFrame:
    """Written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame, name: str) -> DataFrame:
    """The same as a table, whose size the planner knows: it broadcasts a small one and shuffles to a large one."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    written.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_all(frames: Iterable[DataFrame], spark: SparkSession, schema: str, name: str) -> DataFrame:
    """Frames of one schema, each made and written before the next is asked for, as one table."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written.append(path)
    found = False
    for df in frames:
        df.write.mode("append").parquet(path)
        found = True
    return spark.read.schema(schema).parquet(path) if found else spark.createDataFrame([], schema)


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder; one is made only where the session names none (local mode)."""
    if not spark.sparkContext.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="quillon-"))
    return spark.sparkContext.getCheckpointDir()
