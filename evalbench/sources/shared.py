"""The folder that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where it is unset and everything runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.gettempdir()}/evalbench-shared"
    return found.rstrip("/")


_folders: set[str] = set()


def fresh(spark: SparkSession, name: str) -> str:
    """A new path in this application's folder, which goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders.add(folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def rewritten(df: DataFrame, name: str = "rows", codec: str = "snappy") -> DataFrame:
    """Written and read again: short lineage that outlives lost executors."""
    path = fresh(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of fewer splits are small: at the usual split size they hold a gigabyte at most.
FEW_SPLITS = 8


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt over the cores if its files are fewer pieces than these; a scan never splits a row group."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 64)) if df.rdd.getNumPartitions() < min(FEW_SPLITS, cores) else df
