"""Session helpers of the pipeline operators."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors see; a temporary one only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = f"file://{tempfile.gettempdir()}/evalbench-shared"
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found.rstrip("/")


_folders: set[str] = set()


def own_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one; it goes when the application ends."""
    folder = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        _folders.add(folder)
    return folder


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = f"{own_dir(spark)}/stash/{re.sub('[^a-z0-9]+', '-', name)}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables of fewer splits are small: at the usual split size they hold a gigabyte at most.
FEW_SPLITS = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one whose files are fewer pieces than the cores is dealt out, as a scan never splits a row group."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(min(cores, 64)) if df.rdd.getNumPartitions() < min(FEW_SPLITS, cores) else df


def crc_part(spark_column: Column, parts: int) -> Column:
    """crc32 of an id written as text, modulo ``parts``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(spark_column.cast("string"), F.lit("")).cast("binary")) % F.lit(parts)


def release() -> None:
    """Give memory that large arrays have left behind back to the system; workers live on between tasks."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return
