"""Writers: Parquet, CSV, JSON lines by content hash, and export manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("compression", "zstd").parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """Header, decimals as plain text; one file, for report tables."""
    plain = df.select(*[F.col(f.name).cast("string").alias(f.name) if "decimal" in f.dataType.simpleString() else F.col(f.name) for f in df.schema.fields])
    plain.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def snapshot_name(df: DataFrame) -> str:
    """Content hash of a table that does not depend on the order of its rows: a sum of row hashes, and their number."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    total, n = df.agg(F.sum(F.xxhash64(row).cast("decimal(38,0)")), F.count(F.lit(1))).first()
    return f"{(int(total or 0)) & (2**128 - 1):032x}-{n}"


def immutable_json(df: DataFrame, base: str) -> str:
    """JSON lines under the content's name; writing the same content again is a no-op."""
    path = f"{base.rstrip('/')}/snapshot={snapshot_name(df)}"
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).exists(target):
        df.write.mode("overwrite").json(path)
    return path


def manifest(spark: SparkSession, base: str) -> DataFrame:
    """path, bytes and SHA-256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
